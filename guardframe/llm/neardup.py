"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Documents with equal shingle sets are merged first. The rest walk down
independent trees: a node selects a few coordinates by hashing its own path,
and a document goes to one child for each of them, named by its minwise token
there, so documents meet the oftener the more alike they are. Nodes that are
small enough are compared exhaustively; larger ones branch again. Signatures
only propose pairs: a link is confirmed on the two full sets. In nodes that are
too large to be compared every document first proposes one pivot, so a group of
thousands of near copies grows together in linear work before anything
branches. Two passes over the trees then propose one pair a document and node;
the last pass compares every pair that still lies across components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import materialise, released, slices
from guardframe.llm.components import connected_components
from guardframe.llm.hashing import spaced, word_hashes

#: Independent trees, and coordinates that a node selects.
TREES, BRANCH = 2, 3
#: Single documents of a node that is compared exhaustively (beyond, pairs across components
#: count), documents that any such node may have, and levels after which larger nodes are
#: compared block against block instead of branching.
LEAF, MOST, DEPTH = 5000, 40_000, 4
#: Partners that one copy of a hub's set is held against.
PART = 200
#: Pivots that the documents of large nodes are held against, one after the other.
TURNS = 3
#: Parts in which the partners of a hub are joined with their number.
SALTS = 64
#: Minwise values in a signature, 16 bits each.
COORDINATES = 64
#: Ids that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_IDS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _keys() -> np.ndarray:
    """A random odd factor for each minwise coordinate, those of the roots first."""
    return (_mix(np.arange(1, TREES * BRANCH + COORDINATES + 1, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words."""
    out = np.full(words.size - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _GOLD + words[k : k + out.size])
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words; of fewer
    words the whole sequence is the one shingle."""
    words, begins = word_hashes(texts, spaced())
    rolled = _rolled(words, size) if words.size >= size else words[:0]
    for first, last in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        n = last - first
        if n < size:
            yield _rolled(words[first:last], n) if n else words[:0]
            continue
        out = np.sort(rolled[first : last - size + 1])
        yield out[np.append(True, out[1:] != out[:-1])]


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's 32-bit hash over a set."""
    keys, own = _keys(), shingles.astype(np.uint32)
    least = np.full(keys.size, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, own.size, 1024):
        np.minimum(least, (own[at : at + 1024, None] * keys).min(axis=0), out=least)
    return least


def _children(nodes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """A (documents x BRANCH) array: the children that each document goes to from its node."""
    out = np.empty((nodes.size, BRANCH), dtype=np.uint64)
    for j in range(BRANCH):
        chosen = _mix(nodes + np.uint64(j + 1) * _GOLD)
        coordinate = (chosen % np.uint64(COORDINATES)).astype(np.int64)
        value = signatures[np.arange(nodes.size), coordinate].astype(np.uint64)
        out[:, j] = _mix(chosen ^ _mix(value + np.uint64(1)))
    return out


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _binaries(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(``id``, ``n``, ``digest``, ``signature``, ``roots``) per row; the last three null for an empty set."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("roots", T.BinaryType())])
    first = TREES * BRANCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, digests, signatures, roots = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), size):
                n.append(shingles.size)
                if not shingles.size:
                    for part in (digests, signatures, roots):
                        part.append(None)
                    continue
                least = minwise(shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                signatures.append(least[first:].astype(np.uint16).tobytes())
                roots.append(_mix(_mix(least[:first].astype(np.uint64)) + np.arange(1, first + 1, dtype=np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, signatures, roots))], names=schema.names)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(released(run), schema)


_PLACE = "node long, id long, n long, signature binary, component long"
_KEPT = ("id", "n", "signature", "component")


def _places(reps: DataFrame) -> DataFrame:
    """Every document's places below the roots of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                roots = np.frombuffer(b"".join(batch.column("roots").to_pylist()), dtype=np.uint64)
                many = pa.array(np.repeat(np.arange(batch.num_rows), TREES * BRANCH))
                yield pa.RecordBatch.from_arrays([_long(roots), *(batch.column(c).take(many) for c in _KEPT)], names=["node", *_KEPT])

    return reps.select(*_KEPT, "roots").mapInArrow(released(run), _PLACE)


def _branched(places: DataFrame) -> DataFrame:
    """The same documents one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = np.asarray(batch.column("node")).view(np.uint64)
                down = _children(nodes, _signatures(batch.column("signature")))
                many = pa.array(np.repeat(np.arange(batch.num_rows), BRANCH))
                yield pa.RecordBatch.from_arrays([_long(down.ravel()), *(batch.column(c).take(many) for c in _KEPT)], names=["node", *_KEPT])

    return places.mapInArrow(released(run), _PLACE)


def _blocks(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """Large nodes at the last level, as pairs of blocks of at most about half a leaf each.

    Every two documents of a node meet in one of the pairs, so none is lost.
    """
    n = F.ceil(F.col("documents") * 2 / LEAF).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit(17)), n)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return places.join(sizes, "node").withColumn("own", own).withColumn("other", other).select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), *_KEPT)


def _sizes(places: DataFrame) -> DataFrame:
    """Per node its documents and its pairs across components, from partial sums: a node
    with most of the documents costs each task a row per component."""
    parts = places.groupBy("node", "component").count()
    total = parts.groupBy("node").agg(F.sum("count").alias("documents"), F.sum(F.col("count") * F.col("count")).alias("__same"))
    return total.select("node", "documents", ((F.col("documents") * F.col("documents") - F.col("__same")) / 2).alias("pairs"))


def leaves(reps: DataFrame) -> DataFrame:
    """Places (``node``, ``id``, ...) where documents of different components are to be compared.

    A node is compared if it has at most as many such pairs as a leaf of single
    documents, and is dropped if it is all one component: there is nothing left
    to find. Only larger nodes are joined back and branched.
    """
    places, out = _places(reps), None
    for depth in range(1, DEPTH + 1):
        sizes = _sizes(places)
        large = materialise(sizes.where((F.col("pairs") > LEAF * LEAF / 2) | (F.col("pairs") > 0) & (F.col("documents") > MOST)), "large")
        small = places.join(large.select("node"), "node", "left_anti")
        out = small if out is None else out.unionByName(small)
        if not large.limit(1).count():
            return out
        if depth < DEPTH:
            places = materialise(_branched(places.join(large.select("node"), "node", "left_semi")), "places")
    return out.unionByName(_blocks(places, large))


def _crowd(places: DataFrame) -> DataFrame | None:
    """The places in nodes below the roots that would have to branch, None if there is none."""
    large = materialise(places.groupBy("node").count().where(F.col("count") > LEAF).select("node"), "crowded")
    return materialise(places.join(large, "node", "left_semi"), "crowd") if large.limit(1).count() else None


def _near_pivots(crowd: DataFrame, turn: int, percent: int) -> DataFrame | None:
    """Pairs (``hub``, ``id``) to be confirmed: in each node with too many pairs across components
    a document proposes the node's pivot, a document chosen by hash. None if there is no such node.

    Every document gives a row a node at most, however many are alike.
    """
    by = F.xxhash64("id", F.lit(turn))
    if turn:  # before, every document is a component of its own
        large = materialise(_sizes(crowd).where(F.col("pairs") > LEAF * LEAF / 2).select("node"), "crowded")
        if not large.limit(1).count():
            return None
        crowd = crowd.join(large, "node", "left_semi")
    least = crowd.groupBy("node").agg(F.min(by).alias("least"))
    pivots = crowd.join(least, "node").where(by == F.col("least")).select("node", *(F.col(c).alias(f"pivot_{c}") for c in _KEPT))
    held = crowd.join(pivots, "node").where((F.col("component") != F.col("pivot_component")) & (F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = np.count_nonzero(_signatures(batch.column("signature")) == _signatures(batch.column("pivot_signature")), axis=1)
                near = pa.array(equal >= _least_equal(percent))
                yield pa.RecordBatch.from_arrays([batch.column("pivot_id").filter(near), batch.column("id").filter(near)], names=["hub", "id"])

    return held.select("pivot_id", "id", "signature", "pivot_signature").mapInArrow(released(run), "hub long, id long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        differs = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        last = int(differs[-1]) + 1 if differs.size else 0
        now = tuple(int(c[-1]) for c in columns)
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        elif held and before != now:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(last))
        before = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of two or more equal values."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(np.append(True, new))
    last = np.append(first[1:], keys[0].size)
    several = last - first > 1
    yield from zip(first[several].tolist(), last[several].tolist(), strict=True)


def _least_equal(percent: int) -> float:
    """Equal values of two signatures, four standard deviations below what the threshold gives."""
    share = percent / 100
    return COORDINATES * (share - 4 * (share * (1 - share) / COORDINATES) ** 0.5)


def _alike(signatures: np.ndarray, n: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For documents sorted by set size: each one, the later ones of other components that
    may reach the similarity, and how many values of the signatures are equal.

    That number lies at most four standard deviations below what the threshold
    gives; set sizes must allow the similarity.
    """
    least = _least_equal(percent)
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(n.size - 1):
        stop = int(ends[i])
        if stop > i + 1:
            equal = np.count_nonzero(signatures[i + 1 : stop] == signatures[i], axis=1)
            found = np.flatnonzero((equal >= least) & (component[i + 1 : stop] != component[i]))
            if found.size:
                yield i, found + i + 1, equal[found]


def _nodes(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each node that isn't all one component: where its rows begin and, by set size, their
    order, ids, sizes, components and signatures."""
    nodes, ids, n, component = (np.asarray(group[c]) for c in ("node", "id", "n", "component"))
    for first, last in _runs(nodes):
        part = slice(first, last)
        if (component[part] != component[first]).any():
            order = np.lexsort((ids[part], n[part]))
            yield first, order, ids[part][order], n[part][order], component[part][order], _signatures(group["signature"].slice(first, last - first))[order]


def _proposed(places: DataFrame, percent: int) -> DataFrame:
    """Pairs (``hub``, ``id``) to be confirmed: a document proposes the node's least id if
    that may be alike, else the one most alike."""

    def of_node(ids: np.ndarray, n: np.ndarray, component: np.ndarray, signatures: np.ndarray) -> Iterator[tuple[int, int]]:
        pivot = int(np.argmin(ids))
        best, most = np.full(ids.size, -1), np.zeros(ids.size, dtype=np.int64)
        for i, partners, equal in _alike(signatures, n, component, percent):
            strength = equal + np.where((partners == pivot) | (i == pivot), COORDINATES, 0)
            k = int(np.argmax(strength))
            if strength[k] > most[i]:
                best[i], most[i] = partners[k], strength[k]
            better = strength > most[partners]
            best[partners[better]], most[partners[better]] = i, strength[better]
        for i in np.flatnonzero(best >= 0).tolist():
            yield int(ids[best[i]]), int(ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            found = [pair for _, _, *node in _nodes(group) for pair in of_node(*node)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["hub", "id"])

    return places.repartition("node").sortWithinPartitions("node").mapInArrow(released(run), "hub long, id long").distinct()


def _open(places: DataFrame, percent: int) -> DataFrame:
    """The places whose document may still be alike to one of another component in the node,
    in nodes of at most a leaf; larger ones come as pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            taken = np.zeros(group.num_rows, dtype=bool)
            for first, order, _, *node in _nodes(group):
                n, component, signatures = node
                for i, partners, _ in _alike(signatures, n, component, percent):
                    taken[first + order[i]] = True
                    taken[first + order[partners]] = True
            if taken.any():
                yield from group.filter(pa.array(taken)).to_batches()

    found = materialise(places.repartition("node").sortWithinPartitions("node").mapInArrow(released(run), _PLACE), "open")
    large = found.groupBy("node").agg(F.count("*").alias("documents")).where(F.col("documents") > LEAF)
    return found.join(large.select("node"), "node", "left_anti").unionByName(_blocks(found, large))


def _exhausted(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) from comparing all pairs across components in each node.

    A document's full set is held against those of all its possible partners at
    once; partners that are joined to it by then are left out.
    """

    def of_node(order: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        above = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for i, partners, _ in _alike(signatures, n, component, percent):
            own = root(int(component[i]))
            partners = [j for j in partners.tolist() if root(int(component[j])) != own]
            if not partners:
                continue
            hub, theirs = sets[order[i]], [sets[order[j]] for j in partners]
            joined, sizes = np.concatenate(theirs), np.array([x.size for x in theirs])
            at = np.minimum(np.searchsorted(hub, joined), hub.size - 1)
            shared = np.add.reduceat((hub[at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
            for k in np.flatnonzero(100 * shared >= percent * (hub.size + sizes - shared)).tolist():
                other = root(int(component[partners[k]]))
                if other != root(own):
                    above[other] = root(own)
                    yield int(ids[i]), int(ids[partners[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "node"):
            links = []
            for first, order, *node in _nodes(group):
                own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["shingles"].slice(first, order.size).combine_chunks()]
                links += of_node(order, *node, own)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return places.join(sets, "id").repartition("node").sortWithinPartitions("node").mapInArrow(released(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) among the pairs, from the full sets (``id``, ``shingles``).

    A hub's partners are dealt into parts of bounded size, each with a copy of
    the hub's set, so a set is shuffled about once for each hub it is held against.
    Only hubs of several parts are joined back, by (hub, a hash of the partner) if
    they are many, so no task gets all partners of one.
    """
    hot = materialise(pairs.groupBy("hub").count().where(F.col("count") > PART), "hubs")
    salt = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS))
    if hot.count() <= BROADCAST_IDS:
        counted = pairs.join(F.broadcast(hot), "hub", "left")
    else:
        counted = pairs.withColumn("salt", salt).join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hub", "salt"], "left")
    dealt = counted.select("hub", F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("count", F.lit(1)) / PART)).cast("long").alias("part"), "id")
    members = dealt.unionAll(dealt.select("hub", "part", F.col("hub").alias("id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "hub", "part"):
            hubs, ids = np.asarray(group["hub"]), np.asarray(group["id"])
            links = []
            for first, last in _runs(hubs, np.asarray(group["part"])):
                found = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["shingles"].slice(first, last - first).combine_chunks()]
                own = [x for x, i in zip(found, ids[first:last].tolist(), strict=True) if i == hubs[first]]
                for x, i in zip(found, ids[first:last].tolist(), strict=True):
                    if i != hubs[first]:
                        for hub in own:
                            shared = np.intersect1d(hub, x, assume_unique=True).size
                            if 100 * shared >= percent * (hub.size + x.size - shared):
                                links.append((int(hubs[first]), i))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return members.join(sets, "id").repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(released(run), "a long, b long")


def _sets(docs: DataFrame, some: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(``id``, ``shingles``) of the documents with the given ids, and of no others."""
    ids = materialise(some.select("id").distinct(), "ids").withColumnRenamed("id", key)
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.where(F.col(key).isNotNull()).join(F.broadcast(ids) if few else ids, key, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binaries(list(shingle_sets(batch.column("text"), size)))], names=["id", "shingles"])

    return wanted.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(released(run), "id long, shingles binary")


def _labelled(reps: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``reps`` with the component that each belongs to so far."""
    if roots is None:
        return reps.withColumn("component", F.col("id"))
    joined = reps.drop("component").join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("root", "id")).drop("root")
    return materialise(joined, "labelled")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: key (long), ``n_shingles`` and ``component_id``, the least
    id that links reach from the row (its own without links).

    Links are pairs with 100 * intersection >= percent * union of their sets of
    distinct ``size``-word shingles (lower-cased A-Z, words between white space).
    A text without words has no set and no links. Rows with the same id are one
    document; a row without an id has no component. Empty tables give no rows;
    other columns are not read.

    Shuffled: a signature for each distinct set, then per place in a tree
    (6 on the first level) 160 bytes, then the full sets of only those documents
    that have a possible partner. Nothing larger than a count reaches the driver.
    """
    seen = materialise(sketches(docs, key, text, size), "sketches")
    reps = materialise(
        seen.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("roots").alias("roots")),
        "representatives",
    )
    roots, links, alive = None, None, reps
    crowd = _crowd(_places(_labelled(reps, None)))
    for turn in range(TURNS if crowd is not None else 0):
        pairs = _near_pivots(crowd, turn, percent)
        if pairs is None:
            break
        pairs = materialise(pairs, "pairs")
        if not pairs.limit(1).count():
            break  # no document of a crowded node is like the pivot of another component
        some = pairs.select(F.col("hub").alias("id")).unionAll(pairs.select("id")).distinct()
        found = materialise(_confirmed(pairs, _sets(docs, some, key, text, size), percent), "links")
        links = found if links is None else links.unionAll(found)
        roots = connected_components(links, 2)  # pivots and what is like them are stars
        crowd = _labelled(crowd, roots)
    for _ in range(2):
        pairs = materialise(_proposed(leaves(_labelled(alive, roots)), percent), "pairs")
        some = pairs.select(F.col("hub").alias("id")).unionAll(pairs.select("id")).distinct()
        found = materialise(_confirmed(pairs, _sets(docs, some, key, text, size), percent), "links")
        links = found if links is None else links.unionAll(found)
        roots = connected_components(links, 1)  # only saves the next pass work
        if alive is reps:  # later passes are about documents that have a possible partner at all
            alive = materialise(reps.join(some, "id", "left_semi"), "alive")
    places = materialise(_open(leaves(_labelled(alive, roots)), percent), "unlinked")
    found = materialise(_exhausted(places, _sets(docs, places, key, text, size), percent), "links")
    roots = connected_components(links.unionAll(found))
    same = reps.select("digest", F.col("id").alias("rep")).join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = seen.select("id", "n", "digest").join(same, "digest", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
