"""Language-model scoring: a hashed maximum-entropy model.

Words are the leaves of a tree of classes with ``FAN`` branches, built from
their counts (Huffman), and the probability of a token is the product of the
softmaxes over the branches on its way. Each softmax sums, over three context
features, a row of weights found by hash of feature and class: the word before,
the two words before, and the word before that alone (a skip). Words beyond the
held vocabulary share one leaf, within which they keep their smoothed share of
the corpus; as context every word counts as itself.

Words are known by 64-bit hashes, which are worked out for whole batches of
text at once, so each pass reads the texts anew and nothing the size of the
corpus is written. Training runs over all training documents: each task updates
its own copy of the weights, and the changes to a row are averaged over the
tasks that met it, by how often they did.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import fold, materialise, released, slices
from guardframe.llm.hashing import GOLD, mixed, spaced, word_hashes

#: Words whose counts every task holds, each a leaf of its own; counts of the others are joined.
HELD = 1 << 18
#: Branches of a class, floats in a row of weights, and bits of the number of rows, at least.
FAN, WIDE, LEAST_BITS = 14, 16, 12
#: Held words for each row of weights.
SHARED = 2
#: Sums of distinct words that a task holds before it passes them on.
COUNTED = 1_000_000
ROUNDS, RATE, BATCH_TOKENS = 1, 0.3, 2048
#: Times a row occurs in a batch up to which its gradients are added one by one.
FEW = 4
#: Rows of weights in a block of the averaging, and parts in which each block is summed first.
BLOCK, PARTS = 1 << 12, 16
SMOOTH = 0.1
#: Hash of the end of a text (the empty word).
END = np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(32)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words after lower-casing A-Z, each text's followed by the end's,
    and where each text begins among them (the number of tokens last). Null texts are empty."""
    words, first = word_hashes(column, spaced())
    begins = first + np.arange(first.size)
    tokens = np.full(words.size + len(column), END, dtype=np.uint64)
    inside = np.ones(tokens.size, dtype=bool)
    inside[begins[1:] - 1] = False
    tokens[inside] = words
    return tokens, begins


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _tallied(parts: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(parts), np.concatenate(times)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n[order], first) if first.size else n[:0]


def _counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and how often each occurs."""
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if hashes.size else np.zeros(0, dtype=np.int64)
    return hashes[first], np.diff(np.append(first, hashes.size))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``word``, ``n``): how often the token with each hash occurs in ``docs``.

    Summed within each task first, so a frequent word costs a task a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held, least = [], [], 0, COUNTED
        for batch in slices(batches, "text"):
            own, n = _counts(token_hashes(batch.column("text"))[0])
            keys.append(own)
            times.append(n)
            held += own.size
            if held > least:
                merged, sums = _tallied(keys, times)
                keys, times, held = [merged], [sums], merged.size
                least = max(COUNTED, 2 * held)
                if held > COUNTED:
                    yield pa.RecordBatch.from_arrays([_signed(merged), pa.array(sums)], names=["word", "n"])
                    keys, times, held, least = [], [], 0, COUNTED
        if keys:
            merged, sums = _tallied(keys, times)
            yield pa.RecordBatch.from_arrays([_signed(merged), pa.array(sums)], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words that every task knows, the tree over them, and the corpus totals."""

    def __init__(self, held: np.ndarray, n: np.ndarray, tokens: int, distinct: int):
        """``held``: hashes of the held words, the most frequent first, and their counts."""
        self.tokens, self.distinct = tokens, distinct
        self.total = tokens + SMOOTH * (distinct + 1)
        mass = n + SMOOTH
        self.rare = self.total - float(mass.sum())
        self.log_table = np.log10(mass)
        self.words = held.size  # number of the leaf of all other words
        order = np.argsort(held)
        self.keys = np.append(held[order], np.uint64(0))
        self.place = np.append(order, self.words).astype(np.int32)
        self.shift = np.uint64(64 - max(1, int(held.size).bit_length() + 1))
        self.first = np.searchsorted(self.keys[:-1], np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)[:-1] << self.shift).astype(np.int32)
        self.bits = max(LEAST_BITS, (held.size // SHARED).bit_length())
        self._grow(np.append(mass, max(self.rare, 1e-12)))

    def _grow(self, mass: np.ndarray) -> None:
        """The tree: of each leaf the classes on its way and the branch taken in each, and of
        each class the log masses of its branches."""
        n, fan = mass.size, FAN
        classes = max(1, -(-(n - 1) // (fan - 1)))
        weight = np.concatenate([mass, np.zeros(classes)]).tolist()
        parent, branch = [-1] * len(weight), [0] * len(weight)
        prior = np.full((classes, WIDE), -np.inf, dtype=np.float32)
        leaves = iter(np.argsort(mass, kind="stable").tolist())
        leaf, inner = next(leaves), n
        take = (n - 2) % (fan - 1) + 2 if n > 1 else 1  # the first class has what is over, so that all others are full
        for made in range(classes):
            own, total = [], 0.0
            for _ in range(take):
                if leaf is not None and (inner == n + made or weight[leaf] <= weight[inner]):
                    least, leaf = leaf, next(leaves, None)
                else:
                    least, inner = inner, inner + 1
                parent[least], branch[least] = made, len(own)
                own.append(weight[least])
                total += weight[least]
            weight[n + made] = total
            prior[made, : len(own)] = np.log(np.array(own) / total)
            take = fan
        self.prior = prior
        up, side, at, way = np.array(parent), np.array(branch), np.arange(n), []
        while (at >= 0).any():
            node = np.where(at >= 0, up[at], -1)
            way.append((node, np.where(node >= 0, side[at], 0)))
            at = np.where(node >= 0, node + n, -1)
        nodes = np.stack([w[0] for w in way], axis=1)
        known = nodes >= 0
        self.length = known.sum(axis=1).astype(np.int32)
        self.begin = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.way = (nodes[known] * WIDE + np.stack([w[1] for w in way], axis=1)[known]).astype(np.int32)
        self.node_hash = (mixed(np.arange(1, classes + 1, dtype=np.uint64) * GOLD) >> _HIGH).astype(np.uint32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's leaf; that of all other words is the last."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        out = np.full(hashes.size, self.words, dtype=np.int32)
        left = np.arange(hashes.size)
        while left.size:
            found = self.keys[at]
            same = found == hashes[left]
            out[left[same]] = self.place[at[same]]
            go = found < hashes[left]
            go &= at < self.words
            left, at = left[go], at[go] + 1
        return out


def features(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token the hashes of its context: the word before, both before, and the skip."""
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    first = begins[:-1]
    one[first], two[first] = END, END  # the end of a text stands for what is before one
    second = first[np.diff(begins) > 1] + 1
    two[second] = END
    pair = mixed(one) ^ two
    pair *= GOLD
    return (one >> _HIGH).astype(np.uint32), (pair >> _HIGH).astype(np.uint32), (mixed(two) >> _HIGH).astype(np.uint32)


class Model:
    """Rows of weights, one for each hash of a feature and a class.

    A row's last two columns hold the sum of its squared gradients and how many
    tokens it was trained on, so that all of a row lies in one cache line.
    """

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        self.v = vocabulary
        self.weights = np.zeros((1 << vocabulary.bits, WIDE), dtype=np.float32) if weights is None else weights

    def _predict(self, leaves: np.ndarray, context: tuple[np.ndarray, ...]):
        """All classes on the tokens' ways: the token's index, where the branch taken lies, by feature
        the numbers of the rows and the rows, exp of all branches' scores, and their sums."""
        v = self.v
        length = v.length[leaves]
        ends = np.cumsum(length, dtype=np.int32)
        who = np.repeat(np.arange(leaves.size, dtype=np.int32), length)
        way = v.way[np.arange(who.size, dtype=np.int32) + np.repeat(v.begin[leaves] - (ends - length), length)]
        node = way >> np.int32(4)
        taken = (way & np.int32(WIDE - 1)) + np.arange(0, way.size * WIDE, WIDE, dtype=np.int32)
        own, shift = v.node_hash[node], np.uint32(32 - v.bits)
        z, rows, held = v.prior.take(node, axis=0), [], []
        for one in context:
            row = one[who]
            row ^= own
            row *= np.uint32(0x9E3779B1)
            row ^= row >> np.uint32(15)
            row *= np.uint32(0x85EBCA77)
            row >>= shift
            rows.append(row.view(np.int32))
            held.append(self.weights.take(rows[-1], axis=0))
            z += held[-1]
        np.exp(z, out=z)
        return who, taken, rows, held, z, z @ np.ones(WIDE, dtype=np.float32)

    def log10(self, leaves: np.ndarray, context: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of each token, the leaf it comes to."""
        who, taken, _, _, z, total = self._predict(leaves, context)
        return np.bincount(who, weights=np.log10(np.maximum(z.ravel()[taken], np.float32(1e-30)) / total), minlength=leaves.size)

    def update(self, leaves: np.ndarray, context: tuple[np.ndarray, ...]) -> None:
        """One gradient step on a batch, a row's step being scaled by all its gradients so far."""
        _, taken, rows, held, g, total = self._predict(leaves, context)
        g *= (np.float32(1) / total)[:, None]
        g.ravel()[taken] -= np.float32(1)
        places = np.arange(len(g), dtype=np.uint64)
        for row, before in zip(rows, held, strict=True):
            keys = row.astype(np.uint64)
            keys <<= np.uint64(32)
            keys |= places
            keys.sort()
            order, row = keys.astype(np.uint32).view(np.int32), (keys >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            times = np.diff(np.append(first, row.size))
            change = g.take(order[first], axis=0)
            for k in range(1, FEW):
                more = np.flatnonzero((times > k) & (times <= FEW))
                change[more] += g.take(order[first[more] + k], axis=0)
            many = times > FEW
            if many.any():
                change[many] = np.add.reduceat(g.take(order[np.repeat(many, times)], axis=0), np.cumsum(times[many]) - times[many], axis=0)
            new = before.take(order[first], axis=0)
            squares = new[:, FAN] + np.einsum("ij,ij->i", change, change)
            change *= (np.float32(-RATE) / np.sqrt(squares + np.float32(1e-2)))[:, None]
            new += change
            new[:, FAN] = squares
            new[:, FAN + 1] += times
            self.weights[row[first]] = new


def _summed(parts: DataFrame, key: str) -> DataFrame:
    """Sums of float32 vectors (``data``) by key, one running sum at a time, in the order of ``source``."""
    schema = f"{key} long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=[key, "data"])

        now, total = None, None
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                one = np.frombuffer(data.as_buffer(), dtype=np.float32)
                if k.as_py() == now:
                    total += one
                    continue
                if now is not None:
                    yield out()
                now, total = k.as_py(), one.astype(np.float64)
        if now is not None:
            yield out()

    return parts.repartition(key).sortWithinPartitions(key, "source").select(key, "data").mapInArrow(released(run), schema)


def train(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """The weights after ``rounds`` passes over all of ``docs``.

    What a task passes on is of the model's size (fixed by the vocabulary's bound).
    The change of a row is the mean over the tasks that met it, weighted by their
    tokens; it is summed in two steps, so no task meets more than a sixteenth of
    the tasks' parts, and in a fixed order.
    """
    weights = Model(vocabulary).weights
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            model = Model(vocabulary, start.copy())
            for batch in slices(batches, "text"):
                tokens, begins = token_hashes(batch.column("text"))
                leaves, context = vocabulary.places(tokens), features(tokens, begins)
                for at in range(0, tokens.size, BATCH_TOKENS):
                    model.update(leaves[at : at + BATCH_TOKENS], tuple(x[at : at + BATCH_TOKENS] for x in context))
            change = model.weights - start
            if not change[:, FAN + 1].any():
                return
            change[:, :FAN] *= change[:, FAN + 1 :]
            source = TaskContext.get().partitionId()
            for at in range(0, len(change), BLOCK):
                block = at // BLOCK * PARTS + source % PARTS
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([source], pa.int64()), pa.array([change[at : at + BLOCK].tobytes()], pa.binary())], names=["part", "source", "data"])

        parts = _summed(docs.select(F.col(text).alias("text")).mapInArrow(released(run), "part long, source long, data binary"), "part")
        blocks = _summed(parts.select(F.floor(F.col("part") / PARTS).alias("block"), F.col("part").alias("source"), "data"), "block")
        found = sorted(blocks.collect(), key=lambda r: r["block"])
        if not found:
            break
        change = np.concatenate([np.frombuffer(bytes(r["data"]), dtype=np.float32) for r in found]).reshape(-1, WIDE).copy()
        change[:, :FAN] /= np.maximum(change[:, FAN + 1 :], 1)
        weights = weights + change
    return weights


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, from the numbers of words by ranges of counts.

    A range is divided until it is a single count, so the driver gets 1024 numbers at a time."""
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:
        width = -(-(high - low) // 1024)
        own = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.floor((F.col("n") - low) / width).alias("range")).agg(F.count("*").alias("words"))
        least = high
        for row in sorted(own.collect(), key=lambda r: -r["range"]):
            if above + row["words"] > most:
                break
            above, least = above + row["words"], low + row["range"] * width
        else:
            return low
        if width == 1:
            return least
        low, high = low + row["range"] * width, min(high, low + (row["range"] + 1) * width)
    return low


def learn(docs: DataFrame, text: str = "text", held: int = HELD) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts of all tokens, the vocabulary and the trained weights."""
    counts = materialise(token_counts(docs, text), "counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    found = counts.where(F.col("n") >= _least_count(counts, held)).toArrow()
    words, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.lexsort((words, -n))
    vocabulary = Vocabulary(words[order], n[order], total["tokens"] or 0, total["distinct"])
    return counts, vocabulary, train(docs, vocabulary, text)


#: Columns that a scored table has besides the documents' own.
_SCORED = "__lm_tokens long, __lm_held long, __lm_base double, __lm_model double, __lm_row long, __lm_words array<struct<word:long,times:long>>"
RESULTS = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``base_score`` (smoothed
    unigrams) and ``score`` (the model), both log10.

    A null text is empty and has one token, its end. Repeated rows each give a
    row. Columns of ``docs`` with the names of the results are replaced, all
    others pass through; names that begin with ``__lm_`` are reserved. Words
    outside the held vocabulary, each of which has at most a ``HELD``-th of all
    tokens, meet their counts in a join of (row, word, times); the sums return by
    row, so no text is shuffled.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text and c not in RESULTS), F.col(text).alias("__lm_text"))
    own = kept.columns[:-1]
    schema = type(kept.schema)([*kept.schema.fields[:-1], *docs.sparkSession.createDataFrame([], _SCORED).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = Model(vocabulary, weights), TaskContext.get().partitionId() << 40
        logs = np.append(vocabulary.log_table, 0.0)
        rare = math.log10(vocabulary.rare) if vocabulary.rare > 0 else 0.0
        for batch in slices(batches, "__lm_text"):
            if not batch.num_rows:
                continue
            tokens, begins = token_hashes(batch.column("__lm_text"))
            leaves, context, first = vocabulary.places(tokens), features(tokens, begins), begins[:-1]
            each = [model.log10(leaves[at : at + BATCH_TOKENS], tuple(x[at : at + BATCH_TOKENS] for x in context)) for at in range(0, tokens.size, BATCH_TOKENS)]
            other = leaves == vocabulary.words
            sums = [np.add.reduceat(x, first) for x in (logs[leaves], np.concatenate(each) - np.where(other, rare, 0.0))]
            at = np.flatnonzero(other)
            whose, words = np.searchsorted(begins, at, side="right") - 1, tokens[at]
            order = np.lexsort((words, whose))
            whose, words = whose[order], words[order]
            new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (whose[1:] != whose[:-1]))) if at.size else at
            pairs = pa.StructArray.from_arrays([_signed(words[new]), pa.array(np.diff(np.append(new, at.size)), pa.int64())], names=["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose[new], np.arange(batch.num_rows + 1)).astype(np.int32)), pairs)
            held = np.add.reduceat((~other).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(begins)), pa.array(held), *map(pa.array, sums), pa.array(np.arange(row, row + batch.num_rows)), lists], names=schema.names)
            row += batch.num_rows

    scored = materialise(kept.mapInArrow(released(run), schema), "scored")
    rare = scored.select("__lm_row", F.inline("__lm_words")).join(counts, "word")
    more = rare.groupBy("__lm_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + SMOOTH)).alias("__lm_more"), F.sum("times").alias("__lm_found"))
    unseen = (F.col("__lm_tokens") - F.col("__lm_held") - F.coalesce("__lm_found", F.lit(0))) * math.log10(SMOOTH)
    added = F.coalesce("__lm_more", F.lit(0.0)) + unseen
    return scored.drop("__lm_words").join(more, "__lm_row", "left").select(
        *(F.col(f"`{c}`") for c in own),
        F.col("__lm_tokens").alias("n_tokens"),
        (F.col("__lm_held") + F.coalesce("__lm_found", F.lit(0))).cast("long").alias("n_known"),
        (F.col("__lm_base") + added - F.col("__lm_tokens") * math.log10(vocabulary.total)).alias("base_score"),
        (F.col("__lm_model") + added).alias("score"),
    )


def held_out_fold(key: str = "doc_id") -> Column:
    """Column: whether a document is kept from learning."""
    return F.coalesce(fold(key, 10) == 0, F.lit(False))
