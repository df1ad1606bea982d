"""Approximate nearest neighbours: a navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash. Each shard becomes one row that
holds its vectors and the graph's levels as flat neighbour arrays, so an index
is a table that any executor can read again. Queries go through all shards in
blocks of bounded size, and each shard's best are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardframe.llm.common import materialise, released

#: Distinct vectors in a shard, links of a vector (twice as many on the lowest level), and
#: how many vectors a search keeps while it builds and while it answers.
SHARD, LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16_384, 12, 64, 320
#: Queries in a block: what is sent to every task at once.
QUERY_BLOCK = 20_000


class Graph:
    """A hierarchical navigable small world over unit vectors, in flat arrays.

    ``near[level]`` has a row of neighbours for each vector, -1 where there is none.
    """

    def __init__(self, unit: np.ndarray, near: list[np.ndarray] | None = None, entry: int = 0):
        self.unit, self.entry = np.ascontiguousarray(unit, dtype=np.float32), entry
        self.near = near if near is not None else []
        self.stamp, self.turn = np.zeros(len(unit), dtype=np.int64), 0

    def _nearest(self, query: np.ndarray, starts: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` most similar vectors found on a level, most similar first."""
        near, unit, stamp = self.near[level], self.unit, self.stamp
        self.turn += 1
        turn = self.turn
        for _, i in starts:
            stamp[i] = turn
        todo, best = [(-s, i) for s, i in starts], list(starts)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= width:
                break
            row = near[i]
            row = row[row >= 0]
            row = row[stamp[row] != turn]
            if not row.size:
                continue
            stamp[row] = turn
            for t, j in zip((unit[row] @ query).tolist(), row.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(todo, (-t, j))
        return sorted(best, reverse=True)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, most similar first, those that are nearer to the vector than to one taken before."""
        ids = np.array([i for _, i in found])
        if ids.size <= most:
            return ids.tolist()
        among = self.unit[ids] @ self.unit[ids].T
        taken: list[int] = []
        closest = np.full(ids.size, -2.0, dtype=np.float32)
        for k, (s, _) in enumerate(found):
            if s >= closest[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                closest = np.maximum(closest, among[k])
        if len(taken) < most:
            rest = [k for k in range(ids.size) if k not in set(taken)]
            taken += rest[: most - len(taken)]
        return ids[taken].tolist()

    def build(self, seed: int = 1) -> Graph:
        n = len(self.unit)
        levels = np.minimum(6, (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(LINKS)).astype(int))
        top = int(levels.max(initial=0))
        self.near = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(top + 1)]
        if n:
            self.entry = 0
        highest = int(levels[0]) if n else 0
        for i in range(1, n):
            query = self.unit[i]
            found = [(float(self.unit[self.entry] @ query), self.entry)]
            for level in range(highest, int(levels[i]), -1):
                found = self._nearest(query, found[:1], 1, level)
            for level in range(min(highest, int(levels[i])), -1, -1):
                found = self._nearest(query, found, BUILD_WIDTH, level)
                near = self.near[level]
                chosen = self._diverse(found, LINKS)
                near[i, : len(chosen)] = chosen
                for j in chosen:
                    row = near[j]
                    if row[-1] < 0:
                        row[int(np.argmax(row < 0))] = i
                        continue
                    ids = np.append(row, i)
                    similar = (self.unit[ids] @ self.unit[j]).tolist()
                    kept = self._diverse(sorted(zip(similar, ids.tolist(), strict=True), reverse=True), row.size)
                    row[: len(kept)] = kept
                    row[len(kept) :] = -1
            if levels[i] > highest:
                highest, self.entry = int(levels[i]), i
        return self

    def search(self, query: np.ndarray, width: int) -> list[int]:
        if not len(self.unit):
            return []
        found = [(float(self.unit[self.entry] @ query), self.entry)]
        for level in range(len(self.near) - 1, 0, -1):
            found = self._nearest(query, found[:1], 1, level)
        return [i for _, i in self._nearest(query, found, width, 0)]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(``id``, ``v``) of the vectors that aren't null, empty or zero and have only finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col(key).cast("long").alias("id"), (F.col(vector) if single else F.col(vector).cast("array<double>")).alias("v"))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


_INDEX = "shard long, width int, bytes int, ids binary, owners binary, vectors binary, near binary, levels int, entry int"


def build_index(vectors: DataFrame, neighbours: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per shard: its vectors and its graph's flat neighbour arrays.

    Of equal vectors only the ``neighbours + 1`` least ids are kept, since no
    other can be among a query's nearest; tasks cut each such group before it is
    shuffled, so a vector with a third of all rows costs a few rows a task. An id
    with several vectors is a candidate with each. Vectors keep their precision.
    """
    order = Window.partitionBy("v").orderBy("id")
    own = usable(vectors, key, vector).distinct()
    kind = np.float32 if own.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    few = own.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= neighbours + 1)
    sets = materialise(few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    shards = max(1, -(-sets.count() // SHARD))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort([x[0] for x in group["ids"]], kind="stable")]
        rows = np.array(group["v"].tolist(), dtype=kind)
        graph = Graph(_unit(rows)).build()
        ids = [np.asarray(x, dtype=np.int64) for x in group["ids"]]
        owners = np.repeat(np.arange(len(ids)), [len(x) for x in ids]).astype(np.int32)
        return pd.DataFrame({"shard": [key[0]], "width": [rows.shape[1]], "bytes": [rows.itemsize], "ids": [np.concatenate(ids).tobytes()], "owners": [owners.tobytes()], "vectors": [rows.tobytes()], "near": [b"".join(n.tobytes() for n in graph.near)], "levels": [len(graph.near)], "entry": [graph.entry]})

    placed = sets.select("v", "ids", F.size("v").alias("width"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("long").alias("shard"))
    return materialise(placed.groupBy("shard", "width").applyInPandas(build, _INDEX), "graphs")


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    ids, owners = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["owners"], dtype=np.int32)
    rows = np.frombuffer(row["vectors"], dtype=f"f{row['bytes']}").reshape(-1, row["width"])
    flat, near, at = np.frombuffer(row["near"], dtype=np.int32), [], 0
    for level in range(row["levels"]):
        links = LINKS * (2 if level == 0 else 1)
        near.append(flat[at : at + len(rows) * links].reshape(len(rows), links))
        at += len(rows) * links
    return ids, owners, rows, Graph(_unit(rows), near, row["entry"])


def search(index: DataFrame, queries: DataFrame, neighbours: int = 5, width: int = SEARCH_WIDTH, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): each query's nearest by cosine in
    double precision, ties to the smaller id, the query's own id left out.

    Queries of another length than a shard's vectors don't meet them. Vectors
    that are null, zero or hold null or non-finite components take no part, as
    queries or as candidates; a query with fewer candidates has fewer rows. Of
    an id that is asked with several vectors the least counts. The queries go to
    the tasks in blocks of ``block`` rows; what a block has found is written
    before the next is gathered, so the driver holds one block, whatever their number.
    """
    own = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    kind = np.float32 if own.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    own = materialise(own, "queries")
    blocks = max(1, -(-own.count() // block))
    out = None
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        asked = [(r["id"], r["v"]) for r in part.orderBy("id").collect()]
        packed = {w: (np.array([i for i, v in asked if len(v) == w], dtype=np.int64), np.array([v for _, v in asked if len(v) == w], dtype=kind)) for w in {len(v) for _, v in asked}}

        def run(batches: Iterator[pa.RecordBatch], packed: dict = packed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["width"] not in packed:
                        continue
                    ids, owners, rows, graph = _load(row)
                    query_ids, vectors = packed[row["width"]]
                    units, wide = _unit(vectors).astype(np.float32), rows.astype(np.float64)
                    norms = np.sqrt((wide * wide).sum(axis=1))
                    first = np.searchsorted(owners, np.arange(len(rows) + 1))
                    found: list[tuple[int, int, float]] = []
                    for q, unit, vector in zip(query_ids.tolist(), units, vectors.astype(np.float64), strict=True):
                        at = np.array(graph.search(unit, width), dtype=np.int64)
                        cosine = (wide[at] @ vector) / (norms[at] * np.sqrt(vector @ vector))
                        best = sorted((-c, i) for c, a in zip(cosine.tolist(), at.tolist(), strict=True) for i in ids[first[a] : first[a + 1]].tolist() if i != q)
                        found += [(q, i, -c) for c, i in best[:neighbours]]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(released(run), "query_id long, vec_id long, score double")
        if blocks > 1:
            found = materialise(found, "found")
        out = found if out is None else out.unionAll(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
