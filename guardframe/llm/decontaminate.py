"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive word-gram hashes the least is kept
as a fingerprint, on both sides, so any shared span of ``WINDOW`` words shares
a fingerprint. Fingerprints of items and of documents are tables that are
joined by hash; each hit is extended word by word as far as a window can reach,
and what the hits of a document cover together is its longest common spans.
Items shorter than a window are matched with grams of their own length and
windows of one gram, in the same way.

Fingerprints of documents that no item can have are dropped in the task that
makes them, by a Bloom filter of the items' hashes, so the join moves about as
many rows as there are hits, and the documents stay where they are. Words are
known by 64-bit hashes; a window counts as equal if all its words' hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import materialise, numbered, released, slices
from guardframe.llm.hashing import GOLD, alphanumeric, mixed, word_hashes

WINDOW, GRAM = 10, 5
#: Grams in a window.
SPAN = WINDOW - GRAM + 1
#: Bits of the Bloom filter for each fingerprint of the items; powers of two between which its size lies.
BLOOM, LEAST_BITS, MOST_BITS = 32, 16, 27
#: Ids of contaminated rows that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_IDS = 1_000_000
#: Names that begin so are reserved in the documents.
_OWN = "__dc_"


def gram_hashes(words: np.ndarray, size: int, short: bool) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, other ones for items shorter than a window."""
    out = np.full(max(0, words.size - size + 1), 2 * size + short, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * GOLD + words[k : k + out.size])
    return out


def selected(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether winnowing keeps the hashes at some places: whether it is the least, and the last of
    equals, in some window. ``first`` and ``last`` are the bounds of each place's text; what a
    window would hold beyond them doesn't count."""
    own, reach = hashes[at], []
    for step in (1, -1):
        run, going = np.zeros(at.size, dtype=np.int64), np.ones(at.size, dtype=bool)
        for k in range(1, SPAN):
            there = at + step * k
            outside = (there >= last) | (there < first)
            other = hashes[np.clip(there, 0, hashes.size - 1)]
            going &= outside | (other > own if step > 0 else other >= own)
            run += going
        reach.append(run)
    return reach[0] + reach[1] >= SPAN - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def item_prints(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(``hash``, ``size``, ``item``, ``before``, ``words``): the items' fingerprints, each with the
    words that a window around it can hold, ``before`` of them before the gram.

    ``size`` is the gram's length for items shorter than a window, else 0.
    """
    own = items.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).cast("string").alias("text")).distinct()
    schema = "hash long, size int, item string, before int, words binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, begins = word_hashes(batch.column("text"), alphanumeric())
            rows: list[tuple[int, int, str, int, bytes]] = []
            for name, first, last in zip(batch.column("name").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                part = words[first:last]
                if 0 < part.size < WINDOW:
                    rows.append((int(gram_hashes(part, part.size, True)[0]), part.size, name, 0, part.tobytes()))
                elif part.size:
                    hashes = gram_hashes(part, GRAM, False)
                    every = np.arange(hashes.size)
                    for at in np.flatnonzero(selected(hashes, np.zeros_like(every), np.full_like(every, hashes.size), every)).tolist():
                        start = max(0, at - SPAN + 1)
                        rows.append((int(hashes[at]), 0, name, at - start, part[start : at + WINDOW].tobytes()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([_signed(np.array(columns[0], dtype=np.uint64)), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=names)

    return own.mapInArrow(released(run), schema)


def bloom(prints: DataFrame) -> tuple[np.ndarray, int]:
    """A table of booleans by the first bits of a hash, and their number; at most 16 MB of bits.

    It is put together from blocks of 8 KB that the executors make."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BLOOM * prints.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    blocks = prints.select(place.alias("place")).distinct().groupBy(F.shiftright("place", 16).alias("block")).agg(F.collect_list((F.col("place") % 65536).cast("int")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for places in batch.column("places"):
                block = np.zeros(65536, dtype=bool)
                block[places.values.to_numpy()] = True
                made.append(np.packbits(block).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, pa.binary())], names=["block", "bits"])

    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in blocks.mapInArrow(released(run), "block long, bits binary").collect():
        table[row["block"] * 8192 : (row["block"] + 1) * 8192] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return table, bits


def marked(docs: DataFrame, prints: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """The documents, numbered (``__dc_row``), with their number of words and, as
    ``__dc_found``, their fingerprints that pass the Bloom filter, each with where it lies and
    the words that a window around it can hold."""
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())
    table, bits = bloom(prints)
    shift = np.uint64(64 - bits)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if keep_text or c != text), F.col(text).cast("string").alias(f"{_OWN}text"))
    own = kept.columns[:-1]
    found_type = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.LongType()), T.StructField("near", T.IntegerType()), T.StructField("around", T.BinaryType())]))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(f"{_OWN}row", T.LongType()), T.StructField(f"{_OWN}words", T.LongType()), T.StructField(f"{_OWN}found", found_type)])
    arrow_found = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("near", pa.int32()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, f"{_OWN}text"):
            words, begins = word_hashes(batch.column(f"{_OWN}text"), alphanumeric())
            hits: list[tuple[np.ndarray, ...]] = []
            for size in sizes:
                width = size or GRAM
                hashes = gram_hashes(words, width, size > 0)
                place = hashes >> shift
                at = np.flatnonzero(table[(place >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)))
                whose = np.searchsorted(begins, at, side="right") - 1
                inside = at + (width if size else WINDOW) <= begins[whose + 1]
                if not size:  # also the last grams of texts that hold a whole window
                    inside = (at + GRAM <= begins[whose + 1]) & (begins[whose + 1] - begins[whose] >= WINDOW)
                at, whose = at[inside], whose[inside]
                if not size and at.size:
                    chosen = selected(hashes, begins[whose], begins[whose + 1] - GRAM + 1, at)
                    at, whose = at[chosen], whose[chosen]
                start = at if size else np.maximum(begins[whose], at - SPAN + 1)
                stop = at + width if size else np.minimum(begins[whose + 1], at + WINDOW)
                hits.append((whose, hashes[at], at, start, stop))
            whose, hashes, at, start, stop = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, dtype=np.int64),) * 5
            order = np.argsort(whose, kind="stable")
            around = pa.array([words[a:b].tobytes() for a, b in zip(start[order].tolist(), stop[order].tolist(), strict=True)], pa.binary())
            structs = pa.StructArray.from_arrays([_signed(hashes[order]), pa.array((at - begins[whose])[order]), pa.array((at - start)[order].astype(np.int32)), around], fields=list(arrow_found))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose[order], np.arange(batch.num_rows + 1)).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.diff(begins)), lists], names=schema.names)
            row += batch.num_rows

    return materialise(kept.mapInArrow(released(run), schema), "marked")


def matched(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """(``row``, ``hits``, ``items``) of the documents with a window of an item: the word ranges, end
    exclusive, disjoint and ascending, and the items' names, sorted."""
    pairs = documents.select(F.col(f"{_OWN}row").alias("row"), F.inline(f"{_OWN}found")).join(prints, "hash")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, items = [], [], [], []
            for r in batch.to_pylist():
                doc, item = (np.frombuffer(r[c], dtype=np.uint64) for c in ("around", "words"))
                back, ahead = min(r["near"], r["before"]), min(doc.size - r["near"], item.size - r["before"])
                same = doc[r["near"] - back : r["near"] + ahead] == item[r["before"] - back : r["before"] + ahead]
                before, after = ~same[:back][::-1], ~same[back:]
                left = int(before.argmax()) if before.any() else back
                right = int(after.argmax()) if after.any() else ahead
                if left + right >= (r["size"] or WINDOW):
                    rows.append(r["row"])
                    starts.append(r["at"] - left)
                    ends.append(r["at"] + right)
                    items.append(r["item"])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rows, starts, ends)), pa.array(items, pa.string())], names=["row", "start", "end", "item"])

    spans = pairs.select("row", "at", "near", "around", "size", "item", "before", "words").mapInArrow(released(extended), "row long, start long, end long, item string")
    found = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("hits", span), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for spans in batch.column("spans").to_pylist():
                out: list[dict[str, int]] = []
                for s in spans:
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(s)
                hits.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hits, arrow_span), batch.column("items")], names=schema.names)

    return found.mapInArrow(released(united), schema)


def find_overlaps(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words`` long, ``hits`` (array of word ranges, end exclusive,
    disjoint, ascending) and ``items`` (array of item ids as strings, sorted).

    Null and empty texts have no words; repeated rows each give a row; items
    without words match nothing, an item without an id has the empty name; other
    columns pass through, but for ones with the names of the new ones, which are
    replaced, and, without ``keep_text``, the text. Names that begin with
    ``__dc_`` are reserved. Empty tables give no rows or no hits.
    """
    prints = materialise(item_prints(items, item_key, text), "prints")
    documents = marked(docs.drop("n_words", "hits", "items"), prints, text, keep_text)
    own = [c for c in documents.columns if not c.startswith(_OWN)]
    found = matched(documents, prints).withColumnRenamed("row", f"{_OWN}row")
    joined = documents.drop(f"{_OWN}found").join(found, f"{_OWN}row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return joined.select(*(F.col(f"`{c}`") for c in own), F.col(f"{_OWN}words").alias("n_words"), none("hits"), none("items"))


def without_overlaps(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns; no text is copied."""
    prints = materialise(item_prints(items, item_key, text), "prints")
    own = numbered(docs, f"{_OWN}id")
    documents = marked(own.select(f"{_OWN}id", F.col(f"`{text}`")), prints, text, False)
    found = matched(documents, prints).select(F.col("row").alias(f"{_OWN}row"))
    rows = materialise(documents.select(f"{_OWN}row", f"{_OWN}id").join(found, f"{_OWN}row").select(f"{_OWN}id"), "contaminated")
    few = rows.count() <= BROADCAST_IDS
    return own.join(F.broadcast(rows) if few else rows, f"{_OWN}id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def hit_words(hits: str = "hits") -> Column:
    """Column: how many words the hits cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
