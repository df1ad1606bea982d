"""Sub-word tokenizers for model input: greedy word pieces and unigram Viterbi.

Both are greedy or dynamic programs over bytes, which SQL can't express; they
run in Arrow batches, with the vocabulary loaded once for each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Special:
    """Ids of the special tokens; below zero if the vocabulary hasn't one."""

    cls: int
    sep: int
    pad: int
    unk: int


class WordPiece:
    """Longest pieces first, by byte; a word that can't be covered is one unknown."""

    def __init__(self, vocab: dict[str, int], special: Special, continuation: str = "##", lower: bool = True):
        self.ids = {k.encode(): v for k, v in vocab.items()}
        self.special, self.continuation, self.lower = special, continuation.encode(), lower
        self.longest = max(map(len, self.ids), default=0)

    def pieces(self, word: str) -> list[tuple[int, int, int]]:
        """(id, first byte, last byte + 1) of a word's pieces."""
        data, out, at = word.encode(), [], 0
        if data in self.ids:
            return [(self.ids[data], 0, len(data))]
        while at < len(data):
            lead = self.continuation if at else b""
            ends = range(min(len(data), at + self.longest), at, -1)
            end = next((e for e in ends if lead + data[at:e] in self.ids), None)
            if end is None:
                return [(self.special.unk, 0, len(data))]
            out.append((self.ids[lead + data[at:end]], at, end))
            at = end
        return out or [(self.special.unk, 0, len(data))]

    def _cut(self, rows: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
        """The rows with the end token, their tail if they are too many, behind the start token again (unless its id is 0)."""
        rows = [*rows, (self.special.sep, -1, -1)]
        if len(rows) > length:
            rows = rows[-length:]
            if rows[0][0] != self.special.cls and self.special.cls != 0:
                rows[0] = (self.special.cls, -1, -1)
        return rows + [(self.special.pad, -1, -1)] * (length - len(rows))

    def encode(self, text: str, length: int) -> tuple[list[int], list[int]]:
        """Ids and mask of exactly ``length``. A word's pieces are taken whole; what is then too long keeps its tail."""
        if length <= 0:
            return [], []
        rows = [(self.special.cls, -1, -1)]
        for word in text.split():
            rows += self.pieces(word.lower() if self.lower else word)
            if len(rows) >= length - 1:
                break
        used = min(length, len(rows) + 1)
        return [r[0] for r in self._cut(rows, length)], [1] * used + [0] * (length - used)

    def encode_with_offsets(self, text: str, length: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Ids, mask and byte offsets within the text (-1, -1 for special tokens) of exactly ``length``.

        Unlike ``encode`` it stops inside a word. Offsets are those of the word in
        small letters, whose bytes may be more than those of the word as written.
        """
        if length <= 0:
            return [], [], []
        rows = [(self.special.cls, -1, -1)]
        for i, start, end in self._placed(text):
            rows.append((i, start, end))
            if len(rows) >= length - 1:
                break
        used = min(length, len(rows) + 1)
        cut = self._cut(rows, length)
        return [r[0] for r in cut], [1] * used + [0] * (length - used), [(r[1], r[2]) for r in cut]

    def _placed(self, text: str) -> Iterator[tuple[int, int, int]]:
        at, data = 0, text.encode()
        for word in text.split():
            raw = word.encode()
            at = data.index(raw, at)
            for i, start, end in self.pieces(word.lower() if self.lower else word):
                yield i, at + start, at + end
            at += len(raw)

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, last byte + 1) within the text of all pieces."""
        return list(self._placed(text))


class Unigram:
    """The most probable segmentation; a byte or unknown token only where no piece starts."""

    def __init__(self, pieces: list[tuple[str, float]], special: Special, byte_fallback: bool = True):
        self.special = special
        self.scores = [s for _, s in pieces]
        self.ids: dict[bytes, int] = {p.encode(): i for i, (p, _) in enumerate(pieces)}
        self.longest = max(map(len, self.ids), default=0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _) in enumerate(pieces) if byte_fallback and len(p) == 6 and p.startswith("<0x") and p.endswith(">")}

    def _score(self, i: int) -> float:
        return self.scores[i] if 0 <= i < len(self.scores) else 0.0

    def _steps(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, id) of what may stand at a place."""
        found = [(e, self.ids[data[at:e]]) for e in range(at + 1, min(len(data), at + self.longest) + 1) if data[at:e] in self.ids]
        if found:
            return found
        single = self.bytes.get(data[at], self.special.unk)
        return [(at + 1, single)] if single >= 0 else []

    def tokenize(self, text: str) -> list[int]:
        said = " ".join(text.split())
        if not said:
            return []
        data = ("▁" + said.replace(" ", "▁") if not said.startswith("▁") else said.replace(" ", "▁")).encode()
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)] + [(-math.inf, -1, -1)] * len(data)
        for at in range(len(data)):
            if best[at][0] > -math.inf:
                for end, i in self._steps(data, at):
                    score = best[at][0] + self._score(i)
                    if score > best[end][0]:
                        best[end] = score, at, i
        out, at = [], len(data)
        if best[at][0] == -math.inf:
            return []  # a dead end: nothing covers the text
        while at:
            _, before, i = best[at]
            out.append(i)
            at = before
        return out[::-1]

    def encode(self, text: str, length: int) -> tuple[list[int], list[int]]:
        """Ids and mask of exactly ``length``; the end token is left out if there is no room."""
        if length <= 0:
            return [], []
        ids = ([self.special.cls] if self.special.cls >= 0 else []) + self.tokenize(text)
        ids = ids[:length]
        if self.special.sep >= 0 and len(ids) < length:
            ids.append(self.special.sep)
        return ids + [max(0, self.special.pad)] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))


def tokenized(df: DataFrame, text: str, make: Callable[[], WordPiece | Unigram], length: int) -> DataFrame:
    """``df`` with ``ids`` and ``mask``; ``make`` builds the tokenizer once for each task. A null text is empty."""
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([*df.schema.fields, T.StructField("ids", numbers), T.StructField("mask", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            found = [tokenizer.encode(t or "", length) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))], names=[*batch.schema.names, "ids", "mask"])

    return df.mapInArrow(run, schema)


def from_file(path: str) -> WordPiece | Unigram:
    """The tokenizer of a ``vocab.txt``, a ``tokenizer.json``, or a folder that holds one of them (the latter first)."""
    import json
    import os

    if os.path.isdir(path):
        names = [n for n in ("tokenizer.json", "vocab.txt") if os.path.exists(os.path.join(path, n))]
        if not names:
            raise FileNotFoundError(f"no tokenizer.json or vocab.txt in {path}")
        path = os.path.join(path, names[0])
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if not path.endswith(".json"):
        words = [line.strip() for line in text.splitlines() if line.strip()]
        return _word_piece({w: i for i, w in enumerate(words)})
    raw = json.loads(text)
    model = raw.get("model") or {}
    vocab = model.get("vocab")
    if str(model.get("type") or "").strip().lower() != "unigram":
        found = _vocabulary(vocab)
        if not found:
            raise ValueError("tokenizer.json has no vocabulary")
        return _word_piece(found)
    pieces = [(i, p[0], float(p[1])) for i, p in enumerate(vocab or []) if isinstance(p, list) and len(p) > 1 and p[0] and isinstance(p[0], str) and isinstance(p[1], (int, float))]
    if not pieces:
        raise ValueError("tokenizer.json has no vocabulary")
    known = {p: i for i, p, _ in pieces}
    listed = (raw.get("post_processor") or {}).get("special_tokens") or {}
    special = lambda name: ((listed.get(name) or {}).get("ids") or [known.get(name, -1)])[0]
    return Unigram([(p, s) for _, p, s in pieces], Special(special("[CLS]"), special("[SEP]"), special("[PAD]"), int(model.get("unk_id") or 0)), bool(model.get("byte_fallback")))


def _word_piece(vocab: dict[str, int]) -> WordPiece:
    return WordPiece(vocab, Special(*(vocab.get(name, 0) for name in ("[CLS]", "[SEP]", "[PAD]", "[UNK]"))))


def _vocabulary(raw: object) -> dict[str, int]:
    """Ids by token from a map, a list of scored tokens, or a list of tokens with ids."""
    if isinstance(raw, dict):
        return {k: int(v) for k, v in raw.items() if isinstance(v, (int, float))}
    out: dict[str, int] = {}
    for i, item in enumerate(raw if isinstance(raw, list) else []):
        if isinstance(item, list) and item and isinstance(item[0], str) and item[0]:
            out[item[0]] = i
        elif isinstance(item, dict) and isinstance(item.get("token"), str) and item["token"]:
            out[item["token"]] = int(item["id"]) if isinstance(item.get("id"), (int, float)) else i
    return out
