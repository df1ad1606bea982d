"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the code points cuts each text where the content says so,
so that the same passage gives the same chunks in every document. A worker
encodes each chunk once and keeps the result; where two chunks meet, the word
that the cut went through is encoded anew and compared, with its neighbours,
with the tokenizer's own encoding. Where they disagree, the window is widened by
words on both sides and encoded again, until its outer words come out as they do
alone; what the tokenizer gives for the words between then takes their place.

The cut is exact because the tokenizer turns every run of white space into
one space and then drops it: no token spans white space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import released, slices

#: Words for which lower(), NFC and the letter classes can't differ between libraries.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-žß]+|[0-9]|[^a-zà-öø-žß0-9]+")
_WINDOW = 16
#: A chunk ends where the hash has these bits clear: every 2048 characters on average.
_MASK = np.uint32(((1 << 11) - 1) << 16)
_FACTOR = 0x9E3779B1


def chunk_ends(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, its length last."""
    n = len(text)
    if n < 2 * _WINDOW:
        return [n]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    size = n - _WINDOW + 1
    rolled = np.zeros(size, dtype=np.uint32)
    for k in range(_WINDOW):
        rolled += code[k : k + size] * np.uint32(pow(_FACTOR, _WINDOW - k, 1 << 32))
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x85EBCA6B)
    ends = (np.flatnonzero((rolled & _MASK) == 0) + _WINDOW).tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def _blanks(text: str) -> str:
    """Every cut point as a space: all of these are white space to the tokenizer."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself, else the next free code from 256."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts through bounded caches of words and chunks."""

    def __init__(self, path: str, words: int = 80_000, chunk_chars: int = 5 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.printable = _byte_alphabet()
        self.most_words, self.most_chars = words, chunk_chars
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self.young, self.old, self.pieces = {}, {}, {}
        self.chunks, self.chunk_chars = {}, 0

    def _library(self, text: str) -> tuple[bytes, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        tokens = self.tokenizer.model.tokenize(piece if piece.isascii() else "".join([self.printable[b] for b in piece.encode()]))
        found = b"".join([t.id.to_bytes(4, "little") for t in tokens]), " ".join([t.value for t in tokens])
        if len(self.pieces) >= self.most_words:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids and decoded text of a string without blanks."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                if not word:
                    found = b"", ""
                elif _PLAIN.fullmatch(word) and "<|" not in word and len(word) < 200:
                    known, parts = self.pieces, []
                    for piece in _PIECE.findall(word.lower()):
                        parts.append(known.get(piece) or self._piece(piece))
                    found = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
                else:
                    found = self._library(word)
            if len(word) < 200:
                if len(self.young) >= self.most_words:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found

    def words(self, words: list[str]) -> tuple[bytes, str]:
        known, one = self.young, self.word
        found = [known.get(w) or one(w) for w in words if w]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    def _chunk(self, text: str) -> tuple[str, tuple[bytes, str] | None, str, str, str]:
        """Of a chunk: text before its first blank, the encoded middle, text after its last blank,
        and the whole words beside the cuts. The middle is None if there is no blank."""
        found = self.chunks.get(text)
        if found is None:
            head, *middle = _blanks(text).split(" ")
            if middle:
                tail, whole = middle.pop(), [w for w in middle if w]
                found = (head, self.words(whole), tail, whole[0] if whole else "", whole[-1] if whole else "")
            else:
                found = (head, None, "", "", "")
            if self.chunk_chars + len(text) > self.most_chars:
                self.chunks, self.chunk_chars = {}, 0
            self.chunks[text] = found
            self.chunk_chars += len(text)
        return found

    def _join(self, left: str, word: str, right: str) -> tuple[bytes, str] | None:
        """The word across a cut, checked with its whole neighbours against the library; None if they disagree."""
        found = self.word(word)
        if left or right:
            window = self.words([left, word, right])
            if window != self._library(" ".join(w for w in (left, word, right) if w)):
                return None
        return found

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids (little-endian 32 bits each) and decoded text of a whole text."""
        if not text:
            return b"", ""
        ends = chunk_ends(text)
        ids, said, carry, left, at, cut = [], [], "", "", 0, False
        for end in ends:
            head, middle, tail, first, last = self._chunk(text[at:end])
            carry, at = carry + head, end
            if middle is not None:
                joined = self._join(left, carry, first) if cut else self.word(carry)
                if joined is None:
                    return self._repaired(text, ends[:-1])
                for one in (joined, middle):
                    ids.append(one[0])
                    said.append(one[1])
                carry, left, cut = tail, last or left, True
        one = self.word(carry)
        return b"".join([*ids, one[0]]), " ".join([s for s in [*said, one[1]] if s])

    def _repaired(self, text: str, cuts: list[int]) -> tuple[bytes, str]:
        """A text whose chunks disagree at some cut: word by word, with windows around the cuts
        widened until the library's encoding agrees with the words at their ends."""
        places = [(m.start(), m.group()) for m in re.finditer("[^ ]+", _blanks(text))]
        starts, words = [p[0] for p in places], [p[1] for p in places]
        pieces: list[tuple[bytes, str] | None] = [self.word(w) for w in words]
        for cut in cuts:
            at, reach = max(0, bisect_right(starts, cut) - 1), 1
            while True:
                low, high = max(0, at - reach), min(len(words), at + reach + 1)
                while low and pieces[low] is None:  # inside what an earlier cut has replaced
                    low -= 1
                said = self._library(" ".join(words[low:high]))
                own = [p for p in pieces[low:high] if p is not None]
                if said == (b"".join(p[0] for p in own), " ".join(p[1] for p in own if p[1])):
                    break
                if low == 0 and high == len(words):
                    return said
                first, last = pieces[low], pieces[high - 1]
                if high - low > 2 and first and last and said[0].startswith(first[0]) and said[0].endswith(last[0]) and said[1].startswith(f"{first[1]} ") and said[1].endswith(f" {last[1]}") and len(said[0]) >= len(first[0]) + len(last[0]) > 0:
                    pieces[low + 1] = said[0][len(first[0]) : len(said[0]) - len(last[0])], said[1][len(first[1]) + 1 : len(said[1]) - len(last[1]) - 1]
                    pieces[low + 2 : high - 1] = [None] * (high - low - 3)
                    break
                reach *= 2
        kept = [p for p in pieces if p is not None]
        return b"".join(p[0] for p in kept), " ".join(p[1] for p in kept if p[1])


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker, so that the vocabulary is read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_tokens`` long, ``ids`` binary (little-endian
    unsigned 32 bits each) and ``decoded`` string.

    Narrow: one pass over the text, no shuffle; a lost task is simply run again.
    A null or empty text has no tokens and decodes to the empty string; repeated
    rows each give a row; other columns are not read. ``path`` must exist on
    every executor.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        encoder.forget()  # idle workers stay alive; what a task leaves behind would add up
        for batch in slices(batches, "__text", 2 << 20):
            found = [encoder.encode(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=[key, "n_tokens", "ids", "decoded"])
        encoder.forget()

    return docs.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(released(run), schema)
