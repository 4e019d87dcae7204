"""Packing of token sequences by non-negative least squares.

Each document is tokenized once and cut into whole windows and one rest, so that the digests of all pieces are known before
packing. The histogram of rest lengths has fewer bins than a window has tokens, whatever the corpus, so planning is a
small driver computation: combinations of two or three lengths that fill a window are enumerated, their repeat counts
solve a non-negative least squares problem against the histogram, are rounded down, and the lengths left over
are packed greedily, largest first. The plan gives each length runs of (first rank, count, first sequence, offset); Spark ranks the pieces
of a length within salted groups and looks their places up.

Defined results: a null text is the empty text, which has the closing id alone; repeated rows and null ids are packed as
any others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import table, text_batches, written

WINDOW, END_ID = 2048, 1
#: Groups that the pieces of one length are ranked in.
SALTS = 64
#: Combinations that enter the least squares problem, those of the most frequent lengths first; lengths of the others are packed by the greedy step, which
#: leaves none out. The padding of the whole plan is under 1 % on the given tables (tests).
MOST_PATTERNS, STEPS = 6000, 300
#: Units in each of a worker's two cache generations.
CACHE_UNITS = 400_000

#: The pre-tokenizer's pattern for text without white space but single spaces.
PRINTABLE_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+"
#: Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others as the letters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = [chr(b) if b in _PLAIN else chr(256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)]

_TOKENIZERS: dict[str, CachedTokenizer] = {}


class OddSpace(Exception):
    """A space that no unit starts with: at the end of a text or before other white space."""


class CachedTokenizer(dict):
    """Ids of whole texts by a byte-level BPE tokenizer whose pre-tokenizer starts a token at a single space before a non-space.

    So a text is a sequence of units (a space and what follows up to the next such space), whose ids do not depend on
    their neighbours. A new unit goes through the tokenizer's pre-tokenizer and its BPE model and is remembered, without the space of its beginning, as
    little-endian bytes, in two generations: when the younger is full it becomes the older, and what is used again moves back.
    A text that holds an added token goes through the tokenizer itself, as such a token is found before anything else.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.parts = regex.compile(PRINTABLE_PARTS)
        self.model, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # of parts without a space before them

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, bare: str) -> bytes:
        if not bare or bare[0].isspace():
            raise OddSpace
        found = self.old.get(bare) or self.unit_ids(" " + bare)
        self[bare] = found
        return found

    def unit_ids(self, unit: str) -> bytes:
        """Ids of any text that starts no later than a unit and ends with one."""
        bare = unit[1:] if unit[:1] == " " else unit
        if bare.isalpha():  # one token of the pre-tokenizer
            if bare.isascii():
                letters = BYTE_LETTERS[32] + bare if unit is not bare else bare
            else:
                letters = "".join(map(BYTE_LETTERS.__getitem__, unit.encode()))
            ids = [t.id for t in self.model.tokenize(letters)]
            return struct.pack(f"<{len(ids)}I", *ids)
        if " " not in bare:
            lines = bare.split("\n")
            if len(lines) > 1 and all(x and x.isprintable() for x in lines):
                start = self[lines[0]] if unit is not bare else self.part_ids(lines[0])
                return self.part_ids("\n").join((start, *map(self.part_ids, lines[1:])))
            if bare.isprintable() and len(parts := self.parts.findall(unit)) > 1:
                return b"".join(self[x[1:]] if x[0] == " " else self.part_ids(x) for x in parts)
        return b"".join(t.id.to_bytes(4, "little") for x, _ in self.pre_tokenizer.pre_tokenize_str(unit) for t in self.model.tokenize(x))

    def part_ids(self, part: str) -> bytes:
        found = self.bare.get(part)
        if not found:
            if len(self.bare) > CACHE_UNITS:
                self.bare.clear()
            found = self.bare[part] = self.unit_ids(part)
        return found

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return np.array(self.ids(text), dtype="<u4").tobytes()
        if len(self) > CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.__getitem__, rest))
        except OddSpace:
            units = []
            for u in rest:  # a space that no unit starts with belongs to what stands before it
                if u and not u[0].isspace():
                    units.append(u)
                elif units:
                    units[-1] += " " + u
                else:
                    first += " " + u
            ids = b"".join(map(self.__getitem__, units))
        return self.unit_ids(first) + ids if first else ids


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids and the closing id, cut at multiples of the window."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, close = _tokenizer(tokenizer_path), end_id.to_bytes(4, "little")
        for b in batches:
            for at in range(0, len(b), 500):
                part, rows = b.iloc[at : at + 500], []
                for doc, ids in zip(part["doc_id"], map(tokenizer.encode, part["text"])):
                    ids += close
                    n = len(ids) // 4
                    rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
                yield out

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the window, from lengths that occur; those that could repeat most first."""
    there = np.flatnonzero(histogram)
    there = there[(there > 0) & (there < window)]
    pairs = [(window - a, a, 0) for a in there if 2 * a <= window and histogram[window - a]]
    triples = []
    for b in there:
        a = there[(there >= b) & (there + b < window)]
        c = window - a - b
        good = (c >= 1) & (c <= b)
        a, c = a[good], c[good]
        c_there = histogram[c] > 0
        triples.append(np.stack([a[c_there], np.full(c_there.sum(), b), c[c_there]], axis=1))
    rows = np.concatenate([np.array(pairs, dtype=np.int64).reshape(-1, 3), *triples]) if len(there) else np.zeros((0, 3), dtype=np.int64)
    least = np.where(rows > 0, histogram[rows], histogram.max(initial=0)).min(axis=1) if len(rows) else np.zeros(0)
    order = np.lexsort((rows[:, 2] > 0, -least)) if len(rows) else []
    return rows[order][:MOST_PATTERNS]


def repeats(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A having the rows as columns, by multiplicative updates."""
    h = histogram.astype(float)
    h[0] = 0
    x = np.ones(len(rows))
    used = rows > 0
    aim = (h[rows] * used).sum(axis=1)
    for _ in range(STEPS):
        made = np.bincount(rows.ravel(), weights=np.repeat(x, 3) * used.ravel(), minlength=len(h))
        now = (made[rows] * used).sum(axis=1)
        x *= aim / np.maximum(now, 1e-9)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of every length once."""
    left, taken, runs, sequences = histogram.astype(np.int64).copy(), np.zeros(len(histogram), dtype=np.int64), [], 0

    def place(lengths: list[int], n: int) -> None:
        nonlocal sequences
        offset = 0
        for length in lengths:
            runs.append((length, taken[length], n, sequences, offset))
            taken[length] += n
            left[length] -= n
            offset += length
        sequences += n

    if left[window]:
        place([window], int(left[window]))
    rows = patterns(left, window)
    x = repeats(rows, left) if len(rows) else np.zeros(0)
    for i in np.argsort(-x, kind="stable"):
        lengths = [int(v) for v in rows[i] if v]
        n = min(int(x[i] + 1e-6), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            place(lengths, n)
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            lengths, room, used = [longest], window - longest, {longest: 1}
            for size in range(min(room, longest), 0, -1):
                while size <= room and left[size] > used.get(size, 0):
                    lengths.append(size)
                    used[size] = used.get(size, 0) + 1
                    room -= size
                if not room:
                    break
            place(lengths, min(int(left[v]) // k for v, k in used.items()))
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, window, end_id).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")))
    counts = cut.groupBy("length", "salt").count().toPandas()  # window x SALTS rows at most
    histogram = np.zeros(window + 1, dtype=np.int64)
    np.add.at(histogram, counts["length"].to_numpy(dtype=np.int64), counts["count"].to_numpy(dtype=np.int64))
    runs = plan(histogram, window)
    by_salt = np.zeros((window + 1, SALTS), dtype=np.int64)
    by_salt[counts["length"].to_numpy(dtype=np.int64), counts["salt"].to_numpy(dtype=np.int64)] = counts["count"]
    before = np.cumsum(by_salt, axis=1) - by_salt
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    total = int(histogram.max(initial=0)) + 1
    keys = runs[:, 0] * total + runs[:, 1]

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy(dtype=np.int64)
            rank = before[length, b["salt"].to_numpy(dtype=np.int64)] + b["rank"].to_numpy(dtype=np.int64) - 1
            run = runs[np.searchsorted(keys, length * total + rank, side="right") - 1]
            yield b.drop(columns=["salt", "rank"]).assign(doc_id=pd.array(b["doc_id"], dtype="Int64"), sequence_id=run[:, 3] + rank - run[:, 1], offset=run[:, 4])

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    return ranked.mapInPandas(locate, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizer())
