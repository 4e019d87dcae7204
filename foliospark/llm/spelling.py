"""Spelling variants: words at one inserted, deleted or replaced letter, found in a trie of letter-group counts.

A word's vector holds how many of its letters fall into each of GROUPS groups. Two words that differ by one letter differ by at most one
surplus and one deficit between their vectors: a replaced letter moves one count, an inserted one adds one. A trie arranges words by their length and then by
the counts of one group after the other; the search goes down depth first with a budget of one surplus and one deficit, and the words of the
leaves that it reaches are verified letter by letter.

The trie's subtrees (length and first counts) are spread over the tasks: each word lives in one and visits those that the budget reaches, of two opposite ways only
one, so every pair is met once. Subtrees of more than CHUNK words are cut into chunks that all their visitors see. A task holds the words of one
chunk at a time, and visitors in batches.

Defined results: a null or empty text has no words; letters are A-Z, a-z and U+00C0 to U+00FF; a null id is an empty one in the checksum; rows repeated
count each; ties of the form go to the smallest word in code-point order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, discard, table, written

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Groups of letters by code point, those of frequent letters first.
GROUPS = 16
LEVELS = (5, 1, 9, 15, 14, 4, 2, 3, 12, 13, 8, 0, 7, 6, 10, 11)
#: Words of a subtree beyond which it is cut; words that the depths of subtrees are chosen by.
CHUNK, WORDS_AT_TWO = 8192, 1 << 20
#: Visitors that search at once, entries of the search that are taken a step at once, letters that are verified at once.
VISITORS, FRONTIER, VERIFIED = 4096, 1 << 17, 1 << 22
#: Width of a count in the code of a subtree.
BITS = 20
RESIDENT, ALONE, HERE, SAME, SHORTER = range(5)


def letter_runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, run): the maximal runs of letters of at least that length, A-Z in lower case."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", ascii_lower(F.col("run")))


def counted(words: Column, rows: DataFrame, least: int, occurrences: int) -> DataFrame:
    """(word, n) of words of at least that many letters and occurrences."""
    return rows.select(words.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points (all below 256) of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the letter groups in order of the levels, a row a word."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    group = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8) % GROUPS
    counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return counts[:, LEVELS]


class CountTrie:
    """Words of one length by their vectors: level by level, where the children of each node begin and which count they stand for."""

    def __init__(self, words: list[str], length: int):
        own = vectors(words)
        order = np.lexsort(own.T[::-1])
        own = own[order]
        self.words, self.length, self.order = letters(words, length)[order], length, order
        new = np.zeros(len(words), dtype=bool)
        new[:1] = True
        starts = np.zeros(1, dtype=np.int64)
        self.first, self.count = [], []
        for level in range(GROUPS):
            new[1:] |= own[1:, level] != own[:-1, level]
            below = np.flatnonzero(new)
            self.first.append(np.append(np.searchsorted(below, starts), len(below)))
            self.count.append(own[below, level])
            starts = below
        self.leaves = np.append(starts, len(words))

    def reached(self, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, word) of every leaf that the budget reaches; depth first, many visitors at once."""
        n = len(visitors)
        stack = [(0, np.arange(n), *(np.zeros(n, dtype=np.int64) for _ in range(3)))]
        while stack:
            level, who, node, surplus, deficit = stack.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(level, who[s], node[s], surplus[s], deficit[s]) for s in (slice(half), slice(half, None))]
                continue
            first = self.leaves if level == GROUPS else self.first[level]
            sizes = first[node + 1] - first[node]
            below = np.repeat(first[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            who = np.repeat(who, sizes)
            if level == GROUPS:
                yield who, below
                continue
            change = self.count[level][below] - visitors[who, level]
            surplus = np.repeat(surplus, sizes) + np.maximum(change, 0)
            deficit = np.repeat(deficit, sizes) + np.maximum(-change, 0)
            fits = (surplus <= 1) & (deficit <= 1)
            if fits.any():
                stack.append((level + 1, who[fits], below[fits], surplus[fits], deficit[fits]))

    def near(self, words: list[str], kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, resident) of all pairs one letter apart; of the same subtree's words (RESIDENT, HERE) those whose visitor is the smaller one."""
        own = letters(words, self.length - (kind == SHORTER))
        step = max(1, VERIFIED // self.length)
        for who, at in self.reached(vectors(words)):
            for k in range(0, len(who), step):
                w, a = who[k : k + step], at[k : k + step]
                left, right = own[w], self.words[a]
                if kind == SHORTER:
                    ahead = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
                    behind = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    fits = ahead + behind >= self.length - 1
                else:
                    other = left != right
                    fits = other.sum(axis=1) == 1
                    if kind in (RESIDENT, HERE):
                        rows, place = np.arange(len(w)), other.argmax(axis=1)
                        fits &= left[rows, place] < right[rows, place]
                yield w[fits], self.order[a[fits]]


def ways(depth: int) -> list[tuple[int, np.ndarray]]:
    """(kind, change) from a word's own subtree to those that it visits, itself left out."""
    unit = np.eye(depth, dtype=np.int64)
    same = [u for u in unit] + [unit[i] - unit[j] for i in range(depth) for j in range(i + 1, depth)]
    return [(SAME, c) for c in same] + [(SHORTER, c) for c in (np.zeros(depth, dtype=np.int64), *unit)]


def visits(words: DataFrame, depth: int, chunk: int) -> DataFrame:
    """(len, code, chunk, kind, word, n): words as residents and visitors of subtrees; code holds the first counts, modulo 2^BITS."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, mask = np.arange(depth) * BITS, (1 << BITS) - 1
        for b in batches:
            if not len(b):
                continue
            own, size = vectors(list(b["word"]))[:, :depth], b["word"].str.len().to_numpy()
            for kind, change in [(RESIDENT, np.zeros(depth, dtype=np.int64)), *ways(depth)]:
                code = ((own + change & mask) << shift).sum(axis=1)
                yield b.assign(len=(size + (kind == SHORTER)).astype(np.int32), code=code, kind=np.int8(kind))[["len", "code", "kind", "word", "n"]]

    rows = words.mapInPandas(place, "len int, code long, kind byte, word string, n long")
    sizes = rows.where(F.col("kind") == RESIDENT).groupBy("len", "code").agg(F.count("*").alias("n_words"))
    hot = sizes.where(F.col("n_words") > chunk).select("len", "code", F.ceil(F.col("n_words") / chunk).cast("int").alias("chunks"))
    cut = rows.join(hot, ["len", "code"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    spot = lambda at, kind: F.struct(at.cast("int").alias("chunk"), kind.cast("byte").alias("kind"))
    home, kind = F.pmod(F.xxhash64("word"), F.col("chunks")), F.col("kind")
    each = F.sequence(F.lit(0), F.col("chunks") - 1)
    whole = F.array(spot(F.lit(0), kind))
    split = F.when(kind == RESIDENT, F.concat(F.array(spot(home, F.lit(ALONE))), F.transform(each, lambda c: spot(c, F.lit(HERE))))).otherwise(F.transform(each, lambda c: spot(c, kind)))
    return cut.select("len", "code", "word", "n", F.explode(F.when(F.col("chunks") == 1, whole).otherwise(split)).alias("x")).select("len", "code", "x.chunk", "x.kind", "word", "n")


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, other, other_n): both ways, each word with every word one letter apart; words: (word, n), distinct."""
    total = words.count()
    depth = 2
    while depth < 3 and total > WORDS_AT_TWO * 8 ** (depth - 2):
        depth += 1
    keys = ["len", "code", "chunk"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # residents so far of the group that is not over
        trie: CountTrie | None = None
        group: tuple | None = None

        def pairs(visitors: pd.DataFrame, kind: int) -> Iterator[pd.DataFrame]:
            mine, theirs, my_n, their_n = visitors["word"].to_numpy(), held["word"].to_numpy(), visitors["n"].to_numpy(), held["n"].to_numpy()
            for at in range(0, len(visitors), VISITORS):
                for who, where in trie.near(list(mine[at : at + VISITORS]), kind):
                    who = who + at
                    yield pd.DataFrame({"word": np.concatenate([mine[who], theirs[where]]), "other": np.concatenate([theirs[where], mine[who]]), "other_n": np.concatenate([their_n[where], my_n[who]])})

        def close() -> Iterator[pd.DataFrame]:
            """Residents are complete: the trie is built, and those that are visitors, too, search."""
            nonlocal trie
            trie = CountTrie(list(held["word"]), group[0])
            own = held[held["kind"] == RESIDENT]
            if len(own):
                yield from pairs(own, RESIDENT)

        for b in batches:
            place = list(zip(*(b[k] for k in keys)))
            ends = [i for i in range(1, len(b)) if place[i] != place[i - 1]] + [len(b)]
            at = 0
            for end in ends:
                part = b.iloc[at:end]
                if len(part) and place[at] != group:
                    if held is not None and trie is None:
                        yield from close()
                    held, trie, group = None, None, place[at]
                lives = part["kind"] <= ALONE
                if lives.any():
                    held = part[lives] if held is None else pd.concat([held, part[lives]], ignore_index=True)
                if held is not None and not lives.all():
                    if trie is None:
                        yield from close()
                    for kind, some in part[~lives].groupby("kind"):
                        yield from pairs(some, int(kind))
                at = end
        if held is not None and trie is None:
            yield from close()

    rows = visits(words, depth, chunk)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * (len(ways(depth)) + 1) >> 17))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "kind").mapInPandas(search, "word string, other string, other_n long")


def forms_and_roots(words: DataFrame, near: DataFrame, factor: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n). Chains of forms are followed by doubling: each step at least multiplies n by the factor, so there are few."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    facts = words.join(best, "word", "left")
    has = -F.col("best.less") >= F.col("n") * factor
    facts = written(facts.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    jumps, longer = written(facts.where("form is not null").select("word", F.col("form").alias("root"))), 1
    while longer:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = written(jumps.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        longer = ahead.where("moved").limit(1).count()
        discard(jumps)
        jumps = ahead
    return facts.join(jumps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n): the form is the most frequent word one letter apart, if it is `factor` times as frequent."""
    words = written(words.select("word", "n"))
    return forms_and_roots(words, near_words(words), factor)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = letter_runs(table(spark, sf_dir, "documents"), "doc_id", "text", 7)
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.when(F.col("h") % 31 == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return spelling_variants(counted(damaged, h, 7, 2))
