"""SimHash fingerprints and their near-duplicate groups by a grid over segments' bit counts.

A fingerprint bit is the majority of that bit over the hashes of a text's word n-grams, repeats included. The segments of a fingerprint (two
bits each) are mapped to their numbers of ones: a point whose Manhattan distance to another is at most the Hamming distance of the two fingerprints.
The segments are dealt to blocks. Of two points at a distance of k or less, one block at least has floor(k / blocks) or less
of it; so a fingerprint lives in its cell of each block, and also visits the cells within that radius, of two opposite ones only one. Pairs that meet in a cell are held
against the number of ones (one segment of all bits, the same lower bound), then against the Hamming distance itself.
Blocks are fewer and radii larger the more fingerprints there are, so that cells stay small.

Pairs are not given out: a cell gives a forest of links, less than one a member. Cells of more than CHUNK members are cut into chunks, and every pair of
chunks is a group of its own; a task holds one group of at most 2 * CHUNK fingerprints at a time.

Defined results: a null or empty text has the fingerprint zero, linked like any other; fewer words than n are one n-gram, the whole sequence;
equal fingerprints, repeated rows among them, are one node; a null id names a component only where all its ids are null; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import table, text_batches, words, written
from foliospark.llm.components import components

#: Segments of SEGMENT_BITS bits; a segment's count has SEGMENT_BITS + 1 values.
SEGMENT_BITS, SEGMENTS = 2, 32
#: Members of a cell beyond which it is cut into chunks.
CHUNK = 4096
#: Hashes whose bits are laid out at once.
SLICE = 1 << 16
#: (number of fingerprints up to which it serves, blocks); beyond the last, two blocks.
GRIDS = ((1 << 21, 5), (1 << 28, 3))


def shingle_hashes(docs: DataFrame, text: str, n: int) -> DataFrame:
    """docs with `hashes`, XXH64 with seed 42 of every word n-gram, in place of the text."""
    cut = docs.withColumn("words", F.filter(words(F.col(text)), lambda w: w != "")).drop(text)
    size = F.size("words")
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " ")))
    few = F.when(size > 0, F.array(F.xxhash64(F.array_join("words", " ")))).otherwise(F.array().cast("array<bigint>"))
    return cut.withColumn("hashes", F.when(size >= n, grams).otherwise(few)).drop("words")


def majority(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The 64-bit majority of each list hashes[offsets[i]:offsets[i + 1]]: bits set in over half of it."""
    counts = np.zeros((len(offsets) - 1, 64), dtype=np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), SLICE):
        part = hashes[at : min(at + SLICE, int(offsets[-1]))]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + len(part), "left")
        rows = np.arange(first, last)
        rows = rows[offsets[rows + 1] > offsets[rows]]
        counts[rows] += np.add.reduceat(bits, np.maximum(offsets[rows] - at, 0), axis=0, dtype=np.int64)
    over = 2 * counts > np.diff(offsets)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel()


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, fp a long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("hashes")
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(majority(offsets, values), pa.int64())], names=["doc_id", "fp"])

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return shingle_hashes(own, "text", n).mapInArrow(make, "doc_id long, fp long")


def blocks_of(blocks: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.arange(SEGMENTS), blocks)]


def _moves(size: int, radius: int) -> list[list[tuple[int, int]]]:
    """Lists of (segment, change) of a total change of 1 to radius, of two opposite ones that whose first change is upward."""
    found: list[list[tuple[int, int]]] = []

    def extend(moves: list[tuple[int, int]], at: int, left: int) -> None:
        if moves:
            found.append(moves)
        for i in range(at, size):
            for step in range(1, min(left, SEGMENT_BITS) + 1):
                extend([*moves, (i, step)], i + 1, left - step)
                if moves:
                    extend([*moves, (i, -step)], i + 1, left - step)

    extend([], 0, radius)
    return found


def in_cells(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(fp, block, cell, visits) of (fp): the own cell of each block and, with visits, those near it."""
    base = SEGMENT_BITS + 1
    shifts, ones = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS), np.uint64((1 << SEGMENT_BITS) - 1)
    moves = {len(part): _moves(len(part), radius) for part in blocks_of(blocks)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            counts = np.bitwise_count(fp.view(np.uint64)[:, None] >> shifts & ones).astype(np.int64)
            for k, part in enumerate(blocks_of(blocks)):
                own = counts[:, part]
                power = base ** np.arange(len(part), dtype=np.int64)
                cell = own @ power
                yield pd.DataFrame({"fp": fp, "block": k, "cell": cell, "visits": False})
                for change in moves[len(part)]:
                    at, step = (np.array(x) for x in zip(*change))
                    there = own[:, at] + step
                    inside = ((there >= 0) & (there <= SEGMENT_BITS)).all(axis=1)
                    yield pd.DataFrame({"fp": fp[inside], "block": k, "cell": cell[inside] + int(step @ power[at]), "visits": True})

    return fps.select("fp").mapInPandas(place, "fp long, block int, cell long, visits boolean")


def in_groups(rows: DataFrame, chunk: int, radius: int) -> DataFrame:
    """(block, cell, visitors, i, j, side, fp): what is compared with each other. Members of a cell among themselves (sides 0: both, 1: left, 2: right), visitors (1) with members (2)."""
    sizes = rows.groupBy("block", "cell").agg(F.count_if(~F.col("visits")).alias("members"), F.count_if("visits").alias("guests"))
    hot = sizes.where((F.col("members") > chunk) | (F.col("guests") > chunk)).select("block", "cell", F.ceil(F.greatest("members", "guests") / chunk).cast("int").alias("chunks"))
    cut = rows.join(hot, ["block", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    group = lambda visitors, i, j, side: F.struct(F.lit(visitors).alias("visitors"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.col("own")
    among = F.transform(every, lambda x: group(False, F.least(own, x), F.greatest(own, x), F.when(own == x, 0).when(own < x, 1).otherwise(2)))
    guest = F.transform(every, lambda x: group(True, own, x, F.lit(1)))
    host = F.transform(every, lambda x: group(True, x, own, F.lit(2)))
    member = F.concat(among, host) if radius else among
    return cut.select("block", "cell", "fp", F.explode(F.when(F.col("visits"), guest).otherwise(member)).alias("g")).select("block", "cell", "g.visitors", "g.i", "g.j", "g.side", "fp")


def forest(left: np.ndarray, right: np.ndarray, most: int, same: bool) -> list[tuple[int, int]]:
    """Links within `most` bits between left and right (with `same` both are one group), as few as connect what they connect."""
    both = left if same else np.concatenate([left, right])
    label = np.arange(len(both))
    ones = np.bitwise_count(right)
    order = np.argsort(ones, kind="stable")
    right, ones = right[order], ones[order]
    place = order if same else order + len(left)
    if same:
        left, own = right, place
    else:
        own = np.arange(len(left))
    count = np.bitwise_count(left).astype(np.int64)
    low, high = np.searchsorted(ones, count - most, "left"), np.searchsorted(ones, count + most, "right")
    if same:
        low = np.arange(len(left)) + 1
    links = []
    for k in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(right[low[k] : high[k]] ^ left[k]) <= most) + low[k]
        if not len(near):
            continue
        mine = label[own[k]]
        roots = label[place[near]]
        fresh, first = np.unique(roots, return_index=True)
        for root, at in zip(fresh, first):
            if root != mine:
                links.append((int(left[k]), int(right[near[at]])))
                label[label == root] = mine
    return links


def near_links(fps: DataFrame, most: int = 4, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all that lie within `most` bits."""
    if blocks is None:
        n = fps.count()
        blocks = next((b for limit, b in GRIDS if n <= limit), 2)
        blocks = most + 1 if blocks > most else blocks
    groups = in_groups(in_cells(fps, blocks, most // blocks), chunk, most // blocks)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = ["block", "cell", "visitors", "i", "j"], None

        def linked(rows: pd.DataFrame) -> list[tuple[int, int]]:
            side, fp = rows["side"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            own = fp[side == 0]
            return forest(own, own, most, True) if len(own) else forest(fp[side == 1], fp[side == 2], most, False)

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            ends = np.flatnonzero((b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)) + 1
            found = [x for lo, hi in zip([0, *ends[:-1]], ends) if hi - lo > 1 for x in linked(b.iloc[lo:hi])]
            held = b.iloc[ends[-1] if len(ends) else 0 :]
            yield pd.DataFrame(np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])
        if held is not None and len(held) > 1:
            yield pd.DataFrame(np.array(linked(held), dtype=np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    keys = ["block", "cell", "visitors", "i", "j"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(link, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, most: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id that links of at most `most` bits reach."""
    prints = written(fingerprinted(docs, id_col, text_col, n))
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(written(near_links(fps.select("fp"), most, blocks)))
    grouped = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = grouped.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
