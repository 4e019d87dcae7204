"""Places in one order over all rows: ranges of the order in parallel, and one figure per range.

Rows are dealt out by ranges of their sort keys, sorted there and written with the range they are in and their place in it. How many rows each range holds is
all that the ranges have to tell each other; its first and last row are all that neighbours need. What the driver sees is one row per range, at most the
number of shuffle partitions. Ties must be broken by the keys, or else their order is open; keys that tell rows apart also keep ranges of like size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.storage import written

PART, AT, KEY = "_range", "_at", "_key"
#: Bits that monotonically_increasing_id() keeps for the place in a partition.
PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with _range and _at: rows with a smaller range or, within it, a smaller place come first in the ascending order of the key values."""
    names = [f"{KEY}{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    number = F.monotonically_increasing_id()
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumn(AT, number).drop(*names)
    return written(placed.withColumns({PART: F.shiftright(AT, PLACE_BITS).cast("int"), AT: F.col(AT).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}))


def with_rank(rows: DataFrame, name: str) -> DataFrame:
    """Rows of in_ranges with their place from 1 on in the whole order."""
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(PART).agg(F.count("*")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    known = rows.sparkSession.createDataFrame(offsets, f"{PART} int, _before long")
    return rows.join(F.broadcast(known), PART).withColumn(name, F.col("_before") + F.col(AT) + 1).drop(PART, AT, "_before")


def range_ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place, from 1 on, in the ascending order of the key values over all rows."""
    return with_rank(in_ranges(df, order), name)


def range_neighbours(df: DataFrame, order: list[Column], id_col: str, before: str, after: str) -> DataFrame:
    """df with the id of the row before and after each one in the order over all rows; the first and the last row are neighbours, too."""
    rows = in_ranges(df, order)
    edges = rows.groupBy(PART).agg(F.min_by(id_col, AT).alias("first"), F.max_by(id_col, AT).alias("last")).orderBy(PART).collect()
    around = [(e[PART], edges[i - 1]["last"], edges[(i + 1) % len(edges)]["first"]) for i, e in enumerate(edges)]
    kind = df.schema[id_col].dataType.simpleString()
    known = rows.sparkSession.createDataFrame(around, f"{PART} int, _before {kind}, _after {kind}")
    w = Window.partitionBy(PART).orderBy(AT)
    inner = rows.withColumns({before: F.lag(id_col).over(w), after: F.lead(id_col).over(w), "_size": F.max(AT).over(Window.partitionBy(PART))})
    edged = inner.join(F.broadcast(known), PART)
    at_start, at_end = F.col(AT) == 0, F.col(AT) == F.col("_size")
    out = edged.withColumns({before: F.when(at_start, F.col("_before")).otherwise(F.col(before)), after: F.when(at_end, F.col("_after")).otherwise(F.col(after))})
    return out.drop(PART, AT, "_size", "_before", "_after")
