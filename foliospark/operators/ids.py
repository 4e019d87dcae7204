"""Ids of dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranks import range_ranked


def assign_ids(names: DataFrame, known: DataFrame | None, key: str, id_col: str) -> DataFrame:
    """(id_col, key): the known ids, and for each new distinct name the next id in order of name. Names are ranked by ranges, whatever they begin with."""
    new = names.where(F.col(key).isNotNull()).select(key).distinct()
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
    out = range_ranked(new, [F.col(key)], id_col).select(F.col(id_col).cast("long").alias(id_col), key)
    if known is None:
        return out
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    return known.select(id_col, key).unionByName(out.crossJoin(F.broadcast(top)).select((F.col(id_col) + F.col("top")).alias(id_col), key))
