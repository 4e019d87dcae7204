"""Streams of index files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.ingest import BOOK_COLUMNS, KEY, added_books
from foliospark.storage import written


def stream_lines(spark: SparkSession, path: str, pattern: str = "*.inp", files_per_batch: int = 1000) -> DataFrame:
    """(source, member, line_no, line) of text index files as they arrive, each read by one task, so that lines have their numbers, then dealt to all tasks: few files of a batch hold up no parsing."""
    text = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(path)
    source = F.col("_metadata.file_path")
    lines = text.select(source.alias("source"), F.regexp_extract(source, "[^/]*$", 0).alias("member"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.where("line <> ''").repartition("source", "line_no")


def merge_into(path: str, added_at) -> Callable[[DataFrame, int], None]:
    """What a stream of resolved records runs for every micro-batch: the books that it adds to the catalog at `path` (folders batch=<number>, the first one -1) go to a folder of the batch's own.

    Stored books are never rewritten. A batch that comes again sees the catalog without its own folder and replaces that, so it gives the same books and ids.
    """

    def merge(records: DataFrame, number: int) -> None:
        spark = records.sparkSession
        stored = spark.read.parquet(path).where(F.col("batch") < number).select(*BOOK_COLUMNS)
        found = written(records.select(*(c for c in records.columns if c not in ("authors", "genres"))))  # ranges of keys read them twice
        added_books(found, stored, added_at).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return merge


def stream_ingest(lines: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch goes through `merge`, which is idempotent, as a batch can come again after a failure."""
    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_dedup(records: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first record of each natural key. With an event time the state holds the keys of the last `delay` of it only, and a key that comes back later passes again;
    without one it holds all keys, in whatever state store the session names. Once over the whole catalog with no state at all: `commits.merge_all`, which asks the stored books.
    """
    if event_time is None:
        return records.dropDuplicates(KEY)
    return records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(KEY)
