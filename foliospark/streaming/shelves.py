"""Shelves kept from a stream of actions: a batch rewrites the buckets of the users that it names, and no others.

Users are dealt to BUCKETS buckets. A bucket's table holds the last action of each (user, book) with its time; a batch joins its own actions to the buckets it
touches, writes these anew into a folder of its own, and then its rows of the manifest, which name the folder of each bucket. So no state is kept in the
stream, readers see whole batches, a batch that comes again changes nothing, and late actions never undo newer ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "batch long, bucket int, folder string"
STATE = "user_id long, book_id long, action string, ts timestamp, event_id long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, bucket, folder); a batch without actions has one row with a null bucket."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def stored_actions(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The last action of each (user, book) of all buckets or of some. The driver sees one row a bucket."""
    rows = manifest(spark, path).where("bucket is not null")
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    latest = rows.groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()
    if not latest:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*(f"{path.rstrip('/')}/data/{r.folder}/bucket={r.bucket}" for r in latest))


def read_shelves(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, book_id) of the books that are on a shelf."""
    return stored_actions(spark, path).where("action = 'add'").select("user_id", "book_id")


def last_actions(events: DataFrame) -> DataFrame:
    """(user_id, book_id, action, ts, event_id): the last one of each pair by time, then event."""
    return events.groupBy("user_id", "book_id").agg(F.max_by(F.struct("action", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("user_id", "book_id", "x.action", "x.ts", "x.event_id")


def upsert_shelves(path: str, n_buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What a stream of actions (event_id, ts, user_id, book_id, action) runs for every micro-batch. The number of buckets must stay the same for a path."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(n_buckets)).cast("int")

    def upsert(events: DataFrame, number: int) -> None:
        spark = events.sparkSession
        if manifest(spark, path).where(F.col("batch") == number).limit(1).count():
            return
        fresh = last_actions(events.where(F.col("user_id").isNotNull() & F.col("book_id").isNotNull()).select(F.col("user_id").cast("long").alias("user_id"), F.col("book_id").cast("long").alias("book_id"), "action", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id")))
        touched = sorted(r[0] for r in fresh.select(bucket.alias("bucket")).distinct().collect())
        folder = f"{number}-{uuid.uuid4().hex}"
        if touched:
            merged = last_actions(stored_actions(spark, path, touched).unionByName(fresh)).withColumn("bucket", bucket)
            merged.repartition("bucket").sortWithinPartitions("bucket", "user_id").write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/data/{folder}")
        rows = [(number, b, folder) for b in touched] or [(number, None, folder)]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest/{number}")

    return upsert
