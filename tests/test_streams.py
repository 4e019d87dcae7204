import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliospark.streaming import ingest, shelves

SCHEMA = "event_id long, ts timestamp, user_id long, book_id long, action string"


def brute(events):
    last = {}
    for e, ts, u, b, action in sorted(events, key=lambda e: (e[1], e[0])):
        if u is not None and b is not None:
            last[u, b] = action
    return sorted(k for k, a in last.items() if a == "add")


def test_batches_touch_their_own_buckets_and_come_again(spark, tmp_path):
    path = str(tmp_path / "s")
    rng, start = random.Random(4), datetime(2024, 1, 1)
    events = [(i, start + timedelta(minutes=rng.randint(0, 50)), rng.randint(1, 30), rng.randint(1, 4), rng.choice(["add", "add", "remove"])) for i in range(400)]
    rng.shuffle(events)  # late actions come in later batches
    upsert = shelves.upsert_shelves(path, 8)
    assert shelves.read_shelves(spark, path).count() == 0
    for n in range(4):
        batch = spark.createDataFrame(events[n * 100 : n * 100 + 100], SCHEMA)
        upsert(batch, n)
        upsert(batch, n)
        assert sorted(tuple(r) for r in shelves.read_shelves(spark, path).collect()) == brute(events[: n * 100 + 100])
    before = {r.bucket: r.folder for r in shelves.manifest(spark, path).groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()}
    one = [(999, start + timedelta(days=1), 7, 77, "add"), (1000, start, None, 1, "add"), (1001, start, 1, None, "add")]
    upsert(spark.createDataFrame(one, SCHEMA), 4)
    after = {r.bucket: r.folder for r in shelves.manifest(spark, path).groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()}
    assert sum(before[b] != after[b] for b in after) == 1
    assert sorted(tuple(r) for r in shelves.read_shelves(spark, path).collect()) == brute(events + one)
    upsert(spark.createDataFrame([], SCHEMA), 5)
    upsert(spark.createDataFrame([], SCHEMA), 5)
    assert sorted(tuple(r) for r in shelves.read_shelves(spark, path).collect()) == brute(events + one)


def test_dedup_state_is_bounded_by_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    for day in range(5):
        rows = [(f"T{day}-{i % 50}", "f", "z", start + timedelta(days=day, seconds=i)) for i in range(100)]
        spark.createDataFrame(rows, "title string, file_name string, zip string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"d{day}"))
    stream = spark.readStream.schema("title string, file_name string, zip string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out, kept = str(tmp_path / "out"), []
    query = ingest.stream_dedup(stream, "at", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(out).count() == 250 and spark.read.parquet(out).distinct().count() == 250
    assert max(kept) < 250, kept


def test_lines_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    """a batch of few large files had as many tasks as files for all parsing."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.inp").write_text("\n".join(f"line {i}" for i in range(400)))
    seen = []

    def merge(batch, number):
        seen.append(batch.groupBy(F.spark_partition_id()).agg(F.count("*"), F.min("line_no"), F.max("line_no")).collect())

    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be put together again
    spark.conf.set(key, "false")
    try:
        ingest.stream_ingest(ingest.stream_lines(spark, str(tmp_path / "in")), merge, str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        spark.conf.unset(key)
    assert len(seen) == 1 and len(seen[0]) > 1
    assert sum(r[1] for r in seen[0]) == 400 and min(r[2] for r in seen[0]) == 0 and max(r[3] for r in seen[0]) == 399
