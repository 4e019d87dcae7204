"""A catalog that grows by batches, each of them one commit of all its tables.

A batch writes what it adds to each table into a folder of its own and then one row of the manifest, which names that folder: until then nobody reads it, and
from then on everybody reads all of it. A batch that comes again finds its row and changes nothing; an attempt that died has left a folder that no row names, and the
next one takes a new folder. Stored rows are never rewritten. `compact` folds all folders into one.

Tables: books (BOOK_COLUMNS), authors (author_id, name), genres (genre_id, code), series (series_id, name), book_authors, book_genres, log (source, records, added_at).
One writer at a time, as of a streaming query. Readers see the commits that were there when they asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ids import assign_ids
from foliospark.operators.ingest import BOOK_COLUMNS, KEY, added_books
from foliospark.storage import written

SCHEMAS = {
    "books": "book_id long, title string, series string, series_no long, file_name string, zip string, format string, file_size long, language string, del int, added_at timestamp",
    "authors": "author_id long, name string", "genres": "genre_id long, code string", "series": "series_id long, name string",
    "book_authors": "book_id long, author_id long", "book_genres": "book_id long, genre_id long", "log": "source string, records long, added_at timestamp",
}
#: Of each dimension: the records' column, whether that is a list, its id and name.
DIMENSIONS = {"authors": ("authors", True, "author_id", "name"), "genres": ("genres", True, "genre_id", "code"), "series": ("series", False, "series_id", "name")}
BRIDGES = {"book_authors": "authors", "book_genres": "genres"}
MANIFEST = "batch long, folder string, base boolean"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, folder, base): the commits of a catalog; none where there is no catalog yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_catalog(spark: SparkSession, path: str, before: int | None = None) -> dict[str, DataFrame]:
    """The tables of all commits, or of those of batches below `before`. The driver sees one row per commit since the last compaction."""
    rows = manifest(spark, path)
    rows = sorted((rows if before is None else rows.where(F.col("batch") < before)).collect(), key=lambda r: (r.batch, r.base))
    last = max((i for i, r in enumerate(rows) if r.base), default=0)
    folders = [r.folder for r in rows[last:]]
    read = lambda name, schema: spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/data/{f}/{name}" for f in folders))
    return {name: read(name, schema) if folders else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def commit(spark: SparkSession, path: str, number: int, tables: dict[str, DataFrame], base: bool = False) -> None:
    """Writes the rows that a batch adds, then its row of the manifest."""
    folder = f"{number}-{uuid.uuid4().hex}"
    for name, schema in SCHEMAS.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        tables[name].select(*columns).write.parquet(f"{path.rstrip('/')}/data/{folder}/{name}")
    row = spark.createDataFrame([(number, folder, base)], MANIFEST).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest/{number}{'-base' if base else ''}")


def additions(records: DataFrame, stored: dict[str, DataFrame], added_at) -> dict[str, DataFrame]:
    """What resolved records add to each table: books of new keys, names of new entities, links of new and stored books that are not there yet."""
    records = written(records)
    out = {"books": written(added_books(records, stored["books"], added_at))}
    books = stored["books"].select("book_id", *KEY).unionByName(out["books"].select("book_id", *KEY))
    # names meet books by their id alone: keys are long, and a record has many names
    linked = written(records.select(*KEY, *(DIMENSIONS[name][0] for name in BRIDGES.values())).join(books, KEY).drop(*KEY))
    links: dict[str, DataFrame] = {}
    for name, (column, many, id_col, name_col) in DIMENSIONS.items():
        each = lambda rows, *keys: rows.select(*keys, (F.explode(F.array_distinct(column)) if many else F.col(column)).alias(name_col)).where(F.col(name_col).isNotNull())  # noqa: B023, E731
        known = assign_ids(each(records), stored[name], name_col, id_col)
        out[name] = written(known.join(stored[name].select(name_col), name_col, "left_anti").select(id_col, name_col))
        if name in BRIDGES.values():
            links[name] = each(linked, "book_id").join(stored[name].unionByName(out[name]), name_col).select("book_id", id_col).distinct()
    for bridge, name in BRIDGES.items():
        out[bridge] = links[name].join(stored[bridge], links[name].columns, "left_anti")
    sources = records.groupBy("source").agg(F.count("*").alias("records"))
    return out | {"log": sources.withColumn("added_at", F.lit(added_at).cast("timestamp"))}


def merge_all(path: str, added_at) -> Callable[[DataFrame, int], None]:
    """What a stream of resolved records (with their source) runs for every micro-batch."""

    def merge(records: DataFrame, number: int) -> None:
        spark = records.sparkSession
        if manifest(spark, path).where((F.col("batch") == number) & ~F.col("base")).limit(1).count():
            return
        commit(spark, path, number, additions(records, read_catalog(spark, path, number), added_at))

    return merge


def compact(spark: SparkSession, path: str) -> None:
    """All commits so far as one: later readers and batches read a single folder of each table. Links are clustered by book."""
    last = manifest(spark, path).agg(F.max("batch")).first()[0]
    if last is None:
        return
    tables = read_catalog(spark, path)
    commit(spark, path, last, {n: t.repartition("book_id").sortWithinPartitions("book_id") if n in BRIDGES else t for n, t in tables.items()}, base=True)
