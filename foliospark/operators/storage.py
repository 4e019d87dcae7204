"""A catalog stored for its reads: books and bridges in buckets, books also in folders by ingest date.

Books and bridges have the same buckets of book_id, so lists of names and new links read the stored side without an exchange; bridges
carry the name beside the id, so a list of names needs no dimension. A bridge may be stored once more in buckets of its entity's id, from which
the books of given entities are found: then only ids and hits are exchanged. A filter on `added` (the start of the year, month or day of added_at) prunes
folders. Files are external: `open_catalog` registers them in another session.

Defined results: books without a date are in the folder of null; a link whose book or id is null is not stored; links that repeat are stored once;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets at least, and rows of a bucket.
BUCKETS, BUCKET_ROWS = 64, 500_000


def _save(df: DataFrame, table: str, path: str, buckets: int, mode: str, key: str = "book_id", *folders: str) -> None:
    """One file a bucket (and folder): rows are dealt as the buckets are."""
    out = df.repartition(buckets, key).write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    (out.partitionBy(*folders) if folders else out).saveAsTable(table)


def buckets_for(links: DataFrame, least: int = BUCKETS) -> int:
    """A number of buckets, a power of two times `least`, in which a bucket has BUCKET_ROWS of these links on average at most: what the task that sorts or reads a bucket holds does not grow with the catalog."""
    n, buckets = links.count(), least
    while n > buckets * BUCKET_ROWS:
        buckets *= 2
    return buckets


def named_links(bridge: DataFrame, dim: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(book_id, id_col, name_col), each once."""
    return bridge.join(dim.select(id_col, name_col), id_col).where(F.col("book_id").isNotNull()).select("book_id", id_col, name_col).distinct()


def store_catalog(books: DataFrame, links: dict[str, DataFrame], prefix: str, path: str, buckets: int = BUCKETS, every: str = "month", keys: dict[str, str] | None = None) -> None:
    """Writes the tables `prefix`_books and `prefix`_{name} for every entry of links (book_id, id, name), in buckets of keys[name] or else book_id; `every`: year, month or day."""
    _save(books.withColumn("added", F.date_trunc(every, "added_at").cast("date")), f"{prefix}_books", f"{path}/books", buckets, "overwrite", "book_id", "added")
    for name, df in links.items():
        _save(df, f"{prefix}_{name}", f"{path}/{name}", buckets, "overwrite", (keys or {}).get(name, "book_id"))


def open_catalog(spark: SparkSession, names: list[str], prefix: str, path: str, buckets: int = BUCKETS, keys: dict[str, str] | None = None) -> None:
    """Registers stored tables in a session that does not know them; names: books, and those of the links. buckets and keys must be as stored. Books stored empty have no file, so no columns to open."""
    for name in names:
        table, key = f"{prefix}_{name}", (keys or {}).get(name, "book_id")
        types = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{path}/{name}").schema} | ({"added": "date"} if name == "books" else {})
        columns = ", ".join(f"`{column}` {kind}" for column, kind in types.items())
        folders = "PARTITIONED BY (added)" if name == "books" else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {folders} CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        if folders:
            spark.catalog.recoverPartitions(table)


def names_of_books(links: DataFrame, id_col: str, name_col: str, out: str) -> DataFrame:
    """(book_id, out): the names of each book in order of their id, joined by a comma; no exchange on stored links."""
    names = F.sort_array(F.collect_list(F.struct(id_col, name_col)))[name_col]
    return links.groupBy("book_id").agg(F.array_join(names, ", ").alias(out))


def missing_links(stored: DataFrame, fresh: DataFrame, id_col: str, key: str = "book_id") -> DataFrame:
    """Distinct rows of fresh (book_id, id_col, ..) that are not stored: only fresh rows are exchanged.

    Rows meet by the key of the buckets alone, and are told apart by the other column within the join.
    """
    other = id_col if key == "book_id" else "book_id"
    have = stored.select(F.col(key).alias("stored_key"), F.col(other).alias("stored_other"))
    same = (F.col(key) == F.col("stored_key")) & (F.col(other) <= F.col("stored_other")) & (F.col(other) >= F.col("stored_other"))
    known = fresh.where(F.col(key).isNotNull() & F.col(other).isNotNull()).distinct()
    return known.join(have, same, "left_anti")


def append_links(fresh: DataFrame, name: str, id_col: str, prefix: str, path: str, buckets: int = BUCKETS, key: str = "book_id") -> None:
    """Adds what is not stored yet; the same rows again change nothing."""
    stored = fresh.sparkSession.table(f"{prefix}_{name}")
    _save(missing_links(stored, fresh.select(*stored.columns), id_col, key), f"{prefix}_{name}", f"{path}/{name}", buckets, "append", key)
