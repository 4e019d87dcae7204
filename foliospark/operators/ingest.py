"""From index lines to the catalog: records, archives, first records, merge, links, counts, the ingest log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.ranks import range_ranked

# Fixed value: the default record layout.
DEFAULT_LAYOUT = "author;genre;title;series;serno;file;size;libid;del;ext;date;insno;folder;lang;librate;keywords"
KEY = ["title", "file_name", "zip"]


def parse_records(lines: DataFrame, layout: str = DEFAULT_LAYOUT) -> DataFrame:
    """lines: (source, member, line_no, line) and, if known, collection and layout. Fields are separated by \\x04 or |; bad integers are 0.

    A line without a folder is in the archive that its collection's name gives. A line's layout (of its source, as `read_layout` gives it) says which field stands where;
    lines without one have the layout of the call. Of a field that a layout names twice the first place counts.
    """
    own = F.coalesce(F.nullif(F.trim("layout"), F.lit("")), F.lit(layout)) if "layout" in lines.columns else F.lit(layout)
    names = F.split(X.trimmed(F.lower(F.regexp_replace(own, "(?U)\\s*;\\s*", ";"))), ";")
    # a generator, below which no filter on a field goes: a line is split once
    parts = F.explode(F.array(F.split("line", "[|\x04]")))
    place = lambda name: F.array_position("names", name).cast("int") - 1

    def field(name: str) -> Column:
        return X.trimmed(F.coalesce(F.get("parts", place(name)), F.lit("")))

    number = lambda name: F.coalesce(field(name).try_cast("bigint"), F.lit(0).cast("bigint"))
    authors = F.when(place("author") >= 0, X.parse_authors(field("author"))).otherwise(F.array().cast("array<string>"))
    collection = F.coalesce(F.col("collection"), F.lit("")) if "collection" in lines.columns else F.lit("")
    base = F.regexp_replace(F.regexp_extract(F.regexp_replace(collection, "/+$", ""), "[^/]*$", 0), "\\.inp$", "")
    return lines.withColumn("names", names).select("*", parts.alias("parts")).select(
        "source", "member", "line_no", field("title").alias("title"), F.nullif(field("series"), F.lit("")).alias("series"), number("serno").alias("series_no"), field("file").alias("file_name"),
        F.coalesce(F.nullif(field("folder"), F.lit("")), F.concat(F.lower(base), F.lit(".zip"))).alias("folder"), F.lower(field("ext")).alias("format"), number("size").alias("file_size"),
        F.coalesce(F.nullif(field("lang"), F.lit("")), F.lit("unknown")).alias("language"), number("del").cast("int").alias("del"), authors.alias("authors"), X.split_genres(field("genre")).alias("genres"),
    )


def with_layouts(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """lines with the layout and collection of their source; layouts: (source, layout, collection), one row per source."""
    return lines.join(layouts.select("source", "layout", "collection"), "source", "left")


def located(records: DataFrame, archives: DataFrame) -> DataFrame:
    """records with zip: the archive of that exact name, else the smallest one equal but for case, else null. archives: (zip), one row per file."""
    exact = archives.select(F.col("zip").alias("folder"), F.col("zip").alias("exact")).distinct()
    loose = archives.groupBy(F.lower("zip").alias("folded")).agg(F.min("zip").alias("loose"))
    found = records.join(exact, "folder", "left").withColumn("folded", F.lower("folder")).join(loose, "folded", "left")
    return found.withColumn("zip", F.coalesce("exact", "loose")).drop("exact", "loose", "folded", "folder")


def resolve_archive(records: DataFrame, archives: DataFrame) -> DataFrame:
    """The located records whose archive is there."""
    return located(records, archives).where(F.col("zip").isNotNull())


def is_valid() -> Column:
    return (F.col("del") != 1) & (F.col("title") != "") & (F.col("file_name") != "") & (F.size("authors") > 0)


def valid_records(records: DataFrame) -> DataFrame:
    return records.where(is_valid())


def checked_records(lines: DataFrame, archives: DataFrame) -> DataFrame:
    """All parsed lines with zip and sent: whether they go into the catalog."""
    return located(parse_records(lines), archives).withColumn("sent", is_valid() & F.col("zip").isNotNull())


def observed_records(checked: DataFrame, counts: Observation) -> DataFrame:
    """The records that go into the catalog; `counts` has parsed and sent once an action has run over them: no read of their own."""
    return checked.observe(counts, F.count(F.lit(1)).alias("parsed"), F.count_if("sent").alias("sent")).where("sent").drop("sent")


def first_record(records: DataFrame) -> DataFrame:
    """One row per natural key, the first by (source, member, line_no)."""
    order = Window.partitionBy(*KEY).orderBy("source", "member", "line_no")
    return records.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def new_books(records: DataFrame, books: DataFrame) -> DataFrame:
    return records.join(books.select(*KEY), KEY, "left_anti")


BOOK_COLUMNS = ["book_id", "title", "series", "series_no", "file_name", "zip", "format", "file_size", "language", "del", "added_at"]


def added_books(records: DataFrame, books: DataFrame, added_at) -> DataFrame:
    """The books that the records add to a catalog: ids follow the largest one in order of the key."""
    ranked = range_ranked(new_books(first_record(records), books), [F.concat_ws("\x04", *KEY)], "new_id")
    top = books.agg(F.coalesce(F.max("book_id"), F.lit(0)).alias("top"))
    made = ranked.crossJoin(F.broadcast(top))
    return made.withColumns({"book_id": F.col("top") + F.col("new_id"), "added_at": F.lit(added_at).cast("timestamp")}).select(*BOOK_COLUMNS)


def merge_records(records: DataFrame, books: DataFrame, added_at) -> DataFrame:
    """The catalog's books with those that the records add: stored rows never change."""
    return books.select(*BOOK_COLUMNS).unionByName(added_books(records, books, added_at))


def attach_links(records: DataFrame, books: DataFrame, dim: DataFrame, bridge: DataFrame, names: str, id_col: str, name_col: str) -> DataFrame:
    """(book_id, id_col): the bridge and the links that records give to new and stored books alike."""
    each = records.select(*KEY, F.explode(names).alias(name_col)).distinct()
    linked = each.join(books.select("book_id", *KEY), KEY).join(dim, name_col).select("book_id", id_col)
    return bridge.select("book_id", id_col).unionByName(linked).distinct()


def ingest_counts(checked: DataFrame) -> DataFrame:
    """(source, parsed, sent) of checked records, in one pass."""
    return checked.groupBy("source").agg(F.count("*").alias("parsed"), F.count_if("sent").alias("sent"))


def pending_sources(files: DataFrame, log: DataFrame) -> DataFrame:
    """files: (source, mtime). Those that the log (source, mtime) lacks or has older."""
    known = log.groupBy("source").agg(F.max("mtime").alias("logged"))
    return files.join(known, "source", "left").where(F.col("logged").isNull() | (F.col("mtime") > F.col("logged"))).select("source", "mtime")


def logged(log: DataFrame, done: DataFrame) -> DataFrame:
    return log.select("source", "mtime").unionByName(done.select("source", "mtime")).groupBy("source").agg(F.max("mtime").alias("mtime"))


def write_catalog(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet; rows of bridges and tokens are clustered by book."""
    for name, df in tables.items():
        out = df.repartition("book_id").sortWithinPartitions("book_id") if "book_id" in df.columns and name != "books" else df
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
