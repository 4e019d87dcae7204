"""Index archives, book archives and their members, read by `zips`."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ingest import DEFAULT_LAYOUT
from foliospark.sources import zips
from foliospark.storage import small_batches


def archive_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_members(spark: SparkSession, path: str, pattern: str = "*.zip", keep: str = ".*") -> DataFrame:
    """(source, member, size, content, error); keep: a regular expression on the lower-cased member name."""
    return zips.register(spark).read.format("zip_members").option("pattern", pattern).option("members", keep).load(path)


def members(files: DataFrame, keep: str = ".*") -> DataFrame:
    """The rows of read_members for archives that a table holds whole (path, content): those of stores that only Spark reads, or inside other files."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source", "member", "size", "content", "error"]).astype({"size": "Int64"})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(keep)
        for b in batches:
            rows, held = [], 0
            for path, content in zip(b["path"], b["content"]):
                for row in zips.member_rows(io.BytesIO(content), path, 0, None, wanted):
                    if rows and held + len(row[3] or b"") > zips.BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                    rows.append(row)
                    held += len(row[3] or b"")
            if rows:
                yield frame(rows)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(expand, zips.MEMBER_ROW)


def broken(rows: DataFrame) -> DataFrame:
    """(source, member, error) of what could not be read; member is null where it is the archive itself. rows: of read_members, members or read_index."""
    return rows.where(F.col("error").isNotNull()).select("source", "member", "error")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(source, member, line_no, line, error): what all `.inp` members of index archives hold, lines numbered from 0 as they are read."""
    return zips.register(spark).read.format("zip_lines").option("pattern", "*.inpx").option("members", r".*\.inp").load(path)


def read_inpx(spark: SparkSession, path: str) -> DataFrame:
    """(source, member, line_no, line) of all lines that could be read, dealt out anew; `broken(read_index(..))` has the others' errors."""
    return read_index(spark, path).where(F.col("error").isNull()).drop("error").repartition("source", "member", "line_no")


def index_layout(infos: DataFrame, files: DataFrame) -> DataFrame:
    """(source, layout, collection) of each index (path): structure.info in lower case or the default layout; the first line of collection.info. infos: members."""
    texts = infos.where(F.col("content").isNotNull()).withColumn("text", F.trim(F.decode("content", "utf-8")))
    of = lambda name: F.max(F.when(F.endswith(F.lower("member"), F.lit(name)), F.nullif(F.col("text"), F.lit(""))))
    read = texts.groupBy("source").agg(F.lower(of("structure.info")).alias("layout"), F.split_part(of("collection.info"), F.lit("\n"), F.lit(1)).alias("collection"))
    return files.select(F.col("path").alias("source")).join(read, "source", "left").withColumn("layout", F.coalesce("layout", F.lit(DEFAULT_LAYOUT)))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return index_layout(read_members(spark, path, "*.inpx", r"(.*/)?(structure|collection)\.info"), archive_files(spark, path, "*.inpx"))


def newest_file(files: DataFrame) -> DataFrame:
    """(source, mtime) of the file changed last, of several the one with the largest path; files: (path, modificationTime)."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("source"), F.max("modificationTime").alias("mtime"))


def latest_source(spark: SparkSession, path: str) -> DataFrame:
    return newest_file(archive_files(spark, path, "*.inpx").select("path", "modificationTime"))


def archive_names(files: DataFrame) -> DataFrame:
    """(zip): names of the archives that are there; no content is read."""
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("zip"))


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    return archive_names(archive_files(spark, path, "*.zip"))


def archive_members(rows: DataFrame) -> DataFrame:
    """(zip, member, content) of the members that could be read."""
    return rows.where(F.col("error").isNull()).select(F.regexp_extract("source", "[^/]*$", 0).alias("zip"), "member", "content")


def read_archive_members(spark: SparkSession, path: str) -> DataFrame:
    return archive_members(read_members(spark, path))


def book_members(books: DataFrame, held: DataFrame) -> DataFrame:
    """(book_id, member, content): the member named file_name.format or file_name, else the one with the same base name; names match in either case."""
    full = F.lower(F.concat_ws(".", "file_name", F.nullif(F.col("full_format"), F.lit(""))))
    asked = books.select("book_id", "zip", F.explode(F.array(F.struct(F.lit(1).alias("tier"), full.alias("name")), F.struct(F.lit(2).alias("tier"), F.lower("file_name").alias("name")), F.struct(F.lit(3).alias("tier"), full.alias("name")))).alias("x"))
    base = F.lower(F.regexp_extract("member", "[^/]*$", 0))
    names = held.select("zip", "member", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.lower("member").alias("name")), F.struct(F.lit(2).alias("tier"), F.lower("member").alias("name")), F.struct(F.lit(3).alias("tier"), base.alias("name")))).alias("x"))
    best = asked.join(names, ["zip", "x"]).groupBy("book_id", "zip").agg(F.min(F.struct("x.tier", "member")).alias("best")).select("book_id", "zip", "best.member")
    return best.join(held, ["zip", "member"]).select("book_id", "member", "content")
