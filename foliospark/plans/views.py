"""The catalog's tables, as the given tables hold them, and the same views in SQL for the oracle queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ids import assign_ids


class Catalog:
    """Lazy views: each is built when asked for; dimensions, whose ids are written, once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def authors(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_name")
        rows = self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select((F.col("s_suppkey") + 1).cast("long").alias("author_id"), F.concat_ws(" ", "n_name", "s_name").alias("name"))

    def series(self) -> DataFrame:
        return self.once("series", lambda: assign_ids(self.table("part").select(F.col("p_brand").alias("name")), None, "name", "series_id"))

    def _codes(self) -> DataFrame:
        part = self.table("part").select((F.col("p_partkey") + 1).cast("long").alias("book_id"), "p_type", "p_size")
        codes = F.array(F.lower("p_type"), F.concat(F.lit("size_"), (F.col("p_size") % 10).cast("string")))
        return part.select("book_id", F.explode(F.array_distinct(codes)).alias("code"))

    def genres(self) -> DataFrame:
        return self.once("genres", lambda: assign_ids(self._codes().select("code"), None, "code", "genre_id"))

    def book_genres(self) -> DataFrame:
        return self._codes().join(self.genres(), "code").select("book_id", "genre_id")

    def book_authors(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_partkey") + 1).cast("long").alias("book_id"), (F.col("l_suppkey") + 1).cast("long").alias("author_id")).distinct()

    def books(self) -> DataFrame:
        added = self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("added_at"))
        part = self.table("part").join(self.series(), F.col("p_brand") == F.col("name")).join(added, "p_partkey", "left")
        key, size = F.col("p_partkey"), F.col("p_size")
        tail = F.when(key % 4 == 1, F.concat(F.lit(" "), size.cast("string"))).when(key % 4 == 2, F.concat(F.lit(": "), F.lower("p_type"))).when(key % 4 == 3, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise("")
        pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (key % n).cast("int") + 1)
        return part.select(
            (key + 1).cast("long").alias("book_id"), F.concat("p_name", tail).alias("title"), F.when(key % 3 != 0, F.col("series_id")).alias("series_id"), (size % 8).cast("long").alias("series_no"),
            F.concat(F.lit("b"), key.cast("string"), F.when(key % 5 == 4, ".epub").otherwise("")).alias("file_name"), F.concat(F.lit("arc-"), (key % 7).cast("string"), F.lit(".zip")).alias("zip"),
            pick(5, ["fb2", "epub", "pdf", "unknown", ""]).alias("format"), (size.cast("long") * 100000 + key).alias("file_size"), pick(6, ["ru", "en", "de", "unknown", "rus", "en"]).alias("language"),
            F.when(key % 20 == 0, 1).otherwise(0).alias("del"), "added_at",
        )

    def shelf_events(self, events: DataFrame | None = None) -> DataFrame:
        rows = (self.table("events") if events is None else events).where(F.col("event_type").isin("click", "purchase", "error"))
        book = F.get_json_object("props", "$.k").cast("long") + 1
        return rows.select("event_id", "ts", "user_id", book.alias("book_id"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))

    def text_books(self, whole: bool = False) -> DataFrame:
        title = F.col("text") if whole else F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
        return self.table("documents").select((F.col("doc_id") + 1).alias("book_id"), title.alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"), F.col("n_chars").alias("file_size"))


VIEWS = """with authors as (
  select s_suppkey + 1 as author_id, n_name || ' ' || s_name as name from supplier join nation on s_nationkey = n_nationkey
), series as (
  select row_number() over (order by name) as series_id, name from (select distinct p_brand as name from part)
), book_genre_codes as (
  select p_partkey + 1 as book_id, lower(p_type) as code from part union select p_partkey + 1, 'size_' || cast(p_size % 10 as varchar) from part
), genres as (
  select row_number() over (order by code) as genre_id, code from (select distinct code from book_genre_codes)
), book_genres as (
  select book_id, genre_id from book_genre_codes join genres using (code)
), book_authors as (
  select distinct l_partkey + 1 as book_id, l_suppkey + 1 as author_id from lineitem
), books as (
  select p_partkey + 1 as book_id,
    p_name || case p_partkey % 4 when 1 then ' ' || cast(p_size as varchar) when 2 then ': ' || lower(p_type) when 3 then ' (' || p_brand || ')' else '' end as title,
    case when p_partkey % 3 = 0 then null else series_id end as series_id, cast(p_size % 8 as bigint) as series_no,
    'b' || cast(p_partkey as varchar) || case p_partkey % 5 when 4 then '.epub' else '' end as file_name, 'arc-' || cast(p_partkey % 7 as varchar) || '.zip' as zip,
    case p_partkey % 5 when 0 then 'fb2' when 1 then 'epub' when 2 then 'pdf' when 3 then 'unknown' else '' end as format, cast(p_size as bigint) * 100000 + p_partkey as file_size,
    case p_partkey % 6 when 0 then 'ru' when 1 then 'en' when 2 then 'de' when 3 then 'unknown' when 4 then 'rus' else 'en' end as language,
    case when p_partkey % 20 = 0 then 1 else 0 end as del, added_at
  from part join series on p_brand = series.name left join (select l_partkey, max(l_shipdate) as added_at from lineitem group by l_partkey) on l_partkey = p_partkey
), shelf_events as (
  select event_id, ts, user_id, cast(json_extract_string(props, '$.k') as bigint) + 1 as book_id, case event_type when 'error' then 'remove' else 'add' end as action
  from events where event_type in ('click', 'purchase', 'error')
), text_books as (
  select doc_id + 1 as book_id, substring(split_part(text, chr(10), 1), 1, 60) as title, source as author, lang as language, n_chars as file_size from documents
), wide as (
  select b.*, s.name as series,
    coalesce(ba.author, '') as author, coalesce(bg.genre, '') as genre, coalesce(ba.authors, []) as authors
  from books b left join series s on s.series_id = b.series_id
  left join (select book_id, string_agg(name, ', ' order by author_id) as author, list(name order by author_id) as authors from book_authors join authors using (author_id) group by book_id) ba on ba.book_id = b.book_id
  left join (select book_id, string_agg(code, ', ' order by genre_id) as genre from book_genres join genres using (genre_id) group by book_id) bg on bg.book_id = b.book_id
), tok as (
  select book_id, field, unnest(list_distinct(regexp_extract_all(lower(txt), '[\\p{L}\\p{Nd}]+'))) as token from (
    select book_id, 'title' as field, title as txt from wide union all select book_id, 'author', author from wide union all select book_id, 'series', series from wide) where txt is not null
)
"""
