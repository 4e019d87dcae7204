"""The registered catalog queries and their SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import bitmaps as BM
from foliospark.operators import books as B
from foliospark.operators import browse as R
from foliospark.operators import feeds as D
from foliospark.operators import ingest as I
from foliospark.operators import search as S
from foliospark.operators import search_many as SM
from foliospark.operators import shelves as H
from foliospark.operators.ids import assign_ids
from foliospark.plans.views import VIEWS, Catalog
from foliospark.sources import metadata as M
from foliospark.storage import new_folder, written
from foliospark.streaming import ingest as T
from foliospark.streaming import shelves as HS

#: name -> (function of Catalog, SQL or None)
_ALL: dict = {}
TITLE, AUTHOR, SERIES, GENRE = "ring", "Supplier 00000000", "brand#1", "size_1 size_2"
#: Genre and language names of the queries: an invented table, as the driver's data has codes of its own.
GENRE_NAMES = (("economy", "Economic tales"), ("small", "Small forms"), ("large", "Large forms"), ("size_1", "Pocket tales"), ("size_2", "Pocket tales"), ("size_3", "Tales of three"))
LANGUAGE_NAMES = (("ru", "Russian"), ("rus", "Russian"), ("en", "English"), ("de", "German"))


def query(name: str, sql: str | None = None):
    def add(f):
        _ALL[name] = (f, VIEWS + sql if sql else None)
        return f

    return add


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def wide(c: Catalog) -> DataFrame:
    return B.wide_books(*tables(c))


def tables(c: Catalog) -> tuple[DataFrame, ...]:
    return c.books(), c.series(), c.authors(), c.genres(), c.book_authors(), c.book_genres()


def named(c: Catalog, rows) -> DataFrame:
    return c.spark.createDataFrame(list(rows), "code string, name string")


# SQL of the text rules
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}]+')"


def low(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def padded(x: str) -> str:
    return f"(' ' || array_to_string({toks(x)}, ' ') || ' ')"


def title_priority(t: str, query: str) -> str:
    return (
        f"case when {low(query)} = '' then 4 when (len({toks(query)}) > 0 and {toks(t)} = {toks(query)}) then 0"
        f" when len({toks(query)}) > 0 and contains({padded(t)}, {padded(query)}) then 1 when len({toks(query)}) > 0 and list_has_all({toks(t)}, {toks(query)}) then 2"
        f" when contains(lower({t}), {low(query)}) then 3 else 4 end"
    )


def author_priority(query: str) -> str:
    words = query.split()
    names = [" ".join(words).lower()] + ([" ".join(words[1:] + words[:1]).lower()] if len(words) > 1 else [])
    terms = " and ".join(f"contains(lower(x), {q(w.lower())})" for w in words) or "false"
    fits = f"list_transform(authors, lambda x: lower(x) in ({', '.join(map(q, names))}) or ({terms}))"
    at = f"coalesce(list_position({fits}, true), 0)"
    return f"case when {at} = 0 then 5 when {at} > 1 then 4 when len(authors) = 1 then 1 when len(authors) = 2 then 2 else 3 end"


TITLE_CLASS = "(case when lower(trim(coalesce(language, ''))) in ('ru', 'rus', 'ru-ru', '', 'unknown') then 0 else 100 end + case when regexp_matches(title, '[\\p{P}\\p{S}]') then 1 else 0 end)"
TITLE_KEY = f"{TITLE_CLASS}, {low('title')}, title"


def prefixes(field: str, text: str) -> str:
    return f"(select count(distinct p) from (select unnest({toks(q(text))}) as p) z where not exists (select 1 from tok where tok.book_id = wide.book_id and tok.field = {q(field)} and starts_with(token, p))) = 0"


# 2.1 sources that derive from the tables, 2.4 and 2.5 ingest
LINES_SQL = """, lines as (
  select book_id, case when book_id % 50 = 0 then 1 else 0 end as gone, case when book_id % 50 = 1 then '' else title end as title, series, series_no, file_name,
    case when book_id % 50 = 2 then 'other.zip' when book_id % 50 = 3 then upper(zip) when book_id % 50 = 4 then 'arc-0.zip' else zip end as folder, format, file_size, language, authors, genre
  from wide where del = 0
), records as (
  select title, series, series_no, file_name, lower(folder) as zip, format, file_size, language, case when len(authors) = 0 then ['Неизвестный автор'] else authors end as authors, genre
  from lines where gone = 0 and title <> '' and folder <> 'other.zip'
)"""


#: What collection.info of the composed index says.
COLLECTION = "lib/ARC-0.inp"


def lines(c: Catalog, active: DataFrame | None = None) -> DataFrame:
    """Index lines composed from the catalog (or from its active wide books as given): some deleted, without a title, of an unknown archive, with its name in capitals or without it."""
    w = B.active_books(wide(c)) if active is None else active
    key = F.col("book_id") % 50
    archive = F.when(key == 2, "other.zip").when(key == 3, F.upper("zip")).when(key == 4, "").otherwise(F.col("zip"))
    none = F.lit("")
    listed = lambda names: F.when(F.size(names) > 0, F.concat(F.array_join(names, ":"), F.lit(":"))).otherwise(none)
    authors, genres = F.replace(listed("authors"), F.lit(" "), F.lit(",")), listed("genres")
    fields = [authors, genres, F.when(key == 1, "").otherwise(F.col("title")), F.coalesce("series", none), F.col("series_no").cast("string"), F.col("file_name"), F.col("file_size").cast("string"), none,
              F.when(key == 0, "1").otherwise("0"), F.col("format"), F.lit("2020-01-01"), none, archive, F.col("language"), none, none]
    return w.select(F.lit("lib.inpx").alias("source"), F.lit("a.inp").alias("member"), F.col("book_id").alias("line_no"), F.concat_ws("\x04", *fields).alias("line"), F.lit(COLLECTION).alias("collection"))


def archives(c: Catalog) -> DataFrame:
    return c.spark.range(7).select(F.concat(F.lit("arc-"), F.col("id").cast("string"), F.lit(".zip")).alias("zip"))


def records(c: Catalog) -> DataFrame:
    return I.resolve_archive(I.valid_records(I.parse_records(lines(c))), archives(c))


@query("parse_records", LINES_SQL + " select book_id as line_no, title, series, series_no, file_name, folder, format, file_size, language, gone as del, array_to_string(case when len(authors) = 0 then ['Неизвестный автор'] else authors end, ';') as authors, replace(genre, ', ', ';') as genres from lines")
def parse_records(c: Catalog) -> DataFrame:
    out = I.parse_records(lines(c))
    return out.select("line_no", "title", "series", "series_no", "file_name", "folder", "format", "file_size", "language", "del", F.array_join("authors", ";").alias("authors"), F.array_join("genres", ";").alias("genres"))


@query("valid_records", LINES_SQL + " select title, file_name, zip, array_to_string(authors, ';') as authors from records")
def valid_records(c: Catalog) -> DataFrame:
    return records(c).select("title", "file_name", "zip", F.array_join("authors", ";").alias("authors"))


@query("merge_records", LINES_SQL + """, stored as (select * from wide where del = 0 and book_id % 3 = 0),
  fresh as (select distinct title, file_name, zip from records r where not exists (select 1 from stored s where s.title = r.title and s.file_name = r.file_name and s.zip = r.zip)),
  ids as (select *, row_number() over (order by title || chr(4) || file_name || chr(4) || zip) as n from fresh)
  select book_id, title, file_name, zip from stored union all select n + (select max(book_id) from stored), title, file_name, zip from ids""")
def merge_records(c: Catalog) -> DataFrame:
    stored = B.active_books(wide(c)).where("book_id % 3 = 0")
    found = written(records(c))
    twice = found.unionByName(found.withColumn("member", F.lit("b.inp")).withColumn("file_size", F.lit(0).cast("bigint")))
    return I.merge_records(twice, stored, "2024-01-01 00:00:00").select("book_id", "title", "file_name", "zip")


@query("assign_ids", "select name, row_number() over (order by name) as author_id from authors where author_id % 2 = 0 union all select name, (select count(*) from authors where author_id % 2 = 0) + row_number() over (order by name) from authors where author_id % 2 = 1")
def assign(c: Catalog) -> DataFrame:
    known = assign_ids(c.authors().where("author_id % 2 = 0").select("name"), None, "name", "author_id")
    return assign_ids(c.authors().select("name"), known, "name", "author_id")


@query("attach_links", LINES_SQL + ", un as (select title, file_name, zip, unnest(authors) as name from records) select distinct book_id, author_id from un join books using (title, file_name, zip) join authors using (name) union select book_id, author_id from book_authors where book_id % 50 = 0")
def attach_links(c: Catalog) -> DataFrame:
    return I.attach_links(records(c), c.books(), c.authors(), c.book_authors().where("book_id % 50 = 0"), "authors", "author_id", "name")


@query("ingest_counts", LINES_SQL + " select 'lib.inpx' as source, (select count(*) from lines) as parsed, (select count(*) from records) as sent")
def ingest_counts(c: Catalog) -> DataFrame:
    return I.ingest_counts(I.checked_records(lines(c), archives(c)))


@query("observed_ingest", LINES_SQL + " select (select count(*) from lines) as parsed, (select count(*) from records) as sent, (select count(*) from records) as written")
def observed_ingest(c: Catalog) -> DataFrame:
    """Counts that the writing of the records itself has observed."""
    counts = Observation("ingest")
    kept = written(I.observed_records(I.checked_records(lines(c), archives(c)), counts))
    found = c.spark.createDataFrame([(counts.get["parsed"], counts.get["sent"])], "parsed long, sent long")
    return found.crossJoin(kept.agg(F.count("*").alias("written")))


#: The second layout of the query: names in other places, a field twice, one that no rule knows.
OTHER_LAYOUT = " Title;FILE;Author;folder;del;other;TITLE;Lang;genre"


@query("layouts_per_source", LINES_SQL + " select 'a.inpx' as source, book_id as line_no, title, file_name, lower(folder) as folder, language, coalesce(series, '') as series, gone as del, array_to_string(case when len(authors) = 0 then ['Неизвестный автор'] else authors end, ';') as authors, replace(genre, ', ', ';') as genres, file_size from lines where book_id % 2 = 0 union all select 'b.inpx', book_id, title, file_name, lower(folder), language, '', gone, array_to_string(case when len(authors) = 0 then ['Неизвестный автор'] else authors end, ';'), replace(genre, ', ', ';'), 0 from lines where book_id % 2 = 1")
def layouts_per_source(c: Catalog) -> DataFrame:
    """Two indexes of different layouts in one job."""
    told = lines(c).withColumn("parts", F.split("line", "\x04")).withColumn("odd", F.col("line_no") % 2 == 1)
    at = lambda i: F.get("parts", F.lit(i))
    other = F.concat_ws("|", at(2), at(5), at(0), at(12), at(8), F.lit("x"), F.lit("y"), at(13), at(1))
    both = told.select(F.when(F.col("odd"), "b.inpx").otherwise("a.inpx").alias("source"), "member", "line_no", F.when(F.col("odd"), other).otherwise(F.col("line")).alias("line"))
    layouts = c.spark.createDataFrame([("a.inpx", None, COLLECTION), ("b.inpx", OTHER_LAYOUT, COLLECTION)], "source string, layout string, collection string")
    out = I.parse_records(I.with_layouts(both, layouts))
    return out.select("source", "line_no", "title", "file_name", F.lower("folder").alias("folder"), "language", F.coalesce("series", F.lit("")).alias("series"), "del", F.array_join("authors", ";").alias("authors"), F.array_join("genres", ";").alias("genres"), "file_size")


@query("pending_sources", ", f as (select zip as source, max(added_at) as mtime from books where added_at is not null group by zip), l as (select zip as source, max(added_at) as mtime from books where added_at is not null and book_id % 3 = 0 and zip <> 'arc-2.zip' group by zip) select f.source, f.mtime from f left join l on f.source = l.source where l.mtime is null or f.mtime > l.mtime")
def pending_sources(c: Catalog) -> DataFrame:
    dated = c.books().where("added_at is not null").select(F.col("zip").alias("source"), F.col("added_at").alias("mtime"), "book_id")
    files = dated.groupBy("source").agg(F.max("mtime").alias("mtime"))
    return I.pending_sources(files, dated.where("book_id % 3 = 0 and source <> 'arc-2.zip'"))


# 2.2 projections and filters
@query("wide_books", "select book_id, title, series, author, genre, case when format in ('', 'unknown') then case when file_name like '%.epub' then 'epub' else 'unknown' end else format end as full_format from wide")
def wide_books(c: Catalog) -> DataFrame:
    return wide(c).select("book_id", "title", "series", "author", "genre", "full_format")


@query("filter_language", "select book_id, title from books where del = 0 and language = 'en'")
def filter_language(c: Catalog) -> DataFrame:
    return B.filter_language(B.active_books(c.books()), "en").select("book_id", "title")


@query("filter_genre", "select book_id, title from books where book_id in (select book_id from book_genres join genres using (genre_id) where code in ('size_1', 'size_2'))")
def filter_genre(c: Catalog) -> DataFrame:
    return B.filter_genre(c.books(), c.book_genres(), c.genres(), GENRE).select("book_id", "title")


@query("series_filters", "select book_id, case when series is null then 'none' else series end as kind from wide where series is null or series = 'Brand#7'")
def series_filters(c: Catalog) -> DataFrame:
    w = wide(c).select("book_id", "series")
    return B.without_series(w).select("book_id", F.lit("none").alias("kind")).unionByName(B.in_series(w, "Brand#7").select("book_id", F.col("series").alias("kind")))


# 2.3 search
@query("book_tokens", "select book_id, field, token from tok")
def book_tokens(c: Catalog) -> DataFrame:
    return S.book_tokens(wide(c))


@query("match_queries", ", queries as (select author_id * 3 as query_id, 'author' as field, name as text from authors union all select series_id * 3 + 1, 'series', name from series union all select distinct p_size * 3 + 2, 'title', substring(p_name, 1, 5) || ' ' || cast(p_size as varchar) from part), wanted as (select query_id, field, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'))) as prefix from (select distinct on (query_id) * from queries order by query_id, text)), met as (select query_id, book_id, count(distinct prefix) as met from wanted join tok on tok.field = wanted.field and starts_with(token, prefix) group by 1, 2) select query_id, book_id from met join (select query_id, count(*) as needed from wanted group by 1) using (query_id) where met = needed")
def match_queries(c: Catalog) -> DataFrame:
    part = c.table("part").select((F.col("p_size") * 3 + 2).cast("long").alias("query_id"), F.concat_ws(" ", F.substring("p_name", 1, 5), F.col("p_size").cast("string")).alias("text"))
    titles = part.groupBy("query_id").agg(F.min("text").alias("text")).withColumn("field", F.lit("title"))
    names = c.authors().select((F.col("author_id") * 3).alias("query_id"), F.lit("author").alias("field"), F.col("name").alias("text"))
    series = c.series().select((F.col("series_id") * 3 + 1).alias("query_id"), F.lit("series").alias("field"), F.col("name").alias("text"))
    return S.match_queries(names.unionByName(series).unionByName(titles), S.book_tokens(wide(c)))


@query("match_queries_all")
def match_queries_all(c: Catalog) -> DataFrame:
    """As match_queries, with a title query of every distinct text of all part rows. No SQL: a test holds it against Python."""
    return S.match_queries(all_queries(c), S.book_tokens(wide(c)))


def all_queries(c: Catalog) -> DataFrame:
    """(query_id, field, text): a query for each author, series and distinct title text."""
    texts = c.table("part").select(F.concat_ws(" ", F.substring("p_name", 1, 5), F.col("p_size").cast("string")).alias("text"))
    titles = assign_ids(texts, None, "text", "n").select((F.col("n") * 3 + 2).alias("query_id"), F.lit("title").alias("field"), "text")
    names = c.authors().select((F.col("author_id") * 3).alias("query_id"), F.lit("author").alias("field"), F.col("name").alias("text"))
    series = c.series().select((F.col("series_id") * 3 + 1).alias("query_id"), F.lit("series").alias("field"), F.col("name").alias("text"))
    return names.unionByName(series).unionByName(titles)


def tiers_sql(dim: str, id_col: str, field: str, text: str, exact: str, least: int, fallback: str) -> str:
    return f""", hits as (select * from (select {id_col}, name, case when {exact} then 1 when lower(name) like lower({q(text)}) || '%' then 2 when lower(name) like '%' || lower({q(text)}) || '%' then 3 end as tier from {dim}) z
      where tier is not null order by tier, name, {id_col} limit 500), more as (select {id_col}, name, 4 as tier from {dim} where {id_col} in ({fallback}) order by name, {id_col} limit 500)
      select {id_col}, name, tier from hits union all select {id_col}, name, tier from more where {id_col} not in (select {id_col} from hits) and (select count(*) from hits) < {least}"""


@query("find_authors", tiers_sql("authors", "author_id", "author", "NATION_1 Sup", "name = 'NATION_1 Sup'", 20, f"select author_id from book_authors where book_id in (select book_id from wide where del = 0 and {prefixes('author', 'NATION_1 Sup')})"))
def find_authors(c: Catalog) -> DataFrame:
    return S.find_authors(c.authors(), wide(c), c.book_authors(), "NATION_1 Sup").select("author_id", "name", "tier")


@query("find_series", tiers_sql("series", "series_id", "series", "2 brand", "lower(name) = '2 brand'", 10, f"select series_id from wide where del = 0 and series_id is not null and {prefixes('series', '2 brand')}"))
def find_series(c: Catalog) -> DataFrame:
    return S.find_series(c.series(), wide(c), "2 brand").select("series_id", "name", "tier")


@query("find_genres", "select genre_id, code, case when code = 'size_1' then 1 when code like 'size_1%' then 2 else 3 end as tier from genres where lower(code) like '%size_1%' order by 3, 2 limit 100")
def find_genres(c: Catalog) -> DataFrame:
    return S.find_genres(c.genres(), "size_1").select("genre_id", "code", "tier")


# tables of queries
MANY_AUTHORS = "case author_id % 4 when 0 then substring(name, 3, 9) when 1 then lower(name) when 2 then split_part(name, ' ', 2) || ' ' || substring(name, 1, 4) else right(name, 1) end"


def many_tiers_sql(dim: str, id_col: str, column: str, exact: str, most: int) -> str:
    return f"""hits as (select query_id, {id_col}, {column}, case when {exact} then 1 when lower({column}) like lower(text) || '%' then 2 when lower({column}) like '%' || lower(text) || '%' then 3 end as tier
      from queries cross join {dim} where lower({column}) like '%' || lower(text) || '%' qualify row_number() over (partition by query_id order by tier, {column}, {id_col}) <= {most})"""


def met_sql(field: str) -> str:
    return f"""wanted as (select query_id, unnest(list_distinct({toks('text')})) as prefix from queries), live as (select tok.* from tok join books using (book_id) where del = 0 and field = '{field}'),
      counted as (select query_id, book_id, count(distinct prefix) as met from wanted join live on starts_with(token, prefix) group by 1, 2),
      found as (select query_id, book_id from counted join (select query_id, count(*) as needed from wanted group by 1) using (query_id) where met = needed)"""


@query("find_authors_of", f", queries as (select author_id as query_id, {MANY_AUTHORS} as text from authors), {many_tiers_sql('authors', 'author_id', 'name', 'name = text', 500)}, {met_sql('author')}, more as (select query_id, author_id, name, 4 as tier from (select distinct query_id, author_id from found join book_authors using (book_id)) join authors using (author_id) qualify row_number() over (partition by query_id order by name, author_id) <= 500) select query_id, author_id, name, tier from hits union all select query_id, author_id, name, tier from more where query_id not in (select query_id from hits group by 1 having count(*) >= 20) and (query_id, author_id) not in (select query_id, author_id from hits)")
def find_authors_of(c: Catalog) -> DataFrame:
    """A query of each author: a piece of the name, the name in lower case, its words turned round, its last letter."""
    texts = c.authors().select(F.col("author_id").alias("query_id"), F.expr(MANY_AUTHORS).alias("text"))
    return SM.find_authors_of(texts, c.authors(), S.book_tokens(B.active_books(wide(c))), c.book_authors()).select("query_id", "author_id", "name", "tier")


@query("find_series_of", f", queries as (select series_id as query_id, case when series_id % 2 = 0 then right(name, 2) else split_part(name, '#', 2) || ' ' || substring(name, 1, 3) end as text from series), {many_tiers_sql('series', 'series_id', 'name', 'lower(name) = lower(text)', 500)}, {met_sql('series')}, more as (select query_id, series_id, name, 4 as tier from (select distinct query_id, series_id from found join books using (book_id) where series_id is not null) join series using (series_id)) select query_id, series_id, name, tier from hits union all select query_id, series_id, name, tier from more where query_id not in (select query_id from hits group by 1 having count(*) >= 10) and (query_id, series_id) not in (select query_id, series_id from hits)")
def find_series_of(c: Catalog) -> DataFrame:
    text = F.expr("case when series_id % 2 = 0 then right(name, 2) else concat(split_part(name, '#', 2), ' ', substring(name, 1, 3)) end")
    return SM.find_series_of(c.series().select(F.col("series_id").alias("query_id"), text.alias("text")), c.series(), S.book_tokens(B.active_books(wide(c))), c.books()).select("query_id", "series_id", "name", "tier")


@query("find_genres_of", f", queries as (select genre_id as query_id, substring(code, 2, 5) as text from genres), {many_tiers_sql('genres', 'genre_id', 'code', 'code = text', 100)} select query_id, genre_id, code, tier from hits")
def find_genres_of(c: Catalog) -> DataFrame:
    return SM.find_genres_of(c.genres().select(F.col("genre_id").alias("query_id"), F.substring("code", 2, 5).alias("text")), c.genres()).select("query_id", "genre_id", "code", "tier")


_TITLES_ASKED = "select series_id * 2 as query_id, substring(name, 2) as text from series union all select genre_id * 2 + 1, 'rin ' || substring(code, 1, 3) from genres"


@query("find_titles_of", f", queries as ({_TITLES_ASKED}), live_books as (select * from wide where del = 0), {many_tiers_sql('live_books', 'book_id', 'title', 'lower(title) = lower(text)', 1000)}, {met_sql('title')}, more as (select query_id, book_id from found join books using (book_id) qualify row_number() over (partition by query_id order by added_at desc nulls last, book_id) <= 1000), ids as (select query_id, book_id from hits union all select query_id, book_id from more where query_id not in (select query_id from hits)) select query_id, book_id, row_number() over (partition by query_id order by {title_priority('title', 'text')}, {TITLE_KEY}, book_id) as rank from ids join queries using (query_id) join live_books using (book_id)")
def find_titles_of(c: Catalog) -> DataFrame:
    series = c.series().select((F.col("series_id") * 2).alias("query_id"), F.expr("substring(name, 2)").alias("text"))
    types = c.genres().select((F.col("genre_id") * 2 + 1).alias("query_id"), F.concat(F.lit("rin "), F.substring("code", 1, 3)).alias("text"))
    w = written(wide(c))
    return SM.find_titles_of(series.unionByName(types), w, S.book_tokens(B.active_books(w))).select("query_id", "book_id", "rank")


FOUND_TITLES = f", hits as (select *, case when lower(title) = 'hot ring' then 1 when lower(title) like 'hot ring%' then 2 else 3 end as tier from wide where del = 0 and lower(title) like '%hot ring%' order by tier, title, book_id limit 1000), ranked as (select *, row_number() over (order by {title_priority('title', q('hot ring'))}, {TITLE_KEY}, book_id) as rank from hits)"


@query("find_titles", FOUND_TITLES + " select book_id, title, rank from ranked")
def find_titles(c: Catalog) -> DataFrame:
    return S.find_titles(wide(c), "hot ring").select("book_id", "title", "rank")


@query("find_titles_by_prefix", f", hits as (select * from wide where del = 0 and {prefixes('title', 'ri ho')} order by added_at desc nulls last, book_id limit 1000) select book_id, title, row_number() over (order by {title_priority('title', q('ri ho'))}, {TITLE_KEY}, book_id) as rank from hits")
def find_titles_by_prefix(c: Catalog) -> DataFrame:
    return S.find_titles(wide(c), "ri ho").select("book_id", "title", "rank")


_FOUND = tiers_sql("authors", "author_id", "author", "NATION_3 Supplier", "name = 'NATION_3 Supplier'", 20, f"select author_id from book_authors where book_id in (select book_id from wide where del = 0 and {prefixes('author', 'NATION_3 Supplier')})")
_AT = _FOUND.rindex(" select author_id, name, tier from hits union all")


@query("search_by_type", _FOUND[:_AT] + f", found as ({_FOUND[_AT:]}), rows as (select * from wide where del = 0 and book_id in (select book_id from book_authors where author_id in (select author_id from found))) select book_id, title, row_number() over (order by {author_priority('NATION_3 Supplier')}, len(authors), {TITLE_KEY}, book_id) as rank from rows")
def search_by_type(c: Catalog) -> DataFrame:
    w = wide(c)
    return S.search_by_type("author", "NATION_3 Supplier", w, c.authors(), c.series(), c.genres(), c.book_authors(), c.book_genres()).select("book_id", "title", "rank")


@query("search_by_series", ", hits as (select * from wide where del = 0 and lower(series) like '%brand#1%') select book_id, title, row_number() over (order by series_no, title, book_id) as rank from hits")
def search_by_series(c: Catalog) -> DataFrame:
    return S.search_by_type("series", "brand#1", wide(c), c.authors(), c.series(), c.genres(), c.book_authors(), c.book_genres()).select("book_id", "title", "rank")


@query("advanced_search", f", hits as (select * from wide where del = 0 and language = 'en' and {prefixes('title', 'ring')}), pg as (select * from hits order by title, book_id limit 50) select book_id, title, author, series, row_number() over (order by {title_priority('title', q('ring'))}, {TITLE_KEY}, book_id) as rank, (select count(*) from hits) as total from pg")
def advanced_search(c: Catalog) -> DataFrame:
    return S.advanced_search(*tables(c), 1, 50, title=TITLE, language="en").select("book_id", "title", "author", "series", "rank", "total")


@query("advanced_search_all_filters", f", hits as (select * from wide where del = 0 and {prefixes('title', 're')} and {prefixes('author', 'Supplier NATION')} and {prefixes('series', 'brand')} and book_id in (select book_id from book_genres join genres using (genre_id) where code in ('size_1', 'size_2'))), pg as (select * from hits order by title, book_id limit 20 offset 20) select book_id, title, row_number() over (order by {title_priority('title', q('re'))}, {author_priority('Supplier, NATION').replace('supplier,', 'supplier,')}, {TITLE_KEY}, book_id) as rank, (select count(*) from hits) as total from pg")
def advanced_search_all_filters(c: Catalog) -> DataFrame:
    out = S.advanced_search(*tables(c), 2, 20, title="re", author="Supplier, NATION", series_text="brand", genre=GENRE)
    return out.select("book_id", "title", "rank", "total")


@query("bitmap_matches", ", queries as (select series_id as query_id, 'series' as field, name as text from series union all select genre_id + 100, 'title', substring(code, 1, 4) || ' re' from genres), wanted as (select query_id, field, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'))) as prefix from queries), met as (select query_id, book_id, count(distinct prefix) as met from wanted join tok on tok.field = wanted.field and starts_with(token, prefix) group by 1, 2) select query_id, book_id from met join (select query_id, count(*) as needed from wanted group by 1) using (query_id) where met = needed")
def bitmap_matches(c: Catalog) -> DataFrame:
    """The books of a query of each series and genre, read off the bitmaps."""
    series = c.series().select(F.col("series_id").alias("query_id"), F.lit("series").alias("field"), F.col("name").alias("text"))
    types = c.genres().select((F.col("genre_id") + 100).alias("query_id"), F.lit("title").alias("field"), F.concat(F.substring("code", 1, 4), F.lit(" re")).alias("text"))
    return BM.query_books(series.unionByName(types), written(BM.token_index(S.book_tokens(wide(c)))))


@query("search_totals", ", terms as (select unnest(['ring', 'nation', 'brand', 'zzz']) as term), f as (select unnest(['title', 'author', 'series']) as field) select term, f.field, count(distinct b.book_id) as total from terms cross join f left join tok on tok.field = f.field and starts_with(token, term) left join books b on b.book_id = tok.book_id and del = 0 group by 1, 2")
def search_totals(c: Catalog) -> DataFrame:
    terms = c.spark.createDataFrame([("ring",), ("nation",), ("brand",), ("zzz",)], "term string")
    return BM.search_totals(S.book_tokens(wide(c)), c.books(), terms)


@query("authors_of_matching_books", f"select author_id, name from authors where author_id in (select author_id from book_authors where book_id in (select book_id from wide where del = 0 and {prefixes('author', 'nation_12')})) order by name limit 500")
def authors_of_matching_books(c: Catalog) -> DataFrame:
    return S.authors_of_matching_books(wide(c), c.book_authors(), c.authors(), "nation_12").select("author_id", "name")


@query("series_of_matching_books", f"select series_id, name from series where series_id in (select series_id from wide where del = 0 and series_id is not null and {prefixes('series', '1')}) order by name limit 500")
def series_of_matching_books(c: Catalog) -> DataFrame:
    return S.series_of_matching_books(wide(c), c.series(), "1").select("series_id", "name")


for _kind, _bridge, _id in (("authors", "book_authors", "author_id"), ("genres", "book_genres", "genre_id")):

    @query(f"books_of_{_kind}", f"select book_id, title from books where del = 0 and book_id in (select book_id from {_bridge} where {_id} in (1, 3, 5))")
    def _books_of(c: Catalog, bridge=_bridge, id_col=_id) -> DataFrame:
        ids = c.spark.createDataFrame([(1,), (3,), (5,)], f"{id_col} long")
        return B.books_of(c.books(), getattr(c, bridge)(), ids, id_col).select("book_id", "title")


@query("books_of_series", "select book_id, row_number() over (order by series_no, title, book_id) as place from books where del = 0 and series_id in (1, 3)")
def books_of_series(c: Catalog) -> DataFrame:
    books = B.active_books(c.books()).where(F.col("series_id").isin(1, 3))
    return S.ranked(books, [F.col("series_no"), F.col("title"), F.col("book_id")]).select("book_id", F.col("rank").alias("place"))


# 2.6 windows
@query("rank_by_title", f"select book_id, zip, row_number() over (partition by zip order by {title_priority('title', q('red ring'))}, {TITLE_KEY}, book_id) as rank from wide")
def rank_by_title(c: Catalog) -> DataFrame:
    return S.rank_by_title(wide(c), "red ring", ("zip",)).select("book_id", "zip", "rank")


@query("rank_by_author", f"select book_id, zip, row_number() over (partition by zip order by {author_priority('Supplier#000000003 NATION_1')}, len(authors), {TITLE_KEY}, book_id) as rank from wide")
def rank_by_author(c: Catalog) -> DataFrame:
    return S.rank_by_author(wide(c), "Supplier#000000003 NATION_1", ("zip",)).select("book_id", "zip", "rank")


@query("rank_by_title_author", f"select book_id, zip, row_number() over (partition by zip order by {title_priority('title', q('ring'))}, {author_priority('nation_2')}, {TITLE_KEY}, book_id) as rank from wide")
def rank_by_title_author(c: Catalog) -> DataFrame:
    return S.rank_by_title_author(wide(c), "ring", "nation_2", ("zip",)).select("book_id", "zip", "rank")


ORDERED = ", keyed as (select *, coalesce(nullif(author, ''), 'Неизвестный автор') as author_key, coalesce(series, '') as series_key from wide where del = 0), placed as (select *, row_number() over (partition by author_key, series_key order by case when series_no <> 0 then 0 else 1 end, case when series_no <> 0 then series_no end nulls first, case when series_no = 0 then case when language = 'ru' or language like 'ru-%' then 0 else 1 end end nulls first, case when series_no = 0 then title end nulls first, book_id) as place, min(book_id) over (partition by author_key) as author_first from keyed)"


@query("series_order", ORDERED + " select book_id, author_key, series_key, place, author_first from placed")
def series_order(c: Catalog) -> DataFrame:
    return R.series_order(B.active_books(wide(c))).select("book_id", "author_key", "series_key", "place", "author_first")


@query("neighbours", ORDERED + ", w as (select book_id, author_key, lag(book_id) over x as p, lead(book_id) over x as n, first_value(book_id) over x as f, last_value(book_id) over (partition by author_key order by series_key, place rows between unbounded preceding and unbounded following) as l from placed window x as (partition by author_key order by series_key, place)) select book_id, coalesce(p, l) as previous_id, coalesce(n, f) as next_id from w")
def neighbours(c: Catalog) -> DataFrame:
    return R.neighbours(R.series_order(B.active_books(wide(c))), ["series_key", "place"], ["author_key"]).select("book_id", "previous_id", "next_id")


@query("neighbours_of_all", ORDERED + ", w as (select book_id, lag(book_id) over x as p, lead(book_id) over x as n, first_value(book_id) over x as f, last_value(book_id) over (order by author_first, series_key, place rows between unbounded preceding and unbounded following) as l from placed window x as (order by author_first, series_key, place)) select book_id, coalesce(p, l) as previous_id, coalesce(n, f) as next_id from w")
def neighbours_of_all(c: Catalog) -> DataFrame:
    """The whole list: authors in order of their first book, their series, the books of each; it wraps at both ends."""
    return R.neighbours(R.series_order(B.active_books(wide(c))), ["author_first", "series_key", "place"]).select("book_id", "previous_id", "next_id")


@query("rank_of_all", f"select book_id, row_number() over (order by {title_priority('title', q('red ring'))}, {TITLE_KEY}, book_id) as rank from wide")
def rank_of_all(c: Catalog) -> DataFrame:
    return S.rank_by_title(wide(c), "red ring").select("book_id", "rank")


# 2.5 and 2.7 browse
@query("latest_books", "select book_id, title, added_at from books where del = 0 order by added_at desc nulls last, book_id limit 100")
def latest_books(c: Catalog) -> DataFrame:
    return R.latest_books(c.books(), 100).select("book_id", "title", "added_at")


@query("author_list_counts", f", names as (select distinct name from authors where lower(name) like 'nation_1%' order by name limit 100), w as (select name, unnest(list_distinct({toks('name')})) as p from names), m as (select name, tok.book_id, count(distinct p) as met from w join tok on tok.field = 'author' and starts_with(token, p) join books b on b.book_id = tok.book_id and del = 0 group by 1, 2), k as (select name, count(*) as needed from w group by 1), h as (select name, count(*) as books from m join k using (name) where met = needed group by 1) select names.name, coalesce(books, 0) as books from names left join h using (name)")
def author_list_counts(c: Catalog) -> DataFrame:
    return BM.list_counts(R.authors_with_prefix(c.authors(), "NATION_1"), "name", "author", wide(c))


@query("title_list_counts", f", names as (select distinct title as name from books where del = 0 and lower(title) like 're%' order by 1 limit 100), w as (select name, unnest(list_distinct({toks('name')})) as p from names), m as (select name, tok.book_id, count(distinct p) as met from w join tok on tok.field = 'title' and starts_with(token, p) join books b on b.book_id = tok.book_id and del = 0 group by 1, 2), k as (select name, count(*) as needed from w group by 1), h as (select name, count(*) as books from m join k using (name) where met = needed group by 1) select names.name, coalesce(books, 0) as books from names left join h using (name)")
def title_list_counts(c: Catalog) -> DataFrame:
    return BM.list_counts(R.titles_with_prefix(c.books(), "re"), "title", "title", wide(c))


@query("series_list_counts", f", names as (select distinct name from series order by name limit 1000), w as (select name, unnest(list_distinct({toks('name')})) as p from names), m as (select name, tok.book_id, count(distinct p) as met from w join tok on tok.field = 'series' and starts_with(token, p) join books b on b.book_id = tok.book_id and del = 0 group by 1, 2), k as (select name, count(*) as needed from w group by 1), h as (select name, count(*) as books from m join k using (name) where met = needed group by 1) select names.name, coalesce(books, 0) as books from names left join h using (name)")
def series_list_counts(c: Catalog) -> DataFrame:
    return BM.list_counts(R.series_names(c.series()), "name", "series", wide(c))


@query("series_facets", "select series, count(*) as books from wide where del = 0 group by series")
def series_facets(c: Catalog) -> DataFrame:
    return R.series_facets(B.active_books(wide(c)))


@query("rank_series_facets", f", f as (select series, count(*) as books from wide where del = 0 and series is not null group by series) select series, books, row_number() over (order by {title_priority('series', q('brand#1'))}, lower(series), series) as rank from f")
def rank_series_facets(c: Catalog) -> DataFrame:
    return R.rank_series_facets(B.active_books(wide(c)), "brand#1")


@query("author_series_tree_counts", ", k as (select coalesce(nullif(author, ''), 'Неизвестный автор') as author, coalesce(series, '') as series from wide) select author, series, count(*) as books, cast(grouping_id(author, series) as bigint) as level from k group by rollup(author, series)")
def author_series_tree_counts(c: Catalog) -> DataFrame:
    return R.author_series_tree_counts(wide(c))


@query("library_stats", "select * from (select count(*) as total_books, count(distinct language) as languages, max(added_at) as last_added from books where del = 0) cross join (select count(*) as total_authors, count(distinct author_id) as unique_authors from book_authors) cross join (select count(distinct genre_id) as unique_genres from book_genres)")
def library_stats(c: Catalog) -> DataFrame:
    return R.library_stats(c.books(), c.book_authors(), c.book_genres())


@query("languages_with_all", "select 'Все языки' as language, 0 as place union all select language, row_number() over (order by language) from (select distinct language from books where del = 0)")
def languages_with_all(c: Catalog) -> DataFrame:
    return R.languages_with_all(c.books())


@query("genre_codes", "select code from genres")
def genre_codes(c: Catalog) -> DataFrame:
    return c.genres().select("code")


_NAMES = ", ".join(f"({q(a)}, {q(b)})" for a, b in GENRE_NAMES)
_LANGS = ", ".join(f"({q(a)}, {q(b)})" for a, b in LANGUAGE_NAMES)


@query("genre_names", f", names as (select * from (values {_NAMES}) v(code, name)), e as (select book_id, genre_id, coalesce(names.name, genres.code) as shown from book_genres join genres using (genre_id) left join names on names.code = genres.code) select book_id, string_agg(shown, ', ' order by genre_id) as names from e group by book_id")
def genre_names(c: Catalog) -> DataFrame:
    return R.genre_names(wide(c).select("book_id", "genres"), named(c, GENRE_NAMES))


@query("language_names", f", names as (select * from (values {_LANGS}) v(code, name)) select book_id, coalesce(names.name, language) as language_name from books left join names on code = language")
def language_names(c: Catalog) -> DataFrame:
    return R.language_names(c.books(), named(c, LANGUAGE_NAMES))


# 2.8 sets, shelves
@query("shelf_state", "select user_id, book_id from (select user_id, book_id, arg_max(action, (ts, event_id)) as action from shelf_events group by 1, 2) where action = 'add'")
def shelf_state(c: Catalog) -> DataFrame:
    return H.shelf_state(c.shelf_events())


SHELF = ", shelf as (select distinct user_id, book_id from shelf_events where action = 'add')"


@query("favorites_books", SHELF + " select book_id, title, author from wide where book_id in (select book_id from shelf where user_id = 7)")
def favorites_books(c: Catalog) -> DataFrame:
    shelf = c.shelf_events().where("action = 'add'").select("user_id", "book_id").distinct()
    return H.favorites_books(shelf, wide(c), 7).select("book_id", "title", "author")


@query("flag_favorites", SHELF + " select book_id, book_id in (select book_id from shelf where user_id = 7) as on_shelf from books")
def flag_favorites(c: Catalog) -> DataFrame:
    shelf = c.shelf_events().where("action = 'add'").select("user_id", "book_id").distinct()
    return H.flag_favorites(c.books().select("book_id"), shelf, 7)


@query("edit_favorites", SHELF + " select user_id, book_id from (select * from shelf union select user_id, book_id + 1 from shelf) where (user_id, book_id) not in (select user_id, book_id from shelf_events where action = 'remove')")
def edit_favorites(c: Catalog) -> DataFrame:
    shelf = c.shelf_events().where("action = 'add'").select("user_id", "book_id").distinct()
    more = H.add_favorites(shelf, shelf.select("user_id", (F.col("book_id") + 1).alias("book_id")))
    return H.remove_favorites(more, c.shelf_events().where("action = 'remove'"))


# 2.9 text functions over titles with accents and marks
@query("text_functions", f"select book_id, array_to_string({toks('title')}, ' ') as tokens, {low('title')} as folded, {TITLE_CLASS} as class, {title_priority('title', q('the of'))} as priority, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as code, printf('%.2f', file_size / 1048576.0) as mb, trim(regexp_replace(trim(title), '[/\\\\:*?\"<>|\\p{{Cc}}]', '', 'g')) as safe from (select doc_id + 1 as book_id, text as title, lang as language, n_chars as file_size from documents)")
def text_functions(c: Catalog) -> DataFrame:
    return _text_functions(c.text_books(whole=True))


@query("text_functions_whole")
def text_functions_whole(c: Catalog) -> DataFrame:
    """The text functions over whole texts. No SQL: a test holds it against Python."""
    return _text_functions(c.text_books(whole=True))


def _text_functions(t: DataFrame) -> DataFrame:
    return t.select(
        "book_id", F.array_join(X.tokens("title"), " ").alias("tokens"), X.squeeze_lower("title").alias("folded"), X.title_class("language", "title").alias("class"), X.title_priority("title", F.lit("the of")).alias("priority"),
        X.normalize_genre_code("title").alias("code"), X.size_mb("file_size").alias("mb"), X.safe_filename("title").alias("safe"),
    )


@query("feed_entries", "select book_id, 'urn:uuid:book-' || book_id as id, case when series is null then title when series_no > 0 then '#' || series_no || ' ' || title else '— ' || title end as title, strftime(added_at, '%Y-%m-%dT%H:%M:%SZ') as updated, case when series is null then 'Автор: ' || author || '. Жанр: ' || genre || '. Формат: ' else 'Автор: ' || author || '. Серия: ' || series || ' (№' || series_no || '). Жанр: ' || genre || '. Формат: ' end || case when format in ('', 'unknown') then case when file_name like '%.epub' then 'epub' else 'unknown' end else format end as text from wide")
def feed_entries(c: Catalog) -> DataFrame:
    return D.feed_entries(wide(c), "http://library", True).select("book_id", "id", "title", "updated", "text")


@query("export_search_json")
def export_search_json(c: Catalog) -> DataFrame:
    rows = S.advanced_search(*tables(c), 1, 50, title=TITLE, language="en").select("book_id", "title", "author", "series", "rank", "total")
    return D.search_json(rows, R.languages_with_all(c.books()), 1, 50)


@query("suggest_genres", ", f as (select name, min(instr(lower(name), '#1')) as pos, min(cast(series_id as varchar)) as code from series where instr(lower(name), '#1') > 0 group by name) select name, code, cast(pos as integer) as \"at\" from f order by pos, name limit 5")
def suggest_genres(c: Catalog) -> DataFrame:
    return R.suggest_genres(c.series().select(F.col("series_id").cast("string").alias("code"), "name"), "#1")


@query("genre_codes_for", "select distinct p_brand as code from part where lower(trim(p_name)) = 'red plate'")
def genre_codes_for(c: Catalog) -> DataFrame:
    return R.genre_codes_for(c.table("part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")).distinct(), " Red Plate ")


@query("cover_and_download", "select book_id, case when format in ('fb2', 'epub') then 'http://h/api/cover?file=' || file_name || '&format=' || format || '&zip=' || zip end as cover, coalesce(nullif(regexp_replace(title, '[/\\\\:*?\"<>|]', '', 'g'), ''), 'book') || ' - ' || author || ' (' || language || ').' || format as download from wide")
def cover_and_download(c: Catalog) -> DataFrame:
    cover = F.when(F.col("format").isin(*D.COVER_FORMATS), D.cover_url("http://h", "file_name", "format", "zip"))
    return wide(c).select("book_id", cover.alias("cover"), D.download_name("title", "author", "language", "format").alias("download"))


@query("book_count", "select count(*) as books from books where del = 0")
def book_count(c: Catalog) -> DataFrame:
    return R.book_count(c.books())


@query("file_names", """, f as (select *, case when format in ('', 'unknown') then case when file_name like '%.epub' then 'epub' else 'unknown' end else format end as full_format from wide)
  select book_id, case full_format when 'fb2' then 'application/fb2' when 'epub' then 'application/epub+zip' when 'pdf' then 'application/pdf' else 'application/octet-stream' end as mime,
    replace(url_encode(title), '%3A', ':') as escaped, case when reader = '' then 'book' else reader end as reader
  from (select *, regexp_replace(trim(regexp_replace(title, '[^a-zA-Z0-9 .-]', '', 'g')), ' +', '_', 'g') as reader from f)""")
def file_names(c: Catalog) -> DataFrame:
    return wide(c).select("book_id", X.mime_type("full_format").alias("mime"), X.path_escape("title").alias("escaped"), X.reader_filename("title").alias("reader"))


# 2.10 book files derived from the catalog: one FB2 document per book
def fb2_files(c: Catalog) -> DataFrame:
    text = lambda s: F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><last-name>"), text(a), F.lit("</last-name></author>"))), "")
    genres = F.array_join(F.transform("genres", lambda g: F.concat(F.lit("<genre>"), text(g), F.lit("</genre>"))), "")
    series = F.when(F.col("series").isNotNull(), F.concat(F.lit('<sequence name="'), text(F.col("series")), F.lit('" number="'), F.col("series_no").cast("string"), F.lit('"/>'))).otherwise("")
    head = F.concat(F.lit("<title-info>"), genres, people, F.lit("<book-title>"), text(F.col("title")), F.lit("</book-title><annotation><p>"), text(F.col("title")), F.lit('</p></annotation><coverpage><image l:href="#c"/></coverpage><lang>'), F.col("language"), F.lit("</lang>"), series, F.lit("</title-info>"))
    cover = F.concat(F.lit('<binary id="c" content-type="image/png">'), F.base64(F.col("title").cast("binary")), F.lit("</binary>"))
    whole = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns:l="x"><description>'), head, F.lit("</description>"), cover, F.lit("</FictionBook>"))
    return wide(c).select("zip", F.concat(F.lit("b"), F.col("book_id").cast("string"), F.lit(".fb2")).alias("member"), whole.cast("binary").alias("content"))


@query("fb2_metadata", "select 'b' || book_id || '.fb2' as member, title, array_to_string(authors, ';') as authors, replace(genre, ', ', ';') as genres, language as lang, case when series is null then '' when series_no > 0 then series || ' #' || series_no else series end as sequence, '<p>' || title || '</p>' as annotation from wide")
def fb2_metadata(c: Catalog) -> DataFrame:
    t = F.col("title_info")
    join = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ";")
    out = M.fb2_metadata(fb2_files(c))
    return out.select("member", t["book_title"].alias("title"), join(t["author"]).alias("authors"), join(t["genre"]).alias("genres"), t["lang"].alias("lang"), join(t["sequence"]).alias("sequence"), t["annotation_html"].alias("annotation"))


@query("fb2_covers", "select 'b' || book_id || '.fb2' as member, 'image/png' as mime, title as cover from wide")
def fb2_covers(c: Catalog) -> DataFrame:
    return M.fb2_covers(fb2_files(c)).select("member", "mime", F.col("cover").cast("string").alias("cover"))


# 2.11 streams over files that exist when they start; each ends when it has read them
def _scratch(c: Catalog) -> str:
    return new_folder(c.spark, "streams")


@query("stream_ingest", LINES_SQL + " select distinct title, file_name, zip, array_to_string(authors, ';') as authors from records")
def stream_ingest(c: Catalog) -> DataFrame:
    at = _scratch(c)
    lines(c).select("line").write.text(f"{at}/in")
    manifest = archives(c)

    def merge(batch: DataFrame, number: int) -> None:
        found = I.resolve_archive(I.valid_records(I.parse_records(batch.withColumn("collection", F.lit(COLLECTION)))), manifest)
        found.select("title", "file_name", "zip", F.array_join("authors", ";").alias("authors")).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    T.stream_ingest(T.stream_lines(c.spark, f"{at}/in", "*.txt"), merge, f"{at}/checkpoint").awaitTermination()
    return c.spark.read.schema("title string, file_name string, zip string, authors string").parquet(f"{at}/out").select("title", "file_name", "zip", "authors").distinct()


def _streamed(c: Catalog, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a folder or a single file."""
    reader = c.spark.readStream.schema(c.table(name).schema)
    if all(f.endswith(f"/{name}.parquet") for f in c.table(name).inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(c.sf_dir)
    return reader.parquet(f"{c.sf_dir}/{name}.parquet")


@query("stream_dedup", "select distinct p_name as title, p_brand as file_name, p_type as zip from part")
def stream_dedup(c: Catalog) -> DataFrame:
    at = _scratch(c)
    keys = _streamed(c, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("file_name"), F.col("p_type").alias("zip"))
    T.stream_dedup(keys).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.schema("title string, file_name string, zip string").parquet(f"{at}/out")


@query("stream_shelf", "select user_id, book_id from (select user_id, book_id, arg_max(action, (ts, event_id)) as action from shelf_events group by 1, 2) where action = 'add'")
def stream_shelf(c: Catalog) -> DataFrame:
    """Actions that arrive in four files are upserted batch by batch; the first batch comes twice."""
    at = _scratch(c)
    c.shelf_events().repartition(4, "event_id").write.parquet(f"{at}/in")
    upsert = HS.upsert_shelves(f"{at}/shelves", 8)

    def arrive(batch: DataFrame, number: int) -> None:
        upsert(batch, number)
        if number == 0:
            upsert(batch, number)

    schema = c.spark.read.parquet(f"{at}/in").schema
    actions = c.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    actions.writeStream.foreachBatch(arrive).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return HS.read_shelves(c.spark, f"{at}/shelves")


from foliospark.plans import file_queries  # noqa: E402,F401  registers its queries; it needs the names above
