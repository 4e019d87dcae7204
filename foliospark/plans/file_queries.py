"""Queries over archives, book files and outputs that are composed from the catalog: index archives of lines, book archives, EPUB files, feeds, JSON.

Archives hold at most BLOCK books and indexes five blocks, so their number grows with the catalog and no archive does.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from foliospark.functions import text as X
from foliospark.operators import books as B
from foliospark.operators import browse as R
from foliospark.operators import feeds as D
from foliospark.operators import ingest as I
from foliospark.operators import search as S
from foliospark.operators import storage as ST
from foliospark.plans.queries import COLLECTION, LINES_SQL, TITLE, TITLE_KEY, _scratch, archives, export_search_json, lines, prefixes, q, query, records, title_priority, wide
from foliospark.plans.views import Catalog
from foliospark.sources import archives as Z
from foliospark.sources import metadata as M
from foliospark.sources.zips import write_archives
from foliospark.storage import small_batches, written
from foliospark.streaming import commits as C
from foliospark.streaming import ingest as T

BLOCK, INDEX = 20, 100
#: Books of an index file that streams read, on average.
FILE_BOOKS = 50_000


@F.pandas_udf(BinaryType())
def zipped(names: pd.Series, contents: pd.Series) -> pd.Series:
    """A zip archive of each row's members; the same bytes whenever it is made."""

    def one(row_names, row_contents) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in zip(row_names, row_contents):
                z.writestr(zipfile.ZipInfo(name), content)
        return out.getvalue()

    return pd.Series([one(n, c) for n, c in zip(names, contents)], dtype=object)


def div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by)


def text_of(number: Column) -> Column:
    return number.cast("string")


def index_rows(c: Catalog) -> DataFrame:
    """(archive, member, content, mtime) of index archives of the composed lines; every other one names its collection, every third one its layout."""
    dated = lines(c).join(c.books().select(F.col("book_id").alias("line_no"), F.col("added_at").cast("timestamp").alias("mtime")), "line_no")
    blocks = dated.groupBy(div("line_no", BLOCK).alias("at")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"), F.max("mtime").alias("mtime"))
    inp = blocks.select(div("at", INDEX // BLOCK).alias("number"), F.concat(F.lit("lib/ARC-"), text_of(F.col("at")), F.lit(".inp")).alias("member"), F.array_join(F.transform("x", lambda r: r["line"]), "\r\n").cast("binary").alias("content"), "mtime")
    numbers = inp.select("number").distinct()
    info = lambda of, name, text: numbers.where(of).select("number", F.lit(name).alias("member"), text.cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    collection = info(F.col("number") % 2 == 0, "collection.info", F.concat(F.lit("Collection "), text_of(F.col("number")), F.lit("\nsecond line")))
    layout = info(F.col("number") % 3 == 0, "structure.info", F.lit("AUTHOR;GENRE;TITLE"))
    return inp.unionByName(collection).unionByName(layout).withColumn("archive", F.concat(F.lit("lib-"), text_of(F.col("number")), F.lit(".inpx")))


def book_rows(c: Catalog) -> DataFrame:
    """(archive, member, content) of book archives: members under the full name in capitals, the plain name, the full name in a folder, or a name that no book has."""
    full = F.concat_ws(".", "file_name", "full_format")
    kind = F.col("book_id") % 4
    name = F.when(kind == 0, F.upper(full)).when(kind == 1, F.col("file_name")).when(kind == 2, F.concat(F.lit("dir/"), full)).otherwise(F.concat(F.lit("x"), text_of(F.col("book_id"))))
    return wide(c).select(F.concat(F.lit("bk-"), text_of(div("book_id", BLOCK)), F.lit(".zip")).alias("archive"), name.alias("member"), F.col("title").cast("binary").alias("content"))


def stored(c: Catalog, rows: DataFrame) -> str:
    """The folder that holds the rows' archives as zip files."""
    at = _scratch(c)
    write_archives(rows, at)
    return at


def base_name(column: str) -> Column:
    return F.regexp_extract(column, "[^/]*$", 0)


INDEX_SQL = LINES_SQL + """, indexed as (
  select book_id, 'lib-' || (book_id // 100) || '.inpx' as source, 'lib/ARC-' || (book_id // 20) || '.inp' as member, row_number() over (partition by book_id // 20 order by book_id) - 1 as line_no,
    array_to_string([array_to_string(list_transform(authors, lambda a: replace(a, ' ', ',') || ':'), ''), case when genre = '' then '' else replace(genre, ', ', ':') || ':' end, title, coalesce(series, ''), cast(series_no as varchar), file_name,
      cast(file_size as varchar), '', cast(gone as varchar), format, '2020-01-01', '', case when book_id % 50 = 4 then '' else folder end, language, '', ''], chr(4)) as line
  from lines
)"""

FULL_FORMAT = "case when format in ('', 'unknown') then case when file_name like '%.epub' then 'epub' else 'unknown' end else format end"

HELD_SQL = f""", named as (select *, {FULL_FORMAT} as full_format from wide), held as (
  select book_id, title, full_format, 'bk-' || (book_id // 20) || '.zip' as archive,
    case book_id % 4 when 0 then upper(file_name || '.' || full_format) when 1 then file_name when 2 then 'dir/' || file_name || '.' || full_format else 'x' || book_id end as member
  from named
)"""


@query("read_inpx", INDEX_SQL + " select source, member, line_no, line from indexed")
def read_inpx(c: Catalog) -> DataFrame:
    return Z.read_inpx(c.spark, stored(c, index_rows(c))).select(base_name("source").alias("source"), "member", "line_no", "line")


@query("read_layout", INDEX_SQL + f" select source, case when k % 3 = 0 then 'author;genre;title' else {q(I.DEFAULT_LAYOUT)} end as layout, case when k % 2 = 0 then 'Collection ' || k end as collection from (select distinct source, book_id // 100 as k from indexed)")
def read_layout(c: Catalog) -> DataFrame:
    return Z.read_layout(c.spark, stored(c, index_rows(c))).select(base_name("source").alias("source"), "layout", "collection")


@query("latest_source", INDEX_SQL + ", dated as (select source, max(added_at) as mtime from indexed join books using (book_id) group by source) select source, mtime from dated where mtime is not null order by mtime desc, source desc limit 1")
def latest_source(c: Catalog) -> DataFrame:
    return Z.newest_file(index_rows(c).select(F.col("archive").alias("path"), F.col("mtime").alias("modificationTime"))).select(base_name("source").alias("source"), "mtime")


@query("archive_manifest", HELD_SQL + " select distinct archive as zip from held")
def archive_manifest(c: Catalog) -> DataFrame:
    return Z.archive_manifest(c.spark, stored(c, book_rows(c)))


@query("read_archive_members", HELD_SQL + " select archive as zip, member, title as content from held")
def read_archive_members(c: Catalog) -> DataFrame:
    return Z.read_archive_members(c.spark, stored(c, book_rows(c))).withColumn("content", F.col("content").cast("string"))


@query("book_members", HELD_SQL + " select book_id, member, title as content from held where book_id % 4 <> 3")
def book_members(c: Catalog) -> DataFrame:
    asked = wide(c).withColumn("zip", F.concat(F.lit("bk-"), text_of(div("book_id", BLOCK)), F.lit(".zip")))
    return Z.book_members(asked, Z.read_archive_members(c.spark, stored(c, book_rows(c)))).withColumn("content", F.col("content").cast("string"))


@query("broken_archives", HELD_SQL + " select distinct archive as source, true as told from held where book_id // 20 % 2 = 1")
def broken_archives(c: Catalog) -> DataFrame:
    """Every second archive has lost its end."""
    held = book_rows(c).groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("member", "content"))).alias("held"))
    whole = held.select("archive", zipped(F.transform("held", lambda m: m["member"]), F.transform("held", lambda m: m["content"])).alias("content"))
    lost = F.regexp_extract("archive", "([0-9]+)\\.zip$", 1).cast("long") % 2 == 1
    files = whole.select(F.col("archive").alias("path"), F.when(lost, F.substring("content", 1, 20)).otherwise(F.col("content")).alias("content"))
    return Z.broken(Z.members(files)).select("source", (F.col("error") != "").alias("told"))


@query("write_catalog", "select book_id, title, file_name, zip, coalesce(links, 0) as links from books left join (select book_id, count(*) as links from book_authors group by book_id) using (book_id)")
def write_catalog(c: Catalog) -> DataFrame:
    at = _scratch(c)
    I.write_catalog({"books": c.books(), "book_authors": c.book_authors()}, at)
    links = c.spark.read.parquet(f"{at}/book_authors").groupBy("book_id").agg(F.count("*").alias("links"))
    return c.spark.read.parquet(f"{at}/books").join(links, "book_id", "left").select("book_id", "title", "file_name", "zip", F.coalesce("links", F.lit(0)).alias("links"))


# a catalog stored in buckets
def _stored(c: Catalog, bridge: DataFrame | None = None) -> tuple[str, str, int]:
    """Prefix, path and number of buckets of the tables; buckets follow the links of all books."""
    prefix, at = f"catalog_{uuid.uuid4().hex}", _scratch(c)
    links = written(c.book_authors())
    buckets = ST.buckets_for(links, 8)
    authors = written(ST.named_links(links if bridge is None else bridge, c.authors(), "author_id", "name"))
    genres = ST.named_links(c.book_genres(), c.genres(), "genre_id", "code")
    ST.store_catalog(c.books(), {"book_authors": authors, "author_books": authors, "book_genres": genres}, prefix, at, buckets, "year", {"author_books": "author_id"})
    return prefix, at, buckets


@query("stored_lists", "select book_id, title, author, genre from wide")
def stored_lists(c: Catalog) -> DataFrame:
    prefix, _, _ = _stored(c)
    read = lambda name: c.spark.table(f"{prefix}_{name}")
    rows = read("books").join(ST.names_of_books(read("book_authors"), "author_id", "name", "author"), "book_id", "left").join(ST.names_of_books(read("book_genres"), "genre_id", "code", "genre"), "book_id", "left")
    return rows.select("book_id", "title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("genre", F.lit("")).alias("genre"))


@query("stored_books_of", "select book_id, title from books where del = 0 and added_at >= timestamp '1996-01-01' and book_id in (select book_id from book_authors join authors using (author_id) where starts_with(name, 'NATION_1'))")
def stored_books_of(c: Catalog) -> DataFrame:
    """Books of some authors since a date: folders before it are not read."""
    prefix, _, _ = _stored(c)
    recent = c.spark.table(f"{prefix}_books").where(F.col("added") >= F.lit("1996-01-01").cast("date"))
    ids = c.authors().where(F.startswith("name", F.lit("NATION_1"))).select("author_id")
    return B.books_of(recent, c.spark.table(f"{prefix}_author_books"), ids, "author_id").select("book_id", "title")


@query("stored_links", LINES_SQL + ", un as (select title, file_name, zip, unnest(authors) as name from records) select distinct book_id, author_id, name from un join books using (title, file_name, zip) join authors using (name) union select book_id, author_id, name from book_authors join authors using (author_id) where book_id in (select book_id from books where added_at < timestamp '1997-06-01')")
def stored_links(c: Catalog) -> DataFrame:
    """Links of older books are stored; the records' links are added, twice."""
    old = c.books().where(F.col("added_at") < F.lit("1997-06-01").cast("timestamp"))
    prefix, at, buckets = _stored(c, c.book_authors().join(old, "book_id", "left_semi"))
    each = records(c).select(*I.KEY, F.explode("authors").alias("name")).distinct()
    # written, as both rounds read them
    fresh = written(each.join(c.books().select("book_id", *I.KEY), I.KEY).join(c.authors(), "name").select("book_id", "author_id", "name"))
    for _ in range(2):
        ST.append_links(fresh, "book_authors", "author_id", prefix, at, buckets)
    return c.spark.table(f"{prefix}_book_authors")


# outputs
LINKS_SQL = f""", named as (select *, {FULL_FORMAT} as full_format, coalesce(nullif(trim(regexp_replace(title, '[/\\\\:*?"<>|]', '', 'g')), ''), 'book') as safe from wide), addressed as (
  select *, 'http://library/download/' || book_id || '/' || url_encode(replace(safe || ' - ' || trim(author) || '.' || full_format, '  ', ' ')) as download,
    'http://library/api/cover?file=' || url_encode(file_name) || '&format=' || full_format || '&zip=' || zip as cover,
    case full_format when 'fb2' then 'application/fb2' when 'epub' then 'application/epub+zip' when 'pdf' then 'application/pdf' else 'application/octet-stream' end as mime
  from named
), feed_links as (
  select book_id, 'http://opds-spec.org/acquisition' as rel, download as href, mime as "type", 'Скачать ' || title || ' (' || upper(full_format) || ')' as title from addressed
  union all select book_id, 'http://opds-spec.org/image/thumbnail', cover, 'image/jpeg', null from addressed union all select book_id, 'http://opds-spec.org/image', cover, 'image/jpeg', null from addressed
)"""


@query("feed_links", LINKS_SQL + ' select book_id, rel, href, "type", title from feed_links')
def feed_links(c: Catalog) -> DataFrame:
    return D.feed_entries(wide(c), "http://library", True).select("book_id", F.inline("links"))


@query("feed_categories", "select book_id, author, language, 'BookID:' || book_id as identifier, genre as terms from wide")
def feed_categories(c: Catalog) -> DataFrame:
    terms = F.array_join(F.transform("categories", lambda x: x["term"]), ", ")
    return D.feed_entries(wide(c), "http://library", True).select("book_id", "author", "language", "identifier", terms.alias("terms"))


@query("export_feed", LINKS_SQL + """, placed as (select *, row_number() over (partition by zip order by title, book_id) - 1 as spot from addressed), paged as (select *, zip || '-' || (spot // 100 + 1) as feed from placed),
  heads as (select feed, max(added_at) as newest from paged group by feed)
  select feed, spot % 100 + 1 as place, 'Books of ' || feed as feed_title, 'urn:uuid:acquisition-feed-Books_of_' || feed || '-' || cast(epoch(newest) as bigint) as feed_id, strftime(newest, '%Y-%m-%dT%H:%M:%SZ') as feed_updated, 4 as feed_links,
    'http://library/feeds/' || feed as own, 'urn:uuid:book-' || book_id as id, title, coalesce(strftime(added_at, '%Y-%m-%dT%H:%M:%SZ'), '0001-01-01T00:00:00Z') as updated, author, language, 'BookID:' || book_id as identifier, 'text' as text_type,
    3 as links, download, mime, 'Скачать ' || title || ' (' || upper(full_format) || ')' as label, cover, genre as terms
  from paged join heads using (feed)""")
def export_feed(c: Catalog) -> DataFrame:
    """Atom files of pages of each archive's books, read again as XML with their attributes."""
    at = _scratch(c)
    entries = D.feed_entries(wide(c), "http://library", keep=("zip", "added_at"))
    paged = D.feed_pages(entries, ["zip"], [F.col("title"), F.col("book_id")], 100).withColumn("feed", F.concat_ws("-", "zip", F.col("page").cast("string")))
    D.export_feed(D.atom_feeds(paged, "http://library", F.concat(F.lit("Books of "), F.col("feed")), F.concat(F.lit("http://library/feeds/"), F.col("feed")), F.col("added_at")), at)
    link = "array<struct<_rel:string,_href:string,_type:string,_title:string>>"
    entry = f"id string, title string, updated string, content struct<_type:string,_VALUE:string>, link {link}, author struct<name:string>, `dc:language` string, `dc:identifier` string, category array<struct<_term:string,_label:string>>"
    schema = f"id string, title string, updated string, link {link}, entry array<struct<{entry}>>"
    read = c.spark.read.format("xml").option("rowTag", "feed").option("ignoreNamespace", False).schema(schema).load(at)
    own = F.filter("link", lambda x: x["_rel"] == "self")
    each = read.select(F.col("title").alias("feed_title"), F.col("id").alias("feed_id"), F.col("updated").alias("feed_updated"), F.size("link").alias("feed_links"), F.get(own, 0)["_href"].alias("own"), F.posexplode("entry").alias("at", "e"))
    acquire = F.get(F.filter("e.link", lambda x: x["_rel"] == D.ACQUISITION), 0)
    image = F.get(F.filter("e.link", lambda x: x["_rel"] == D.IMAGE), 0)
    return each.select(
        F.regexp_extract("own", "[^/]*$", 0).alias("feed"), (F.col("at") + 1).alias("place"), "feed_title", "feed_id", "feed_updated", "feed_links", "own", "e.id", "e.title", "e.updated", F.coalesce("e.author.name", F.lit("")).alias("author"), F.col("e.dc:language").alias("language"),
        F.col("e.dc:identifier").alias("identifier"), F.col("e.content._type").alias("text_type"), F.size("e.link").alias("links"), acquire["_href"].alias("download"), acquire["_type"].alias("mime"), acquire["_title"].alias("label"), image["_href"].alias("cover"),
        F.array_join(F.transform("e.category", lambda x: x["_term"]), ", ").alias("terms"),
    )


@query("search_json", f", hits as (select * from wide where del = 0 and language = 'en' and {prefixes('title', TITLE)}), pg as (select * from hits order by title, book_id limit 50), ranked as (select *, row_number() over (order by {title_priority('title', q(TITLE))}, {TITLE_KEY}, book_id) as place from pg) select place, book_id, title, author, series, (select count(*) from hits) as total, 1 as page, 50 as per_page, (select 'Все языки' || coalesce(string_agg('|' || language, '' order by language), '') from (select distinct language from books where del = 0)) as languages from ranked")
def search_json(c: Catalog) -> DataFrame:
    """The rows of the JSON result, read back from it."""
    shape = "books array<struct<book_id:long,title:string,author:string,series:string>>, total long, page int, perPage int, languages array<string>"
    read = export_search_json(c).select(F.from_json("json", shape).alias("r"))
    each = read.select("r.total", "r.page", F.col("r.perPage").alias("per_page"), F.array_join("r.languages", "|").alias("languages"), F.posexplode("r.books").alias("at", "b"))
    return each.select((F.col("at") + 1).cast("long").alias("place"), "b.book_id", "b.title", "b.author", "b.series", "total", "page", "per_page", "languages")


# pages and places of many queries, names
@query("page_of_each", "select zip, book_id, rank from (select zip, book_id, row_number() over (partition by zip order by title, book_id) as rank from books where del = 0) where rank > 10 and rank <= 20")
def page_of_each(c: Catalog) -> DataFrame:
    return S.page_of_each(B.active_books(c.books()), ["zip"], S.page_order(title="any"), 2, 10).select("zip", "book_id", F.col("rank").cast("long").alias("rank"))


@query("books_in_series_order", "select book_id, row_number() over (order by series_no, title, book_id) as place from books where del = 0 and series_id = 3 order by series_no, title, book_id limit 1000")
def books_in_series_order(c: Catalog) -> DataFrame:
    return R.books_in_series_order(c.books(), c.series().where("series_id = 3")).select("book_id", "place")


@query("search_by_title", ", hits as (select *, case when lower(title) = 'ring' then 1 when lower(title) like 'ring%' then 2 else 3 end as tier from wide where del = 0 and lower(title) like '%ring%' order by tier, title, book_id limit 1000) " + f"select book_id, title, row_number() over (order by {title_priority('title', q('ring'))}, {TITLE_KEY}, book_id) as rank from hits")
def search_by_title(c: Catalog) -> DataFrame:
    return S.search_by_type("title", "ring", wide(c), c.authors(), c.series(), c.genres(), c.book_authors(), c.book_genres()).select("book_id", "title", "rank")


@query("search_by_genre", ", hits as (select book_id, title from books where del = 0 and book_id in (select book_id from book_genres join genres using (genre_id) where code like '%size_1%') order by title, book_id limit 1000) select book_id, title, row_number() over (order by title, book_id) as rank from hits")
def search_by_genre(c: Catalog) -> DataFrame:
    return S.search_by_type("genre", "size_1", wide(c), c.authors(), c.series(), c.genres(), c.book_authors(), c.book_genres()).select("book_id", "title", "rank")


@query("language_code_for", "select min(p_brand) as code from part where lower(trim(p_type)) = 'economy'")
def language_code_for(c: Catalog) -> DataFrame:
    return R.language_code_for(c.table("part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("name")), " Economy ")


# book files
#: Letters a-z and what the composed texts have in their place.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"


@query("decode_text", f"select book_id, '<?xml version=\"1.0\" encoding=\"' || ['windows-1251', 'koi8-r', 'iso-8859-5', 'utf-8'][book_id % 4 + 1] || '\"?><t>' || translate(title, '{LATIN}', '{CYRILLIC}') || '</t>' as text from books")
def decode_text(c: Catalog) -> DataFrame:
    """Titles in Cyrillic letters, in the bytes of four charsets."""
    content = F.lit(None).cast("binary")
    for i, charset in enumerate(M.CHARSETS):
        head = F.lit(f'<?xml version="1.0" encoding="{charset}"?><t>').cast("binary")
        if charset == "utf-8":
            body = F.translate("title", LATIN, CYRILLIC).cast("binary")
        else:
            body = F.encode(F.translate("title", LATIN, CYRILLIC.encode(charset).decode("latin-1")), "ISO-8859-1")
        content = F.when(F.col("book_id") % 4 == i, F.concat(head, body, F.lit("</t>").cast("binary"))).otherwise(content)
    return c.books().select("book_id", M.decode_text(content).alias("text"))


def epub_files(c: Catalog) -> DataFrame:
    """(zip, member, content): an EPUB file of each book; its cover is named by a meta element, an item's id, or an item's properties and only the file's base name."""
    text = lambda s: F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kind = F.col("book_id") % 3
    creators = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<dc:creator>"), text(a), F.lit("</dc:creator>"))), "")
    subjects = F.array_join(F.transform("genres", lambda g: F.concat(F.lit("<dc:subject>"), text(g), F.lit("</dc:subject>"))), "")
    meta = F.when(kind == 0, '<meta name="cover" content="pic"/>').otherwise("")
    item = F.when(kind == 0, '<item id="pic" href="img/c.jpg" media-type="image/jpeg"/>').when(kind == 1, '<item id="the-Cover" href="img/c.jpg" media-type="image/jpeg"/>').otherwise('<item id="z" href="c.png" media-type="image/png" properties="cover-image"/>')
    package = F.concat(
        F.lit('<?xml version="1.0"?><package xmlns:dc="d"><metadata><dc:title>'), text(F.col("title")), F.lit("</dc:title>"), creators, F.lit("<dc:language>"), F.col("language"), F.lit("</dc:language><dc:publisher>"), F.coalesce("series", F.lit("none")), F.lit("</dc:publisher>"), subjects, meta,
        F.lit('</metadata><manifest><item id="x" href="t.html" media-type="text/html"/>'), item, F.lit("</manifest></package>"),
    )
    container = F.lit('<?xml version="1.0"?><container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
    names = F.array(F.lit("META-INF/container.xml"), F.lit("OPS/p.opf"), F.when(kind == 2, "other/c.png").otherwise("OPS/img/c.jpg"))
    small_batches(c.spark)
    content = zipped(names, F.array(container.cast("binary"), package.cast("binary"), F.col("title").cast("binary")))
    return wide(c).select("zip", F.concat(F.lit("b"), text_of(F.col("book_id")), F.lit(".epub")).alias("member"), content.alias("content"))


@query("epub_metadata", "select 'b' || book_id || '.epub' as member, title, array_to_string(authors, ';') as authors, genre as keywords, language as lang, coalesce(series, 'none') as publisher from wide")
def epub_metadata(c: Catalog) -> DataFrame:
    t = F.col("title_info")
    authors = F.array_join(F.coalesce(t["author"], F.array().cast("array<string>")), ";")
    return M.epub_metadata(epub_files(c)).select("member", t["book_title"].alias("title"), authors.alias("authors"), t["keywords"].alias("keywords"), t["lang"].alias("lang"), F.col("publish_info.publisher").alias("publisher"))


@query("epub_covers", "select 'b' || book_id || '.epub' as member, case when book_id % 3 = 2 then 'image/png' else 'image/jpeg' end as mime, title as cover from wide")
def epub_covers(c: Catalog) -> DataFrame:
    return M.epub_covers(epub_files(c)).select("member", "mime", F.col("cover").cast("string").alias("cover"))


# streams
def _active(c: Catalog) -> DataFrame:
    """Active wide books, written once for the stored part and the lines."""
    return written(B.active_books(wide(c)).drop("author", "genre", "full_format"))


def _index_files(c: Catalog, least: int) -> int:
    """How many index files the books fill: FILE_BOOKS each on average, so that files, each read by one task, do not grow."""
    return max(least, -(-c.table("part").count() // FILE_BOOKS))


@query("stream_merge", LINES_SQL + ", stored as (select title, file_name, zip from wide where del = 0 and book_id % 3 = 0) select title, file_name, zip from stored union select title, file_name, zip from records")
def stream_merge(c: Catalog) -> DataFrame:
    """Index files that arrive, batch by batch, are merged into a catalog that holds a third of the books."""
    at, manifest, active, files = _scratch(c), archives(c), _active(c), _index_files(c, 8)
    active.where("book_id % 3 = 0").select(*I.BOOK_COLUMNS).write.parquet(f"{at}/books/batch=-1")
    lines(c, active).select("line").repartition(files, F.xxhash64("line")).write.text(f"{at}/in")
    merge = T.merge_into(f"{at}/books", "2024-01-01 00:00:00")

    def arrive(batch: DataFrame, number: int) -> None:
        merge(I.resolve_archive(I.valid_records(I.parse_records(batch.withColumn("collection", F.lit(COLLECTION)))), manifest), number)

    T.stream_ingest(T.stream_lines(c.spark, f"{at}/in", "*.txt", -(-files // 2)), arrive, f"{at}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{at}/books").select("title", "file_name", "zip")


@query("stream_merge_all", LINES_SQL + """, stored as (select * from wide where del = 0 and book_id % 3 = 0), each as (
    select title, file_name, zip, authors, genre from stored union all select title, file_name, zip, authors, genre from records)
  select distinct 'book' as kind, title, file_name, zip, '' as name from each union all select distinct 'author', title, file_name, zip, unnest(authors) from each
  union all select distinct 'genre', title, file_name, zip, unnest(string_split(genre, ', ')) from each where genre <> ''""")
def stream_merge_all(c: Catalog) -> DataFrame:
    """Index files that arrive are merged into all tables of a catalog of a third of the books; a batch comes twice, and the catalog is compacted."""
    at, manifest, when, active, files = _scratch(c), archives(c), "2024-01-01 00:00:00", _active(c), _index_files(c, 4)
    first = active.where("book_id % 3 = 0").withColumn("source", F.lit("first"))
    C.commit(c.spark, f"{at}/catalog", -1, C.additions(first.withColumns({"member": F.lit(""), "line_no": F.col("book_id")}), C.read_catalog(c.spark, f"{at}/catalog"), when))
    lines(c, active).select("line").repartition(files, F.xxhash64("line")).write.text(f"{at}/in")
    merge = C.merge_all(f"{at}/catalog", when)

    def arrive(batch: DataFrame, number: int) -> None:
        found = I.resolve_archive(I.valid_records(I.parse_records(batch.withColumn("collection", F.lit(COLLECTION)))), manifest)
        merge(found, number)
        if number == 0:
            merge(found, number)

    T.stream_ingest(T.stream_lines(c.spark, f"{at}/in", "*.txt", -(-files // 2)), arrive, f"{at}/checkpoint").awaitTermination()
    C.compact(c.spark, f"{at}/catalog")
    t = C.read_catalog(c.spark, f"{at}/catalog")
    keys = t["books"].select("book_id", "title", "file_name", "zip")
    named = lambda kind, bridge, dim, id_col, name: t[bridge].join(t[dim], id_col).join(keys, "book_id").select(F.lit(kind).alias("kind"), *I.KEY, F.col(name).alias("name"))
    return keys.select(F.lit("book").alias("kind"), *I.KEY, F.lit("").alias("name")).unionByName(named("author", "book_authors", "authors", "author_id", "name")).unionByName(named("genre", "book_genres", "genres", "genre_id", "code"))
