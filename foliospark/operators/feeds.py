"""Feed entries and search results as rows ready to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X

COVER_FORMATS = ("fb2", "epub")
# Fixed values of feeds: namespaces, media types, link relations, the author's name, the time of books without one.
NAMESPACES = (("xmlns", "http://www.w3.org/2005/Atom"), ("xmlns:opds", "http://opds-spec.org/2010/catalog"), ("xmlns:dc", "http://purl.org/dc/terms/"))
CATALOG_TYPE, PAGE_TYPE = "application/atom+xml;profile=opds-catalog", "application/atom+xml;profile=opds-catalog;kind=acquisition"
SEARCH_TYPE, ATOM_TYPE = "application/opensearchdescription+xml", "application/atom+xml"
ACQUISITION, THUMBNAIL, IMAGE = "http://opds-spec.org/acquisition", "http://opds-spec.org/image/thumbnail", "http://opds-spec.org/image"
FEED_AUTHOR, NO_TIME = "Web Books Server", "0001-01-01T00:00:00Z"
#: Stands for the prefix dc: in names of fields.
PREFIXED = "dc__"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def cover_url(base: str, file_name, fmt, archive) -> Column:
    return F.concat(F.lit(f"{base}/api/cover?file="), X.query_escape(file_name), F.lit("&format="), X.query_escape(fmt), F.lit("&zip="), X.query_escape(archive))


def download_name(title, author, language, fmt) -> Column:
    safe = F.coalesce(F.nullif(X.safe_filename(title), F.lit("")), F.lit("book"))
    return F.concat(safe, F.lit(" - "), X.safe_filename(author), F.lit(" ("), X.col(language), F.lit(")."), X.col(fmt))


def feed_entries(wide: DataFrame, base_url: str = "", in_series: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, title, updated, author, text, language, identifier, links and categories of each book, and the columns of wide to keep."""
    fmt = X.ensure_format("format", "file_name")
    safe = F.coalesce(F.nullif(X.safe_filename("title"), F.lit("")), F.lit("book"))
    file = X.path_escape(F.replace(F.concat(safe, F.lit(" - "), X.safe_filename("author"), F.lit("."), fmt), F.lit("  "), F.lit(" ")))
    link = lambda rel, href, kind, title: F.struct(F.lit(rel).alias("rel"), href.alias("href"), kind.alias("type"), title.alias("title"))
    cover, none, jpeg = cover_url(base_url, "file_name", fmt, "zip"), F.lit(None).cast("string"), F.lit("image/jpeg")
    acquire = F.concat(F.lit("Скачать "), F.col("title"), F.lit(" ("), F.upper(fmt), F.lit(")"))
    links = F.array(
        link(ACQUISITION, F.concat(F.lit(f"{base_url}/download/"), F.col("book_id").cast("string"), F.lit("/"), file), X.mime_type(fmt), acquire),
        link(THUMBNAIL, cover, jpeg, none), link(IMAGE, cover, jpeg, none),
    )
    terms = F.filter(F.transform(F.split("genre", ","), X.trimmed), lambda g: g != "")
    return wide.select(
        "book_id", F.concat(F.lit("urn:uuid:book-"), F.col("book_id").cast("string")).alias("id"), X.display_title("title", "series", "series_no", in_series).alias("title"),
        F.date_format("added_at", TIME_FORMAT).alias("updated"), "author", X.feed_text("author", "genre", "series", "series_no", fmt).alias("text"), "language",
        F.concat(F.lit("BookID:"), F.col("book_id").cast("string")).alias("identifier"), links.alias("links"), F.transform(terms, lambda g: F.struct(g.alias("term"), g.alias("label"))).alias("categories"), *keep,
    )


def atom_feeds(entries: DataFrame, base_url: str, feed_title: Column, self_url: Column, updated: Column) -> DataFrame:
    """(feed, xml): one Atom document per feed. entries: of feed_entries, with feed (its key, of one page's entries) and place (their order); the other columns, of those of entries, are told once per feed."""
    links = F.transform("links", lambda x: F.struct(x["rel"].alias("_rel"), x["href"].alias("_href"), x["type"].alias("_type"), x["title"].alias("_title")))
    categories = F.transform("categories", lambda x: F.struct(x["term"].alias("_term"), x["label"].alias("_label")))
    entry = F.struct(
        "id", "title", F.coalesce("updated", F.lit(NO_TIME)).alias("updated"), F.struct(F.lit("text").alias("_type"), F.col("text").alias("_VALUE")).alias("content"), links.alias("link"),
        F.struct(F.coalesce("author", F.lit("")).alias("name")).alias("author"), F.nullif(F.col("language"), F.lit("")).alias(f"{PREFIXED}language"), F.col("identifier").alias(f"{PREFIXED}identifier"), categories.alias("category"),
    )
    held = entries.groupBy("feed").agg(
        F.array_sort(F.collect_list(F.struct("place", "id", entry.alias("entry")))).alias("held"), F.min(feed_title).alias("title"), F.min(self_url).alias("own"), F.max(updated).cast("timestamp").alias("at")
    )
    link = lambda rel, href, kind: F.struct(F.lit(rel).alias("_rel"), href.alias("_href"), F.lit(kind).alias("_type"))
    at = F.coalesce("at", F.to_timestamp(F.lit(NO_TIME)))
    feed = F.struct(
        F.concat(F.lit("urn:uuid:acquisition-feed-"), F.replace("title", F.lit(" "), F.lit("_")), F.lit("-"), F.unix_seconds(at).cast("string")).alias("id"), F.col("title").alias("title"),
        F.date_format(at, TIME_FORMAT).alias("updated"), F.struct(F.lit(FEED_AUTHOR).alias("name")).alias("author"),
        F.array(link("start", F.lit(f"{base_url}/opds/"), CATALOG_TYPE), link("self", F.col("own"), PAGE_TYPE), link("search", F.lit(f"{base_url}/opds/opensearch"), SEARCH_TYPE), link("search", F.lit(base_url + "/opds/search?term={searchTerms}"), ATOM_TYPE)).alias("link"),
        F.transform("held", lambda x: x["entry"]).alias("entry"),
    )
    # to_xml knows no prefixes; a < is always markup in what it gives
    spaces = " ".join(f'{name}="{uri}"' for name, uri in NAMESPACES)
    named = F.regexp_replace(F.regexp_replace(F.to_xml(feed, {"rowTag": "feed"}), "^<feed>", f"<feed {spaces}>"), f"<(/?){PREFIXED}", "<$1dc:")
    return held.select("feed", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), named).alias("xml"))


def feed_pages(entries: DataFrame, by: list[str], order: list[Column], per_page: int) -> DataFrame:
    """entries with page (from 1) and place (from 1) within `by`: every entry is on one page, and a page has per_page entries at most."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return entries.withColumn("at", at).withColumns({"page": F.floor(F.col("at") / per_page) + 1, "place": (F.col("at") % per_page + 1).cast("int")}).drop("at")


def export_feed(feeds: DataFrame, path: str) -> None:
    """One file per feed (feed, xml), in a folder feed=<key>."""
    feeds.select("feed", F.col("xml").alias("value")).repartition("feed").write.mode("overwrite").partitionBy("feed").text(path)


def search_json(rows: DataFrame, languages: DataFrame, number: int, per_page: int) -> DataFrame:
    """One row: the page of a search (its rows bounded by per_page) with total, page, perPage and languages as JSON."""
    fields = [c for c in rows.columns if c not in ("total", "rank")]
    books = rows.agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("book")))).alias("x"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    listed = languages.agg(F.array_sort(F.collect_list(F.struct("place", "language"))).alias("y"))
    whole = F.struct(F.transform("x", lambda x: x["book"]).alias("books"), F.col("total"), F.lit(number).alias("page"), F.lit(per_page).alias("perPage"), F.transform("y", lambda y: y["language"]).alias("languages"))
    return books.crossJoin(listed).select(F.to_json(whole).alias("json"))
