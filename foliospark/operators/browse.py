"""Browse lists, facets, reading order, statistics and display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.books import active_books, newest_first
from foliospark.operators.ranks import range_neighbours, range_ranked
from foliospark.operators.search import ESCAPE

# Lengths of lists.
LIST_NAMES, LIST_SERIES, SUGGESTIONS = 100, 1000, 5
SERIES_BOOKS = 1000


def latest_books(books: DataFrame, n: int) -> DataFrame:
    return active_books(books).orderBy(*newest_first()).limit(n)


def books_in_series_order(books: DataFrame, series_ids: DataFrame, n: int = SERIES_BOOKS) -> DataFrame:
    """(.., place): the first n active books of the series (series_id) by number, title and id."""
    order = [F.col("series_no"), F.col("title"), F.col("book_id")]
    rows = active_books(books).join(series_ids.select("series_id"), "series_id", "left_semi").orderBy(*order).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _with_prefix(names: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    return names.where(F.like(X.ascii_lower(column), F.lit(prefix.lower() + "%"), F.lit(ESCAPE))).select(column).distinct().orderBy(column).limit(n)


def authors_with_prefix(authors: DataFrame, prefix: str) -> DataFrame:
    return _with_prefix(authors, "name", prefix, LIST_NAMES)


def titles_with_prefix(books: DataFrame, prefix: str) -> DataFrame:
    return _with_prefix(active_books(books), "title", prefix, LIST_NAMES)


def series_names(series: DataFrame) -> DataFrame:
    return series.select("name").distinct().orderBy("name").limit(LIST_SERIES)


def languages(books: DataFrame) -> DataFrame:
    return active_books(books).select("language").distinct()


def languages_with_all(books: DataFrame) -> DataFrame:
    """(place, language): `all languages` first, then the sorted list."""
    listed = languages(books).withColumn("place", F.row_number().over(Window.orderBy("language")))
    first = books.sparkSession.range(1).select(F.lit(X.ALL_LANGUAGES).alias("language"), F.lit(0).alias("place"))
    return first.unionByName(listed)


def series_facets(books: DataFrame) -> DataFrame:
    """(series, books): the null series is the bucket of books without one."""
    return books.groupBy("series").agg(F.count("*").alias("books"))


def rank_series_facets(books: DataFrame, query: str) -> DataFrame:
    facets = series_facets(books.where(F.col("series").isNotNull()))
    return range_ranked(facets, [X.title_priority("series", F.lit(query)), F.lower("series"), F.col("series")])


def author_series_tree_counts(books: DataFrame) -> DataFrame:
    """(author, series, level, books): level 0 of (author, series), 1 of the author, 3 of all."""
    filled = books.select(F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit(X.UNKNOWN_AUTHOR)).alias("author"), F.coalesce("series", F.lit("")).alias("series"))
    return filled.rollup("author", "series").agg(F.count("*").alias("books"), F.grouping_id().cast("long").alias("level"))


def series_order(books: DataFrame, search_rank: str = "book_id") -> DataFrame:
    """place in (author, series) and the author's first place: numbered books by number, then Russian ones, then by title."""
    rows = books.withColumns({"author_key": F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit(X.UNKNOWN_AUTHOR)), "series_key": F.coalesce("series", F.lit(""))})
    numbered = F.coalesce(F.col("series_no"), F.lit(0)) != 0
    russian = (F.col("language") == "ru") | F.startswith("language", F.lit("ru-"))
    keys = [F.when(numbered, 0).otherwise(1), F.when(numbered, F.col("series_no")), F.when(~numbered, F.when(russian, 0).otherwise(1)), F.when(~numbered, F.col("title")), F.col(search_rank)]
    group = Window.partitionBy("author_key", "series_key").orderBy(*keys)
    return rows.withColumns({"place": F.row_number().over(group), "author_first": F.min(search_rank).over(Window.partitionBy("author_key"))})


def neighbours(books: DataFrame, order: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """previous and next book_id in the order within `by`, or over all books, wrapping at both ends. The order must tell books apart."""
    if not by:
        return range_neighbours(books, [F.col(c) for c in order], "book_id", "previous_id", "next_id")
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return books.withColumns({"previous_id": F.coalesce(F.lag("book_id").over(w), F.last("book_id").over(whole)), "next_id": F.coalesce(F.lead("book_id").over(w), F.first("book_id").over(whole))})


def book_count(books: DataFrame) -> DataFrame:
    """(books): the number of active books, in one row."""
    return books.where("del = 0").agg(F.count("*").alias("books"))


def library_stats(books: DataFrame, book_authors: DataFrame, book_genres: DataFrame) -> DataFrame:
    """One row: books, languages and last_added over active books, links and linked entities over all."""
    parts = [
        active_books(books).agg(F.count("*").alias("total_books"), F.countDistinct("language").alias("languages"), F.max("added_at").alias("last_added")),
        book_authors.agg(F.count("*").alias("total_authors"), F.countDistinct("author_id").alias("unique_authors")),
        book_genres.agg(F.countDistinct("genre_id").alias("unique_genres")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def suggest_genres(names: DataFrame, text: str) -> DataFrame:
    """names: (code, name). The first names that hold the text, by where it stands, then by name."""
    at = F.instr(F.lower("name"), text.lower())
    found = names.where(F.lit(bool(text.strip()))).select("code", F.trim("name").alias("name")).withColumn("at", at).where("at > 0")
    once = found.groupBy("name").agg(F.min(F.struct("at", "code")).alias("x")).select("name", "x.code", "x.at")
    return once.orderBy("at", "name").limit(SUGGESTIONS)


def genre_codes_for(names: DataFrame, text: str) -> DataFrame:
    """(code): all codes of a display name; else the text itself, spaces as `_`."""
    found = names.where(F.lower(F.trim("name")) == text.strip().lower()).select("code")
    none = found.agg((F.count("*") == 0).alias("none"))
    other = none.where("none").select(F.lit(text.strip().replace(" ", "_")).alias("code"))
    return found.unionByName(other)


def language_code_for(names: DataFrame, text: str) -> DataFrame:
    return names.where(F.lower(F.trim("name")) == text.strip().lower()).agg(F.min("code").alias("code"))


def genre_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """(book_id, names): codes (book_id, genres) as display names in list order; an unknown code stays. names has one row per code and is broadcast by Spark's threshold."""
    each = codes.select("book_id", F.posexplode("genres").alias("at", "code")).withColumn("key", X.normalize_genre_code("code"))
    named = each.join(names.select(F.col("code").alias("key"), "name"), "key", "left").withColumn("shown", F.coalesce("name", "code"))
    lists = named.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("at", "shown"))).alias("x"))
    shown = lists.select("book_id", F.array_join(F.transform("x", lambda x: x["shown"]), ", ").alias("names"))
    return codes.select("book_id").join(shown, "book_id", "left").select("book_id", F.coalesce("names", F.lit("—")).alias("names"))


def language_names(books: DataFrame, names: DataFrame) -> DataFrame:
    return books.join(names.select(F.col("code").alias("language"), "name"), "language", "left").select("book_id", F.coalesce("name", "language").alias("language_name"))
