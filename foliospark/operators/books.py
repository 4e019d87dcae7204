"""Book rows: lists of authors and genres, wide rows, filters, and the books of given entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X


def name_list(bridge: DataFrame, dim: DataFrame, id_col: str, name_col: str, out: str) -> DataFrame:
    """(book_id, out): the names of each book in order of their id. Aggregated before any further join; rows are exchanged, not lists begun before, which would save none."""
    pairs = bridge.join(dim.select(id_col, name_col), id_col).repartition("book_id")
    ordered = F.sort_array(F.collect_list(F.struct(id_col, name_col)))
    return pairs.groupBy("book_id").agg(ordered[name_col].alias(out))


def wide_books(books: DataFrame, series: DataFrame, authors: DataFrame, genres: DataFrame, book_authors: DataFrame, book_genres: DataFrame) -> DataFrame:
    """Books with series, authors, genres (arrays) and author, genre (joined); the format is filled from the file name."""
    none = F.array().cast("array<string>")
    by_author = name_list(book_authors, authors, "author_id", "name", "authors")
    by_genre = name_list(book_genres, genres, "genre_id", "code", "genres")
    rows = books.join(series.select("series_id", F.col("name").alias("series")), "series_id", "left").join(by_author, "book_id", "left").join(by_genre, "book_id", "left")
    rows = rows.withColumns({"authors": F.coalesce("authors", none), "genres": F.coalesce("genres", none)})
    return rows.withColumns({"author": F.array_join("authors", ", "), "genre": F.array_join("genres", ", "), "full_format": X.ensure_format("format", "file_name")})


def active_books(books: DataFrame) -> DataFrame:
    return books.where(F.col("del") == 0)


def filter_language(books: DataFrame, language: str | None) -> DataFrame:
    return books if not language or language == X.ALL_LANGUAGES else books.where(F.col("language") == language)


def filter_genre(books: DataFrame, book_genres: DataFrame, genres: DataFrame, codes: str) -> DataFrame:
    """Books with any of the white-space separated codes."""
    wanted = codes.split()
    if not wanted:
        return books
    ids = book_genres.join(genres.where(F.col("code").isin(*wanted)).select("genre_id"), "genre_id", "left_semi")
    return books.join(ids.select("book_id"), "book_id", "left_semi")


def books_of(books: DataFrame, bridge: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Active books linked to any of the entities; semi joins, so no row repeats."""
    linked = bridge.join(ids.select(id_col), id_col, "left_semi").select("book_id")
    return active_books(books).join(linked, "book_id", "left_semi")


def without_series(books: DataFrame) -> DataFrame:
    return books.where(F.col("series").isNull())


def in_series(books: DataFrame, name: str) -> DataFrame:
    return books.where(F.col("series") == name)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("added_at"), F.col("book_id")]
