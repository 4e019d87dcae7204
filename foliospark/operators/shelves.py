"""Bookshelves: sets of (user_id, book_id), and shelves kept from a log of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_favorites(shelf: DataFrame, added: DataFrame) -> DataFrame:
    return shelf.select("user_id", "book_id").union(added.select("user_id", "book_id")).distinct()


def remove_favorites(shelf: DataFrame, removed: DataFrame) -> DataFrame:
    return shelf.join(removed.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")


def shelf_state(events: DataFrame) -> DataFrame:
    """(user_id, book_id): pairs whose last action, by time and then event, is an add. Also an update-mode streaming aggregation."""
    last = events.groupBy("user_id", "book_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    return last.where(F.col("action") == "add").select("user_id", "book_id")


def favorites_books(shelf: DataFrame, wide: DataFrame, user: int) -> DataFrame:
    """Deleted books stay on a shelf."""
    return wide.join(shelf.where(F.col("user_id") == user).select("book_id"), "book_id", "left_semi")


def flag_favorites(books: DataFrame, shelf: DataFrame, user: int) -> DataFrame:
    own = shelf.where(F.col("user_id") == user).select("book_id", F.lit(True).alias("on_shelf")).distinct()
    return books.join(own, "book_id", "left").withColumn("on_shelf", F.coalesce("on_shelf", F.lit(False)))
