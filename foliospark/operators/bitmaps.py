"""Token postings as bitmaps: counts of books per query without a row per hit.

A book's id is a bucket of 32768 ids and a place in it. The index holds, for each token of a field and each bucket, its books: as places where they are few, as
a bitmap of 4096 bytes where they are many. The tokens that begin with a query's prefix are OR-ed per bucket, the prefixes of a query AND-ed, and the
bits counted; what is shuffled is one bitmap per prefix and bucket, however many books it stands for. The index can be written with the catalog (`write_catalog`) and used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.books import active_books
from foliospark.operators.search import book_tokens, tokens_of_prefixes
from foliospark.storage import written

#: Books of a token in a bucket up to which they are kept as places: a bitmap takes 4096 bytes.
FEW = 256


def token_index(tokens: DataFrame, few: int = FEW) -> DataFrame:
    """(field, token, bucket, n, places, bitmap) of tokens (book_id, field, token), each distinct; either places or bitmap is null. A group has one bucket's books at most."""
    keys = ["field", "token", "bucket"]
    spots = tokens.select("field", "token", F.bitmap_bucket_number("book_id").alias("bucket"), F.bitmap_bit_position("book_id").cast("int").alias("place"))
    held = spots.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_list("place").alias("places"))
    sparse = held.where(F.col("n") <= few).withColumn("bitmap", F.lit(None).cast("binary"))
    dense = held.where(F.col("n") > few).select(*keys, "n", F.explode("places").alias("place")).groupBy(*keys, "n").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bitmap"))
    return sparse.unionByName(dense.withColumn("places", F.lit(None).cast("array<int>")))


def prefix_bitmaps(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(field, prefix, bucket, bitmap): the books with a token that begins with each asked (field, prefix)."""
    hits = tokens_of_prefixes(index.select("field", "token").distinct(), asked)
    near = hits.join(index, ["field", "token"])
    keys = ["field", "prefix", "bucket"]
    few = near.where(F.col("bitmap").isNull()).select(*keys, F.explode("places").alias("place")).groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    return few.unionByName(near.where(F.col("bitmap").isNotNull()).select(*keys, "bitmap")).groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def query_bitmaps(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, bucket, bitmap) of queries (query_id, field, text): the books where every token of the text begins some token of the field. A text without tokens finds nothing."""
    prefixes = F.array_distinct(X.tokens("text"))
    wanted = queries.select("query_id", "field", F.size(prefixes).alias("needed"), F.explode(prefixes).alias("prefix"))
    found = prefix_bitmaps(wanted.select("field", "prefix").distinct(), index)
    met = wanted.join(found, ["field", "prefix"]).groupBy("query_id", "field", "needed", "bucket").agg(F.count("*").alias("met"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return met.where(F.col("met") == F.col("needed")).select("query_id", "bucket", "bitmap")


def query_counts(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, books): how many books each query finds; queries that find none have no row. queries: (query_id, field, text), one row each."""
    return query_bitmaps(queries, index).groupBy("query_id").agg(F.sum(F.bitmap_count("bitmap")).alias("books")).where(F.col("books") > 0)


def search_totals(tokens: DataFrame, books: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, field, total): active books that a term meets as author, title and series; terms: (term)."""
    fields = F.explode(F.array(*map(F.lit, ("title", "author", "series"))))
    queries = terms.select("term", fields.alias("field")).withColumn("query_id", F.concat_ws("|", "field", "term"))
    index = written(token_index(tokens.join(active_books(books).select("book_id"), "book_id", "left_semi")))
    counts = query_counts(queries.withColumn("text", F.col("term")), index)
    return queries.join(counts, "query_id", "left").select("term", "field", F.coalesce("books", F.lit(0)).alias("total"))


def list_counts(names: DataFrame, column: str, field: str, wide: DataFrame) -> DataFrame:
    """(name, books): the token matches of every listed name among the active books, answered in one job."""
    queries = names.select(F.col(column).alias("text"), F.lit(field).alias("field"), F.xxhash64(column).alias("query_id"))
    index = written(token_index(book_tokens(active_books(wide)).where(F.col("field") == field)))
    counts = query_counts(queries, index)
    return queries.join(counts, "query_id", "left").select(F.col("text").alias("name"), F.coalesce("books", F.lit(0)).alias("books"))


def query_books(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, book_id): the books themselves, from the bitmaps' bytes."""
    bytes_of = F.transform(F.sequence(F.lit(1), F.octet_length("bitmap")), lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i, F.lit(1))), 16, 10).cast("int"))
    each = query_bitmaps(queries, index).select("query_id", "bucket", F.posexplode(bytes_of).alias("byte", "bits")).where(F.col("bits") > 0)
    spots = each.select("query_id", "bucket", "bits", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.getbit("bits", "bit") == 1)
    place = F.col("byte") * 8 + F.col("bit")
    # bucket 1 begins with id 1 at place 0; from bucket 0 downwards places count down from its largest id
    book = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place)
    return spots.select("query_id", book.alias("book_id"))
