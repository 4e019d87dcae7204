"""Search: tiers over names and titles, token prefixes for one query or a table of queries, ranking, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.books import active_books, books_of, filter_genre, filter_language, name_list, newest_first, wide_books
from foliospark.operators.ranks import range_ranked
from foliospark.storage import written

# Caps of hits, and the least hits below which the token fallback is added.
MOST_AUTHORS, MOST_SERIES, MOST_GENRES, MOST_TITLES = 500, 500, 100, 1000
LEAST_AUTHORS, LEAST_SERIES, LEAST_TITLES = 20, 10, 1
#: Rows that a task sorts or tells apart at once, on average, where tables of queries meet postings.
TASK_ROWS = 500_000
#: Absent from any pattern, so that % and _ of a query stay wildcards and a backslash is itself.
ESCAPE = "\u0001"


def _like(value: Column, pattern: Column) -> Column:
    return F.like(value, pattern, F.lit(ESCAPE))


def match_tier(value: Column, forms: list[Column], exact: Column | None = None) -> Column:
    """1 equal, 2 begins with, 3 holds any of the forms, else null; letters A-Z in either case."""
    folded = X.ascii_lower(value)
    any_of = lambda pattern: _any([_like(folded, pattern(X.ascii_lower(q))) for q in forms])
    equal = _any([folded == X.ascii_lower(q) for q in forms]) if exact is None else exact
    return F.when(equal, 1).when(any_of(lambda q: F.concat(q, F.lit("%"))), 2).when(any_of(lambda q: F.concat(F.lit("%"), q, F.lit("%"))), 3)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def book_tokens(wide: DataFrame) -> DataFrame:
    """(book_id, field, token): distinct tokens of title, author list and series."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(X.tokens(F.coalesce(F.col(f), F.lit("")))).alias("tokens")) for f in ("title", "author", "series")))
    rows = wide.select("book_id", F.explode(fields).alias("x"))
    return rows.select("book_id", "x.field", F.explode("x.tokens").alias("token"))


def prefixes_match(value, query) -> Column:
    """Every token of the query begins some token of the value; a query without tokens matches all."""
    own = X.tokens(F.coalesce(X.col(value), F.lit("")))
    return F.forall(X.tokens(query), lambda t: F.exists(own, lambda w: F.startswith(w, t)))


def tokens_of_prefixes(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(field, prefix, token, ..): the tokens that begin with each asked (field, prefix), distinct; vocabulary: (field, token, ..). An equi-join on the tokens cut to the lengths in use."""
    lengths = asked.select("field", F.length("prefix").alias("k")).distinct()
    cut = vocabulary.join(lengths, "field").where(F.length("token") >= F.col("k")).withColumn("prefix", F.substr("token", F.lit(1), F.col("k"))).drop("k")
    return cut.join(asked, ["field", "prefix"])


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about `rows` rows, dealt by the keys to so many tasks that each has TASK_ROWS at most on average; as it is where the session's number of partitions does for that."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def match_queries(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, book_id) of a table (query_id, field, text): books where every token of the text begins some token of the field.

    The distinct vocabulary is cut to the lengths that query tokens of its field have and meets them in an equi-join. A query then goes on with the postings of
    its rarest token alone, and its other tokens are held against the books found there: no nested loop, and no row per book of a frequent token.
    Tokens are written once, as they are read three times. Tokens and books found are dealt to tasks by their number, so that what a task holds does not grow with it.
    For counts alone see `bitmaps`.
    """
    tokens = written(tokens.select("book_id", "field", "token"))
    held = tokens.count()
    wanted = queries.select("query_id", "field", F.explode(F.array_distinct(X.tokens("text"))).alias("prefix"))
    asked = wanted.select("field", "prefix").distinct()
    hits = written(tokens_of_prefixes(tokens.groupBy("field", "token").agg(F.count("*").alias("n")), asked))
    sizes = hits.groupBy("field", "prefix").agg(F.sum("n").alias("postings"))
    planned = wanted.join(sizes, ["field", "prefix"], "left").groupBy("query_id", "field").agg(
        F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "prefix")).alias("first"), F.collect_set("prefix").alias("prefixes")
    )
    starts = written(planned.where(F.col("first.postings") > 0).select("query_id", "field", "prefixes", F.col("first.prefix").alias("prefix"), "first.postings"))
    found = starts.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    met = starts.join(hits.select("field", "prefix", "token"), ["field", "prefix"]).join(spread(tokens, held, "field", "token"), ["field", "token"])
    near = spread(met.select("query_id", "field", "book_id", "prefixes"), found, "book_id", "field").distinct()
    alone = near.where(F.size("prefixes") == 1).select("query_id", "book_id")
    more = near.where(F.size("prefixes") > 1)
    own = spread(tokens, held, "book_id", "field").join(more.select("book_id", "field").distinct(), ["book_id", "field"], "left_semi").groupBy("book_id", "field").agg(F.collect_set("token").alias("own"))
    holds = F.forall("prefixes", lambda p: F.exists("own", lambda t: F.startswith(t, p)))
    return alone.unionByName(more.join(own, ["book_id", "field"]).where(holds).select("query_id", "book_id"))


def append_missing(primary: DataFrame, fallback: DataFrame, id_col: str, least: int) -> DataFrame:
    """(.., place): primary, then the fallback rows not in it where primary has fewer than `least` rows. Both carry an order column `place`; both are bounded by their caps."""
    few = primary.agg((F.count("*") < least).alias("few"))
    more = fallback.join(primary.select(id_col), id_col, "left_anti").crossJoin(F.broadcast(few)).where("few").drop("few")
    return primary.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)))


def _placed(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of an order, with their place in it: a bounded top-k."""
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def authors_of_matching_books(wide: DataFrame, book_authors: DataFrame, authors: DataFrame, query: str) -> DataFrame:
    """Every author of the active books whose author text meets the query's token prefixes."""
    if not _tokens_of(query):
        return authors.limit(0)
    hits = active_books(wide).where(prefixes_match("author", F.lit(query))).select("book_id")
    ids = book_authors.join(hits, "book_id", "left_semi").select("author_id").distinct()
    return authors.join(ids, "author_id", "left_semi").orderBy("name").limit(MOST_AUTHORS)


def series_of_matching_books(wide: DataFrame, series: DataFrame, query: str) -> DataFrame:
    if not _tokens_of(query):
        return series.limit(0)
    hits = active_books(wide).where(prefixes_match("series", F.lit(query)) & F.col("series_id").isNotNull())
    return series.join(hits.select("series_id").distinct(), "series_id", "left_semi").orderBy("name").limit(MOST_SERIES)


def _tokens_of(query: str) -> bool:
    return any(c.isalpha() or c.isdecimal() for c in query)


def find_authors(authors: DataFrame, wide: DataFrame, book_authors: DataFrame, query: str) -> DataFrame:
    q = F.lit(query)
    forms = [q, X.normalize_author(q)]
    tier = match_tier(F.col("name"), forms, _any([F.col("name") == f for f in forms]))
    hits = authors.select("author_id", "name", tier.alias("tier")).where("tier is not null")
    primary = _placed(hits, [F.col("tier"), F.col("name"), F.col("author_id")], MOST_AUTHORS)
    more = authors_of_matching_books(wide, book_authors, authors, query).select("author_id", "name", F.lit(4).alias("tier"))
    return append_missing(primary, _placed(more, [F.col("name"), F.col("author_id")], MOST_AUTHORS), "author_id", LEAST_AUTHORS)


def find_series(series: DataFrame, wide: DataFrame, query: str) -> DataFrame:
    hits = series.select("series_id", "name", match_tier(F.col("name"), [F.lit(query)]).alias("tier")).where("tier is not null")
    primary = _placed(hits, [F.col("tier"), F.col("name"), F.col("series_id")], MOST_SERIES)
    more = series_of_matching_books(wide, series, query).select("series_id", "name", F.lit(4).alias("tier"))
    return append_missing(primary, _placed(more, [F.col("name"), F.col("series_id")], MOST_SERIES), "series_id", LEAST_SERIES)


def find_genres(genres: DataFrame, query: str) -> DataFrame:
    tier = match_tier(F.col("code"), [F.lit(query)], F.col("code") == query)
    hits = genres.select("genre_id", "code", tier.alias("tier")).where("tier is not null")
    return _placed(hits, [F.col("tier"), F.col("code")], MOST_GENRES)


def find_titles(wide: DataFrame, query: str) -> DataFrame:
    """Ranked wide rows of active books."""
    query = query.strip()
    active = active_books(wide)
    if not query:
        return rank_by_title(active.limit(0), query, bounded=True)
    hits = active.withColumn("tier", match_tier(F.col("title"), [F.lit(query)])).where("tier is not null")
    primary = hits.orderBy("tier", "title", "book_id").limit(MOST_TITLES).drop("tier")
    fallback = active.where(prefixes_match("title", F.lit(query))).orderBy(*newest_first()).limit(MOST_TITLES)
    if not _tokens_of(query):
        fallback = fallback.limit(0)
    return rank_by_title(append_missing(primary, fallback, "book_id", LEAST_TITLES).drop("part"), query, bounded=True)


def ranked(books: DataFrame, order: list[Column], by: tuple[str, ...] | list[str] = (), bounded: bool = False) -> DataFrame:
    """rank within `by`. Without it all rows are in one order: by ranges, or in one window where the rows are a page or have a cap (bounded)."""
    if by or bounded:
        return books.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return range_ranked(books, order)


def rank_by_title(books: DataFrame, query, by: tuple[str, ...] = (), bounded: bool = False) -> DataFrame:
    """rank within `by` (one query where empty): title priority, title key, id. Keys are computed once per row."""
    q = F.lit(query) if isinstance(query, str) else query
    return ranked(books, [X.title_priority("title", q), X.title_key("language", "title"), F.col("book_id")], by, bounded)


def rank_by_author(books: DataFrame, query, by: tuple[str, ...] = (), bounded: bool = False) -> DataFrame:
    q = F.lit(query) if isinstance(query, str) else query
    return ranked(books, [X.author_priority("authors", q), F.size("authors"), X.title_key("language", "title"), F.col("book_id")], by, bounded)


def rank_by_title_author(books: DataFrame, title_query, author_query, by: tuple[str, ...] = (), bounded: bool = False) -> DataFrame:
    t, a = (F.lit(x) if isinstance(x, str) else x for x in (title_query, author_query))
    return ranked(books, [X.title_priority("title", t), X.author_priority("authors", a), X.title_key("language", "title"), F.col("book_id")], by, bounded)


def page(books: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    return books.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_of_each(books: DataFrame, by: list[str], order: list[Column], number: int, per_page: int) -> DataFrame:
    """One page of every query of a table of hits; `by` names the query. Rows past the page fall within the sort of a partition."""
    first = (number - 1) * per_page
    return ranked(books, order, by).where((F.col("rank") > first) & (F.col("rank") <= first + per_page))


def page_order(title: str = "", author: str = "", series: str = "", genre: str = "") -> list[Column]:
    if title:
        return [F.col("title"), F.col("book_id")]
    if series:
        return [F.col("series_no"), F.col("title"), F.col("book_id")]
    return [F.col("title"), F.col("book_id")] if author or genre else newest_first()


def matching_books(books: DataFrame, series: DataFrame, authors: DataFrame, genres: DataFrame, book_authors: DataFrame, book_genres: DataFrame, title: str = "", author: str = "", series_text: str = "", language: str = "", genre: str = "") -> DataFrame:
    """Active books that meet all filters; a filter without tokens filters nothing. Names are joined for the filters that ask for them only, authors last and for the books left by then."""
    out = filter_genre(filter_language(active_books(books), language), book_genres, genres, genre)
    if _tokens_of(title):
        out = out.where(prefixes_match("title", F.lit(title)))
    if _tokens_of(series_text):
        named = series.select("series_id", F.col("name").alias("_series")).where(prefixes_match("_series", F.lit(series_text)))
        out = out.join(named, "series_id", "left_semi")
    if _tokens_of(author):
        links = book_authors.join(out.select("book_id"), "book_id", "left_semi")
        lists = name_list(links, authors, "author_id", "name", "_authors").where(prefixes_match(F.array_join("_authors", ", "), X.normalize_author(F.lit(author))))
        out = out.join(lists.select("book_id"), "book_id", "left_semi")
    return out


def advanced_search(books: DataFrame, series: DataFrame, authors: DataFrame, genres: DataFrame, book_authors: DataFrame, book_genres: DataFrame, number: int = 1, per_page: int = 5000, title: str = "", author: str = "", series_text: str = "", language: str = "", genre: str = "") -> DataFrame:
    """One page of the filtered books as wide rows, ranked inside the page, with the total of all hits. The hits' sort keys are written once; wide rows are made for the page alone."""
    found = matching_books(books, series, authors, genres, book_authors, book_genres, title, author, series_text, language, genre)
    hits = written(found.select("book_id", "title", "series_no", "added_at"))
    order = page_order(title, author, series_text, genre)
    ids = F.broadcast(page(hits, order, number, per_page).select("book_id"))
    own = lambda df: df.join(ids, "book_id", "left_semi")
    rows = wide_books(own(books), series, authors, genres, own(book_authors), own(book_genres))
    if title and author:
        rows = rank_by_title_author(rows, title, author, bounded=True)
    elif title:
        rows = rank_by_title(rows, title, bounded=True)
    elif author:
        rows = rank_by_author(rows, author, bounded=True)
    else:
        rows = ranked(rows, order, bounded=True)
    return rows.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


def search_by_type(kind: str, query: str, wide: DataFrame, authors: DataFrame, series: DataFrame, genres: DataFrame, book_authors: DataFrame, book_genres: DataFrame) -> DataFrame:
    """Wide rows ranked by title or author, or in the order of the kind: series number and title, or title."""
    if kind == "title":
        return find_titles(wide, query)
    if kind == "author":
        hits = books_of(wide, book_authors, find_authors(authors, wide, book_authors, query), "author_id")
        return rank_by_author(hits, query)
    if kind == "series":
        hits = active_books(wide).join(find_series(series, wide, query).select("series_id"), "series_id", "left_semi")
        return ranked(hits, [F.col("series_no"), F.col("title"), F.col("book_id")])
    hits = books_of(wide, book_genres, find_genres(genres, query), "genre_id").orderBy("title", "book_id").limit(MOST_TITLES)
    return ranked(hits, [F.col("title"), F.col("book_id")], bounded=True)
