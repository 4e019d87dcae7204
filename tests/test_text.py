"""Hand cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import browse, shelves
from foliospark.operators.search import prefixes_match

U = X.UNKNOWN_AUTHOR
CASES = [
    (X.parse_authors, "Doe,Jane,Q:Roe,Sam:", ["Doe Jane Q", "Roe Sam"]), (X.parse_authors, "  Doe ,  Jane  Ann ", ["Doe Jane Ann"]), (X.parse_authors, "Solo", ["Solo"]), (X.parse_authors, "", [U]), (X.parse_authors, ":", [U]), (X.parse_authors, " , ", [U]), (X.parse_authors, None, [U]),
    (X.normalize_author, "Doe, Jane Q", "Jane Q Doe"), (X.normalize_author, "Doe,Jane,Q", "Jane,Q Doe"), (X.normalize_author, "Jane  Q   Doe", "Jane Q Doe"),
    (X.author_variants, "Doe, Jane Q", ["Doe, Jane Q", "Jane Q Doe,"]), (X.author_variants, "Doe,Jane,Q", ["Doe,Jane,Q"]), (X.author_variants, "Jane  Q   Doe", ["Jane Q Doe", "Q Doe Jane"]),
    (X.tokens, " Война и мир! №5-A ", ["война", "и", "мир", "5", "a"]), (X.tokens, "Éa_b", ["éa", "b"]), (X.tokens, "?!", []),
    (X.safe_filename, ' a/b:c?"d ', "abcd"), (X.safe_filename, "***", ""), (X.reader_filename, "a  b!", "a_b"), (X.reader_filename, "", "book"),
    (X.normalize_genre_code, "SF Fantasy-2 ", "sf_fantasy_2"), (X.normalize_genre_code, "__a__", "a"), (X.mime_type, "FB2", "application/fb2"), (X.mime_type, "zzz", X.OTHER_MIME),
    (X.split_genres, "a:: b:", ["a", " b"]), (X.clean_annotation, ' <p xmlns="u">a &amp;lt; <strong>b</strong></p> ', "<p>a &lt; <b>b</b></p>"), (X.path_escape, "a b+c/d", "a%20b+c%2Fd"), (X.query_escape, "a b+c*", "a+b%2Bc%2A"),
]
TITLES = [("War and Peace", "war  AND peace!", 0), ("The War and Peace Saga", "war and peace", 1), ("Peace after War and Rain", "war and peace", 2), ("Warcraft", "war", 3), ("Dune", "war", 4), ("Dune", "  ", 4), ("C++ Primer", "c++", 1), ("Wow!!! Really", "!!!", 3), ("!!!", "!!!", 3), ("Wara  bc", "ra b", 4)]
AUTHORS = [(["Doe Jane"], "Jane Doe", 1), (["doe jane", "Roe Sam"], "Jane Doe", 2), (["Doe Jane", "Roe Sam", "Poe Al"], "Jane Doe", 3), (["Roe Sam", "Doe Jane"], "Jane Doe", 4), (["Roe Sam"], "Jane Doe", 5), (["Doe-Smith Mary-Jane"], "Jane Doe", 1), (["Doe Jane"], "Doe, Jane", 5)]
CLASSES = [("ru", "Abc", 0), ("ru", "A, b", 1), ("unknown", "Abc", 0), ("", "A-b", 1), ("en", "Abc", 100), ("en", "A + b", 101)]
FORMATS = [("", "x.FB2", "fb2"), ("unknown", "x.htm", "html"), ("", "my_epub_1", "epub"), ("", "x", "unknown"), ("pdf", "x.fb2", "pdf")]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_one_argument(spark):
    got = spark.range(1).select(*(f(F.lit(x).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES))).first()
    assert list(got) == [want for _, _, want in CASES]


@pytest.mark.parametrize("f, cases", [(X.title_priority, TITLES), (X.author_priority, AUTHORS), (X.title_class, CLASSES), (X.ensure_format, FORMATS)])
def test_two_arguments(spark, f, cases):
    made = lambda a: F.array(*map(F.lit, a)) if isinstance(a, list) else F.lit(a)
    got = spark.range(1).select(*(f(made(a), F.lit(b)).alias(f"c{i}") for i, (a, b, _) in enumerate(cases))).first()
    assert list(got) == [want for _, _, want in cases]


def test_sizes_titles_and_prefixes(spark):
    assert [value(spark, X.size_mb(F.lit(n))) for n in (1048576, 1572864)] == ["1.00", "1.50"]
    shown = [value(spark, X.display_title(F.lit("T"), F.lit(s), F.lit(n), True)) for s, n in (("S", 3), ("S", 0), ("", 3))]
    assert shown == ["#3 T", "— T", "T"]
    met = [value(spark, prefixes_match(F.lit(t), F.lit(x))) for t, x in (("the ring", "ri"), ("string", "ri"), ("ring of war", "war ri"), ("x", "!!!"))]
    assert met == [True, False, True, True]


def test_neighbours_wrap(spark):
    out = browse.neighbours(spark.createDataFrame([(5,), (7,), (9,)], "book_id long").withColumn("g", F.lit(1)), ["book_id"], ["g"])
    assert {r.book_id: (r.previous_id, r.next_id) for r in out.collect()} == {5: (9, 7), 7: (5, 9), 9: (7, 5)}


def test_shelf_state(spark):
    events = [(1, 1, "add"), (2, 1, "remove"), (3, 1, "add"), (4, 2, "add"), (5, 2, "add"), (6, 2, "remove")]
    df = spark.createDataFrame([(e, 7, b, a) for e, b, a in events], "event_id long, user_id long, book_id long, action string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [(r.user_id, r.book_id) for r in shelves.shelf_state(df).collect()] == [(7, 1)]


def test_genres(spark):
    names = spark.createDataFrame([("sf", "Science tales"), ("sf_b", "Science tales"), ("ta", "tales")], "code string, name string")
    assert [r.name for r in browse.suggest_genres(names, "TALES").collect()] == ["tales", "Science tales"]
    assert {r.code for r in browse.genre_codes_for(names, " science TALES ").collect()} == {"sf", "sf_b"}
    assert [r.code for r in browse.genre_codes_for(names, "other genre").collect()] == ["other_genre"]
    assert browse.language_code_for(names, "tales").first().code == "ta"
