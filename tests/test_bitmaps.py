import random

from foliospark.operators import bitmaps, search


def test_counts_and_books_equal_the_rows(spark):
    rng = random.Random(2)
    vocabulary = ["a", "ab", "abc", "b", "ba", "é", "1", "12"]
    ids = [0, -1, -32768, -40000, *rng.sample(range(1, 200_000), 300)]
    rows = [(i, f, t) for i in ids for f in ("title", "author") for t in rng.sample(vocabulary, rng.randint(0, 4))]
    tokens = spark.createDataFrame(rows, "book_id long, field string, token string")
    texts = ["a", "A b", "ab 1", "é", "zz", "a zz", "", "1 12 a", "abc ab a", None]
    queries = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate((f, t) for f in ("title", "author") for t in texts)], "query_id long, field string, text string")
    want = sorted(tuple(r) for r in search.match_queries(queries, tokens).select("query_id", "book_id").collect())
    own: dict = {}
    for i, f, t in rows:
        own.setdefault((i, f), set()).add(t)
    brute = sorted((q.query_id, i) for q in queries.collect() for i in ids if (p := (q.text or "").lower().split()) and all(any(t.startswith(x) for t in own.get((i, q.field), ())) for x in p))
    assert want == brute
    for few in (0, 5, 1000):
        index = bitmaps.token_index(tokens, few).cache()
        assert index.where("(places is null) = (bitmap is null)").count() == 0
        assert sorted(tuple(r) for r in bitmaps.query_books(queries, index).collect()) == brute
        assert {r.query_id: r.books for r in bitmaps.query_counts(queries, index).collect()} == {q: sum(1 for x, _ in brute if x == q) for q in {x for x, _ in brute}}
    assert bitmaps.query_counts(queries, bitmaps.token_index(tokens.limit(0))).count() == 0
