import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans import queries as catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else (round(float(v), 6) if isinstance(v, float) else str(v))
    return sorted((tuple(clean(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog_query_equals_sql(spark, data, duck, name):
    got, want = catalog.queries()[name](spark, data).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert {"book_id", "title", "rank", "total"} <= set(entry.entry(spark).columns)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_functions_read_whole_texts(spark, tmp_path):
    import re

    words = [f"Word{i}, é{i}" for i in range(400)]
    texts = {0: "Short", 1: " ".join(words), 2: "the first line\n" + "\n".join(words) + " /: end", 3: None}
    spark.createDataFrame([(i, t, "en", "s", 9) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.book_id - 1: r for r in catalog.queries()["text_functions_whole"](spark, str(tmp_path)).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        if t is not None:
            assert out[i].tokens.split() == re.findall(r"[^\W_]+", t.lower())
            assert out[i].code == re.sub(r"[^a-z0-9]+", "_", t.lower()).strip("_")


def test_every_part_gives_a_title_query(spark, data):
    import re

    c = catalog.Catalog(spark, data)
    asked = catalog.all_queries(c).collect()
    want_texts = {f"{r.p_name[:5]} {r.p_size}" for r in c.table("part").collect()}
    assert sorted(r.text for r in asked if r.field == "title") == sorted(want_texts) and len({r.query_id for r in asked}) == len(asked)
    find = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    books = [(b.book_id, {f: find(b[f]) for f in ("title", "author", "series")}) for b in catalog.wide(c).collect()]
    want = {(r.query_id, book) for r in asked for book, own in books if all(any(w.startswith(t) for w in own[r.field]) for t in find(r.text))}
    got = [tuple(r) for r in catalog.queries()["match_queries_all"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
