import hashlib
from collections import Counter

from foliospark.llm.fingerprints import SAMPLES, fingerprint_edits, op6_fingerprints


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        out = out.replace(c, " ")
    return Counter(x for x in out.split(" ") if x)


def jaccard(a, b):
    a, b = words(a), words(b)
    return sum((a & b).values()) / (sum((a | b).values()) or 1) if a or b else 1.0


def check(rows, docs):
    ranked = sorted(docs.items(), reverse=True)
    assert len(rows) == len(docs)
    out, errors = {r.doc_id: r for r in rows}, []
    for (doc, text), (_, following) in zip(ranked, ranked[1:] + ranked[:1]):
        text, following, r = text or "", following or "", out[doc]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert abs(sum(errors) / len(errors)) < 0.02
    assert max(map(abs, errors)) < 4.5 * 0.5 / SAMPLES**0.5
    return out


def test_query_estimates_the_generalised_jaccard(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = check(op6_fingerprints(spark, data).collect(), docs)
    by_text = {}
    for doc, text in docs.items():
        assert by_text.setdefault(text, out[doc].fingerprint) == out[doc].fingerprint


def test_edges(spark):
    texts = ["", None, "a", "a", "é" * 10, "w " * 30_000, "a b", " \n ", "x y z" * 40]
    docs = {i * 10**15 - 7: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, id int")
    out = check(fingerprint_edits(df).collect(), docs)
    assert out[-7].near_edited == 1 and out[10**15 - 7].near_next == 1.0
    assert fingerprint_edits(df.limit(0)).count() == 0


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (5, "x y"), (None, "n"), (None, None)], "doc_id long, text string")
    out = fingerprint_edits(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 0), (0, 1), (5, 3), (5, 5), (5, 5)]
    one = fingerprint_edits(df.where("text = 'x y'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
