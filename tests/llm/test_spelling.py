import random
import re
import zlib
from collections import Counter

import pytest

from foliospark.llm import spelling as P


def apart(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts, factor=10):
    by_cut = {}
    for w in counts:
        for i in range(len(w)):
            for key in {(w[:i] + w[i + 1 :]), (w[:i] + "*" + w[i + 1 :])}:
                by_cut.setdefault(key, set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for key in [w, *(w[:i] + w[i + 1 :] for i in range(len(w))), *(w[:i] + "*" + w[i + 1 :] for i in range(len(w)))]:
            near[w] |= {x for x in by_cut.get(key, set()) if apart(x, w)}
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def brute_counts(rows):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def same(got, want):
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = P.op12_spelling(spark, data)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = out.collect()
    assert any(r.form for r in got)
    same(got, brute_forms(brute_counts(rows)))


@pytest.mark.parametrize("chunk", [8192, 25])
def test_dense_words_whole_and_in_chunks(spark, monkeypatch, chunk):
    for name, value in {"VISITORS": 50, "FRONTIER": 300, "VERIFIED": 100}.items():
        monkeypatch.setattr(P, name, value)
    rng = random.Random(chunk)
    counts = {}
    for _ in range(700):
        w = "".join(rng.choice("abqrÀÿ×") for _ in range(rng.randint(7, 9)))
        counts[w] = 10 ** rng.randint(0, 4) + rng.randint(0, 1)
    counts |= {"aaaaaaa" + "b" * k: 10**k for k in range(8)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = [tuple(r) for r in P.near_words(words, chunk).collect()]
    want = sorted((a, b, counts[b]) for a in counts for b in counts if apart(a, b))
    assert sorted(near) == want
    same(P.spelling_variants(words).collect(), brute_forms(counts))


def test_nulls_long_runs_repeats_and_an_empty_table(spark, tmp_path):
    long = "ab" * 300
    rows = [(1, None), (2, ""), (3, f"{long} {long}x {long} {long}x"), (None, "WORDING wordING wordinÉ"), (None, "wording"), (5, "short 你好 déclaration Déclaration déclarations " * 40), (5, "short")]
    schema = "doc_id long, text string, word string, n long, run string, h long"
    spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    same(P.op12_spelling(spark, str(tmp_path)).collect(), brute_forms({w: n for w, n in brute_counts(rows).items()}))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert P.op12_spelling(spark, f"{tmp_path}/e").count() == 0
