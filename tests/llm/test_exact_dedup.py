import hashlib
import random
from collections import defaultdict

import pytest

from foliospark.llm.exact_dedup import Trie, exact_duplicates, merged, op5_exact_dedup, text_owners


def brute(rows, largest=True):
    """{(id, text): (keep_id, group_size)} by comparing whole texts."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = lambda ids: (max if largest else min)([i for i in ids if i is not None], default=None)
    return {(i, t or ""): (best(groups[t or ""]), len(groups[t or ""])) for i, t in rows}


def check(out, rows, largest=True):
    want, text_of = brute(rows, largest), {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    assert len(out) == len(rows)
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.doc_id, text_of[r.text_sha256]]
        assert not r.kept or r.doc_id == r.keep_id
    kept = [r.text_sha256 for r in out if r.kept]
    assert sorted(kept) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows})  # one row of every text


def made_rows(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "ab", "abc", "é", "é", "x" * 50_000, "x" * 50_000 + "y", "line\nline", "A", " a"]
    texts += ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(120)]
    return [(i * 7 - 50, rng.choice(texts)) for i in range(400)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bound", [64 << 20, 300])
def test_equals_brute_force_with_and_without_spill(spark, keep, bound):
    rows = made_rows(len(keep))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, owner string")  # columns of the operator's own names
    check(exact_duplicates(df, keep=keep, trie_bytes=bound).collect(), rows, keep == "largest")
    assert text_owners(df, trie_bytes=bound).count() == len({t or "" for _, t in rows})


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "t"), (5, "t"), (5, "u"), (None, "t"), (None, "v"), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_duplicates(df).collect()
    check(out, rows)
    assert sum(r.kept for r in out) == 4 and [r.keep_id for r in out if r.group_size == 1 and r.doc_id is None] == [None]
    assert exact_duplicates(df.limit(0)).count() == 0


def test_a_third_of_all_rows_hold_one_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    check(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect(), rows)


def test_spilled_subtrees_are_merged():
    rng = random.Random(4)
    keys = [bytes(rng.choices(b"abc", k=rng.randint(0, 30))) for _ in range(500)] * 3
    out = list(merged(((k, i, 1) for i, k in enumerate(keys)), True, 2000))
    assert {k: (o, n) for k, o, n in out} == {k: (max(i for i, x in enumerate(keys) if x == k), keys.count(k)) for k in set(keys)}
    assert len(out) == len(set(keys))
    trie = Trie(True)
    trie.insert(b"abc", 0, 1, 1)
    trie.insert(b"abd", 0, 2, 1)
    assert sorted(trie.entries(b"", trie.root)) == [(b"abc", 1, 1), (b"abd", 2, 1)]


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(op5_exact_dedup(spark, data).collect(), rows)
