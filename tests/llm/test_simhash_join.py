import random
import re

import numpy as np
import pytest
import xxhash

from foliospark.llm import simhash_join as S


def brute_fp(text, n=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, most):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def brute(rows, n=4, most=4):
    prints = [(i, brute_fp(t, n)) for i, t in rows]
    roots = brute_roots({f for _, f in prints}, most)
    least = {}
    for i, f in prints:
        r = roots[f]
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, f"{f:016x}", least[roots[f]]) for i, f in prints), key=repr)


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op13_simhash(spark, data).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == brute(docs)


def test_nulls_repeats_clashing_columns_and_an_empty_table(spark):
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE  TWO"), (None, "one two"), (None, "alone here"), (7, long), (7, long), (8, long + " end"), (9, "É é ﬁ 好 \U0001f600 x")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, words int")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in S.simhash_groups(df).collect()), key=repr)
    assert got == brute(rows)
    assert S.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks,most,chunk", [(5, 4, 4096), (3, 4, 40), (2, 4, 4096), (1, 2, 4096), (2, 1, 10)])
def test_every_grid_connects_what_brute_force_connects(spark, blocks, most, chunk):
    rng = random.Random(blocks * 10 + most)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, most + 2)):
                v ^= 1 << b
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [tuple(r) for r in S.near_links(fps, most, blocks, chunk).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= most for a, b in links)
    back = lambda v: v & (1 << 64) - 1
    root = {v: v for v in values}
    for a, b in links:
        low, high = sorted((root[back(a)], root[back(b)]))
        root = {k: low if r == high else r for k, r in root.items()}
    least = brute_roots(values, most)
    groups = lambda of: {frozenset(v for v in values if of[v] == r) for r in set(of.values())}
    assert groups(root) == groups(least)


def test_a_group_of_near_fingerprints_gives_fewer_links_than_members():
    near = np.array([0, *(1 << b for b in range(64)), *(1 << a | 1 << b for a in range(64) for b in range(a))], dtype=np.uint64)
    assert len(S.forest(near, near, 4, True)) == len(near) - 1
    assert len(S.forest(near[:65], near[65:], 4, False)) == len(near) - 1


def test_majority_over_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 20, 1, 0, 7, 14, 0])
    offsets = np.concatenate([[0], np.cumsum(sizes)]) + 2
    hashes = rng.integers(-(1 << 63), 1 << 63, offsets[-1], dtype=np.int64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[lo:hi]) > hi - lo) for lo, hi in zip(offsets, offsets[1:])]
    assert [int(x) & (1 << 64) - 1 for x in S.majority(offsets, hashes)] == want
