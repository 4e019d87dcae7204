import random

import numpy as np

from foliospark.llm import ngram_join
from foliospark.llm.components import components
from foliospark.llm.ngram_join import op8_ngram_join, shingles, similar_groups


def brute(texts, n, percent):
    """{id: (size, component)} by comparing all pairs."""
    sets = {}
    for doc, text in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def made_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(3, 120)) + passage * rng.randint(0, 1)
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    texts += ["", None, "one", "One", "one two", "a b c d", "A\tB c  d ", " ", "é e", "\x85 x"]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def test_components_equal_brute_force(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 1, 60), (6, 2, 100)):
        texts = made_texts(seed)
        df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, size int")
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, n=n, percent=percent).collect()}
        assert out == brute(texts, n, percent)


def test_rounds_equal_brute_force(spark, monkeypatch):
    """Lists of over two members go to rounds of their own, under a sketch that tells little."""
    monkeypatch.setattr(ngram_join, "LONG", 2)
    monkeypatch.setattr(ngram_join, "PAIRS", 0)
    for seed, n, percent, bits, most, shrink in ((4, 4, 85, 2, 4, 0.99), (5, 5, 80, 6, 6, 0.0)):
        monkeypatch.setattr(ngram_join, "SKETCH_BITS", bits)
        monkeypatch.setattr(ngram_join, "MOST_SKETCH_BITS", most)
        monkeypatch.setattr(ngram_join, "SHRINK", shrink)
        texts = made_texts(seed)
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), n=n, percent=percent).collect()}
        assert out == brute(texts, n, percent)


def test_groups_that_share_a_passage_do_not_meet_in_it(spark, monkeypatch):
    """Candidate pairs do not grow with the square of a group, even where the corpus is far larger than its sketch."""
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 9)
    monkeypatch.setattr(ngram_join, "PAIRS", 0)
    compared = []
    real = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), real(pairs, *rest))[1])
    rng = random.Random(7)
    fill = [[f"f{rng.randrange(10**6)}" for _ in range(130)] for _ in range(900)]
    passage = [f"p{i}" for i in range(90)]
    pairs = {}
    for size in (60, 120):
        group = [passage + [f"g{rng.randrange(10**6)}" for _ in range(40)] for _ in range(size)]
        texts = list(enumerate([" ".join(x) for x in fill + group + [group[3][:-1] + ["odd"]]]))
        compared.clear()
        out = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), n=4, percent=85).collect()}
        assert {i: c for i, c in out.items() if i != c} == {900 + size: 903}
        pairs[size] = sum(compared)
    assert pairs[120] < 3 * pairs[60] and pairs[120] < 20 * 120, pairs


def test_the_sketch_grows_with_the_corpus(spark, monkeypatch):
    """A passage in one of 16 documents is told in the first round, whatever the least size of a sketch."""
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 6)
    monkeypatch.setattr(ngram_join, "PAIRS", 0)
    monkeypatch.setattr(ngram_join, "LONG", 8)
    rounds = []
    real = ngram_join.sketch_classes
    monkeypatch.setattr(ngram_join, "sketch_classes", lambda hashed, n, bits: (rounds.append(bits), real(hashed, n, bits))[1])
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    group = [passage + [f"g{rng.randrange(10**6)}" for _ in range(40)] for _ in range(60)]
    fill = [[f"f{rng.randrange(10**6)}" for _ in range(130)] for _ in range(900)]
    texts = list(enumerate([" ".join(x) for x in fill + group + [group[3][:-1] + ["odd"]]]))
    out = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), n=4, percent=85).collect()}
    assert {i: c for i, c in out.items() if i != c} == {960: 903} and len(rounds) == 1, rounds


def test_sketch_classes_count_all_tasks(spark):
    """Against counts in one piece: ranges of buckets, counts beyond one byte, an empty range."""
    docs = [[1, 2, 3, 4, 5]] * 700 + [[7 * i, 7 * i + 1, 7 * i + 2, 7 * i + 3] for i in range(3000)] + [[]]
    hashed = spark.createDataFrame([(d,) for d in docs], "hashes array<long>").repartition(5)
    for bits in (3, 13):
        total = np.zeros(1 << bits, dtype=np.int64)
        for d in docs:
            np.add.at(total, (shingles(np.array(d, dtype=np.int64), 4) >> np.uint64(64 - bits)).astype(np.int64), 1)
        width = 1 << min(bits, ngram_join.RANGE_BITS)
        load = np.repeat(np.maximum(np.median(total.reshape(-1, width), axis=1), 1.0), width)
        over = (total - load) / (4 * load**0.5)
        want = np.where(over <= 1, 0, 1 + np.log2(np.maximum(over, 1))).astype(np.uint8)
        assert (ngram_join.sketch_classes(hashed, 4, bits) == want).all() and want.max() > 0
    assert not ngram_join.sketch_classes(hashed.limit(0), 4, 13).any()


def test_repeated_rows_nulls_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    df = spark.createDataFrame([(2, "a b c d e f")] * 30 + [(None, "a b c d e f"), (9, long), (8, long + " x"), (None, "q r s t u v")], "doc_id long, text string")
    out = similar_groups(df).collect()
    assert len(out) == 34 and {r.component_id for r in out if r.n_shingles == 2 and r.doc_id} == {2}
    assert {r.component_id for r in out if r.doc_id in (8, 9)} == {8}
    assert sorted((r.component_id is None, r.component_id or 0) for r in out if r.doc_id is None) == [(False, 2), (True, 0)]
    assert similar_groups(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(500, 499), (7, 7)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(out[i] == 100 for i in range(100, 161)) and all(out[i] == 1 for i in range(1, 30)) and out[500] == 499 and 499 in out


def test_shingles():
    h = np.arange(6, dtype=np.int64)
    assert len(shingles(h, 4)) == 3 and len(shingles(h[:2], 4)) == 1 and len(shingles(h[:0], 4)) == 0
    assert len(shingles(np.zeros(9, dtype=np.int64), 4)) == 1


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_join(spark, data).collect()} == brute(docs, 4, 85)
