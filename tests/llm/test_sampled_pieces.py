import math
from collections import Counter

import numpy as np

from foliospark.llm.sampled_pieces import PieceLattice, decoded, op4_sampled_pieces, public_model, sampled_segmentations

LATTICE = PieceLattice(public_model())


def all_paths(words):
    """{ids: log-probability} of every segmentation, by brute force."""
    out = {(): 0.0}
    for w in words:
        edges, done, open_ = w.edges, {}, [(0, (), 0.0)]
        while open_:
            at, ids, p = open_.pop()
            if at == len(edges):
                done[ids] = p - w.log_mass
                continue
            open_ += [(j, ids + piece, p + x) for j, piece, x in edges[at]]
        out = {a + b: p + q for a, p in out.items() for b, q in done.items()}
    return out


def test_samples_follow_the_probabilities():
    text = "ab cat"
    want = all_paths([LATTICE.word(w) for w in LATTICE.split(text)])
    assert abs(sum(map(math.exp, want.values())) - 1) < 1e-9
    first, second, runs = Counter(), Counter(), 6000
    for seed in range(runs):
        out = LATTICE.sample(text, 2, seed)
        assert out[0][2] >= out[1][2] and out[0][0] != out[1][0]
        first[tuple(out[0][0])] += 1
        second[tuple(out[1][0])] += 1
        for ids, p, _, inclusion in out:
            assert abs(want[tuple(ids)] - p) < 1e-9 and 0 < inclusion <= 1
    p = {ids: math.exp(x) for ids, x in want.items()}
    for ids, x in p.items():
        assert abs(first[ids] / runs - x) < 0.03
        without = sum(p[o] * x / (1 - p[o]) for o in p if o != ids and p[o] < 1)
        assert abs(second[ids] / runs - without) < 0.03


def test_all_segmentations_of_a_small_text():
    word = LATTICE.word(LATTICE.split("to")[0])
    want = all_paths([word])
    out = LATTICE.sample("to", 500, 1)
    assert {tuple(o[0]) for o in out} == set(want) and all(o[3] == 1.0 for o in out)


def test_choices_do_not_depend_on_history():
    w, fresh = (PieceLattice(public_model()).word("▁nation") for _ in range(2))
    want = all_paths([w])
    rng, n = np.random.default_rng(0), 4000
    us = rng.random(n).tolist()
    got = [w.choose(u) for u in us]
    assert got[::-1] == [fresh.choose(u) for u in us[::-1]]
    counts = Counter(ids for ids, _ in got)
    for ids, p in want.items():
        assert abs(counts[ids] / n - math.exp(p)) < 0.03


def test_rows_decode_to_the_normalized_text(spark):
    texts = ["", None, "a", "Hello  wörld 漢字\n", "x" * 300, "the cat " * 4000, "é", "▁", "\t"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (2, "a", 2)], "doc_id long, text string, ids int")
    rows = decoded(sampled_segmentations(df, public_model(), k=3), public_model()).collect()
    for r in rows:
        text = "a b" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.text == LATTICE.model.decode(LATTICE.model.encode(text)), r
    per = Counter((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id != 2)
    assert max(per.values()) == 1 and len([r for r in rows if r.doc_id == 5]) == 3
    assert len({tuple(r.ids) for r in rows if r.doc_id == 0}) == 1
    assert sampled_segmentations(df.limit(0), public_model()).count() == 0


def test_query_is_repeatable(spark, data):
    a, b = (sorted(map(tuple, op4_sampled_pieces(spark, data).collect())) for _ in range(2))
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert a == b and len({r[0] for r in a}) == docs


def whole_paths(text):
    """{ids: log weight} of every segmentation of the whole normalized text."""
    normal, out = LATTICE.model.normalize(text), {}
    open_ = [(0, (), 0.0)]
    while open_:
        at, ids, p = open_.pop()
        if at == len(normal):
            out[ids] = p
            continue
        for j in range(at + 1, len(normal) + 1):
            if (hit := LATTICE.weight.get(normal[at:j])) is not None:
                open_.append((j, (*ids, *hit[0]), p + hit[1]))
        assert normal[at] in LATTICE.weight
    total = math.log(sum(map(math.exp, out.values())))
    return {ids: p - total for ids, p in out.items()}


def test_runs_of_spaces_are_segmented_as_a_whole():
    for text in ("a  b", "a   b c", "  a", "a  ", "    "):
        want = whole_paths(text)
        out = LATTICE.sample(text, 5000, 3)
        assert {tuple(o[0]) for o in out} == set(want) and all(o[3] == 1.0 for o in out), text
        assert all(abs(want[tuple(ids)] - p) < 1e-9 for ids, p, *_ in out)
        assert tuple(LATTICE.model.encode(text)) in want
    assert "".join(LATTICE.split("a  b   c d")) == LATTICE.model.normalize("a  b   c d") and len(LATTICE.split("a b c")) == 3
    out = LATTICE.sample("x" + " " * 3000 + "y", 4, 1)
    assert len({tuple(o[0]) for o in out}) == 4 and all(LATTICE.decode(o[0]) == "x" + " " * 3000 + "y" for o in out)


def test_query_decodes(spark, tmp_path):
    import hashlib

    texts = {1: "a  b\tc", 2: None, 3: "    if x:\n        y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op4_sampled_pieces(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256(LATTICE.model.decode(LATTICE.model.encode(texts[r.doc_id] or "")).encode()).hexdigest()


def small_lattice(weights):
    lattice = PieceLattice.__new__(PieceLattice)
    lattice.weight = {piece: ((i,), w) for i, (piece, w) in enumerate(weights.items())}
    lattice.joined, lattice.longest, lattice.words, lattice.edges = set(), 8, {}, 0
    lattice.split = lambda text: text.split()
    return lattice


def test_segmentations_of_the_smallest_mass_are_drawn_too():
    """2**6 segmentations, of which one has all mass but e**-300: more than are listed, and none is dropped or waited for."""
    lattice = small_lattice({"a" * k: (0.0 if k == 7 else -300.0 * (k + 1)) for k in range(1, 8)})
    for k in (40, 63, 64, 80):
        out = lattice.sample("a" * 7, k, 5)
        assert len(out) == len({tuple(ids) for ids, *_ in out}) == min(k, 64)
        assert all(sum(len("a") * (i + 1) for i in ids) == 7 for ids, *_ in out)
        assert k < 64 or all(x[3] == 1.0 for x in out)


def test_departures_are_what_the_known_ones_leave():
    lattice = small_lattice({"a" * k: -1.0 - 0.37 * k for k in range(1, 6)})
    word = lattice.word("a" * 8)
    every = word.best(10_000)
    assert abs(math.fsum(math.exp(p) for _, p in every) - 1) < 1e-9
    for size in (1, 5, 24, 60):
        known = {ids for ids, _ in every[::2][:size]}
        left = math.fsum(math.exp(p) for ids, p in every if ids not in known)
        assert abs(math.fsum(math.exp(x[-1]) for x in word.departures(known)) - left) < 1e-9
        assert abs(math.exp(word.log_left(known)) - left) < 1e-9
        rng, drawn, by_ids = np.random.default_rng(1), [], dict(every)
        for _ in range(2000):
            ids, p = word.draw_other(known, rng)
            assert ids not in known and abs(by_ids[ids] - p) < 1e-9
            drawn.append(ids)
        top = max((p, ids) for ids, p in every if ids not in known)
        share = math.exp(top[0]) / left
        assert abs(drawn.count(top[1]) / 2000 - share) < 5 * math.sqrt(share / 2000)


def test_texts_searched_together_get_what_they_get_alone(monkeypatch):
    """Long words, spelled characters, runs of spaces and barred first words among others; no word of a usual text gets a lattice of its own."""
    texts = ["The house of the rising sun, été 漢字🙂🧿\n", "", "x" * 700 + " and on", "a", "a  b   c", *(f"nation {i} station" for i in range(40))]
    seeds = list(range(len(texts)))
    together = PieceLattice(public_model()).samples(texts, 4, seeds)
    for i in (0, 1, 2, 3, 4, 17):
        alone = LATTICE.samples([texts[i]], 4, [seeds[i]])[0]
        assert [(ids.tolist(), *x) for ids, *x in together[i]] == [(ids.tolist(), *x) for ids, *x in alone]
        for ids, p, *_ in alone:
            assert p < 1e-12 and LATTICE.decode(ids.tolist()) == LATTICE.model.decode(LATTICE.model.encode(texts[i]))
    asked = []
    monkeypatch.setattr(PieceLattice, "word", lambda self, text, word=PieceLattice.word: asked.append(text) or word(self, text))
    LATTICE.samples([" ".join(f"ing{i}er" for i in range(1000))], 4, [1])
    assert len(asked) < 10


def test_texts_decoded_in_the_same_pass(spark):
    df = spark.createDataFrame([(1, "a  b\tc"), (2, None), (3, "été 漢字🙂\nx"), (4, "    if x:")], "doc_id long, text string")
    one = sampled_segmentations(df, public_model(), texts=True)
    assert sorted(map(str, one.collect())) == sorted(map(str, decoded(sampled_segmentations(df, public_model()), public_model()).collect()))
