import math
import zlib
from collections import Counter

import numpy as np

from foliospark.llm import recurrent_lm as lm


def tokens_of(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        out = out.replace(c, " ")
    return [x for x in out.split(" ") if x] + [lm.END]


def small_vocabulary():
    head = tuple((f"w{i}", 5000 // (i + 1) + 1) for i in range(1500))
    return lm.Vocabulary(head, sum(c for _, c in head) + 700, 1500 + 400)


def test_probabilities_sum_to_one():
    v = small_vocabulary()
    p = lm.first_parameters(v)
    h = np.tanh(np.random.default_rng(0).normal(size=(lm.HIDDEN, 1))).astype(np.float32)
    symbols = np.arange(lm.EXPLICIT + v.bands + 1)
    logs, _ = lm.outputs(p, np.repeat(h, len(symbols), axis=1), symbols)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    for band in (lm.EXPLICIT,):
        inside = np.exp(v.within[:-1][v.symbol[:-1] == band])
        assert abs(inside.sum() - 1) < 1e-9


def test_gradients_are_the_derivatives():
    rng, v = np.random.default_rng(1), small_vocabulary()
    p = {k: x.astype(np.float64) for k, x in lm.first_parameters(v).items()}
    sequences = [rng.integers(0, 40, n) for n in (5, 3, 1)]
    tokens, before, lengths = lm.padded(sequences, lm.EXPLICIT + v.bands + 1)
    h = rng.normal(size=(lm.HIDDEN, 3)) * 0.1
    grads, _, loss = lm.window_gradients(p, tokens, before, lengths, h)
    for name, x in p.items():
        touched = np.argwhere(np.abs(grads[name]) > 1e-3)
        for at in map(tuple, touched[rng.integers(0, len(touched), 3)]):
            old = x[at]
            x[at] = old + 1e-4
            up = lm.window_gradients(p, tokens, before, lengths, h)[2]
            x[at] = old - 1e-4
            down = lm.window_gradients(p, tokens, before, lengths, h)[2]
            x[at] = old
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-2 * max(1, abs(grads[name][at])), (name, at)


def test_scores_equal_one_by_one():
    rng, v = np.random.default_rng(2), small_vocabulary()
    p, begin = lm.first_parameters(v), lm.EXPLICIT + v.bands + 1
    sequences = [rng.integers(0, begin, n) for n in (1, 40, 7, 900, 40)]
    got = lm.score_sequences(p, sequences, begin)
    for s, total in zip(sequences, got):
        h, before, want = np.zeros((lm.HIDDEN, 1), dtype=np.float32), begin, 0.0
        for t in s:
            h = lm._step(p, p["E"][[before]].T, h)[0]
            want += lm.outputs(p, h, np.array([t]))[0][0]
            before = t
        assert abs(want - total) < 1e-3 * len(s)


def brute_base(docs, training):
    c = Counter(t for text in training for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    return {d: (len(tokens_of(t)), sum(c[x] > 0 for x in tokens_of(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens_of(t))) for d, t in docs.items()}


def test_query(spark):
    data = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want = brute_base(docs, [t for d, t in docs.items() if not held(d)])
    out = lm.op3_lm_scores(spark, data).collect()
    assert len(out) == len(docs)
    for r in out:
        size, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), size, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r.score) and r.score < 0
    unseen = [r for r in out if r.held_out]
    print("held out, log10 per token:", sum(r.base_score for r in unseen) / sum(r.n_tokens for r in unseen), sum(r.score for r in unseen) / sum(r.n_tokens for r in unseen))
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_edges(spark):
    texts = {1: "", 2: None, 3: "a b A\tb", 4: "x" * 30_000, 5: "w " * 20_000, 6: "a", 7: "é \x85 ü"}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()] + [(None, "a b", 1), (6, "a", 2)], "doc_id long, text string, score int")
    counts, v = lm.vocabulary_of(df.limit(0))
    assert (v.total, v.distinct) == (0, 0)
    codes = lm.encoded(df, v)
    assert lm.score_codes(codes, counts, v, lm.train(codes.limit(0), v)).count() == 9
    counts, v = lm.vocabulary_of(df)
    codes = lm.encoded(df, v)
    out = lm.score_codes(codes, counts, v, lm.train(codes, v)).collect()
    want = brute_base(texts, [*texts.values(), "a b", "a"])
    assert len(out) == 9
    for r in out:
        if r.doc_id:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and abs(r.base_score - want[r.doc_id][3]) < 1e-6 * abs(want[r.doc_id][3])
    assert lm.score_codes(lm.encoded(df.limit(0), v), counts, v, lm.first_parameters(v)).count() == 0


def test_every_token_is_trained_on(monkeypatch):
    rng, begin = np.random.default_rng(4), 50
    monkeypatch.setattr(lm, "BATCH", 3)
    sequences = [rng.integers(0, 40, n) for n in (1, 200, 16, 17, 33, 5, 700, 32)]
    done, places = [], []
    for tokens, before, lengths, carried in lm.windows(iter(sequences), begin):
        assert len(carried) == tokens.shape[1] <= 3 and len(tokens) <= lm.WINDOW
        now = []
        for i, old in enumerate(carried):
            own = tokens[: lengths[i], i].tolist()
            if old < 0:
                done.append([])
            one = done[-1] if old < 0 else places[old]
            assert before[0, i] == (one[-1] if one else begin) and before[1 : len(own), i].tolist() == own[:-1]
            one += own
            now.append(one)
        places = now
    assert sorted(done) == sorted(s.tolist() for s in sequences)


def test_training_carries_the_state_over_all_windows(monkeypatch):
    v = small_vocabulary()
    p, begin = lm.first_parameters(v), lm.EXPLICIT + v.bands + 1
    sequences = [np.random.default_rng(5).integers(0, 40, n) for n in (100, 20_000)]
    states, real = [], lm.window_gradients

    def kept(p, tokens, before, lengths, h):
        out = real(p, tokens, before, lengths, h)
        states.append((h.copy(), out[1].copy()))
        return out

    monkeypatch.setattr(lm, "window_gradients", kept)
    assert lm.trained(p, iter(sequences), begin)[1] == 20_100
    assert len(states) == 20_000 // lm.WINDOW and (states[0][0] == 0).all()
    assert all((new[0][:, 0] == old[1][:, 0]).all() for old, new in zip(states, states[1:]))  # the longest is first


def test_train_reads_whole_documents(spark, monkeypatch):
    texts = [(1, " ".join(f"w{i % 30}" for i in range(5000)), 0), (2, "w1 w2", 0), (3, None, 0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, x int")
    counts, v = lm.vocabulary_of(df)
    codes = lm.encoded(df.coalesce(1), v)
    scores = {r.doc_id: r for r in lm.score_codes(codes, counts, v, lm.train(codes, v)).collect()}
    assert scores[1].n_tokens == 5001 and scores[1].score > 0.6 * scores[1].base_score


def test_head_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)
    text = " ".join(f"w{i}" for i in range(200) for _ in range(200 - i))
    counts, v = lm.vocabulary_of(spark.createDataFrame([(text,)], "text string"))
    c = {r.word: r.c for r in counts.collect()}
    assert 32 < len(v.head) <= 64 and all(c[w] == n for w, n in v.head) and min(n for _, n in v.head) > max(n for w, n in c.items() if w not in dict(v.head))
    assert (v.total, v.distinct) == (sum(c.values()), len(c))
