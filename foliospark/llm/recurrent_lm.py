"""Language-model scores by a gated recurrent network in numpy.

Words of all training documents are counted by Spark. The most frequent ones, HEAD at most, are shipped to the tasks;
of these the EXPLICIT most frequent have states of their own in the network, further ones belong to bands of doubling rank, and all other words,
unseen ones among them, to one tail class. The output softmax is factored: a softmax over classes, then within a class of explicit words
a softmax over its words, within a band or the tail the smoothed share of the word's count. So the model is a probability distribution over
the words seen in training and one unseen word. A document is read from its first word to its end token, with the state of the
gated recurrent unit carried from window to window.

Training: all tokens of every training document, once a round. Each task runs truncated backpropagation (WINDOW tokens) over the documents of its split,
BATCH at once and each with its state carried from window to window, from the same first parameters, which start at the unigram distribution;
the parameters are averaged by a Spark aggregation weighted by tokens, once a round, for ROUNDS rounds. Their number does not depend on the corpus.

Words outside the head meet their counts in an equi-join, so nothing that grows with the vocabulary is broadcast.

Defined results: a null text is the empty text, which has the end token alone; rows repeated with equal id and text each get a row;
a null id is in training; a corpus without training rows scores with N = V = 0; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import SPACES, ascii_lower, crc_fold, table, written

HEAD, EXPLICIT, CLASS_WORDS = 1 << 16, 1024, 32
HIDDEN, WINDOW, ROUNDS = 16, 32, 1
#: Documents trained on at once, step size (Adam), documents scored at once, states whose outputs are computed at once, documents encoded at once.
BATCH, RATE, SCORED, STATES, SLICE = 256, 0.25, 16_384, 1 << 13, 500
#: Whole windows over which the step size grows, before it falls with the root of their number.
WARM = 16
#: Levels of the histogram of counts for each doubling of a count.
LEVELS = 16
END = "\n"  # no word holds a line end
LN10 = math.log(10)


@dataclass(frozen=True)
class Vocabulary:
    """head: (word, count) in order of count; total and distinct over all training tokens."""

    head: tuple[tuple[str, int], ...]
    total: int
    distinct: int

    @functools.cached_property
    def ids(self) -> dict[bytes, int]:
        return {w.encode(): i for i, (w, _) in enumerate(self.head)}

    @functools.cached_property
    def counts(self) -> np.ndarray:
        return np.array([c for _, c in self.head] + [0], dtype=np.float64)

    @property
    def classes(self) -> int:
        return EXPLICIT // CLASS_WORDS + self.bands + 1

    @property
    def bands(self) -> int:
        return int(math.log2(HEAD // EXPLICIT))

    @functools.cached_property
    def symbol(self) -> np.ndarray:
        """The network's symbol of a head id, or of the id after the last (tail): explicit words, then bands, then the tail."""
        i = np.arange(len(self.head))
        out = np.where(i < EXPLICIT, i, EXPLICIT + np.log2(np.maximum(i, 1) / EXPLICIT).clip(0).astype(int))
        return np.append(out, EXPLICIT + self.bands)

    @functools.cached_property
    def tail_total(self) -> float:
        """Smoothed count of all tail words and the unseen word."""
        return self.total - self.counts.sum() + (self.distinct - len(self.head)) + 1

    @functools.cached_property
    def mass(self) -> np.ndarray:
        """Smoothed counts by symbol, also for symbols without words."""
        out = np.bincount(self.symbol[:-1], weights=self.counts[:-1] + 1, minlength=EXPLICIT + self.bands + 1)
        out[-1] = self.tail_total
        return out

    @functools.cached_property
    def within(self) -> np.ndarray:
        """ln of the share of a word in its band, by head id; 0 for explicit words and the tail."""
        share = np.log((self.counts + 1) / np.maximum(self.mass[self.symbol], 1))
        return np.where((self.symbol < EXPLICIT) | (self.symbol == EXPLICIT + self.bands), 0.0, share)


def symbol_class(symbols: np.ndarray) -> np.ndarray:
    explicit = EXPLICIT // CLASS_WORDS
    return np.where(symbols < EXPLICIT, symbols // CLASS_WORDS, explicit + symbols - EXPLICIT)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by tanh, which does not overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def first_parameters(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are the logarithms of the unigram masses."""
    rng, h, symbols, classes = np.random.default_rng(7), HIDDEN, EXPLICIT + vocabulary.bands + 1, vocabulary.classes
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    class_mass = np.bincount(symbol_class(np.arange(symbols)), weights=vocabulary.mass, minlength=classes)
    return {
        "E": small(symbols + 1, 3 * h),  # of the symbol before, or of the beginning
        "U": small(h, 3 * h),
        "C": small(h, classes), "c": np.log(np.maximum(class_mass, 1)).astype(np.float32),
        "W": small(EXPLICIT // CLASS_WORDS, h, CLASS_WORDS), "w": np.log(np.maximum(vocabulary.mass[:EXPLICIT], 0.5)).reshape(-1, CLASS_WORDS).astype(np.float32),
    }


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated recurrent unit for a batch, as (unit, batch); x: the inputs of the symbols that came before."""
    k = HIDDEN
    u = p["U"].T @ h
    gates = _sigmoid(x[: 2 * k] + u[: 2 * k])
    r, z, un = gates[:k], gates[k:], u[2 * k :]
    n = np.tanh(x[2 * k :] + r * un)
    return n + z * (h - n), r, z, n, un


def _softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln p of the targets, exp, sum) of the logits weights.T @ h + bias, as (symbol, batch). States lie in (-1, 1), so one shift for all will do where the weights are small."""
    x = weights.T @ h
    if np.abs(weights).sum(axis=0).max() < 40:
        x += (bias - bias.max())[:, None]
    else:
        x += bias[:, None]
        x -= x.max(axis=0)
    aimed = x[target, np.arange(x.shape[1])]
    e = np.exp(x, out=x)
    total = e.sum(axis=0)
    return aimed - np.log(total), e, total


def outputs(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln probability of the target symbols given states (unit, batch), by class and within the class; with grads also the gradient of -ln p by h."""

    def learn(weights: np.ndarray, into: np.ndarray, bias: np.ndarray, own: np.ndarray, aim: np.ndarray, e: np.ndarray, total: np.ndarray) -> np.ndarray:
        e /= total
        e[aim, np.arange(e.shape[1])] -= 1
        into += own @ e.T
        bias += e.sum(axis=1)
        return weights @ e

    cls = symbol_class(target)
    logs, e, total = _softmax(p["C"], p["c"], h, cls)
    out, dh = logs.astype(np.float64), None
    if grads is not None:
        dh = learn(p["C"], grads["C"], grads["c"], h, cls, e, total)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(len(p["W"]) + 1))
    order = order[: bounds[-1]]
    states, aims, found = h[:, order], target[order] % CLASS_WORDS, np.empty(len(order))
    back = np.empty_like(states)
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[c], bounds[c + 1]
        own, word = states[:, lo:hi], aims[lo:hi]
        found[lo:hi], e, total = _softmax(p["W"][c], p["w"][c], own, word)
        if grads is not None:
            back[:, lo:hi] = learn(p["W"][c], grads["W"][c], grads["w"][c], own, word, e, total)
    out[order] += found
    if grads is not None:
        dh[:, order] += back
    return out, dh


def window_gradients(p: dict[str, np.ndarray], tokens: np.ndarray, before: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Truncated backpropagation over one window: gradients of the summed -ln p, the state after it, the sum. tokens and before are (time, batch), the state is
    (unit, batch), lengths are in falling order."""
    grads, k = {name: np.zeros_like(v) for name, v in p.items()}, HIDDEN
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(len(tokens))]  # sequences that are longer than t
    ends = np.cumsum([0, *live])
    spans = list(zip(ends, ends[1:]))
    flat, seen = (np.concatenate([x[t, :m] for t, m in enumerate(live)]) for x in (tokens, before))
    x = np.ascontiguousarray(p["E"][seen].T)
    olds, after, kept, h = np.empty((k, len(flat)), dtype=h.dtype), np.empty((k, len(flat)), dtype=h.dtype), [], h.copy()
    for m, (lo, hi) in zip(live, spans):
        olds[:, lo:hi] = h[:, :m]
        new, *gates = _step(p, x[:, lo:hi], olds[:, lo:hi])
        kept.append(gates)
        after[:, lo:hi] = h[:, :m] = new
    logs, into = outputs(p, after, flat, grads)
    dx, du, dh = np.empty_like(x), np.empty_like(x), np.zeros_like(h)
    for m, (lo, hi), (r, z, n, un) in zip(live[::-1], spans[::-1], kept[::-1]):
        d, keep = dh[:, :m] + into[:, lo:hi], 1 - z
        dn = d * keep
        dn *= 1 - n * n
        dz = olds[:, lo:hi] - n
        dz *= d
        dz *= z
        dz *= keep
        dr = dn * r
        du[2 * k :, lo:hi] = dr
        dr *= un
        dr *= 1 - r
        dx[:k, lo:hi], dx[k : 2 * k, lo:hi], dx[2 * k :, lo:hi] = dr, dz, dn
        du[: 2 * k, lo:hi] = dx[: 2 * k, lo:hi]
        d *= z
        dh[:, :m] = d + p["U"] @ du[:, lo:hi]
    grads["U"] += olds @ du.T
    for unit, weights in enumerate(dx):
        grads["E"][:, unit] = np.bincount(seen, weights=weights, minlength=len(p["E"]))
    return grads, h, -float(logs.sum())


def windows(sequences: Iterator[np.ndarray], begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, before, lengths, carried) of all tokens, WINDOW at a time of BATCH sequences at once, as (time, batch), the longest first; a place whose
    sequence has ended gets the next one. carried: the places of the window before that go on, -1 for a new sequence."""
    open_, more = [], True
    while True:
        now = [(s, at, i) for i, (s, at, _) in enumerate(open_) if at < len(s)]
        while more and len(now) < BATCH:
            s = next(sequences, None)
            if s is None:
                more = False
            elif len(s):
                now.append((s, 0, -1))
        if not now:
            return
        now.sort(key=lambda x: x[1] - len(x[0]))
        tokens, before, lengths = padded([s[at : at + WINDOW] for s, at, _ in now], begin)
        before[0] = [s[at - 1] if at else begin for s, at, _ in now]
        open_ = [(s, at + WINDOW, i) for s, at, i in now]
        yield tokens, before, lengths, np.array([i for *_, i in now])


def padded(sequences: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, before, lengths): the first two as (time, batch)."""
    lengths = np.array([len(s) for s in sequences])
    tokens = np.zeros((len(sequences), lengths.max()), dtype=np.int64)
    for row, s in zip(tokens, sequences):
        row[: len(s)] = s
    tokens = np.ascontiguousarray(tokens.T)
    return tokens, np.vstack([np.full((1, len(sequences)), begin), tokens[:-1]]), lengths


def trained(p: dict[str, np.ndarray], sequences: Iterator[np.ndarray], begin: int) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after one pass with Adam, and the tokens seen."""
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    seen, step, most, h = 0, 0, 1, np.zeros((HIDDEN, 1), dtype=np.float32)
    for tokens, before, lengths, carried in windows(sequences, begin):
        h = np.where(carried < 0, np.float32(0), h[:, carried])
        n = int(lengths.sum())
        grads, h, _ = window_gradients(p, tokens, before, lengths, h)
        step += 1
        seen += n
        most = max(most, n)
        done = seen / most  # in whole windows: a step goes by its window's share of the largest one, so that no few long texts have the last word
        rate = RATE * min(done / WARM, math.sqrt(WARM / done)) / math.sqrt(WARM) * n / most
        for k in p:
            g = grads[k] / n
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p, seen


def score_sequences(p: dict[str, np.ndarray], sequences: list[np.ndarray], begin: int) -> np.ndarray:
    """ln probability of each whole sequence. Sequences are stepped through together, longest first, and leave when they end."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    flat, starts = np.concatenate([sequences[i] for i in order]).astype(np.int64), np.cumsum(lengths) - lengths
    total = np.zeros(len(order))
    h, before, active, t = np.zeros((HIDDEN, len(order)), dtype=np.float32), np.full(len(order), begin), len(order), 0
    while active:
        states, targets, owners, held = [], [], [], 0
        while active and held < STATES:  # a window of as many steps as give this many states
            h, before = h[:, :active], before[:active]
            h = _step(p, np.ascontiguousarray(p["E"][before].T), h)[0]
            before = flat[starts[:active] + t]
            states.append(h)
            targets.append(before)
            owners.append(np.arange(active))
            held += active
            t += 1
            while active and lengths[active - 1] <= t:
                active -= 1
        states, targets, owners = np.concatenate(states, axis=1), np.concatenate(targets), np.concatenate(owners)
        logs = np.concatenate([outputs(p, states[:, i : i + STATES], targets[i : i + STATES])[0] for i in range(0, len(targets), STATES)])
        total += np.bincount(owners, weights=logs, minlength=len(order))
    out = np.empty(len(order))
    out[order] = total
    return out


def vocabulary_of(training: DataFrame, text_col: str = "text") -> tuple[DataFrame, Vocabulary]:
    """(word, c) of all training tokens, written, and what is shipped of it.

    The words that are shipped are all those with a count of at least a threshold; it comes from a histogram of counts on a logarithmic scale, whose size does not
    depend on the corpus, so that never more than HEAD words reach the driver.
    """
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), SPACES)
    tokens = training.select(F.explode(F.array_append(split, F.lit(END))).alias("word")).where(F.col("word") != "").select(ascii_lower(F.col("word")).alias("word"))
    counts = written(tokens.groupBy("word").agg(F.count("*").alias("c")))
    level = F.floor(F.log2("c") * LEVELS)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.min("c").alias("least"), F.count("*").alias("v"), F.sum("c").alias("n")).collect(), key=lambda r: -r["level"])
    held, least = 0, None
    for r in levels:
        held += r["v"]
        if held > HEAD:
            break
        least = r["least"]
    head = [] if least is None else sorted(((r["word"], int(r["c"])) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    return counts, Vocabulary(tuple(head), sum(int(r["n"]) for r in levels), sum(int(r["v"]) for r in levels))


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row per row of docs: row_key, doc_id, symbols (two bytes each), what the head decides, and the words outside the head with their counts in the text.

    Texts are cut into tokens once, here; training and scoring read symbols.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = known.value
        ids, tail = v.ids, len(v.head)
        symbol, ln_count, seen, within = v.symbol.astype("<u2"), np.log(v.counts + 1), v.counts > 0, v.within
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at : at + SLICE]
                rows = []
                for text in part["text"]:
                    tokens = text.encode().lower().split()
                    tokens.append(END.encode())
                    found = np.fromiter(map(ids.get, tokens, itertools.repeat(tail)), dtype=np.int32, count=len(tokens))
                    rest = Counter(map(tokens.__getitem__, np.flatnonzero(found == tail).tolist()))
                    rows.append((symbol[found].tobytes(), len(tokens), int(seen[found].sum()), ln_count[found].sum(), within[found].sum(), [w.decode() for w in rest], list(rest.values())))
                out = pd.DataFrame(rows, columns=["symbols", "n_tokens", "n_known", "base", "within", "rest", "rest_n"])
                yield out.assign(row_key=part["row_key"].to_numpy(), doc_id=pd.array(part["doc_id"], dtype="Int64"))

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInPandas(run, "row_key long, doc_id long, symbols binary, n_tokens long, n_known long, base double, within double, rest array<string>, rest_n array<long>"))


def _sequences(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in b["symbols"]]


def train(codes: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters averaged over the splits of all encoded training documents."""
    spark = codes.sparkSession
    p = first_parameters(vocabulary)
    shapes, begin = {k: x.shape for k, x in p.items()}, EXPLICIT + vocabulary.bands + 1
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sequences = (s for b in batches for s in sorted(_sequences(b), key=len, reverse=True))  # long ones begin early, so that none goes on alone
            after, seen = trained(sent.value, sequences, begin)
            if seen:
                flat = np.concatenate([after[k].ravel() for k in shapes]).astype(np.float64)
                yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat * seen, "n": float(seen)})

        means = codes.select("symbols").mapInPandas(run, "at int, x double, n double").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(means):
            flat, at = means.sort_values("at")["x"].to_numpy().astype(np.float32), 0
            for k, shape in shapes.items():
                p[k] = flat[at : at + math.prod(shape)].reshape(shape)
                at += math.prod(shape)
        sent.unpersist()
    return p


def score_codes(codes: DataFrame, counts: DataFrame, vocabulary: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """One row per encoded document: doc_id, n_tokens, n_known, train_tokens, base_score, score. Words outside the head meet their counts in a join."""
    model = codes.sparkSession.sparkContext.broadcast(p)
    begin = EXPLICIT + vocabulary.bands + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SCORED):
                part = b.iloc[at : at + SCORED]
                yield pd.DataFrame({"row_key": part["row_key"].to_numpy(), "logs": score_sequences(model.value, _sequences(part), begin) + part["within"].to_numpy(), "doc_id": pd.array(part["doc_id"], dtype="Int64"), **{c: part[c].to_numpy() for c in ("n_tokens", "n_known", "base")}})

    heads = codes.select("row_key", "doc_id", "symbols", "n_tokens", "n_known", "base", "within").mapInPandas(run, "row_key long, doc_id long, n_tokens long, n_known long, base double, logs double")
    rest = codes.select("row_key", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row_key", F.col("x.rest").alias("word"), F.col("x.rest_n").alias("tf"))
    ln_c = F.col("tf") * F.log(F.coalesce("c", F.lit(0)) + 1.0)
    met = rest.join(counts, "word", "left").select(
        "row_key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"),
        ln_c.alias("base"), (ln_c - F.col("tf") * F.lit(math.log(max(vocabulary.tail_total, 1.0)))).alias("logs"),
    )
    sums = heads.unionByName(met).groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "logs")))
    base = (F.col("base") - F.col("n_tokens") * F.lit(math.log(vocabulary.total + vocabulary.distinct + 1))) / LN10
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logs") / LN10).alias("score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_fold("doc_id", 7) == 2, F.lit(False))
    counts, vocabulary = vocabulary_of(docs.where(~held))
    codes = encoded(docs, vocabulary)
    scores = score_codes(codes, counts, vocabulary, train(codes.where(~held), vocabulary))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
