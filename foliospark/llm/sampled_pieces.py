"""SentencePiece encoding and decoding with sampled segmentations.

The model file of the registered query is a BPE model (its description says so); any SentencePiece model file can be given.

The pieces of a model form a lattice over each word; a whole text's segmentation is one path through the lattices of its words. A text is cut into words
only where no piece of the model spans the cut, so a run of space marks stays with the word that follows. Pieces of a BPE model
carry ranks as scores, so the path weights take the probability of a piece as 1 / (rank + ZIPF) (Zipf's law); a character that is no piece is spelled in byte pieces at BYTE_COST.

Gumbel top-k: the k segmentations with the largest perturbed log-probability are a sample without replacement. They are found by a best-first (A*) search
over prefixes of decisions, one decision per word: a node is the set of all segmentations that follow the path so far and then leave it at a given word; its bound is the
largest perturbed value in it, a Gumbel of its exact mass cut off at its parent's bound. The node of the largest bound is opened by drawing the segmentation that attains the
bound, word by word, from the exact masses of the lattices. Segmentations of one text are distinct. Draws are seeded by the row's key and text, so a row's result does not depend on its task.
The texts of a slice are searched side by side: the lattices of their distinct words are arrays (Lattices), and each round draws the words of one more path of every text at once.
Words beyond LONG code points, and what is left of a word whose mass is nearly taken, are drawn one at a time (Word).

For each segmentation: log_prob, perturbed, and the inclusion score 1 - exp(-exp(log_prob - threshold)), the probability that it is in the sample given the
(k+1)th largest perturbed value, threshold; where the text has at most k segmentations all are returned and their inclusion score is 1.

Defined results: a null text is the empty text, with one empty segmentation; white space is as the model's own normalization leaves it, so decoding gives the model's normalized text; rows repeated with the same key and text get the same samples; null keys
share a seed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import table, text_batches

#: Segmentations per text, the offset of Zipf's law, log cost of one byte piece, the longest piece that is tried.
SAMPLES, ZIPF, BYTE_COST, LONGEST = 4, 2.7, -14.0, 16
#: Edges of the lattices that a worker remembers (about 200 bytes each with all that hangs on them), and the segmentations of a word that are listed or remembered.
MOST_EDGES, LISTED = 400_000, 24
#: Rows, and code points of their texts, that a task searches and gives back at once.
SLICE, SLICE_CHARS = 1000, 2_000_000
#: Words of more code points are drawn one at a time. Where less of a word's mass is free, draws are made among what is left in place of being repeated;
#: where less than TINY is left, it is summed up in place of being subtracted from 1.
LONG, SCARCE, TINY = 512, 0.02, 1e-6
#: Log of the factor that each code point brings to the weights of pieces, about what takes it away again.
SCALE = 4.0
#: Of splitmix64, which turns a word's 64 random bits into those of each step; flips them for those of the place where a path is left.
STEP, MIX_1, MIX_2, FLIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03))
#: Rows that are decoded at once.
DECODED = 64
SPACE = "▁"

_MODELS: dict[str, PieceLattice] = {}


def log_sum(logs: list[float]) -> float:
    top = max(logs, default=-math.inf)
    return top if top == -math.inf else top + math.log(math.fsum(math.exp(x - top) for x in logs))


def _pick(logs: list[float], rng: np.random.Generator) -> int:
    """A place, with a probability in proportion to exp of what stands there."""
    return int(np.argmax(np.array(logs) - np.log(-np.log(rng.random(len(logs))))))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) by splitmix64."""
    x = bits ^ (bits >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return x * 2.0**-53


class Word:
    """The lattice of one word. A number u in [0, 1) stands for the segmentation in whose interval it lies, intervals in the order of the lattice;
    those met before are remembered, so that what u stands for does not depend on what came before."""

    __slots__ = ("beta", "edges", "found", "highs", "log_mass", "log_open", "lows", "met", "probs")

    def __init__(self, edges: list[list[tuple[int, tuple[int, ...], float]]]):
        """edges[i]: (end, ids, log weight) of the pieces that start at i."""
        n, exp = len(edges), math.exp
        beta, probs = [0.0] * (n + 1), [()] * n
        for i in range(n - 1, -1, -1):
            logs = [w + beta[j] for j, _, w in edges[i]]
            if len(logs) == 1:
                beta[i], probs[i] = logs[0], (1.0,)
                continue
            top = max(logs)
            shares = [exp(x - top) for x in logs]
            total = sum(shares)
            beta[i], probs[i] = top + math.log(total), [x / total for x in shares]
        self.edges, self.beta, self.probs, self.log_mass = edges, beta, probs, beta[0]
        self.found, self.log_open, self.lows, self.highs, self.met = [], 0.0, [], [], []

    def listed(self) -> list[tuple[tuple[int, ...], float]]:
        """The LISTED most probable segmentations; log_open is the log of the mass that they leave."""
        if not self.found:
            self.found = self.best(LISTED)
            self.log_open = log_sum([x[-1] for x in self.departures({ids for ids, _ in self.found})]) if len(self.found) == LISTED else -math.inf
        return self.found

    def departures(self, known: set[tuple[int, ...]]) -> list[tuple[tuple[int, ...], float, int, int, float]]:
        """All segmentations but the known ones, as disjoint sets: (ids before, their log weight, place, edge, log-probability of the set) of the edges that leave
        a prefix of a known one where no known one goes. Nothing is subtracted, so sets of the smallest mass are there too."""
        nodes: dict[tuple[int, ...], tuple[int, float, set[int]]] = {(): (0, 0.0, set())}
        for ids in known:
            at, k, done = 0, 0, 0.0
            while at < len(self.edges):
                e = next(e for e, (_, piece, _) in enumerate(self.edges[at]) if ids[k : k + len(piece)] == piece)
                nodes[ids[:k]][2].add(e)
                end, piece, w = self.edges[at][e]
                at, k, done = end, k + len(piece), done + w
                if at < len(self.edges):
                    nodes.setdefault(ids[:k], (at, done, set()))
        return [(ids, done, at, e, done + w + self.beta[end] - self.log_mass) for ids, (at, done, used) in nodes.items() for e, (end, _, w) in enumerate(self.edges[at]) if e not in used]

    def others(self, taken: set[tuple[int, ...]]) -> tuple[list[tuple[tuple[int, ...], float]], bool]:
        """The listed segmentations that are not taken, and whether all that are taken are listed."""
        found = self.listed()
        rest = [(ids, p) for ids, p in found if ids not in taken]
        return rest, len(found) - len(rest) == len(taken)

    def log_left(self, taken: set[tuple[int, ...]]) -> float:
        """Log of the mass of all segmentations that are not taken."""
        rest, inside = self.others(taken)
        open_sets = [self.log_open] if inside else [x[-1] for x in self.departures(taken | {ids for ids, _ in self.found})]
        return log_sum([p for _, p in rest] + open_sets)

    def draw_other(self, taken: set[tuple[int, ...]], rng: np.random.Generator) -> tuple[tuple[int, ...], float]:
        """(ids, log-probability) of a draw among all segmentations that are not taken, without a rejection."""
        rest, inside = self.others(taken)
        open_sets = [] if inside and self.log_open == -math.inf else self.departures(taken | {ids for ids, _ in self.found})
        masses = [p for _, p in rest] + [x[-1] for x in open_sets]
        i = _pick(masses, rng)
        if i < len(rest):
            return rest[i]
        ids, done, at, e, _ = open_sets[i - len(rest)]
        while True:
            at, piece, w = self.edges[at][e]
            ids, done = ids + piece, done + w
            if at == len(self.edges):
                return ids, done - self.log_mass
            e = _pick([w + self.beta[end] for end, _, w in self.edges[at]], rng)

    def choose(self, u: float) -> tuple[tuple[int, ...], float]:
        i = bisect.bisect_right(self.lows, u) - 1
        if i >= 0 and u < self.highs[i]:
            return self.met[i]
        choice, low, high = self.draw(u)
        if low < high and len(self.met) < LISTED:
            self.lows.insert(i + 1, low)
            self.highs.insert(i + 1, high)
            self.met.insert(i + 1, choice)
        return choice

    def best(self, k: int) -> list[tuple[tuple[int, ...], float]]:
        """The k most probable segmentations; beta bounds what is left with a margin, so the search goes by exact best completions."""
        edges, n = self.edges, len(self.edges)
        ahead = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            ahead[i] = max(w + ahead[j] for j, _, w in edges[i])
        heap, out = [(-ahead[0], 0, 0.0, ())], []  # of ties, as in runs of one character, the prefix that is furthest on is first
        while heap and len(out) < k:
            _, at, done, ids = heapq.heappop(heap)
            at = -at
            if at == n:
                out.append((ids, done - self.log_mass))
                continue
            for j, piece, w in edges[at]:
                heapq.heappush(heap, (-round(done + w + ahead[j], 9), -j, done + w, ids + piece))
        return out

    def draw(self, u: float) -> tuple[tuple[tuple[int, ...], float], float, float]:
        """((ids, log-probability), low, high); low and high are 0 where the interval is too narrow to be told."""
        at, ids, log_p, low, width, x, narrow = 0, (), 0.0, 0.0, 1.0, u, False
        edges, probs = self.edges, self.probs
        while at < len(edges):
            share = probs[at]
            i = 0
            if len(share) > 1:
                while i < len(share) - 1 and x >= share[i]:
                    x -= share[i]
                    low += width * share[i]
                    i += 1
                x = min(x / share[i], 1 - 2**-53)
                width *= share[i]
                if width < 1e-9:  # the digits of u are used up; others are made of it
                    narrow, width, x = True, 1.0, (u * 1e9 * (at + 1.6180339887)) % 1.0
            at, piece, w = edges[at][i]
            ids, log_p = ids + piece, log_p + w
        return (ids, log_p - self.log_mass), 0.0 if narrow else low, 0.0 if narrow else low + width


class PieceTable:
    """The pieces as a tree of their prefixes, whose branches lie in a hash table that many positions look up at once."""

    def __init__(self, weight: dict[str, tuple[tuple[int, ...], float]], spelled: list[int]):
        """spelled: the ids of bytes."""
        #: Of ASCII characters that are no pieces, the symbol is the id of their byte.
        self.ascii = np.array(spelled[:128], np.int32)
        bits = max(4, (4 * len({piece[: i + 1] for piece in weight for i in range(len(piece))})).bit_length())
        self.shift, self.mask, self.root = np.uint64(64 - bits), (1 << bits) - 1, 1 << bits
        #: A node is its place in the table, -1 none.
        self.keys, self.symbols = np.full(1 << bits, -1, np.int64), np.full((1 << bits) + 2, -1, np.int32)
        self.weights = np.full(1 + max((ids[0] for ids, _ in weight.values()), default=0), -np.inf)
        nodes, size = {"": self.root}, 0
        while fresh := list(dict.fromkeys(piece[: size + 1] for piece in weight if len(piece) > size)):
            keys = np.array([nodes[x[:-1]] << 21 | ord(x[-1]) for x in fresh], np.int64)
            at, todo = self.slots(keys), np.arange(len(keys))
            while len(todo):
                free = todo[self.keys[at[todo]] < 0]
                self.keys[at[free]] = keys[free]  # of several the last one stays
                todo = todo[self.keys[at[todo]] != keys[todo]]
                at[todo] = (at[todo] + 1) & self.mask
            nodes, size = dict(zip(fresh, at.tolist())), size + 1
            for x in fresh:
                if x in weight:
                    (symbol,), w = weight[x]
                    self.symbols[nodes[x]], self.weights[symbol] = symbol, w
        factors = {c: SCALE if c in weight else -BYTE_COST * len(c.encode()) for c in set("".join(weight))}
        #: Weights with a factor for each code point; that of a spelled character is 1.
        self.scaled = np.zeros(len(self.weights))
        with np.errstate(over="ignore", under="ignore"):
            for piece, ((symbol,), w) in weight.items():
                self.scaled[symbol] = np.exp(w + sum(factors[c] for c in piece))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * STEP) >> self.shift).view(np.int64)

    def step(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The node that each code point leads to, or -1."""
        keys = nodes << 21
        keys |= points
        at = self.slots(keys)
        got = self.keys.take(at, mode="clip")
        same = got == keys
        rest = np.flatnonzero(~same & (got >= 0))
        out = np.where(same, at, -1)
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            got = self.keys[at[rest]]
            same = got == keys[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same & (got >= 0)]
        return out


class Lattices:
    """The lattices of many words, given longest first. A place is so many code points before the end of a word; the places of one distance lie together, in the order
    of words, and those of the distance 0 come first. Symbols are ids of pieces, or -1 - the code point of a character that is spelled in two bytes or more."""

    def __init__(self, table: PieceTable, words: list[str]):
        size, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
        reaching = np.bincount(lens, minlength=1)[::-1].cumsum()[::-1]  # words of at least so many code points
        offsets = np.concatenate([[0], reaching.cumsum()])
        total = int(offsets[-1])
        owner = np.arange(total) - np.repeat(offsets[:-1], reaching)
        following = np.arange(total) - np.repeat(np.concatenate([[0], reaching[:-1]]), reaching)
        points = np.zeros(total, np.int64)
        backwards = np.repeat(lens.cumsum(), lens) - np.arange(int(lens.sum()))
        points[offsets[backwards] + np.repeat(np.arange(size), lens)] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, degree = [], np.zeros(total, np.int64)
        live, node = np.arange(size, total), np.full(total - size, table.root)
        at = live
        while len(live):
            node, at = table.step(node, points.take(at, mode="clip")), following.take(at, mode="clip")
            symbols = table.symbols[node]
            if found:
                some = np.flatnonzero(symbols >= 0)
                found.append((live[some], symbols[some], at[some]))
            else:
                spelled = np.flatnonzero(symbols < 0)
                c = points[live[spelled]]
                spelled_at, spelled_weights = live[spelled], BYTE_COST * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
                symbols[spelled] = -1 - c
                if len(plain := np.flatnonzero(c < len(table.ascii))):
                    symbols[spelled[plain]] = table.ascii[c[plain]]
                found.append((live, symbols, at))
            degree[found[-1][0]] += 1
            go = np.flatnonzero((node >= 0) & (at >= size))
            live, node, at = (x.take(go, mode="clip") for x in (live, node, at))
        first = np.concatenate([[0], degree.cumsum()])
        edges = int(first[-1])
        self.symbols, self.ends = np.empty(edges, np.int32), np.empty(edges, np.int64)
        filled = first[:-1].copy()
        for hit, symbols, ends in reversed(found):  # the longest piece, often the most probable one, is looked at first
            edge = filled[hit]
            filled[hit] = edge + 1
            self.symbols[edge], self.ends[edge] = symbols, ends
        shares = self._shares(table, spelled_at, first, degree, offsets) if edges else np.empty(0)
        if shares is None:
            weights = table.weights[np.maximum(self.symbols, 0)]
            weights[first[spelled_at + 1] - 1] = spelled_weights
            shares, self.logs = self._log_shares(weights, first, degree, offsets)
        else:
            with np.errstate(divide="ignore"):
                self.logs = np.log(shares)
        #: Of each edge, the share of the edges of its place up to it.
        self.upto = shares
        at, left = first[:-1][degree > 1], degree[degree > 1] - 1
        while len(at):
            self.upto[at + 1] += self.upto[at]
            more = np.flatnonzero(left > 1)
            at, left = at[more] + 1, left[more] - 1
        self.upto[first[1:][degree > 0] - 1] = 2.0
        self.first, self.size = first, size
        self.start = offsets[lens] + np.arange(size)
        #: Words of a single segmentation, so far as each place has a single edge.
        self.single = np.ones(size, bool)
        self.single[owner[degree > 1]] = False

    def _shares(self, table: PieceTable, spelled_at: np.ndarray, first: np.ndarray, degree: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
        """Of each edge, its share of the mass of its place; None where a mass goes beyond what a double holds. Weights have the factors of their code points,
        which all segmentations of a word have in common and which keep most masses far from there."""
        size = int(offsets[1])
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            shares, mass = table.scaled[np.maximum(self.symbols, 0)], np.ones(len(degree))
            shares[first[spelled_at + 1] - 1] = 1.0
            for t in range(1, len(offsets) - 1):
                a, b = offsets[t], offsets[t + 1]
                x = shares[first[a] : first[b]]
                x *= mass[self.ends[first[a] : first[b]]]
                mass[a:b] = np.add.reduceat(x, first[a:b] - first[a])
            if not (mass[size:].min() > 1e-280 and mass.max() < 1e280):
                return None
            shares /= np.repeat(mass, degree)
        return shares

    def _log_shares(self, weights: np.ndarray, first: np.ndarray, degree: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and their logs, for masses of any size."""
        beta, shares, out = np.zeros(len(degree)), np.empty(len(weights)), np.empty(len(weights))
        for t in range(1, len(offsets) - 1):
            a, b = offsets[t], offsets[t + 1]
            x = weights[first[a] : first[b]] + beta[self.ends[first[a] : first[b]]]
            starts, n = first[a:b] - first[a], degree[a:b]
            top = np.maximum.reduceat(x, starts)
            x -= np.repeat(top, n)
            share = np.exp(x)
            mass = np.add.reduceat(share, starts)
            log_mass = np.log(mass)
            beta[a:b] = top + log_mass
            shares[first[a] : first[b]] = share / np.repeat(mass, n)
            out[first[a] : first[b]] = x - np.repeat(log_mass, n)
        return shares, out

    def draw(self, words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, where each word's begin, and end at last, log-probabilities) of a segmentation of each word, by its 64 random bits."""
        logs, counts, steps = np.zeros(len(words)), np.zeros(len(words), np.int64), []
        who, at, bits = np.arange(len(words)), self.start[words], bits.copy()
        while len(who):
            bits += STEP
            u = _uniform(bits)
            edge = self.first.take(at, mode="clip")  # in bounds, and clip is the fastest mode
            over = np.flatnonzero(u >= self.upto.take(edge, mode="clip"))
            while len(over):
                next_edge = edge[over] + 1
                edge[over] = next_edge
                over = over[u[over] >= self.upto[next_edge]]
            if steps:
                logs[who] += self.logs.take(edge, mode="clip")
            else:
                logs = self.logs.take(edge, mode="clip")
            steps.append((who, self.symbols.take(edge, mode="clip")))
            at = self.ends.take(edge, mode="clip")
            ended = at < self.size
            counts[who[ended]] = len(steps)
            live = np.flatnonzero(~ended)
            who, at, bits = (x.take(live, mode="clip") for x in (who, at, bits))
        starts = np.concatenate([[0], counts.cumsum()])
        out = np.empty(int(starts[-1]), np.int32)
        for i, (who, symbols) in enumerate(steps):
            out[starts[who] + i] = symbols
        return out, starts, logs


class Search:
    """The best-first search of one text. A path is (symbols, where those of each word begin, log-probabilities of its words)."""

    def __init__(self, codes: np.ndarray, seed: int):
        self.codes, self.rng, self.tie, self.out = codes, np.random.default_rng(seed), 0, []
        # bound, tie breaker, path that the node leaves, word it leaves at, choices besides the path's that it must not take there
        self.heap: list = [(math.log(-math.log(self.rng.random())), 0, None, 0, {})]

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the best node to draw, with the random bits of each."""
        self.bound, _, self.path, self.at, self.barred = heapq.heappop(self.heap)
        if self.path is not None:
            symbols, starts, logs = self.path
            self.barred = self.barred | {tuple(symbols[starts[self.at] : starts[self.at + 1]].tolist()): float(logs[self.at])}
        codes = self.codes[self.at :]
        return codes, self.rng.bit_generator.random_raw(len(codes)) if len(codes) else np.zeros(0, np.uint64)

    def leave(self, free: np.ndarray, more: int) -> None:
        """Takes the drawn path as the next sample, and its node apart into those that follow it and leave it at a word. free: of each word drawn, the Gumbel of what leaves there, less the path before it;
        more: the nodes that are looked at yet."""
        (symbols, starts, logs), at = self.drawn, self.at
        if at:
            first, places, before = self.path
            symbols, starts, logs = np.concatenate([first[: places[at]], symbols]), np.concatenate([places[:at], starts + places[at]]), np.concatenate([before[:at], logs])
        upto = np.cumsum(logs)
        self.out.append(((symbols, starts, logs), float(upto[-1]) if len(upto) else 0.0, -self.bound))
        free[1:] += upto[at:-1]
        free[:1] += upto[at - 1] if at else 0.0
        if len(free) > more:  # as many better nodes, each with a sample of its own, leave no place for the others
            places = np.argpartition(free, len(free) - more)[len(free) - more :] if more > 1 else free.argmax(keepdims=True)
            free = free[places]
        else:
            places = np.arange(len(free))
        for place, value in zip(places.tolist(), free.tolist()):
            if value > -math.inf:
                self.tie += 1
                low, high = sorted((self.bound, -value))
                bound = high + math.log1p(math.exp(low - high))  # Gumbels are cut off at the parent's bound
                heapq.heappush(self.heap, (bound, self.tie, (symbols, starts, logs), at + place, {} if place else self.barred))


class PieceLattice:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        order = sorted(plain, key=lambda i: (-self.model.get_score(i), i))
        total = math.log(sum(1 / (r + ZIPF) for r in range(len(order))))
        #: Ids and log weight of each piece, as objects that all edges share.
        self.weight = {self.model.id_to_piece(i): ((i,), -math.log(r + ZIPF) - total) for r, i in enumerate(order)}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: Characters that stand before a mark inside some piece; the longest piece.
        self.joined = {a for piece in self.weight for a, b in zip(piece, piece[1:]) if b == SPACE}
        self.longest = max(LONGEST, *map(len, self.weight))
        self.words: dict[str, Word] = {}
        self.edges = 0

    def word(self, text: str) -> Word:
        found = self.words.get(text)
        if found is None:
            if self.edges >= MOST_EDGES:
                self.words.clear()
                self.edges = 0
            edges, get = [], self.weight.get
            for i, c in enumerate(text):
                out = [(j, *hit) for j in range(i + 1, min(len(text), i + self.longest) + 1) if (hit := get(text[i:j]))]
                if c not in self.weight:
                    data = c.encode()
                    out.append((i + 1, tuple(self.bytes[b] for b in data), BYTE_COST * len(data)))
                edges.append(out)
            found = self.words[text] = Word(edges)
            self.edges += sum(map(len, edges)) + len(edges)
        return found

    def split(self, text: str) -> list[str]:
        """Words of the normalized text, each with the marks of the spaces before it."""
        normal = self.model.normalize(text)
        if not any(c + SPACE in normal for c in self.joined):
            first, *rest = normal.split(SPACE)
            return [first] * bool(first) + [SPACE + x for x in rest]
        out: list[str] = []
        for i, x in enumerate(normal.split(SPACE)):
            part = SPACE + x if i else x
            if out and out[-1][-1] in self.joined:
                out[-1] += part
            elif part:
                out.append(part)
        return out

    @cached_property
    def table(self) -> PieceTable:
        return PieceTable(self.weight, self.__dict__.get("bytes", []))

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols) or symbols.min() >= 0:
            return symbols
        spelled = np.flatnonzero(symbols < 0)
        kinds, kind = np.unique(symbols[spelled], return_inverse=True)
        ids = [[self.bytes[b] for b in chr(-1 - x).encode()] for x in kinds.tolist()]
        counts, n = np.ones(len(symbols), np.int64), np.array([len(x) for x in ids])[kind]
        counts[spelled] = n
        out, starts = np.repeat(symbols, counts), (counts.cumsum() - counts)[spelled]
        for i in range(4):
            out[starts[n > i] + i] = np.array([x[i] if i < len(x) else -1 for x in ids], np.int32)[kind[n > i]]
        return out

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
        """(ids, log_prob, perturbed, inclusion) in falling order of perturbed, k of them or all there are."""
        return [(ids.tolist(), *x) for ids, *x in self.samples([text], k, [seed])[0]]

    def samples(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """What sample() gives, of each text; what a text gets does not depend on the others."""
        split = [self.split(x) for x in texts]
        numbers = defaultdict(itertools.count().__next__)
        codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        distinct, lens = list(numbers), np.fromiter(map(len, numbers), np.int64, len(numbers))
        order = np.argsort(-lens, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        codes, distinct, long = ranks[codes], [distinct[i] for i in order.tolist()], int((lens > LONG).sum())
        lattices = Lattices(self.table, distinct[long:])
        single = np.concatenate([np.zeros(long, bool), lattices.single])
        searches = [Search(own, seed) for own, seed in zip(np.split(codes, np.cumsum([len(x) for x in split[:-1]], dtype=np.int64)), seeds)]

        def draw(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            apart = codes < long
            if not apart.any():
                return lattices.draw(codes - long, bits)
            symbols, starts, logs = lattices.draw(codes[~apart] - long, bits[~apart])
            chosen = [self.word(distinct[c]).choose((x >> 11) * 2.0**-53) for c, x in zip(codes[apart].tolist(), bits[apart].tolist())]
            counts, all_logs = np.empty(len(codes), np.int64), np.empty(len(codes))
            counts[~apart], counts[apart] = np.diff(starts), [len(ids) for ids, _ in chosen]
            all_logs[~apart], all_logs[apart] = logs, [p for _, p in chosen]
            out, there = np.empty(counts.sum(), np.int32), np.repeat(apart, counts)
            out[~there], out[there] = symbols, [i for ids, _ in chosen for i in ids]
            return out, np.concatenate([[0], counts.cumsum()]), all_logs

        def known(barred: Iterable[tuple[int, ...]]) -> set[tuple[int, ...]]:
            return {x if min(x) >= 0 else tuple(self.ids(np.array(x, np.int32)).tolist()) for x in barred}

        small: dict[tuple[int, tuple[int, ...]], float] = {}
        for i in range(k):
            opened = [s for s in searches if s.heap]
            if not opened:
                break
            tasks = [s.open() for s in opened]
            drawn, bits = (np.concatenate(x) for x in zip(*tasks))
            symbols, starts, logs = draw(drawn, bits)
            ends, begin, again = np.cumsum([len(codes) for codes, _ in tasks]).tolist(), 0, []
            for s, end in zip(opened, ends):
                own, at = symbols[starts[begin] : starts[end]], s.at
                s.drawn = own, starts[begin : end + 1] - starts[begin], logs[begin:end]
                if s.barred and tuple(own[: s.drawn[1][1]].tolist()) in s.barred:
                    again.append(s)
                begin = end
            tries = 1
            while again:
                for s in again:
                    if 1 - math.fsum(map(math.exp, s.barred.values())) < SCARCE or s.codes[s.at] < long:
                        s.first = self.word(distinct[s.codes[s.at]]).draw_other(known(s.barred), s.rng)
                    else:
                        s.first = None
                repeated = [s for s in again if s.first is None]
                if repeated:
                    x, begins, p = draw(np.repeat([s.codes[s.at] for s in repeated], tries), np.concatenate([s.rng.bit_generator.random_raw(tries) for s in repeated]))
                    for n, s in enumerate(repeated):
                        for j in range(n * tries, (n + 1) * tries):
                            s.first = tuple(x[begins[j] : begins[j + 1]].tolist()), float(p[j])
                            if s.first[0] not in s.barred:
                                break
                    tries *= 4
                for s in again:
                    if s.first[0] not in s.barred:
                        own, places, own_logs = s.drawn
                        own = np.concatenate([np.array(s.first[0], np.int32), own[places[1] :]])
                        places = places + (len(s.first[0]) - places[1])
                        places[0] = 0
                        s.drawn = own, places, np.concatenate([[s.first[1]], own_logs[1:]])
                again = [s for s in again if s.first[0] in s.barred]
            # of each word, the log of the mass of what leaves the path there, and a Gumbel number
            with np.errstate(divide="ignore"):
                left = np.log(1 - np.exp(np.minimum(logs, 0.0)))
                free = -np.log(-np.log(_uniform(bits ^ FLIP)))
            for x in np.flatnonzero((left < -20) & ~single[drawn]).tolist():  # masses too small for a difference from 1
                case = int(drawn[x]), tuple(symbols[starts[x] : starts[x + 1]].tolist())
                if case not in small:
                    small[case] = self.word(distinct[case[0]]).log_left(known([case[1]]))
                left[x] = small[case]
            begin = 0
            for s, end in zip(opened, ends):
                if s.barred:
                    own, places, p = s.drawn
                    taken = s.barred | {tuple(own[: places[1]].tolist()): float(p[0])}
                    rest = 1 - math.fsum(map(math.exp, taken.values()))
                    left[begin] = math.log(rest) if rest > TINY else self.word(distinct[drawn[begin]]).log_left(known(taken))
                begin = end
            free += left
            begin = 0
            for s, end in zip(opened, ends):
                s.leave(free[begin:end], k - i)
                begin = end
        out = []
        for s in searches:
            threshold = -s.heap[0][0] if s.heap else -math.inf
            out.append([(self.ids(path[0]), total, g, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(total - threshold, 50.0)))) for path, total, g in s.out])
        return out

    @cached_property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all pieces, where those of each begin, how many they are, whether the model itself must decode it)."""
        size = self.model.get_piece_size()
        texts, own = [b""] * size, np.ones(size, bool)
        whole = {ids[0]: piece for piece, (ids, _) in self.weight.items()}
        plain = next((i for i, piece in whole.items() if SPACE not in piece and self.model.decode([i]) == piece), None)
        mark = self.weight.get(SPACE, ((None,), 0.0))[0][0]
        if plain is not None and mark is not None and self.model.decode([mark, mark, plain]) == " " + whole[plain]:  # of marks at the beginning, one goes
            for i, piece in whole.items():
                text = piece.replace(SPACE, " ")
                if self.model.decode([plain, i]) == whole[plain] + text and self.model.decode([i, plain]) == text.removeprefix(" ") + whole[plain]:
                    texts[i], own[i] = text.encode(), False
            for c, i in enumerate(self.bytes[:128]):
                if self.model.decode([plain, i, plain]) == whole[plain] + chr(c) + whole[plain] and self.model.decode([i, plain]) == chr(c) + whole[plain] and chr(c) != " ":
                    texts[i], own[i] = bytes([c]), False
        lens = np.array([len(x) for x in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), lens.cumsum() - lens, lens, own

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the rows, whose ids lie between the offsets."""
        parts = []
        for at in range(0, len(offsets) - 1, DECODED):
            own = offsets[at : at + DECODED + 1]
            parts.append(self._decode(ids[own[0] : own[-1]], own - own[0]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        data, begins, lens, own = self.surfaces
        begin, n = begins[ids], lens[ids]
        heads = offsets[:-1][np.diff(offsets) > 0]
        heads = heads[n[heads] > 0]
        heads = heads[data[begin[heads]] == ord(" ")]  # of marks at the beginning one goes
        begin[heads] += 1
        n[heads] -= 1
        upto = np.concatenate([[0], n.cumsum()])
        out = data[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
        texts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(upto[offsets].astype(np.int32)), pa.py_buffer(out)])
        by_model = np.flatnonzero(np.diff(np.concatenate([[0], own[ids].cumsum()])[offsets]))
        if len(by_model):
            texts = texts.to_pylist()
            for i in by_model.tolist():
                texts[i] = self.decode(ids[offsets[i] : offsets[i + 1]].tolist())
        return pa.array(texts, pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _lattice(path: str) -> PieceLattice:
    if path not in _MODELS:
        _MODELS[path] = PieceLattice(path)
    return _MODELS[path]


def sampled_segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, texts: bool = False) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, inclusion): up to k rows per row of docs, sample counting from 0. No shuffle. texts: with text, as decoded() adds it, in the same pass."""

    fields = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.field("element", pa.int32()))), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), *[("text", pa.string())] * texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_path)
        for b in batches:
            lens = np.fromiter(map(len, given := b.column("text").to_pylist()), np.int64, b.num_rows)
            seeds, upto, at = b.column("seed").to_pylist(), np.concatenate([[0], lens.cumsum()]), 0
            while at < len(given):
                end = min(at + SLICE, max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_CHARS, "right")) - 1))
                found = lattice.samples(given[at:end], k, seeds[at:end])
                rows, sizes = [x for out in found for x in out], [len(out) for out in found]
                offsets, ids = np.concatenate([[0], np.cumsum([len(x[0]) for x in rows])]), np.concatenate([x[0] for x in rows])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), type=fields.field("ids").type)
                decoded_texts = [lattice.decode_all(ids, offsets)] if texts else []
                keys = b.column("doc_id").slice(at, end - at).take(pa.array(np.repeat(np.arange(end - at), sizes)))
                yield pa.record_batch([keys, pa.array([i for n in sizes for i in range(n)], pa.int32()), lists, *(pa.array([x[j] for x in rows], pa.float64()) for j in (1, 2, 3)), *decoded_texts], schema=fields)
                at = end

    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).bitwiseAND(F.lit((1 << 62) - 1)).alias("seed"))
    return rows.mapInArrow(run, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double" + ", text string" * texts)


def decoded(segmentations: DataFrame, model_path: str) -> DataFrame:
    """segmentations with text: the ids decoded by the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_path)
        for b in batches:
            ids = b.column("ids")
            offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = lattice.decode_all(ids.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.record_batch([*b.columns, texts], names=[*b.schema.names, "text"])

    return segmentations.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in segmentations.dtypes) + ", text string")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and sample: the number of pieces, the digests of the ids and of the text they decode to, and the scores."""
    out = sampled_segmentations(table(spark, sf_dir, "documents"), public_model(), texts=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "log_prob", "perturbed", "inclusion")
