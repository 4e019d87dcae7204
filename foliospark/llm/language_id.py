"""Language ID by cross-parsing entropy.

Each language's sample gives a suffix automaton. A text is parsed greedily into the longest phrases that occur in the sample;
the language with the lowest cross entropy wins: phrases, normalised by what a phrase of its sample costs, log2 of the sample's length (Ziv and Merhav's
phrases * log2(n) / length), so that a long sample has no advantage over a short one. The automata are dense transition tables over the letters of their own sample, so that a task
steps through many stretches of text and all languages at once; those that would take the tables beyond DENSE cells (scripts of thousands of letters)
are sorted lists of transitions. A stretch is STRETCH symbols and every stretch starts a new phrase, in texts of any length and for all languages alike.

The classifier is fitted on a bounded sample of labelled rows: the SAMPLE_DOCS rows of each language that come first by a hash of their id, and
SAMPLE_CHARS code points of each. Prediction reads whole texts.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text when nothing is labelled;
ties go to the language that comes first by name; repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import crc_fold, table, text_batches

SAMPLE_DOCS, SAMPLE_CHARS = 64, 400
#: Symbols: 0 any letter that no sample holds, 1 runs of anything but letters, the rest single letters, each letter of the samples its own.
STRETCH = 1024
#: Cells of all dense tables together.
DENSE = 1 << 25
#: Code points handled at once by a task.
BLOCK_CHARS = 1_000_000
UNKNOWN, NEW_PHRASE = "und", 1 << 30


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root. Every path from it spells a factor of the sequence."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """samples: (language, text) pairs in order of language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.letters = {c: i + 2 for i, c in enumerate(sorted({c.lower() for _, text in samples for c in text if c.isalpha()}))}
        self.symbol = np.array([self._code(c) for c in range(0x10000)], dtype=np.int32)
        automata, sizes = [], []
        for i, (_, text) in enumerate(samples):
            own, places = np.unique(self.symbols(text)[0], return_inverse=True)
            local = np.zeros(len(self.letters) + 2, dtype=np.int32)  # 0: not in this sample, which always starts a new phrase
            local[own] = np.arange(1, len(own) + 1)
            sizes.append(len(places))
            moves = suffix_automaton((places + 1).tolist())
            moves.append({})  # between phrases: whatever comes starts a new one
            automata.append((len(moves) * (len(own) + 1), i, local, len(own) + 1, moves))
        blocks, locals_, self.starts, self.dense, self.sparse, base = [], [], [], [], [], 0
        for cells, i, local, width, moves in sorted(automata, key=lambda a: a[:2]):
            if base + cells > DENSE:
                self.sparse.append((i, local, *self._listed(moves, width)))
                continue
            root = np.full(width, base + cells - width, dtype=np.int32)
            for s, to in moves[0].items():
                root[s] = base + to * width
            dense = np.tile(root | NEW_PHRASE, (len(moves), 1))
            for state, out in enumerate(moves):
                for s, to in out.items():
                    dense[state, s] = base + to * width
            blocks.append(dense.ravel())
            locals_.append(local)
            self.dense.append(i)
            self.starts.append(base + cells - width)
            base += cells
        #: Bits that tell one place of a sample from the others: the cost of a phrase.
        self.bits = np.log2(np.maximum(sizes, 2))
        self.moves = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.int32)
        self.local = np.stack(locals_) if blocks else np.zeros((0, len(self.letters) + 2), dtype=np.int32)

    @staticmethod
    def _listed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(keys in order, next states, next states where no key is found, start); states are multiplied by the width, and a key is a state plus a symbol."""
        pairs = sorted((state * width + s, to * width) for state, out in enumerate(moves) for s, to in out.items())
        root = np.full(width, (len(moves) - 1) * width, dtype=np.int64)
        for s, to in moves[0].items():
            root[s] = to * width
        keys, to = np.array([*pairs, (len(moves) * width, 0)], dtype=np.int64).T
        return np.ascontiguousarray(keys), np.ascontiguousarray(to), root, (len(moves) - 1) * width

    def _code(self, code: int) -> int:
        return self.letters.get(chr(code).lower(), 0) if chr(code).isalpha() else 1

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, and whether it has a letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.symbol[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]):
            out[codes == c] = self._code(int(c))
        gap = out == 1
        keep = ~gap
        keep[:1] = True
        keep[1:] |= ~gap[:-1]
        return out[keep], not gap.all()

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """(languages, stretches): phrases of each stretch, all stepped through together."""
        order = np.argsort([-len(s) for s in stretches], kind="stable")
        lengths = np.array([len(stretches[i]) for i in order])
        grid = np.zeros((lengths.max(initial=0), len(order)), dtype=np.int32)
        for column, i in enumerate(order):
            grid[: lengths[column], column] = stretches[i]
        state = np.repeat(np.array(self.starts, dtype=np.int32)[:, None], len(order), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        listed = [np.full(len(order), start, dtype=np.int64) for *_, start in self.sparse]
        counts = np.zeros((len(listed), len(order)), dtype=np.int32)
        active = len(order)
        for t in range(len(grid)):
            while active and lengths[active - 1] <= t:
                active -= 1
            now = grid[t, :active]
            if self.dense:
                to = self.moves[state[:, :active] + self.local[:, now]]
                count[:, :active] += to >> 30
                state[:, :active] = to & (NEW_PHRASE - 1)
            for k, (_, local, keys, next_, root, _) in enumerate(self.sparse):
                s = local[now]
                wanted = listed[k][:active] + s
                at = np.searchsorted(keys, wanted)
                found = keys[at] == wanted
                counts[k, :active] += ~found
                listed[k][:active] = np.where(found, next_[at], root[s])
        out = np.empty((len(self.langs), len(order)), dtype=np.int32)
        for rows, own in ((count, self.dense), (counts, [i for i, *_ in self.sparse])):
            for row, i in zip(rows, own):
                out[i, order] = row
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        stretches, owner, letters, sizes = [], [], np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            symbols, letters[i] = self.symbols(text)
            sizes[i] = len(symbols)
            if letters[i]:
                parts = [symbols[k : k + STRETCH] for k in range(0, len(symbols), STRETCH)]
                stretches += parts
                owner += [i] * len(parts)
        if not self.langs or not stretches:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = self.phrases(stretches)
        entropy = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in counts]) * self.bits[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        second = ranked[1] if len(ranked) > 1 else ranked[0] + 1
        score = np.clip(1 - ranked[0] / np.maximum(second, 1e-9), 0, 1)
        return [(self.langs[b], float(s)) if has else (UNKNOWN, 0.0) for b, s, has in zip(best, score, letters)]


def training_samples(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """At most docs * chars code points of each language. The rank limit is pushed below the shuffle."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("order"), F.substring(text_col, 1, chars).alias("text"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(F.col("rank") <= docs)
    texts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, "\n".join(texts[lang])) for lang in sorted(texts))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: one pass, no shuffle. Only texts go to Python; other columns stay in the JVM and pass through."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = CrossParser(samples)
        for texts in batches:
            found, block, size = [], [], 0
            for t in texts:
                block.append(t or "")
                size += len(block[-1])
                if size >= BLOCK_CHARS:
                    found += parser.predict(block)
                    block, size = [], 0
            found += parser.predict(block)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    text_batches(docs.sparkSession)
    judged = F.pandas_udf(predict, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_judged", judged(F.col(text_col))).select(*kept, F.col("_judged.lang_pred").alias("lang_pred"), F.col("_judged.score").alias("score"))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.coalesce(crc_fold(id_col, 4) != 2, F.lit(True)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = training_samples(training_rows(docs))
    held_out: Column = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
