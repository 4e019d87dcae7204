"""Exact duplicates by Patricia tries.

Texts are partitioned by byte length and content hash. Each task inserts whole byte strings into
a compressed radix trie; a terminal node holds the owner (smallest or largest id) and the number of
rows. The same trie first combines each input split, so a text that a third of all rows hold
reaches its partition once per split. When a trie outgrows its memory bound, its heaviest subtree goes to
a scratch file of the task and is merged by itself afterwards.

Defined results: a null text is the empty text; empty texts are duplicates of each other; null ids never own
a group unless all its ids are null; of rows repeated with the same id and text exactly one is kept;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import table, text_batches

#: Bytes that one trie may hold before a subtree is spilled.
TRIE_BYTES = 64 << 20
#: Counted beside its label for each edge: the objects of the label, the edge and the child node.
EDGE_BYTES = 500

Entry = tuple[bytes, int | None, int]


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slice comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """node = [edges by first byte, rows that end here, their owner]; edge = (label, child node)."""

    def __init__(self, largest: bool):
        self.root, self.largest, self.held = [{}, 0, None], largest, {}

    def owner(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.largest else min(a, b)

    def insert(self, key: bytes, depth: int, owner: int | None, n: int) -> None:
        node, at, cost = self.root, depth, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, 0, None]
                node[0][key[at]] = (key[at:], leaf)
                cost, node = len(key) - at + EDGE_BYTES, leaf
                break
            label, child = edge
            if not key.startswith(label, at):
                same = common_prefix(label, key[at : at + len(label)])
                child = [{label[same]: (label[same:], child)}, 0, None]
                node[0][key[at]] = (label[:same], child)
                cost += EDGE_BYTES
                at, node = at + same, child
            else:
                at, node = at + len(label), child
        node[2] = owner if not node[1] else self.owner(node[2], owner)
        node[1] += n
        if cost:
            self.held[key[depth]] = self.held.get(key[depth], 0) + cost

    def entries(self, prefix: bytes, node: list) -> Iterator[Entry]:
        stack = [(prefix, node)]
        while stack:
            prefix, node = stack.pop()
            if node[1]:
                yield prefix, node[2], node[1]
            stack.extend((prefix + label, child) for label, child in node[0].values())

    def cut(self, byte: int, prefix: bytes) -> Iterator[Entry]:
        """Takes the subtree below a first byte out of the trie."""
        label, child = self.root[0].pop(byte)
        self.held.pop(byte)
        return self.entries(prefix + label, child)


def merged(rows: Iterable[Entry], largest: bool, bound: int, depth: int = 0) -> Iterator[Entry]:
    """One entry per distinct key; all keys share their first `depth` bytes."""
    trie, spilled, prefix = Trie(largest), {}, b""
    try:
        for key, owner, n in rows:
            prefix = key[:depth]
            file = spilled.get(key[depth]) if len(key) > depth else None
            if file:
                pickle.dump((key, owner, n), file)
                continue
            trie.insert(key, depth, owner, n)
            while sum(trie.held.values()) > bound:
                byte = max(trie.held, key=trie.held.get)
                if not trie.root[0][byte][1][0]:  # a single key
                    break
                spilled[byte] = tempfile.TemporaryFile()
                for entry in trie.cut(byte, prefix):
                    pickle.dump(entry, spilled[byte])
        yield from trie.entries(prefix, trie.root)
        del trie
        for file in spilled.values():
            first, shared = None, 0
            for key, _, _ in replayed(file):
                first, shared = (key, len(key)) if first is None else (first, common_prefix(first[:shared], key))
            yield from merged(replayed(file), largest, bound, max(shared, depth + 1))
    finally:
        for file in spilled.values():
            file.close()


def replayed(file) -> Iterator[Entry]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _combiner(largest: bool, bound: int):
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((t.encode(), None if pd.isna(o) else int(o), int(n)) for b in batches for t, o, n in zip(b["text"], b["owner"], b["n"]))
        out, held = [], 0
        for entry in merged(rows, largest, bound):
            out.append(entry)
            held += len(entry[0])
            if held > 8 << 20 or len(out) >= 5000:
                yield _frame(out)
                out, held = [], 0
        if out:
            yield _frame(out)

    return combine


def _frame(entries: list[Entry]) -> pd.DataFrame:
    return pd.DataFrame({"text": [k.decode() for k, _, _ in entries], "owner": pd.array([o for _, o, _ in entries], dtype="Int64"), "n": [n for _, _, n in entries]})


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(text, owner, n): one row per distinct text."""
    schema = "text string, owner long, n long"
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("owner"), F.lit(1).cast("long").alias("n"))
    text_batches(docs.sparkSession)
    combine = _combiner(keep == "largest", trie_bytes)
    local = rows.mapInPandas(combine, schema)
    return local.repartition(F.octet_length("text"), F.xxhash64("text")).mapInPandas(combine, schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    The rows that come back carry the digest of their text instead of the text; digests link them to the owners that the tries found.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    owners = text_owners(docs, id_col, text_col, keep, trie_bytes).select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.withColumn("copy", copy).join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
