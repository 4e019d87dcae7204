"""N-gram Jaccard join by prefix filters under several global orders.

A document is the set of its distinct word n-grams; two link when their Jaccard similarity reaches the threshold. Sets that are equal
become one node. Under any global order of n-grams, linked sets share one of their first n - ceil(t*n) + 1 n-grams, so
candidates must share such prefix n-grams under each of three orders. Candidates come from the lists of the first order; the other orders' prefixes are
intersected before any text is fetched for the exact check.
All orders put n-grams of rare buckets first (bucket counts of a count sketch of bounded size over the whole corpus, so that common
lines and passages come last); within a bucket class they differ by their hash.

Each filter also bounds the overlap by the n-grams that two prefixes have in common: of two prefixes under one order, the one that ends first
has in common with the other prefix all that it has in common with the other set.

Pairs are not expanded within a group. First every prefix list links its members to the most central one (the one
whose shared n-gram comes earliest in its own order); then only members of different components of these
links are compared, with all filters, in lists of bounded length. A long list of different components means that its n-gram is more frequent
than the sketch could tell: its members meet again in a round of their own, where the sketch counts them alone and puts that n-gram last, until
no pair of a list is left unjudged. Linked groups so cost about one pair per member, and groups that share a passage without linking
do not meet in it. Tasks hold one batch of rows and one text's n-grams at a time.

N-grams and sets are compared as 64-bit hashes: two different ones among n agree with probability n*n / 2**65.

Defined results: a null or empty text has an empty set and links with nothing; fewer words than n are one n-gram, the whole sequence; rows
repeated with equal sets are one component; a null id never names a component unless all its ids are null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import discard, table, text_batches, words, written
from foliospark.llm.components import components

#: Buckets of the count sketch: at least, at most, and such that a bucket holds about LOAD n-grams of a corpus with one n-gram in CHARS bytes. A fixed
#: number would tell less of a larger corpus. Each bucket has one byte in a task, far less in the broadcast, as most bytes are 0.
SKETCH_BITS, MOST_SKETCH_BITS, LOAD, CHARS = 18, 24, 32, 6
#: Buckets that tasks exchange, and the driver receives, as one compressed row.
RANGE_BITS = 12
#: Members of a list up to which its pairs are compared; members of longer lists go to another round, with a larger sketch where more than half
#: of a round are left, until one that a larger one could not better leaves over SHRINK of a round, or all lists have at most PAIRS pairs for each row of the corpus.
LONG, SHRINK, PAIRS = 64, 0.9, 16
#: Buckets of keys that may be broadcast, whatever the size of the corpus; with most of them taken the filter lets rows through to the join.
BUCKETS = 1 << 20
#: Rows that a task of the features, and ranges that one of the sketch, gives back at once; rows that a task receives at once, as pairs of the longest texts are long.
SLICE, SENT, RECEIVED = 1000, 256, 200
#: Sets that a task remembers as met; one that it has forgotten gives its prefixes once more.
MOST_SEEN = 1 << 16
#: Seeds of the orders within a class.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of one document."""
    h = np.asarray(word_hashes, dtype=np.int64).view(np.uint64)
    if not len(h):
        return h
    size = min(n, len(h))
    out = mixed(h[: len(h) - size + 1] + np.uint64(size))
    for j in range(1, size):
        out = mixed(out * np.uint64(31) + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def _word_hashes(docs: DataFrame) -> DataFrame:
    """docs with the hashes of its words in place of its text."""
    return docs.withColumn("hashes", _hashes("text")).drop("text")


def _hashes(text: str) -> Column:
    return F.transform(F.filter(words(F.col(text)), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a corpus of so many bytes."""
    return max(min(max(SKETCH_BITS, (size // (LOAD * CHARS)).bit_length()), MOST_SKETCH_BITS), 1)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, wider where one of them needs it; most are small, so they compress well."""
    kind = np.uint8 if counts.max(initial=0) < 256 else np.int64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8 if data[0] == 1 else np.int64)


def sketch_classes(hashed: DataFrame, n: int, bits: int) -> np.ndarray:
    """Class of each bucket by the n-grams counted in it over all documents: 0 up to chance, then by doubling.

    Tasks exchange their counts, and the driver gets the classes, as compressed ranges of buckets: about a byte for each n-gram at most.
    """
    width = 1 << min(bits, RANGE_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, dtype=np.uint16)

        def so_far() -> Iterator[pd.DataFrame]:
            parts = total.reshape(-1, width)
            used = np.flatnonzero(parts.any(axis=1))
            for at in range(0, len(used), SENT):
                some = used[at : at + SENT]
                yield pd.DataFrame({"part": some.astype(np.int32), "counts": [_packed(parts[i]) for i in some]})
            total[:] = 0

        for b in batches:
            for h in b["hashes"]:
                at = (shingles(h, n) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(total, at, np.uint16(1))
                if total[at].max(initial=0) >= 1 << 15:
                    yield from so_far()
        yield from so_far()

    def classes_of(total: np.ndarray) -> bytes:
        load = max(float(np.median(total)), 1.0)  # a bucket's count where it holds rare n-grams only, give or take its root
        over = (total - load) / (4 * load**0.5)
        return zlib.compress(np.where(over <= 1, 0, 1 + np.log2(np.maximum(over, 1))).astype(np.uint8).tobytes(), 1)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(width, dtype=np.int64)
        for b in batches:
            for part, counts in zip(b["part"], b["counts"]):
                if now is not None and part != now:
                    yield pd.DataFrame({"part": [now], "classes": [classes_of(total)]})
                    total[:] = 0
                now = part
                total += _unpacked(counts)
        if now is not None:
            yield pd.DataFrame({"part": [now], "classes": [classes_of(total)]})

    counts = hashed.select("hashes").mapInPandas(count, "part int, counts binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for part, classes in counts.repartition("part").sortWithinPartitions("part").mapInPandas(judge, "part int, classes binary").collect():
        out[part * width : (part + 1) * width] = np.frombuffer(zlib.decompress(classes), dtype=np.uint8)
    return out


def ordered(grams: np.ndarray, classes: np.ndarray, seed: int) -> np.ndarray:
    """Sort keys under one global order: the class, then a hash."""
    bits = int(len(classes)).bit_length() - 1
    rank = classes[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return (rank << np.uint64(57)) | (mixed(grams ^ np.uint64(seed)) >> np.uint64(7))


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    if k < len(keys):
        keys = np.partition(keys, k - 1)[:k]
    return np.sort(keys)


def node_of(grams: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size) // 100 + 1 if size else 0


def features(hashed: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """(row_key, doc_id, size, node, prefix0, ..): node is the hash of the set; its prefixes, one per order, stand at a split's first row of a node."""
    names = [f"prefix{i}" for i in range(len(ORDERS))]
    sent = zlib.compress(classes.tobytes(), 1)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = np.frombuffer(zlib.decompress(sent), dtype=np.uint8)
        seen: set[int | None] = set()
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at : at + SLICE]
                size, node, prefixes = [], [], [[] for _ in ORDERS]
                for h in part["hashes"]:
                    grams = shingles(h, n)
                    size.append(len(grams))
                    node.append(node_of(grams))
                    new = len(grams) and node[-1] not in seen
                    for seed, own in zip(ORDERS, prefixes):
                        own.append(_first(ordered(grams, classes, seed), prefix_length(len(grams), percent)).view(np.int64) if new else np.zeros(0, dtype=np.int64))
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(node[-1])
                yield pd.DataFrame({"row_key": part["row_key"].to_numpy(), "doc_id": pd.array(part["doc_id"], dtype="Int64"), "size": size, "node": pd.array(node, dtype="Int64"), **dict(zip(names, prefixes))})

    return hashed.mapInPandas(make, "row_key long, doc_id long, size int, node long, " + ", ".join(f"{x} array<long>" for x in names))


def exact_links(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of (a, b, hashes_a, hashes_b) the pairs whose sets link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_linked(shingles(x, n), shingles(y, n), percent) for x, y in zip(batch["hashes_a"], batch["hashes_b"])]
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(check, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _could_link(size_a: Column, at_a: Column, size_b: Column, at_b: Column, percent: int) -> Column:
    """Lengths fit, and so many n-grams are left from the first common one on (at_a and at_b before it) that the pair could link."""
    most = F.least(size_a - at_a, size_b - at_b)
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & (100 * most >= percent * (size_a + size_b - most))


def _meet(order: int, percent: int) -> Column:
    a, b = (F.col(f"prefix{order}_{x}") for x in ("a", "b"))
    most = F.size(F.array_intersect(a, b)) + F.when(F.element_at(a, -1) <= F.element_at(b, -1), F.col("size_a") - F.size(a)).otherwise(F.col("size_b") - F.size(b))
    return 100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows joined to wanted (key, ..). Before the shuffle most other rows go by their key's bucket: a broadcast of BUCKETS integers at most."""
    bucket = lambda: F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")
    there = wanted.select(bucket().alias("bucket")).distinct()
    near = rows.withColumn("bucket", bucket()).join(F.broadcast(there), "bucket", "left_semi").drop("bucket")
    return near.join(wanted, key)


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with the columns of rows (node, ..) for each end."""
    side = lambda x: rows.select(*(F.col(c).alias(f"{c}_{x}") for c in rows.columns))
    return pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))


def _verified(pairs: DataFrame, orders: list[list[int]], prefixes: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of distinct (a, b) those whose prefixes have enough in common under each of the orders, which are fetched group by group, and whose sets link.

    Only texts of what is left after all orders are fetched; texts are smaller than the sets and so travel in their place.
    """
    near = written(pairs)
    for group in orders:
        pairs, ends = near, written(_ends(near))
        near = _both(pairs, _only(prefixes.select("node", "size", *(f"prefix{i}" for i in group)), ends, "node"))
        for order in group:
            near = near.where(_meet(order, percent))
        near = written(near.select("a", "b").distinct())
        discard(pairs, ends)
    wanted = written(nodes.join(_ends(near), "node", "left_semi").select("row_key", "node"))
    found = _only(texts.select("row_key", "text"), wanted, "row_key").select("node", "text")
    both = _both(near, found)
    hashed = both.select("a", "b", *(_hashes(f"text_{x}").alias(f"hashes_{x}") for x in ("a", "b")))
    out = written(exact_links(hashed, n, percent).distinct())
    discard(near, wanted)
    return out


def prefix_lists(rows: DataFrame) -> DataFrame:
    """(gram, node, size, at, hub, hub_size, hub_at): the members of the lists of the first order that have more than one, each with the most central one.

    One shuffle, by n-gram; a node that several splits gave stands next to itself in the order of its list. The windows go through a list once and hold a row of it at a time.
    """
    prefix = F.col("prefix0")
    lists = rows.where(F.size(prefix) > 0).select("node", "size", F.posexplode(prefix).alias("at", "gram"))
    order = Window.partitionBy("gram").orderBy(F.col("at") / F.col("size"), "node", "size", "at")
    once = lists.withColumn("last", F.lag("node").over(order)).where(F.col("last").isNull() | (F.col("last") != F.col("node")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hub = {f"hub{x}": F.first(c).over(so_far) for x, c in (("", "node"), ("_size", "size"), ("_at", "at"))}
    placed = once.withColumns({**hub, "more": F.lead("node").over(order)})
    return placed.where((F.col("node") != F.col("hub")) | F.col("more").isNotNull()).select("gram", "node", "size", "at", *hub)


def _cross(left: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different components that share a list and could link by sizes and places; left: (gram, node, size, at, root)."""
    own = ("node", "size", "at", "root")
    # sizes of sets that link differ by one band at most; at 100 percent they are equal
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int") if percent < 100 else F.col("size")
    left = left.select("gram", *own).withColumn("band", band)
    right = left.select("gram", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"{c}_b") for c in own))
    # a pair that links passes the filter by places at its first common n-gram, so each such pair comes out of one list at least
    apart = (F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b"))
    pairs = left.join(right, ["gram", "band"]).where(apart & _could_link(F.col("size"), F.col("at"), F.col("size_b"), F.col("at_b"), percent))
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _linked_sets(texts: DataFrame, rows: DataFrame, nodes: DataFrame, bits: int, n: int, percent: int) -> DataFrame:
    """(a, b): links that leave no two linked sets in different components.

    A round links the members of each list to the hub, then compares what lists of at most LONG members still hold of different components.
    Members of longer such lists go to the next round, in which n-grams are counted, and so ordered, over these members alone: two sets that
    link and met in long lists only are both among them. All lists are compared where their pairs are few for the rows of the corpus, or where the
    sketch leaves over SHRINK of a round's members and is the largest, or has room for all n-grams of the round.
    """
    prefixes, links = rows.where(F.size("prefix0") > 0), None
    before = most = rows.count()
    counted = None  # n-grams in the sketch of the round, once they are few
    label = lambda df, roots, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    while True:
        prefixes = prefixes.select("node", "size", *(f"prefix{i}" for i in range(len(ORDERS))))
        members = written(prefix_lists(prefixes))
        near = members.where((F.col("node") != F.col("hub")) & _could_link(F.col("size"), F.col("at"), F.col("hub_size"), F.col("hub_at"), percent))
        near = near.select("node", "hub").distinct()
        if links is not None:
            roots = written(components(links))
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")  # stars in place of all links
            near = label(label(near, roots, "node"), roots, "hub").where(F.col("node_root") != F.col("hub_root"))
        found = _verified(near.select(F.col("hub").alias("a"), F.col("node").alias("b")), [[0], [1, 2]], prefixes, texts, nodes, n, percent)
        links = found if links is None else links.unionByName(found)

        labelled = label(members, components(links), "node").withColumnRenamed("node_root", "root")
        mixed_lists = labelled.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where(F.col("low") != F.col("high")).select("gram", "n")
        left = written(labelled.select("gram", "node", "size", "at", "root").join(mixed_lists, "gram"))
        again = written(left.where(F.col("n") > LONG).select("node").distinct())
        count, squares = again.count(), left.where(F.col("n") > LONG).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        last = count == 0 or squares <= 2 * PAIRS * most or (count > SHRINK * before and (bits >= MOST_SKETCH_BITS or (counted is not None and counted <= 1 << bits)))
        pairs = written(_cross(left if last else left.where(F.col("n") <= LONG), percent))
        links = links.unionByName(_verified(pairs, [[0], [1, 2]], prefixes, texts, nodes, n, percent))
        discard(members, left, pairs)
        if last:
            discard(again)
            return links
        before, bits = count, min(bits + 2, MOST_SKETCH_BITS) if 2 * count > before else bits
        wanted = written(nodes.join(again, "node", "left_semi").select("row_key"))
        some = _only(texts.select("row_key", F.lit(None).cast("long").alias("doc_id"), "text"), wanted, "row_key")
        hashed = written(_word_hashes(some))
        counted = hashed.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
        prefixes = written(features(hashed, sketch_classes(hashed, n, bits), n, percent)).where(F.size("prefix0") > 0)
        discard(again, wanted, hashed)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach), row_key (hash of id and text), component (null for empty sets)."""
    text_batches(docs.sparkSession, RECEIVED)
    texts = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = sketch_bits(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    rows = written(features(_word_hashes(texts), sketch_classes(_word_hashes(texts), n, bits), n, percent))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"))
    roots = components(_linked_sets(texts, rows, nodes, bits, n, percent))

    grouped = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = grouped.join(named, "root").select("node", "component_id", F.col("root").alias("component"))
    out = rows.select("row_key", "doc_id", F.col("size").cast("long").alias("n_shingles"), "node").join(labels, "node", "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), "row_key", "component")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP8_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents
), s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end) as gram from w
), n as (select doc_id, count(*) as size from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.size + y.size - common)
), reach as (
  select doc_id as a, doc_id as b from w union select reach.a, links.b from reach join links on reach.b = links.a
)
select w.doc_id, coalesce(max(size), 0) as n_shingles, min(b) as component_id
from w left join n on n.doc_id = w.doc_id join reach on reach.a = w.doc_id group by w.doc_id
"""
