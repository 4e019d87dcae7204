"""Hard negatives by lists that clusters of anchors share, walked until certified termination.

Anchors are clustered by angle. In a cluster with centroid c whose members lie within an angle t of it, no member u has an inner product with a row i above
|u| |i| cos(max(0, angle(i, c) - t)). Rows sorted by this bound (without |u|) once are the list of all members: each walks it block by block until the
bound of what is left is below the score it still needs. Two searches use such lists: the positives (rows of the anchor's label) and the
negatives, of which each positive wants the best within a band of its score. The negatives' first run is over one part of the rows only; the scores found there
are certified lower bounds of those of all rows, so a row goes to a cluster only if its bound reaches what some member needs.

Work is dealt out in cells: a chunk of at most MEMBERS anchors of a cluster with a segment of about SEGMENT rows of its list, each walked by itself; the
best of all segments are merged by rank. A task holds one cell at a time, and nothing that grows with the rows is broadcast or collected:
the driver sees at most CLUSTERS centroids and one figure for each. The clusters are fitted on at most SAMPLE anchors, which
only decides how tight the bounds are: all results are exact.

Vectors become integers floor(scale * x); scores are exact as long as they fit into a long (in double arithmetic up to 2^53, in Python's integers beyond).

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; rows repeated with equal id, label and vector are
one row; other rows of one id are rows of their own, after the smaller hash of label and vector where all else ties; of vectors of unequal length the shorter is
filled with zeros; an empty vector scores 0 with all; a positive of negative score has no band and so no negatives; no anchors or an empty table give an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import table, written

#: Clusters at most, anchors that they are fitted on at most, anchors of a cell, rows of a cell about, and the parts of which the first run sees one.
CLUSTERS, SAMPLE, MEMBERS, SEGMENT, PARTS = 256, 1 << 14, 1024, 8192, 16
#: Rows of a list that are scored at once.
BLOCK = 1024
#: Rounding of angles and cosines, on the safe side.
MARGIN = 1e-6
LOWEST = -(1 << 63)


def usable_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column, scale: int) -> DataFrame:
    """(key, id, label, q, anchor): the rows that take part; key tells rows apart, q is the integer vector."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
    q = kept.select("id", "label", "anchor", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))
    return q.withColumn("key", F.xxhash64("id", "label", "q")).dropDuplicates(["key", "id", "label", "q"])


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Integer vectors as rows filled to dim; int64."""
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.array(a.astype(object) @ b.astype(object).T, dtype=np.int64)


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths); a zero vector keeps direction zero, an angle of 90 degrees to all."""
    v = vectors.astype(np.float64)
    length = np.sqrt((v * v).sum(axis=1))
    return v / np.maximum(length, 1e-300)[:, None], length


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the rows of sample."""
    directions = units(sample)[0]
    rng = np.random.default_rng(seed)
    centroids = directions[rng.choice(len(directions), min(k, len(directions)), replace=False)]
    for _ in range(rounds):
        own = (directions @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, directions)
        centroids = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, units(sums)[0], centroids)
    return centroids


def angles(directions: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centroids.T, -1, 1))


def bounds(angle: np.ndarray, length: np.ndarray, width) -> np.ndarray:
    """Per unit of the member's length: no inner product of a member within `width` of the centroid with the row is above."""
    return length * (np.cos(np.maximum(0, angle - width - MARGIN)) + MARGIN)


def clustered(anchors: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """anchors with cluster and chunk; the centroids, and each cluster's largest angle. Clusters follow the number of anchors up to CLUSTERS, beyond that chunks do."""
    n = anchors.count()
    picked = anchors.select("q", "key").orderBy("key").limit(SAMPLE).toPandas()
    centroids = fit_centroids(matrix(picked["q"], dim), max(1, min(CLUSTERS, -(-n // MEMBERS)))) if n else np.zeros((1, dim))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn = angles(units(matrix(b["q"], dim))[0], centroids)
            own = turn.argmin(axis=1)
            yield b[["key", "id", "label", "q"]].assign(cluster=own.astype(np.int32), angle=turn[np.arange(len(b)), own])

    placed = written(anchors.mapInPandas(nearest, "key long, id long, label string, q array<long>, cluster int, angle double"))
    facts = placed.groupBy("cluster").agg(F.max("angle").alias("width"), F.count("*").alias("n")).toPandas()
    widths, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    widths[facts["cluster"]], sizes[facts["cluster"]] = facts["width"], facts["n"]
    chunks = F.element_at(F.lit([max(1, -(-int(s) // MEMBERS)) for s in sizes]), F.col("cluster") + 1)
    return placed.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int")), centroids, widths


def best_of(score: np.ndarray, allowed: np.ndarray, keys: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, floor): of each row the allowed entries from its floor on that can be among its best k, by score alone; the floor rises to the kth of them."""
    masked = np.where(allowed & (score >= floor[:, None]), score, LOWEST)
    if masked.shape[1] >= k:
        floor = np.maximum(floor, np.partition(masked, -k, axis=1)[:, -k])
    row, column = np.nonzero((masked >= floor[:, None]) & (masked != LOWEST))
    return row, column, floor


class Best:
    """The best k rows of each of n searches so far, by score, then id, then key."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.rows = np.zeros((0, 4), dtype=np.int64)  # search, score, id, key

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([search, score, ids, keys], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        rank = np.arange(len(rows)) - start
        self.rows = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.floor[full[:, 0]] = np.maximum(self.floor[full[:, 0]], full[:, 1])


def walk(members: np.ndarray, lengths: np.ndarray, listed: np.ndarray, bound: np.ndarray, needs: Callable[[], np.ndarray], see: Callable[[np.ndarray, slice, np.ndarray], None]) -> None:
    """Goes through a list in order of its bounds, in blocks; a member leaves once nothing further on can reach what it needs."""
    active = np.arange(len(members))
    for at in range(0, len(listed), BLOCK):
        active = active[lengths[active] * bound[at] * (1 + MARGIN) >= needs()[active]]
        if not len(active):
            break
        block = slice(at, at + BLOCK)
        see(active, block, products(members[active], listed[block]))


def _listed(rows: pd.DataFrame, dim: int, centroid: np.ndarray, width: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    vectors = matrix(rows["q"], dim)
    directions, length = units(vectors)
    bound = bounds(angles(directions, centroid[None])[:, 0], length, width)
    order = np.argsort(-bound, kind="stable")
    return rows.iloc[order], vectors[order], bound[order]


def _dealt(lists: DataFrame, members: DataFrame, sizes: Column) -> tuple[DataFrame, DataFrame]:
    """Lists with the segment of each row, members once for every segment of their cell. Columns are named anew, as both sides come from the same rows."""
    out = lists.withColumn("segment", F.pmod(F.xxhash64("key", F.lit(1)), sizes).cast("int"))
    each = members.withColumn("segment", F.explode(F.sequence(F.lit(0), (sizes - 1).cast("int"))))
    return out.toDF(*out.columns), each.toDF(*each.columns)


def top_positives(rows: DataFrame, anchors: DataFrame, dim: int, centroids: np.ndarray, widths: np.ndarray, k: int) -> DataFrame:
    """(anchor, anchor_id, positive_id, positive_score, place): the first k other rows of each anchor's label."""
    cell = ["cluster", "chunk", "label"]
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("segments"))
    cells = anchors.select(*cell).distinct().join(sizes, "label")
    lists, members = _dealt(rows.select("key", "id", "label", "q").join(cells, "label"), anchors.join(sizes, "label"), F.col("segments"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor", "anchor_id", "positive_id", "positive_key", "positive_score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        c = int(left["cluster"].iloc[0])
        listed, vectors, bound = _listed(right, dim, centroids[c], widths[c])
        own = matrix(left["q"], dim)
        ids, keys, self_key, self_id = listed["id"].to_numpy(), listed["key"].to_numpy(), left["key"].to_numpy(), left["id"].to_numpy()
        best = Best(len(left), k, np.full(len(left), LOWEST, dtype=np.int64))

        def see(active: np.ndarray, block: slice, score: np.ndarray) -> None:
            other = (keys[block][None] != self_key[active][:, None]) | (ids[block][None] != self_id[active][:, None])
            row, column, _ = best_of(score, other, keys[block], best.floor[active], k)
            best.add(active[row], score[row, column], ids[block][column], keys[block][column])

        walk(own, units(own)[1], vectors, bound, lambda: best.floor, see)
        s = best.rows
        return pd.DataFrame({"anchor": self_key[s[:, 0]], "anchor_id": self_id[s[:, 0]], "positive_id": s[:, 2], "positive_key": s[:, 3], "positive_score": s[:, 1]}, columns=columns)

    keys = [*cell, "segment"]
    found = members.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(search, "anchor long, anchor_id long, positive_id long, positive_key long, positive_score long")
    order = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best_negatives(rows: DataFrame, asked: DataFrame, dim: int, centroids: np.ndarray, widths: np.ndarray, k: int, high: int, n: int) -> DataFrame:
    """(anchor, anchor_id, place, positive_id, positive_score, negative_id, negative_score, rank): for each positive the first k rows of other labels in its band.

    asked: anchors with `wanted`, an array of (place, positive_id, positive_score, need): need is the least score of interest, at or above the band's lower end. n: rows, about.
    """
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ratio = F.array_min(F.transform("wanted", lambda w: w["need"].cast("double"))) / F.greatest(length, F.lit(1e-300))
    least = asked.groupBy("cluster").agg(F.min(ratio).alias("ratio"), F.max("chunk").alias("chunks")).toPandas()
    clusters, ratios, chunks = (least[x].to_numpy() for x in ("cluster", "ratio", "chunks"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            directions, size = units(matrix(b["q"], dim))
            turn = angles(directions, centroids[clusters]) if len(clusters) else np.zeros((len(b), 0))
            for i, c in enumerate(clusters):
                reach = bounds(turn[:, i], size, widths[c]) * (1 + MARGIN) >= ratios[i]
                for chunk in range(int(chunks[i]) + 1):
                    yield b.loc[reach, ["key", "id", "label", "q"]].assign(cluster=np.int32(c), chunk=np.int32(chunk))

    lists = rows.select("key", "id", "label", "q").mapInPandas(place, "key long, id long, label string, q array<long>, cluster int, chunk int")
    lists, members = _dealt(lists, asked, F.lit(max(1, -(-n // SEGMENT))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_key", "negative_score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        c = int(left["cluster"].iloc[0])
        listed, vectors, bound = _listed(right, dim, centroids[c], widths[c])
        own = matrix(left["q"], dim)
        ids, keys = listed["id"].to_numpy(), listed["key"].to_numpy()
        codes, names = pd.factorize(pd.concat([left["label"], listed["label"]], ignore_index=True))
        mine, theirs = codes[: len(left)], codes[len(left) :]
        # one search for each wanted positive: searches of a member stand together
        owner = np.repeat(np.arange(len(left)), [len(w) for w in left["wanted"]])
        flat = [w for ws in left["wanted"] for w in ws]
        positive = np.array([w["positive_score"] for w in flat], dtype=np.int64)
        top = np.array([int(s) * high // 100 for s in positive], dtype=np.int64)
        best = Best(len(flat), k, np.array([w["need"] for w in flat], dtype=np.int64))
        first = np.searchsorted(owner, np.arange(len(left)), "left")
        count = np.bincount(owner, minlength=len(left))

        def needs() -> np.ndarray:
            return np.minimum.reduceat(best.floor, first)

        def see(active: np.ndarray, block: slice, score: np.ndarray) -> None:
            other = theirs[block][None] != mine[active][:, None]
            for j in range(int(count[active].max())):
                has = np.flatnonzero(count[active] > j)
                which = first[active[has]] + j
                row, column, _ = best_of(score[has], other[has] & (score[has] <= top[which][:, None]), keys[block], best.floor[which], k)
                best.add(which[row], score[has][row, column], ids[block][column], keys[block][column])

        walk(own, units(own)[1], vectors, bound, needs, see)
        s = best.rows
        by = owner[s[:, 0]]
        pick = lambda name: np.array([flat[i][name] for i in s[:, 0]], dtype=np.int64)
        return pd.DataFrame(
            {"anchor": left["key"].to_numpy()[by], "anchor_id": left["id"].to_numpy()[by], "place": pick("place"), "positive_id": pick("positive_id"), "positive_score": positive[s[:, 0]], "negative_id": s[:, 2], "negative_key": s[:, 3], "negative_score": s[:, 1]}, columns=columns
        )

    cell = ["cluster", "chunk", "segment"]
    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_key long, negative_score long"
    found = members.groupBy(*cell).cogroup(lists.groupBy(*cell)).applyInPandas(search, schema)
    order = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchor` holds and each of its first `positives`
    rows of the same label, the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    usable = written(usable_rows(rows, id_col, label_col, vector_col, anchor, scale))
    n, dim = usable.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    anchors, centroids, widths = clustered(usable.where("anchor"), dim)
    near = top_positives(usable, anchors, dim, centroids, widths, positives).where("positive_score >= 0")
    need = F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("long")
    wanted = near.groupBy("anchor", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", need.alias("need")))).alias("wanted"))
    asked = written(anchors.join(wanted, (F.col("key") == F.col("anchor")) & (F.col("id") == F.col("anchor_id"))).drop("anchor", "anchor_id"))

    part = usable.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(PARTS)) == 0)
    first = best_negatives(part, asked, dim, centroids, widths, negatives, high, -(-n // PARTS))
    # the last of a full set found in one part is a lower bound of the last one over all rows
    floors = first.where(F.col("rank") == negatives).groupBy("anchor", "anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "negative_score"))).alias("floors"))
    raised = F.transform("wanted", lambda w: F.struct(w["place"].alias("place"), w["positive_id"].alias("positive_id"), w["positive_score"].alias("positive_score"), F.greatest(w["need"], F.col("floors")[w["place"]]).alias("need")))
    joined = asked.join(floors, (F.col("key") == F.col("anchor")) & (F.col("id") == F.col("anchor_id")), "left").drop("anchor", "anchor_id")
    tight = written(joined.withColumn("wanted", raised).drop("floors"))
    out = best_negatives(usable, tight, dim, centroids, widths, negatives, high, n)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", label.alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, n.vec_id as negative_id, positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id) qualify row_number() over w <= 3
"""
