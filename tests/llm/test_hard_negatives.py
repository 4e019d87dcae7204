import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, key string, q int, anchor int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    ok, seen = [], set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        ok.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a in ok:
        if not anchors(a[0]):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in ok if b is not a), key=lambda s: s[:2])
        for ps, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            band = [s for s in scored if s[2] != a[1] and low * -ps <= 100 * -s[0] <= high * -ps]
            out += [(a[0], pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(band[:negatives], 1)]
    return sorted(out)


def test_query_equals_brute_force_and_sql(spark, data):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = H.op11_hard_negatives(spark, data)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(found.dtypes)["rank"] == "int"
    got = sorted(tuple(r) for r in found.collect())
    assert got and got == brute(rows, lambda i: i % 50 == 0)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    assert got == sorted(con.execute(H.OP11_SQL).fetchall())


def vectors(n, dim, seed, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, rng.randrange(4), [round(x + rng.gauss(0, spread), 2) for x in c]))
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_small_cells_clusters_and_blocks(spark, monkeypatch, spread):
    for name, value in {"MEMBERS": 7, "SEGMENT": 60, "BLOCK": 16, "PARTS": 4, "CLUSTERS": 5}.items():
        monkeypatch.setattr(H, name, value)
    rows = vectors(600, 5, 3, spread)
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, q int, anchor int")
    got = sorted(tuple(r) for r in H.hard_negatives(df, "vec_id", "label", "embedding", F.col("vec_id") % 9 == 0).collect())
    assert got == brute(rows, lambda i: i % 9 == 0)


def test_ties_repeats_nulls_lengths_and_huge_components(spark):
    nan = float("nan")
    rows = [(i, i % 3, [1.0, 0.5, float(i % 4)]) for i in range(60)] + [(100 + i, 1, [1.0, 0.5, 2.0]) for i in range(40)]
    rows += [(0, 0, [1.0, 0.5, 0.0]), (None, 1, [1.0, 2.0, 3.0]), (201, None, [1.0, 2.0, 3.0]), (202, 1, None), (203, 1, [1.0, None, 3.0]), (204, 2, [nan, 1.0, 1.0]), (205, 2, [float("inf"), 1.0, 1.0])]
    rows += [(206, 2, [2.0]), (207, 1, []), (208, 2, [1.0, 0.5, 1.0, 9.0]), (300, 1, [float(1 << 22), 1.0, 0.0]), (301, 2, [float(1 << 22) * 0.75, 1.0, 0.0]), (302, 1, [float(1 << 22), 2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, q int, anchor int")
    got = sorted(tuple(r) for r in H.hard_negatives(df, "vec_id", "label", "embedding", F.col("vec_id") % 4 == 0).collect())
    assert got == brute(rows, lambda i: i % 4 == 0)


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 1, [1.0], "x", 1, 1)], SCHEMA)
    assert H.hard_negatives(df.limit(0), "vec_id", "label", "embedding", F.col("vec_id") % 2 == 0).count() == 0
    assert H.hard_negatives(df, "vec_id", "label", "embedding", F.col("vec_id") % 2 == 0).count() == 0
    assert H.hard_negatives(df, "vec_id", "label", "embedding", F.lit(True)).count() == 0


def test_bounds_hold_for_every_member():
    import numpy as np

    rng = np.random.default_rng(5)
    members, rows = rng.integers(-50, 50, (40, 6)), rng.integers(-300, 300, (500, 6))
    centroid = H.fit_centroids(members, 1)
    width = H.angles(H.units(members)[0], centroid).max()
    bound = H.bounds(H.angles(H.units(rows)[0], centroid)[:, 0], H.units(rows)[1], width)
    assert (H.products(members, rows) <= H.units(members)[1][:, None] * bound[None]).all()
