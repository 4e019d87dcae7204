import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import browse, ids, ranks


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_ranks_and_neighbours_over_all_ranges(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a", "a", "é", "Z"]), rng.randint(0, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "book_id long, name string, _before int")
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), -r[0]))
    keys = [F.col("name"), -F.col("book_id")]
    got = {r.book_id: r["place"] for r in ranks.range_ranked(df.drop("_before"), keys, "place").collect()}
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    around = {r.book_id: (r.previous_id, r.next_id) for r in browse.neighbours(df.drop("_before").withColumn("back", -F.col("book_id")), ["name", "back"]).collect()}
    assert around == {r[0]: (order[i - 1][0], order[(i + 1) % n][0]) for i, r in enumerate(order)}


def test_ids_of_names_with_one_beginning(spark):
    names = [f"NATION_{i % 7} author {i}" for i in range(400)]
    df = spark.createDataFrame([(x,) for x in names + names[:50]] + [(None,)], "name string")
    known = ids.assign_ids(df.where("name like 'NATION_0%'"), None, "name", "id")
    first = sorted(x for x in names if x.startswith("NATION_0"))
    assert {r.name: r.id for r in known.collect()} == {x: i for i, x in enumerate(first, 1)}
    rest = sorted(set(names) - set(first))
    assert {r.name: r.id for r in ids.assign_ids(df, known, "name", "id").collect()} == {x: i for i, x in enumerate(first + rest, 1)}
    none = spark.createDataFrame([], "id long, name string")
    assert {r.id for r in ids.assign_ids(df.limit(0), none, "name", "id").collect()} == set()


def test_no_plan_gathers_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("book_id"), F.col("id").cast("string").alias("name"))
    for out in (ranks.range_ranked(df, [F.col("name")]), browse.neighbours(df, ["name"]), ids.assign_ids(df, None, "name", "n")):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
