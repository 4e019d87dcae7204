from foliospark.operators import books as B
from foliospark.operators import storage as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_of_a_stored_catalog_need_no_exchange(spark, tmp_path):
    books = spark.createDataFrame([(i, f"t{i}", 0, f"20{10 + i % 3}-05-0{1 + i % 9} 00:00:00" if i % 7 else None, "x") for i in range(200)], "book_id long, title string, del int, added_at string, clash string")
    books = books.withColumn("added_at", books.added_at.cast("timestamp"))
    links = spark.createDataFrame([(i, i % 11, f"n{i % 11}") for i in range(150)] * 2 + [(None, 3, "n3")], "book_id long, author_id long, name string")
    named = ST.named_links(links.select("book_id", "author_id"), links.select("author_id", "name").distinct(), "author_id", "name")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ST.store_catalog(books, {"by_author": named, "of_author": named}, "st", str(tmp_path), 4, "year", {"of_author": "author_id"})
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored, own = spark.table("st_by_author"), spark.table("st_books")
        lists = ST.names_of_books(stored, "author_id", "name", "author")
        assert own.join(lists, "book_id", "left").count() == 200 and "Exchange" not in plan(own.join(lists, "book_id", "left"))
        # only fresh rows are exchanged: by all columns to be distinct, then by book
        fresh = spark.createDataFrame([(0, 0, "n0"), (199, 5, "n5"), (199, 5, "n5"), (0, 9, "n9"), (None, 1, "n1"), (4, None, None)], "book_id long, author_id long, name string")
        missing = ST.missing_links(stored, fresh, "author_id")
        right = plan(missing).split("stored_key")[-1]
        assert "Exchange" not in right and plan(missing).count("Exchange hashpartitioning") <= 2
        assert sorted(map(tuple, missing.collect())) == [(0, 9, "n9"), (199, 5, "n5")]
        by_id = ST.missing_links(spark.table("st_of_author"), fresh, "author_id", "author_id")
        assert "Exchange" not in plan(by_id).split("stored_key")[-1] and sorted(map(tuple, by_id.collect())) == [(0, 9, "n9"), (199, 5, "n5")]
        # ids and hits are exchanged, stored tables are not
        of = B.books_of(own, spark.table("st_of_author"), spark.createDataFrame([(3,), (99,)], "author_id long"), "author_id")
        assert plan(of).count("Exchange hashpartitioning(author_id") == plan(of).count("Exchange hashpartitioning(book_id") == 1
        assert {r.book_id for r in of.collect()} == {i for i in range(150) if i % 11 == 3}
        recent = own.where("added >= date'2012-01-01'")
        assert recent.count() == len([i for i in range(200) if i % 7 and i % 3 == 2])
        assert "PartitionFilters: [isnotnull(added" in plan(recent)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_append_is_idempotent_and_files_open_again(spark, tmp_path):
    books = spark.createDataFrame([(1, "a", None)], "book_id long, title string, added_at timestamp")
    links = spark.createDataFrame([(1, 2, "x")], "book_id long, author_id long, name string")
    ST.store_catalog(books, {"l": links}, "s2", str(tmp_path), 2)
    fresh = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (8, 3, "y")], "book_id long, author_id long, name string")
    for _ in range(2):
        ST.append_links(fresh, "l", "author_id", "s2", str(tmp_path), 2)
    want = [(1, 2, "x"), (1, 3, "y"), (8, 3, "y")]
    assert sorted(map(tuple, spark.table("s2_l").collect())) == want
    ST.open_catalog(spark, ["books", "l"], "s3", str(tmp_path), 2)
    assert sorted(map(tuple, spark.table("s3_l").collect())) == want and spark.table("s3_books").count() == 1
    assert "Exchange" not in plan(ST.names_of_books(spark.table("s3_l"), "author_id", "name", "author"))
    ST.store_catalog(books.limit(0), {"l": links.limit(0)}, "s4", str(tmp_path / "e"), 2)
    assert spark.table("s4_books").count() == 0 and ST.names_of_books(spark.table("s4_l"), "author_id", "name", "a").count() == 0


def test_buckets_follow_the_links(spark, monkeypatch):
    monkeypatch.setattr(ST, "BUCKET_ROWS", 10)
    assert [ST.buckets_for(spark.range(n), 8) for n in (0, 80, 81, 1000)] == [8, 8, 16, 128]
