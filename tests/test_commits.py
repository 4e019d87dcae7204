import pytest

from foliospark.streaming import commits

SCHEMA = "source string, member string, line_no long, title string, series string, series_no long, file_name string, zip string, format string, file_size long, language string, del int, authors array<string>, genres array<string>"


def record(i, title, file, authors, genres, series=None, source="s"):
    return (source, "m", i, title, series, 1, file, "a.zip", "fb2", 10, "en", 0, authors, genres)


def state(spark, path):
    t = commits.read_catalog(spark, path)
    return {n: sorted((tuple(r) for r in df.collect()), key=repr) for n, df in t.items()}


def test_batches_are_merged_once_and_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    merge = commits.merge_all(path, "2024-01-01 00:00:00")
    assert state(spark, path) == {n: [] for n in commits.SCHEMAS}
    first = spark.createDataFrame([record(1, "T1", "f1", ["A", "B"], ["g"], "S"), record(2, "T2", "f2", ["B"], [])], SCHEMA)
    merge(first, 0)
    one = state(spark, path)
    assert [r[:2] for r in one["books"]] == [(1, "T1"), (2, "T2")] and one["authors"] == [(1, "A"), (2, "B")] and one["book_authors"] == [(1, 1), (1, 2), (2, 2)]
    merge(first, 0)
    assert state(spark, path) == one
    # links of stored books are added to, their rows stay as they are; a repeated book takes the links of all its records
    second = spark.createDataFrame([record(1, "T1", "f1", ["C"], ["h"], "S2"), record(2, "T3", "f3", ["A"], ["g"]), record(3, "T3", "f3", ["D"], None)], SCHEMA)
    merge(second, 1)
    two = state(spark, path)
    assert [r[:3] for r in two["books"]] == [(1, "T1", "S"), (2, "T2", None), (3, "T3", None)] and two["authors"] == [(1, "A"), (2, "B"), (3, "C"), (4, "D")]
    assert two["book_authors"] == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 1), (3, 4)] and two["book_genres"] == [(1, 1), (1, 2), (3, 1)] and two["series"] == [(1, "S"), (2, "S2")]
    assert [r[:2] for r in two["log"]] == [("s", 2), ("s", 3)]
    for number, batch in ((0, first), (1, second)):
        merge(batch, number)
        assert state(spark, path) == two

    # a batch that dies before its manifest row leaves nothing to be seen, and comes again whole
    third = spark.createDataFrame([record(1, "T4", "f4", ["E"], ["g"])], SCHEMA)
    made = commits.SCHEMAS
    monkeypatch.setattr(commits, "SCHEMAS", made | {"missing": "x long"})
    with pytest.raises(KeyError):
        commits.commit(spark, path, 2, commits.additions(third, _stored(spark, path, made), "2024-01-01"))
    monkeypatch.setattr(commits, "SCHEMAS", made)
    assert state(spark, path) == two
    merge(third, 2)
    three = state(spark, path)
    assert [r[:2] for r in three["books"]][-1] == (4, "T4") and three["authors"][-1] == (5, "E")

    commits.compact(spark, path)
    assert state(spark, path) == three and commits.read_catalog(spark, path)["books"].inputFiles()[0].count("2-") >= 1
    merge(third, 2)
    assert state(spark, path) == three
    merge(spark.createDataFrame([record(1, "T5", "f5", ["A"], ["g"])], SCHEMA), 3)
    four = state(spark, path)
    assert [r[:2] for r in four["books"]][-1] == (5, "T5") and len(four["books"]) == 5 and len(four["authors"]) == 5


def _stored(spark, path, schemas):
    """The catalog as it was read before SCHEMAS was changed."""
    rows = commits.manifest(spark, path).collect()
    return {n: spark.read.schema(s).parquet(*(f"{path}/data/{r.folder}/{n}" for r in rows)) for n, s in schemas.items()}


def test_an_empty_batch_is_a_commit(spark, tmp_path):
    path = str(tmp_path / "c")
    commits.merge_all(path, "2024-01-01")(spark.createDataFrame([], SCHEMA), 7)
    assert state(spark, path) == {n: [] for n in commits.SCHEMAS} and [r.batch for r in commits.manifest(spark, path).collect()] == [7]
