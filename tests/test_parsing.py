"""Lines are split and their authors parsed once, whatever is asked of the records."""

import random
import re

from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import ingest


def test_a_filter_on_fields_does_not_split_lines_again(spark):
    lines = spark.createDataFrame([("s", "m", 0, "Doe,Jane:\x04sf:\x04T\x04\x04\x04f\x04\x04\x040\x04fb2\x04\x04\x04a.zip\x04en\x04\x04")], "source string, member string, line_no long, line string")
    found = ingest.valid_records(ingest.parse_records(lines))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(line") == 1
    assert [(r.title, r.authors, r.genres, r.folder) for r in found.collect()] == [("T", ["Doe Jane"], ["sf"], "a.zip")]


def test_authors_are_parsed_as_name_by_name(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "B", " ", "  ", ",", ":", "\t", "\xa0", " ", "\n", "é", "\x1f"], k=rng.randint(0, 14))) for _ in range(400)]
    space = "[\t-\r \x85\xa0  -     　]+"

    def squeeze(s):
        return re.sub(space, " ", s).strip(" ")

    def parse(s):
        names = [squeeze(" ".join(p for p in map(squeeze, x.split(",")) if p)) for x in s.split(":")]
        return [n for n in names if n] or [X.UNKNOWN_AUTHOR]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.parse_authors("t").alias("authors"), X.squeezed("t").alias("squeezed"), X.trimmed("t").alias("trimmed")).collect()
    for r in rows:
        assert r.authors == parse(r.t)
        assert r.squeezed == squeeze(r.t)
        assert r.trimmed == re.sub(f"^{space}|{space}$", "", r.t)
    assert spark.range(1).select(F.size(X.parse_authors(F.lit(None).cast("string")))).first()[0] == 1
