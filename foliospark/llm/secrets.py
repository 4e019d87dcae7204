"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query (regex_trigrams). The index holds a posting
(trigram, row key) for each trigram that some rule names; it is intersected per row key, and only rows
that a rule's query selects are searched with that rule. Rules without a mandatory trigram scan every row.
The main path is DataFrame functions only.

Defined results: a null text is the empty text and has no spans; matches are leftmost and do not overlap
within a rule; offsets count code points, the end is exclusive; rows repeated with the same id and text each get their own
result row; ids may be null or repeated; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import table
from foliospark.llm.regex_trigrams import Query, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts; least: that length at least, checked after matching."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: A run of [0-9a-f]+ is maximal, so {24,} finds the runs of 24 and more and no others.
BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: What follows the first line of a key: all up to its END line, with no other line of five dashes between; where that is missing, header
#: fields, lines (or parts between written-out line ends) of 16 and more base64 letters, and a shorter last line. Possessive loops need no stack.
KEY_BODY = (
    "(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    "|(?:[ \\t\\r\\n]++(?:Proc-Type|DEK-Info):[^\\r\\n]*+)*+(?:(?:[ \\t\\r\\n]|\\\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)++(?:(?:[\\r\\n]|\\\\[nr])++[A-Za-z0-9+/]{1,15}+={0,2}+(?![^\\r\\n\\\\\"']))?+)?+"
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + KEY_BODY),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)


def trigram_index(rows: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """(trigram, key): the postings of the given trigrams over lower-cased texts."""
    lowered = rows.select(key, F.lower(text).alias("lowered"))
    present = F.array_compact(F.array(*(F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams)))
    return lowered.select(F.explode(present).alias("trigram"), key)


def _selected(query: Query, grams: Column) -> Column:
    plain = [x for x in query[1] if isinstance(x, str)]
    wanted = F.array(*map(F.lit, sorted(plain)))
    nested = [_selected(x, grams) for x in query[1] if not isinstance(x, str)]
    if query[0] == "and":
        parts = [F.size(F.array_except(wanted, grams)) == 0] * bool(plain) + nested
        return _fold(parts, lambda a, b: a & b)
    parts = [F.arrays_overlap(wanted, grams)] * bool(plain) + nested
    return _fold(parts, lambda a, b: a | b)


def _fold(parts: list[Column], f) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = f(out, x)
    return out


def candidates(index: DataFrame, key: str, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules that the postings of a key allow; the trigrams of a key are as many as the rules name."""
    grams = F.collect_set("trigram")
    kinds = F.array_compact(F.array(*(F.when(_selected(q, F.col("grams")), F.lit(k)) for k, q in queries.items())))
    return index.groupBy(key).agg(grams.alias("grams")).select(key, kinds.alias("kinds")).where(F.size("kinds") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per row of docs: (row, text, found), row the struct of its columns, found an array of (start, rank, kind, end) in order of start and rule."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    narrowed = {k: q for k, q in queries.items() if q is not True}
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("row_key"))
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    if narrowed:
        grams = sorted(set().union(*map(trigrams, narrowed.values())))
        wanted = candidates(trigram_index(rows.select("row_key", text.alias("text")), "row_key", "text", grams), "row_key", narrowed)
        rows = rows.join(wanted, "row_key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    matches = [_matches(r, rank, queries[r.kind] is True) for rank, r in enumerate(rules)]
    found = F.array_sort(F.filter(F.concat(*matches), lambda m: m["end"] > 0))
    return rows.withColumn("text", text).select("row", "text", found.alias("found"))


def masked(found: DataFrame, mask: str) -> DataFrame:
    """found with masked_text: every span, and overlapping ones as one, gives way to the mask."""
    piece = lambda start, end: F.substr("text", (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, m: Column) -> Column:
        apart = F.concat(acc["done"], piece(acc["at"], m["start"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(m["start"] >= acc["at"], apart).otherwise(acc["done"]).alias("done"))

    done = F.aggregate("found", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")), step)
    whole = F.concat(done["done"], piece(done["at"], F.length("text").cast("long")))
    return found.withColumn("masked_text", F.when(F.size("found") > 0, whole).otherwise(F.col("text")))


def _matches(rule: Rule, rank: int, everywhere: bool) -> Column:
    """Spans of one rule as structs; end 0 marks a match that fails the rule's length.

    split() gives the pieces between the matches, so the running lengths of pieces and matches are the offsets.
    """
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")
    regex = F.lit(rule.regex)
    pieces, whole = F.split("text", rule.regex, -1), F.regexp_extract_all("text", regex, F.lit(0))
    judged = F.regexp_extract_all("text", regex, F.lit(rule.group)) if rule.group else whole
    each = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("match"), judged.alias("judged"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        good = F.length(x["judged"]) >= rule.least
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(each, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step)["spans"]
    hit = F.rlike("text", regex) if everywhere else F.array_contains("kinds", rule.kind)
    return F.when(F.coalesce(hit, F.lit(False)), spans).otherwise(none)


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda m: m["rank"] < len(kinds))
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, kinds), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))
