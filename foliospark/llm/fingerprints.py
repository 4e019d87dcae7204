"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

The weight of a term (an ASCII-lower-cased word) is its count in the text. For each sample a term draws r and c from
Gamma(2, 1) and beta from U(0, 1), all by hashes of the term and the sample, takes t = floor(ln(weight) / r + beta) and
a = c * exp(r * (1 + beta - t)) (so ln a = ln c - r * (t - beta + 1)), and the term of the smallest a with its t is the sample. Two texts agree in a
sample with the probability of their generalised Jaccard similarity, sum(min) / sum(max) of the weights.
The main path is DataFrame functions only; texts are shuffled once, by ranges of ids, and fingerprints are written as a table.

Defined results: a null text is the empty text, which has the fingerprint of no terms and is like other empty texts alone; documents are in
descending order of id, then text, null ids last, and the document after the last is the first; rows repeated with the same id are
neighbours in that order; in a table of one row the next document is the row itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import SPACES, table, words, written

SAMPLES = 64
#: Samples evaluated for one row of a term; a term has a row per such group, which keeps the generated code small.
GROUP = 4
#: ln a, which the widths of the draws keep above LN_LOW, is held in steps of 2**-24, with CODE_BITS of the sample's code below it.
LN_LOW, LN_STEPS, CODE_BITS = -128.0, 1 << 24, 28
#: Ranges of ids per shuffle partition.
RANGES = 4
NO_ID = -(1 << 63)
#: Spreads t over the bits of a sample's code.
T_FACTOR = 0x9E3779B1


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """In (0, 1), from `width` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def _draws(term: Column, sample: Column) -> tuple[Column, Column, Column]:
    """r, ln c, beta of a term in one sample."""
    one, two = F.xxhash64(term, sample), F.xxhash64(sample, term)
    r = -F.log(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    ln_c = F.log(-F.log(_uniform(two, 0, 21) * _uniform(two, 21, 21)))
    return r, ln_c, _uniform(two, 42, 21)


def _sample(term: Column, ln_weight: Column, draws: tuple[Column, Column, Column]) -> Column:
    """ln a above a code of (term, t) in one long, so that min() finds the sample; null where the weight is 0. The term's own bits are those of a hash."""
    r, ln_c, beta = draws
    t = F.floor(ln_weight / r + beta)
    ln_a = ln_c - r * (t.cast("double") - beta + 1)
    level = ((ln_a - LN_LOW) * LN_STEPS).cast("long")
    return F.shiftleft(level, CODE_BITS).bitwiseOR(term.bitwiseXOR(t * F.lit(T_FACTOR)).bitwiseAND(F.lit((1 << CODE_BITS) - 1)))


def _fingerprint(samples: list[Column]) -> Column:
    codes = [F.lpad(F.hex(s.bitwiseAND(F.lit((1 << CODE_BITS) - 1))), CODE_BITS // 4, "0") for s in samples]
    return F.when(samples[0].isNull(), F.lit("-" * (CODE_BITS // 4 * len(samples)))).otherwise(F.concat(*codes))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    k = CODE_BITS // 4
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substr(a, i * k + 1, F.lit(k)) == F.substr(b, i * k + 1, F.lit(k)))
    return F.size(same) / F.lit(float(samples))


def sampled(rows: DataFrame, keys: list[str], parts: list[tuple[str, tuple[int, ...]]], prints: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and the fingerprints of texts that are given in parts: (column, numbers of the prints whose text it belongs to). No word spans two parts.

    Rows are one per combination of keys. Where they are dealt by a key already, nothing is shuffled. Counts of a term in all texts of a row
    share the term's draws; rows without terms are left out.
    """
    texts = F.array(*(F.struct(F.col(c).alias("text"), *(F.lit(int(i in of)).alias(f"in{i}") for i in range(len(prints)))) for c, of in parts))
    each = rows.select(*keys, F.explode(texts).alias("part")).select(*keys, *(f"part.in{i}" for i in range(len(prints))), F.explode(words(F.col("part.text"))).alias("word"))
    each = each.where(F.col("word") != "").withColumn("term", F.xxhash64("word"))
    terms = each.groupBy(*keys, "term").agg(*(F.sum(f"in{i}").alias(f"weight{i}") for i in range(len(prints))))
    logs = [F.log(F.col(f"weight{i}").cast("double")).alias(f"ln{i}") for i in range(len(prints))]
    groups = samples // GROUP
    spread = terms.select(*keys, "term", *logs, F.explode(F.array(*map(F.lit, range(groups)))).alias("group"))
    mins = []
    for s in range(GROUP):
        draws = _draws(F.col("term"), F.col("group") * GROUP + s)
        mins += [F.min(_sample(F.col("term"), F.col(f"ln{i}"), draws)).alias(f"s{i}_{s}") for i in range(len(prints))]
    parted = spread.groupBy(*keys, "group").agg(*mins)
    whole = parted.groupBy(*keys).agg(*(F.max(F.when(F.col("group") == g, F.col(f"s{i}_{s}"))).alias(f"s{i}_{g * GROUP + s}") for i in range(len(prints)) for g in range(groups) for s in range(GROUP)))
    return whole.select(*keys, *(_fingerprint([F.col(f"s{i}_{s}") for s in range(samples)]).alias(name) for i, name in enumerate(prints)))


def id_ranges(docs: DataFrame, id_col: str, ranges: int) -> Column:
    """The number of the range that an id falls in, by approximate quantiles; found in two steps of about sqrt(ranges) comparisons."""
    marks = [(i + 1) / ranges for i in range(ranges - 1)]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, marks, 10 * ranges)).first()[0] or [])) if marks else []
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    chunks = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col(id_col)))
    tops = F.array(*(F.lit(c[-1]).cast("long") for c in chunks))
    lists = F.array(*(F.array(*(F.lit(x).cast("long") for x in c)) for c in chunks))
    chunk = below(tops)
    return (chunk * k + F.coalesce(below(F.get(lists, chunk)), F.lit(0))).cast("int")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text replaced by the beginning of the next document. Ids are cut into ranges; within a range the next document is
    the next row, and the first document of each range (one row per range) is joined to the range before it: its text, and later its fingerprint, which is
    read from the written fingerprints. Text and edited text share what stands before the last word that the cut could reach, and its words are met once.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("range", id_ranges(rows, "id", RANGES * partitions))
    order = Window.partitionBy("range").orderBy(F.desc("id"), "text")

    highest = rows.groupBy("range").agg(F.max("id").alias("id"))  # one row per range, as is what follows
    down = Window.orderBy(F.desc("range"))
    after = highest.select("range", F.coalesce(F.lead("range").over(down), F.first("range").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    heads = rows.join(F.broadcast(highest), ["range", "id"]).groupBy("range").agg(F.min("text").alias("head"))
    heads = after.join(heads.withColumnRenamed("range", "next"), "next").select("range", "head")

    placed = rows.withColumns({"row": F.row_number().over(order), "lead": F.lead("text").over(order)}).join(heads, "range", "left")
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("lead", "head"), F.lit(1), cut))
    edits = placed.select("range", "row", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), F.regexp_extract(F.substring("text", F.lit(1), n - cut), f"(?s)^.*{SPACES}", 0).alias("shared"))
    rest = {f"{x}_rest": F.substring(F.col(x), F.length("shared") + 1, F.length(x)) for x in ("text", "edited")}
    prints = sampled(edits.withColumns(rest), ["range", "row"], [("shared", (0, 1)), ("text_rest", (0,)), ("edited_rest", (1,))], ["fingerprint", "edited_fingerprint"], samples)

    # the same shuffle of texts once more: what needs no terms
    facts = edits.select("range", "row", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    none = F.lit("-" * (CODE_BITS // 4 * samples))
    found = written(facts.join(prints, ["range", "row"], "left").withColumns({x: F.coalesce(x, none) for x in ("fingerprint", "edited_fingerprint")}))

    following = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("row"))
    firsts = found.where("row = 1").select(F.col("range").alias("next"), F.col("fingerprint").alias("head_print"))
    out = found.withColumn("lead_print", following).join(written(after).join(firsts, "next").select("range", "head_print"), "range", "left")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("lead_print", "head_print"), samples).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
