"""URL filters: rules on host and path first, then a text classifier on segmented host names.

Host labels are split into words by a unigram Viterbi whose counts come from every word of the pages' own
texts; a multinomial naive Bayes over host words and path tokens judges the urls that no rule fits. Urls that a rule blocks, and
unruled ones with a seed word in their host, teach it what to block; those that a rule allows and all other unruled ones stand for what to allow.
Labels and path words that any rule tests are no features: they tell which rule would fit, and nothing of the urls that none fits. Both classes weigh the same, whatever
their sizes, a token without counts changes nothing, and a url is blocked where the odds are over MARGIN. All counts are Spark aggregations, and
scoring joins tokens with their counts; frequent keys of a join (at most HOT of them, as each has over 1 / HOT of its rows) meet broadcast rows, so no task
takes a larger share. Only the split of one label, given the counts of its substrings, runs in Python.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is judged by the method; repeated
rows each get a row; where the odds are at the margin, or one class has no tokens, the url is allowed; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, table, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host words that mark an unruled url as a training case of the class block.
SEED_WORDS = ("adult", "bet", "casino", "cheap", "farm", "pills", "porn", "spam", "viagra", "xxx")
#: The longest DNS label; longer ones are split into stretches of this length first.
LABEL = 63
#: Share of all words that a seed word counts for at least, so that it is found in a name even if no text holds it.
SEED_SHARE = 1e-4
#: Log odds from which a url is blocked, and the occurrences that each token is given beforehand, shared by the classes as all tokens are.
MARGIN, SMOOTH = math.log(20), 4.0
#: Keys with over 1 / HOT of a join's rows are joined by broadcast.
HOT = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over whole texts with their markup taken out: lower-cased runs of letters and digits; those longer than a label can't be part of one."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "<[^<>]*>", " "))
    found = texts.select(F.explode(F.regexp_extract_all(plain, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("word"))
    return found.where(F.length("word") <= LABEL).groupBy("word").agg(F.count("*").alias("n"))


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Unigram Viterbi; an unseen word of k letters has the probability 10 / (total * 10**k)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(end):
            n = counts.get(label[start:end], 0)
            cost = math.log(total / n) if n else math.log(total) + (end - start - 1) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented_labels(labels: DataFrame, counts: DataFrame, total: int, seeds: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """(label, words) of distinct labels that are not empty: each label's substrings meet the word counts in an equi-join."""
    spans = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start"))
    spans = spans.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - F.col("start") + 1), lambda k: F.substr("label", F.col("start"), k))).alias("word"))
    seeded = spans.sparkSession.createDataFrame([(w, max(1, int(total * SEED_SHARE))) for w in seeds], "word string, n long")
    known = counts.unionByName(seeded).groupBy("word").agg(F.max("n").alias("n"))
    hits = looked_up(spans.distinct(), known, "word").select("label", "word", "n")
    found = labels.select("label", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n")).unionByName(hits)
    grouped = found.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [segment(label, {x["word"]: x["n"] for x in known if x["word"]}, max(total, 1) + 1) for label, known in zip(b["label"], b["known"])]
            yield pd.DataFrame({"label": b["label"], "words": words})

    return grouped.mapInPandas(split, "label string, words array<string>")


def looked_up(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """rows joined with by_key, which has one row per key; rows of frequent keys stay where they are."""
    often = written(rows.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") * HOT > rows.count()).select(key))
    few = by_key.join(F.broadcast(often), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(often), key, "left_anti").join(by_key, key))


def tested_words(rules) -> list[str]:
    """Host labels and path words that a rule tests."""
    return sorted({w for _, h, p in rules for w in re.split(r"[\W_]+", f"{h}/{p.lower()}") if w})


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES,
    seeds: tuple[str, ...] = SEED_WORDS, margin: float = MARGIN, held_out: Column | None = None,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (log odds of block; null where a rule decides), seeded (a seed word is in the host).

    held_out, a condition on host and path, keeps urls out of the training of the classifier.
    """
    counts = written(word_counts(pages, text_col))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    tested = tested_words(rules)
    parts = lambda name: F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda x: (x != "") & ~x.isin(tested))
    labels = F.flatten(F.transform(parts("host"), lambda x: F.regexp_extract_all(x, F.lit(f".{{1,{LABEL}}}"), F.lit(0))))
    path_words = F.filter(parts("path"), lambda x: F.rlike(x, F.lit("\\p{L}")))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("train", F.lit(True) if held_out is None else ~held_out)
    urls = written(urls.select(F.struct("host", "path").alias("url_key"), "n", "fit", "train", labels.alias("labels"), path_words.alias("path_words")))
    named = urls.select("url_key", F.explode("labels").alias("label"))
    split = written(segmented_labels(named.select("label").distinct(), counts, total, seeds))
    host_words = looked_up(named, split, "label").select("url_key", F.explode("words").alias("word"))
    host_tokens = host_words.select("url_key", F.concat(F.lit("host:"), "word").alias("token"), F.col("word").isin(*seeds).alias("seed"))
    path_tokens = urls.select("url_key", F.explode("path_words").alias("word")).select("url_key", F.concat(F.lit("path:"), "word").alias("token"), F.lit(False).alias("seed"))
    tokens = written(host_tokens.unionByName(path_tokens))
    seeded = tokens.groupBy("url_key").agg(F.max("seed").alias("seeded"))
    urls = urls.join(seeded, "url_key", "left").select("url_key", "n", "fit", "train", F.coalesce("seeded", F.lit(False)).alias("seeded"))
    urls = written(urls.withColumn("label", F.coalesce("fit.verdict", F.when(F.col("seeded"), F.lit("block")).otherwise(F.lit("allow")))))
    weight = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(k)
    seen = written(tokens.join(urls.where("train").select("url_key", "n", "label"), "url_key").groupBy("token").agg(weight("block"), weight("allow")))
    sums = seen.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("block", "allow"))).first()
    everything = max(1, sums["block"] + sums["allow"])
    log_share = lambda k: F.log((F.col(k) + SMOOTH * sums[k] / everything) / F.lit(float(max(1, sums[k]))))
    odds = log_share("block") - log_share("allow") if sums["block"] and sums["allow"] else F.lit(0.0)
    unruled = tokens.join(urls.where("fit is null").select("url_key"), "url_key", "left_semi").select("url_key", "token")
    scores = looked_up(unruled, seen.select("token", odds.alias("odds")), "token").groupBy("url_key").agg(F.sum("odds").alias("odds"))
    score = F.when(F.col("fit").isNull(), F.round(F.coalesce("odds", F.lit(0.0)), 9))
    judged = urls.join(scores, "url_key", "left").select("url_key", F.col("fit.rule").alias("rule"), "fit", score.alias("score"), "seeded")
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > margin, F.lit("block")).otherwise(F.lit("allow")))
    out = looked_up(rows.select("page_id", F.struct("host", "path").alias("url_key")), judged, "url_key")
    return out.select("page_id", "url_key.host", "url_key.path", "rule", verdict.alias("verdict"), "score", "seeded")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
