import math
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from foliospark.llm.url_filter import LABEL, MARGIN, RULES, SEED_SHARE, SEED_WORDS, SMOOTH, judge_urls, op7_url_filter, segment


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([len(path)] + [path.index(c) for c in "?#" if c in path])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_segment_is_the_best_split():
    counts = {"spam": 50, "farm": 40, "a": 900, "spa": 3, "arm": 5, "m": 1}
    assert segment("spamfarm", counts, 1000) == ["spam", "farm"]
    assert segment("", counts, 1000) == []
    assert segment("zzspam", counts, 1000) == ["zz", "spam"]


def test_rules_and_method(spark):
    urls = ["http://A.example.NET/en/x", "https://example.net/fr", "http://x.net", "http://x.net/", "ftp://a.b.example.com/de/?q#f", "http://q.org/fr/1", "org/fr/", None, "", "http://", "http://notnet/x",
            "http://spam-farm.example.org/en/", "http://spamfarm.example.org/en/", "http://good.example.org/en/", "http://x.net/" + "y" * 30_000, "http://" + "z" * 300 + ".info/", "http://q.org/fr/1"]
    rows = [(i, u, "<p>spam farm good words</p>" * 50, "clash") for i, u in enumerate(urls)] + [(None, "http://good.example.org/en/", None, "clash")]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, (rule, verdict) = brute_rule(urls[r.page_id]) if r.page_id is not None else brute_rule("http://good.example.org/en/")
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    by_id = {r.page_id: r for r in out}
    assert by_id[11].score == by_id[12].score > by_id[13].score


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_brute_force_rules(spark, data):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    out = op7_url_filter(spark, data).collect()
    assert sorted(r.page_id for r in out) == sorted(urls)
    for r in out:
        host, path, (rule, verdict) = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    spam = [r for r in out if r.rule is None and "spam" in r.host]
    assert all(r.verdict == "block" for r in spam)


def brute_verdicts(pages, rules=RULES):
    """[(verdict, score, seeded)] of (url, html) rows, all counts in dictionaries."""
    counts = Counter(w for _, html in pages for w in regex.findall(r"[\p{L}\p{N}]+", re.sub("<[^<>]*>", " ", html or "").lower()) if len(w) <= LABEL)
    total = sum(counts.values())
    for w in SEED_WORDS:
        counts[w] = max(counts[w], 1, int(total * SEED_SHARE))
    tested = {w for _, h, p in rules for w in re.split("[./]", h + p) if w}
    urls, rows = {}, []
    for url, _ in pages:
        host, path, (_, verdict) = brute_rule(url)
        labels, words = [[x for x in regex.split(r"[^\p{L}\p{N}]+", part.lower()) if x and x not in tested] for part in (host, path)]
        names = [w for x in labels for i in range(0, len(x), LABEL) for w in segment(x[i : i + LABEL], counts, max(total, 1) + 1)]
        tokens = [f"host:{w}" for w in names] + [f"path:{w}" for w in words if regex.search(r"\p{L}", w)]
        urls[host, path] = (verdict, tokens, any(w in SEED_WORDS for w in names))
        rows.append((host, path))
    seen = {"block": Counter(), "allow": Counter()}
    for key in rows:
        verdict, tokens, seeded = urls[key]
        seen[verdict or ("block" if seeded else "allow")].update(tokens)
    sums = {k: sum(c.values()) for k, c in seen.items()}
    part = lambda k, t: math.log((seen[k][t] + SMOOTH * sums[k] / sum(sums.values())) / sums[k])
    out = []
    for key in rows:
        verdict, tokens, seeded = urls[key]
        score = sum(part("block", t) - part("allow", t) for t in tokens) if all(sums.values()) else 0.0
        out.append((verdict or ("block" if score > MARGIN else "allow"), None if verdict else score, seeded))
    return out


def assert_equals_brute_force(out, pages):
    for r, (verdict, score, seeded) in zip(out, brute_verdicts(pages), strict=True):
        assert (r.verdict, r.seeded) == (verdict, seeded)
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-6)


def test_verdicts_equal_brute_force(spark, data):
    rows = sorted(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect())
    assert_equals_brute_force(sorted(op7_url_filter(spark, data).collect()), [(r.url, r.html) for r in rows])


def test_words_beside_seeds_are_learned_and_rules_teach_nothing_of_their_own_labels(spark):
    """Half of all rows have one url; names hold digits and other alphabets; bigwin has no seed word, but stands beside casino elsewhere."""
    urls = ["http://m.example.org/en/"] * 200 + [f"http://casino-bigwin.x{i}.info/p/{i}" for i in range(300)] + [f"http://site{i}.com/de/news" for i in range(60)]
    urls += [f"http://net{i}.net/fr/" for i in range(40)] + ["http://bigwin.com/", "http://\u0441\u0430\u0439\u0442.com/\u043f\u0443\u0442\u044c", "http://site3.org/de/", "http://plain.com/"]
    html = "<p>casino bigwin site net plain words \u0441\u0430\u0439\u0442 news</p>"
    out = sorted(judge_urls(spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")).collect())
    assert_equals_brute_force(out, [(u, html) for u in urls])
    by_url = {u: r.verdict for u, r in zip(urls, out)}
    assert by_url["http://bigwin.com/"] == "block" and by_url["http://plain.com/"] == by_url["http://site3.org/de/"] == by_url["http://m.example.org/en/"] == "allow"


def test_held_out_urls(spark):
    """Urls kept out of the training are judged as their host words say; verdicts differ within one top-level domain."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = F.pmod(F.crc32(F.concat_ws(" ", "host", "path").cast("binary")), F.lit(3)) == 1
    unruled = judge_urls(pages, held_out=held).withColumn("held", held).where("rule is null").collect()
    for part in (True, False):
        right = [(r.verdict == "block") == r.seeded for r in unruled if r.held is part]
        assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    assert {r.verdict for r in unruled if r.host.endswith(".com")} == {"allow", "block"}
