"""URL filters against rules and a classifier written out."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from redgreen.llm import urls
from redgreen.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(host, path):
    best = None
    for verdict, rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best or (None, None)


PAGES = [
    (1, "http://a.example.net/en/1", "<p>alpha beta alpha</p>"), (2, "http://EXAMPLE.net/de/x?y#z", "<b>alpha</b>beta"),
    (3, "https://x.example.com/de/", None), (4, "https://x.example.com/fr/alpha", ""), (5, "ftp://site.org/fr/", "gamma"),
    (6, "notexample.net/en/", "x"), (7, None, "<script>var alpha</script>word"), (None, "http://alphabeta.com/9", "<style>q</style>"),
    (8, "http://net", "a"), (9, "http://net/", "a"), (9, "http://net/", "a"), (10, "x://É.ÄB.net/p", "é"), (11, "://", ""), (12, "http://alphabeta.com", None),
    (13, "http://" + "ab" * 3000 + ".org/fr/", "ab"), (14, "http://www.betagamma.info/alpha/77/beta.html", "<p>beta"),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(*p, "clash", "c") for p in PAGES], "page_id bigint, url string, html string, host string, URL string")
    return urls.judge(df, URL_RULES)


def test_hosts_paths_and_rules(judged):
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in judged.collect()), key=str)
    assert got == sorted(((i, *parts(u), rule_of(*parts(u))[1]) for i, u, _ in PAGES), key=str)
    ruled = {(r.rule, r.verdict) for r in judged.collect() if r.rule}
    assert ruled <= {(b, a) for a, b in URL_RULES} and len(ruled) == 4


def visible(html):
    text = re.sub(r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html or "").lower()
    return [w for w in re.split(r"[^a-zäé]+", text) if 0 < len(w) <= urls.LONGEST_WORD]


def weight(cut, counts, total):
    return sum(math.log(counts[w] / (total + 1)) if w in counts else -math.log(total + 1) - len(w) * math.log(10) for w in cut)


def test_segmentation_is_the_likeliest():
    counts, total = {"ab": 5, "abc": 2, "c": 9, "cd": 3, "d": 1, "bcd": 4}, 30
    for host in ["abcd", "abcdabcd", "xabcx", "a", "cdcdcd", "xyzab"]:
        arcs = [(i, j - i, counts[host[i:j]]) for i in range(len(host)) for j in range(i + 1, len(host) + 1) if host[i:j] in counts]
        best = max(
            weight([host[a:b] for a, b in zip((0, *c), (*c, len(host)))], counts, total)
            for n in range(len(host)) for c in combinations(range(1, len(host)), n)
        )
        words = urls.best_words(host, arcs, total)
        assert "".join(words) == host and weight(words, counts, total) == pytest.approx(best)
    assert urls.best_words("ab.cd-ab", [(0, 2, 5), (3, 2, 3), (6, 2, 5)], total) == ["ab", "cd", "ab"]
    assert urls.best_words("", [], 0) == []


def test_verdicts_are_those_of_naive_bayes(spark, judged):
    """The whole model again, with the engine's hash for the slots only."""
    counts = Counter(w for _, _, h in PAGES for w in visible(h))
    total = sum(counts.values())

    def tokens(host, path):
        arcs = [(i, n, counts[host[i : i + n]]) for i in range(len(host)) for n in range(1, urls.LONGEST_WORD + 1) if i + n <= len(host) and host[i : i + n] in counts]
        words = urls.best_words(host, arcs, total)
        path = [t for t in re.split(r"[^a-z0-9äéöü]+", path.lower()) if t]
        return ["h:" + w for w in words] + ["p:" + (f"#{len(t)}" if t.isdigit() else t) for t in path]

    rows = [(parts(u), rule_of(*parts(u))) for _, u, _ in PAGES]
    texts = sorted({t for (h, p), _ in rows for t in tokens(h, p)})
    slots = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(urls.SLOTS)).alias("s")).collect()}
    b, a = np.ones(urls.SLOTS), np.ones(urls.SLOTS)
    for (h, p), (verdict, _) in rows:
        if verdict:
            for t in tokens(h, p):
                (b if verdict == "block" else a)[slots[t]] += 1
    odds = np.log(b / b.sum()) - np.log(a / a.sum())
    prior = math.log((sum(v[0] == "block" for _, v in rows) + 1) / (sum(v[0] == "allow" for _, v in rows) + 1))
    want = sorted(((i, v[0] or ("block" if sum(odds[slots[t]] for t in tokens(h, p)) + prior > 0 else "allow")) for (i, _, _), ((h, p), v) in zip(PAGES, rows)), key=str)
    assert sorted(((r.page_id, r.verdict) for r in judged.collect()), key=str) == want


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.judge(empty, URL_RULES).isEmpty()
    nulls = spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string")
    assert [tuple(r) for r in urls.judge(nulls, URL_RULES).collect()] == [(None, "", "", None, "allow")]
