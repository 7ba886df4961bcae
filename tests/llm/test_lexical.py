"""Ranked search against a score of every document."""

import math
import re
from collections import Counter

from redgreen.llm import lexical

from made import prose


def brute(documents, items, k):
    def terms(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    tfs = [(i, Counter(terms(t))) for i, t in documents]
    n = sum(1 for _, tf in tfs if tf)
    total = sum(tf.total() for _, tf in tfs)
    out = []
    for item, text in items:
        scores = []
        for i, tf in tfs:
            m = 10 + 90 * tf.total() * n // total if total else 0
            score = 0
            for t in set(terms(text)):
                df = sum(1 for _, other in tfs if t in other)
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_a_score_of_every_document(spark, odd_documents):
    documents = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    documents += [(100 + i, prose(100 + i, 5 + i * 3) + " Word" * (i % 40)) for i in range(200)]
    items = [(i, prose(100 + 7 * i, 12)) for i in range(12)] + [(12, None), (13, ""), (14, "漢字 DON t"), (15, "nowhere"), (3, "one x"), (None, "word")]
    left = spark.createDataFrame([(*d, "clash") for d in documents], "doc_id bigint, text string, TEXT string").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, score int")
    assert rows(lexical.search(left, right, k=10)) == brute(documents, items, 10)


def test_queries_in_several_blocks(spark, monkeypatch):
    documents = [(i, prose(i, 40)) for i in range(60)]
    items = [(i, prose(i, 8)) for i in range(9)]
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 4)
    monkeypatch.setattr(lexical, "TERM_BLOCK", 5)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    left, right = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(lexical.search(left, right, k=3)) == brute(documents, items, 3)


def test_empty_tables(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert lexical.search(no_documents, items).isEmpty()
    assert lexical.search(odd_documents, items.limit(0)).isEmpty()
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), items).isEmpty()


def test_bounds_never_fall_below_scores_and_exclude_most():
    texts = [prose(i, 30 + i % 50) for i in range(400)]
    tfs = [Counter(lexical.terms_of(t)) for t in texts]
    total = sum(tf.total() for tf in tfs)
    df = Counter(t for tf in tfs for t in tf)
    weights = {t: lexical.term_weight(n, len(texts)) for t, n in df.items()}
    asked = [sorted(set(lexical.terms_of(prose(7, 20))))]
    memory = lexical.Memory()
    entries = [(memory.of(list(tf)), __import__("numpy").array(list(tf.values()))) for tf in tfs]
    bounds = lexical.Queries(asked, weights, len(texts), total).bounds(
        11, [tf.total() for tf in tfs], [max(tf.values()) for tf in tfs], lexical.block_of(entries, 11)
    )[0]
    scores = [
        sum(weights[t] * lexical.occurrence_weight(tf[t], lexical.length_factor(tf.total(), len(texts), total)) for t in asked[0] if tf[t]) for tf in tfs
    ]
    assert all(b >= s for b, s in zip(bounds, scores))
    tenth = sorted(scores)[-10]
    assert sum(b >= tenth for b in bounds) < 60
