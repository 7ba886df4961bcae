"""Mixing: budgets worked out by hand, properties, and the SQL on odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from redgreen.llm import mixing
from redgreen.llm.oracle import ORACLE
from redgreen.llm.queries import mixture_weights, source_domain


def plan(spark, leaves, fraction, max_epochs=1, weights=None):
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    ones = [F.lit(1), F.lit(1), F.lit(1)]
    rows = mixing.plan(df, weights or ones, fraction, max_epochs).collect()
    return {(r.domain, r.lang, r.source): r.budget for r in rows}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 90), ("a", "y", "3", 100), ("b", "z", "4", 800)]
    # 200 tokens: 100 for each domain, 50 for each language of a; leaf 1 lacks 15, which its sibling takes.
    assert plan(spark, leaves, 0.2) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "z", "4"): 100}
    # 600: a can hold 200 of its 300; only then does b get more.
    assert plan(spark, leaves, 0.6) == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "z", "4"): 400}
    assert sum(plan(spark, leaves, 1.0).values()) == 1000
    assert sum(plan(spark, leaves, 5.0, 2).values()) == 2000  # all epochs of everything


def test_weights(spark):
    leaves = [("a", "x", str(i), 1000) for i in range(3)]
    weights = [F.lit(1), F.lit(1), F.when(F.col("source") == "0", 2).when(F.col("source") == "1", 1).otherwise(0)]
    assert plan(spark, leaves, 0.2, 1, weights) == {("a", "x", "0"): 400, ("a", "x", "1"): 200}


def test_a_leaf_is_a_prefix_of_its_order(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 20), "en", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    tokens = mixing.word_tokens(F.col("text"))
    total = sum(len(t.split()) for _, t, _, _ in rows)
    for fraction, whole in ((0.4, 0), (1.3, 1), (2.5, 2)):
        got = mixing.mixture(df, F.lit("d"), tokens, [F.lit(1)] * 3, fraction, 3).collect()
        budget = int(total * fraction)
        spent = sum(x.n_tokens for x in got)
        assert budget - 20 < spent <= budget and {x.leaf_budget for x in got} == {budget}
        for e in range(whole):
            assert sum(x.epoch == e for x in got) == 500
    again = mixing.mixture(df.repartition(7), F.lit("d"), tokens, [F.lit(1)] * 3, 2.5, 3).collect()
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("leaves", [mixing.BROADCAST_LEAVES, 0])
def test_odd_rows_equal_sql(spark, odd_documents, no_documents, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    got = mixing.mixture(odd_documents, source_domain(), mixing.word_tokens(F.col("text")), mixture_weights(), 0.6, 2)
    con = duckdb.connect()
    con.register("documents", odd_documents.toDF(*[str(i) for i in range(10)]).selectExpr("`0` doc_id", "`1` text", "`2` lang", "`3` source").toArrow())
    names = [c for c in got.columns]
    want = con.execute(f"select {', '.join(names)} from ({ORACLE['op5_mixing']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    empty = mixing.mixture(no_documents, source_domain(), mixing.word_tokens(F.col("text")), mixture_weights(), 0.6, 2)
    assert empty.isEmpty()


def test_only_built_in_functions(spark, odd_documents):
    got = mixing.mixture(odd_documents, source_domain(), mixing.word_tokens(F.col("text")), mixture_weights(), 0.6, 2)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
