"""Mixing sources to target weights, with DataFrame functions only.

Sources are the leaves of a tree domain - language - source. A token budget
goes down the tree by weight. A node can take at most what its leaves hold over
``max_epochs`` epochs; what it cannot take goes to its siblings by their
weights, and only what all children of a parent cannot take is left to the
parent's own siblings. A leaf's budget is spent in epochs: whole ones first,
then the longest prefix, in the epoch's seeded order, whose tokens fit.

The tree has one row per leaf. Documents are never sorted as a whole: order
keys fall into buckets, the bucket in which a leaf's budget ends is found from
sums, and only that bucket's documents are lined up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redgreen.llm.support import durable, pick, reread

WORD = r"[^\x20\x09-\x0D]+"
# Leaves up to this number are sent to all tasks; more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
# Leading hexadecimal digits of the order key: 4096 buckets for a leaf.
BUCKET_DIGITS = 3
TREE = ["domain", "lang", "source"]


def word_tokens(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str, budget: str, capacity: str, weight: str) -> DataFrame:
    """Add ``allotted``: a parent's ``budget`` dealt to its children by ``weight``, none above its ``capacity``.

    Children are taken in ascending order of capacity by weight: as long as a
    child's fair part of what is left reaches its capacity it gets that, and
    the others share the rest by weight. Children without weight get nothing.
    """
    fair = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = fair.orderBy("_ratio", name)
    cap, w = F.col(capacity).cast("double"), F.col(weight).cast("double")
    some = children.where(w > 0).withColumn("_ratio", cap / w)
    some = some.withColumn("_before", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    some = some.withColumn("_weights", F.sum(w).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    left = F.col(budget) - F.col("_before")
    some = some.withColumn("_full", cap * F.col("_weights") <= left * w)
    some = some.withColumn("_level", F.max(F.when(~F.col("_full"), left / F.col("_weights"))).over(fair))
    allotted = F.when(F.col("_full"), cap).otherwise(w * F.col("_level"))
    return some.withColumn("allotted", allotted).drop("_ratio", "_before", "_weights", "_full", "_level")


def plan(leaves: DataFrame, weights: list[Column], fraction: float, max_epochs: int) -> DataFrame:
    """``(domain, lang, source, tokens, budget, whole, rest)`` of every leaf that gets something.

    ``leaves`` is ``(domain, lang, source, tokens)``; ``weights`` has an
    expression over the tree's columns for each level.
    """
    table = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = table.agg(F.floor(F.sum("tokens") * F.lit(float(fraction))).cast("double").alias("budget"))
    level = table.groupBy("domain").agg(F.sum("capacity").alias("capacity")).join(F.broadcast(total))  # one row
    dealt = share_out(level.withColumn("weight", weights[0]), [], "domain", "budget", "capacity", "weight")
    dealt = dealt.select("domain", F.col("allotted").alias("budget"))
    level = table.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(dealt, "domain")
    dealt = share_out(level.withColumn("weight", weights[1]), ["domain"], "lang", "budget", "capacity", "weight")
    dealt = dealt.select("domain", "lang", F.col("allotted").alias("budget"))
    level = table.join(dealt, ["domain", "lang"])
    dealt = share_out(level.withColumn("weight", weights[2]), ["domain", "lang"], "source", "budget", "capacity", "weight")
    dealt = dealt.select(*TREE, "tokens", F.floor("allotted").cast("long").alias("budget")).where("tokens > 0")
    return dealt.select(*TREE, "tokens", "budget", F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order, as hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(
    documents: DataFrame, domain: Column, tokens: Column, weights: list[Column], fraction: float, max_epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The chosen rows with all their columns and ``_tree`` (domain, lang, source, tokens, budget, epoch).

    ``fraction`` of all tokens is the budget. A document comes once for each
    epoch it is chosen in. Null tree columns count as empty names. Rows
    without tokens cost nothing: a whole epoch has all of them, the last one
    those within its prefix. Rows that share an id stand next to each other in the order,
    the shorter first. A leaf whose weight or tokens are zero gives no rows,
    and an empty table none.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    tree = F.struct(F.coalesce(domain, F.lit("")).alias("domain"), name(lang_col).alias("lang"), name(source_col).alias("source"), tokens.alias("tokens"))
    rows = documents.withColumn("_tree", tree)
    leaves = rows.groupBy(*[F.col(f"_tree.{c}").alias(c) for c in TREE]).agg(F.sum("_tree.tokens").alias("tokens"))
    planned = durable(plan(leaves, weights, fraction, max_epochs), "leaves")
    few = planned.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else lambda df: df

    def with_leaf(table: DataFrame) -> DataFrame:
        named = table.select(F.struct(*[F.col(c) for c in TREE]).alias("_leaf"), F.struct(*[c for c in table.columns if c not in TREE]).alias("_plan"))
        return rows.join(small(named), F.struct(*[F.col(f"_tree.{c}") for c in TREE]) == F.col("_leaf")).drop("_leaf")

    key = order_key(seed, F.col("_plan.whole"), F.col(f"`{id_col}`"))
    bucketed = with_leaf(planned).select("_tree", F.col("_plan.rest").alias("rest"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket"))
    sums = bucketed.groupBy(*[F.col(f"_tree.{c}").alias(c) for c in TREE], "bucket").agg(F.sum("_tree.tokens").alias("n"), F.max("rest").alias("rest"))
    # 4096 rows for a leaf at most.
    line = Window.partitionBy(*TREE).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(line)).where("upto > rest").groupBy(*TREE).agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end")
    )
    ended = planned.join(ends, TREE, "left").select(
        *TREE, F.col("budget"), "whole", "rest", F.coalesce("end.bucket", F.lit("g")).alias("bucket"), F.coalesce("end.before", F.lit(0)).alias("before")
    )
    ended = durable(ended, "ends")
    met = with_leaf(ended).withColumn("_key", order_key(seed, F.col("_plan.whole"), F.col(f"`{id_col}`")))
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    last = F.when(bucket < F.col("_plan.bucket"), 1).otherwise(0)
    epochs = F.sequence(F.lit(0).cast("long"), F.col("_plan.whole") + last - 1)
    sure = met.withColumn("_epoch", F.explode(F.when(F.col("_plan.whole") + last > 0, epochs)))
    # Documents at the place where a leaf's budget ends: a bucket of each leaf.
    edge = met.where(bucket == F.col("_plan.bucket"))
    order = Window.partitionBy(*[F.col(f"_tree.{c}") for c in TREE]).orderBy("_key", F.col(f"`{id_col}`"), "_tree.tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.sum("_tree.tokens").over(order) + F.col("_plan.before"))
    edge = edge.where(F.col("_upto") <= F.col("_plan.rest")).withColumn("_epoch", F.col("_plan.whole")).drop("_upto")
    both = sure.unionByName(edge)
    done = F.struct(*[F.col(f"_tree.{c}") for c in TREE], "_tree.tokens", F.col("_plan.budget").alias("budget"), F.col("_epoch").alias("epoch"))
    return both.withColumn("_tree", done).drop("_plan", "_key", "_epoch")


def mixture(documents: DataFrame, domain: Column, tokens: Column, weights: list[Column], fraction: float, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """``(doc_id, domain, lang, source, epoch, n_tokens, leaf_budget)`` of the chosen rows, without texts."""
    rows = pick(documents, doc_id="doc_id", text="text", lang="lang", source="source")
    counted = durable(rows.select("doc_id", "lang", "source", tokens.alias("n")), "tokens")
    chosen = mix(reread(counted), domain, F.col("n"), weights, fraction, max_epochs, seed)
    return chosen.select(
        "doc_id", "_tree.domain", "_tree.lang", "_tree.source", "_tree.epoch", F.col("_tree.tokens").alias("n_tokens"), F.col("_tree.budget").alias("leaf_budget")
    )
