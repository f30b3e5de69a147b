"""Mixing sources to target shares of all tokens.

Every document of a source is due ``target tokens / tokens of the source`` copies, at most the source's ``max_repeat``.
The whole part is certain. What is left is drawn by Pareto order sampling: a document's inclusion probability ``p`` grows
with its tokens (``p = tokens left * n / sum of n^2`` over the source, so that the tokens expected are those left; 1 at most,
which is certain), its rank is ``(u / (1 - u)) / (p / (1 - p))`` of a seeded random ``u``, and documents are taken in that
order. The sample has a fixed size: the source's remaining tokens, the last document only if that comes nearer, so the
shares do not wander with the draw.

The order is found by buckets of rank, about ``BUCKET_DOCUMENTS`` documents each: token sums per bucket are added up
first, and only documents within the same bucket are sorted together, so a source may hold any part of all rows.

Defined cases: documents without tokens, with a null source or of a source without target are never taken; a target
whose source has no tokens, or a null or negative share or repeat, counts as 0; a source that can't reach its target is
taken ``max_repeat`` times and reported with ``reached`` false, the others keep their own targets; a repeated target
row counts once (the largest share).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DOCUMENTS = 20_000


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: share, target tokens, available tokens, copies due (capped), whole copies, fraction.

    ``total_tokens``: size of the mixture; by default all tokens of the targeted sources.
    """
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    want = targets.where("source is not null").groupBy("source").agg(F.max(zero("target_share").cast("double")).alias("target_share"), F.max(zero("max_repeat").cast("bigint")).alias("max_repeat"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    t = want.join(have, "source", "left").fillna(0, ["tokens", "documents", "squares"])
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
    t = t.withColumn("target_tokens", F.col("target_share") * total)
    due = F.least(F.try_divide("target_tokens", "tokens"), F.col("max_repeat").cast("double"))
    t = t.withColumn("due", F.coalesce(due, F.lit(0.0)))
    return t.withColumn("whole", F.floor("due")).withColumn("fraction", F.col("due") - F.floor("due"))


def largest_reachable_total(sizes: DataFrame, targets: DataFrame) -> int:
    """The largest total at which every source with tokens reaches its target within its ``max_repeat``; 0 if there is none."""
    plan = plan_mix(sizes, targets, 0).where("tokens > 0 and target_share > 0")
    least = plan.agg(F.min(F.col("tokens") * F.col("max_repeat") / F.col("target_share")).alias("t")).first()
    return int(least["t"] or 0)


def sample_mix(sizes: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, copies of each document taken at least once.

    ``sizes``: doc_id, source, n_tokens with positive tokens. ``plan``: of ``plan_mix``.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    p = F.least(F.col("fraction") * F.col("tokens") * F.col("n_tokens") / F.col("squares"), F.lit(1.0))
    odds = F.when(F.col("fraction") > 0, F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p))))
    d = sizes.join(F.broadcast(plan.select("source", "whole", "fraction", "tokens", "documents", "squares")), "source")  # a row per source
    d = d.withColumn("rank", odds).withColumn("bucket", F.floor(F.col("rank") / (F.col("rank") + 1) * F.ceil(F.col("documents") / BUCKET_DOCUMENTS)).cast("long"))
    per = d.where("rank is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_bucket").over(w), F.lit(0))).drop("in_bucket")  # a row per bucket
    inner = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(per, ["source", "bucket"], "left")
    start = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("n_tokens"))).over(inner), F.lit(0))
    left = F.col("fraction") * F.col("tokens")
    drawn = F.col("rank").isNotNull() & (start + F.col("n_tokens") / 2 <= left)
    d = d.withColumn("copies", F.col("whole") + drawn.cast("bigint"))
    return d.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def report_mix(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """source, target_share, actual_share, target_tokens, actual_tokens, documents_used, copies, most_copies, reached."""
    got = taken.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    t = plan.join(got, "source", "left").fillna(0, ["actual_tokens", "documents_used", "copies", "most_copies"])
    share = F.coalesce(F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))  # a row per source
    reached = F.col("due") * F.col("tokens") >= F.col("target_tokens") * (1 - 1e-9)
    return t.select("source", "target_share", share.alias("actual_share"), "target_tokens", "actual_tokens", "documents_used", "copies", "most_copies", reached.alias("reached"))
