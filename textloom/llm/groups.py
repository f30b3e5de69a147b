"""Groups of linked keys: components, average linkage, and pairs of a group's members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

#: Members of a group that one row meets in one task.
BLOCK = 400


def block_pairs(members: DataFrame, group: list[str], key: str, but: str | None = None) -> DataFrame:
    """``key``_a < ``key``_b of all members of each group, not yet distinct over groups.

    ``members``: group columns and key, distinct. Members are hashed into blocks of about ``BLOCK``; each meets every
    block of its group, so a group of any size is spread over tasks. ``but``: pairs of members that both have this mark are left out.
    """
    blocks = members.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("bigint")).drop("n")
    m = members.join(blocks, group)
    mark = lambda s: [F.col(but).alias(f"__but_{s}")] if but else []
    left = m.select(*group, F.col(key).alias(f"{key}_a"), *mark("a"), F.pmod(F.xxhash64(key), "blocks").alias("block"))
    right = m.select(*group, F.col(key).alias(f"{key}_b"), *mark("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, [*group, "block"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return (pairs.where("not (__but_a and __but_b)") if but else pairs).select(f"{key}_a", f"{key}_b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of an undirected graph given by columns a, b.

    In each round every node takes the least label of its neighbours, then the label that label's own node has (pointer
    jumping), until nothing changes, so the rounds grow with the logarithm of a path's length.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").withColumn("new", F.least("component", "near")).select("node", "component", "new")
        jump = label.select(F.col("node").alias("new"), F.col("component").alias("over"))
        step = step.join(jump, "new", "left").withColumn("to", F.least("new", F.coalesce("over", "new")))
        step = materialize(step.select("node", "component", "to"), "label")
        label = step.select("node", F.col("to").alias("component"))
        if step.where("to <> component").isEmpty():
            return label
