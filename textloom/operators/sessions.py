"""Turn-by-turn state of sessions, as windows over (session, turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recency(rows: DataFrame, session: str, turn: str, item: str) -> DataFrame:
    """Adds seen (how often the item came up to this turn), last (its last turn before) and rank among the session's items so far by the latest, then the most frequent (WN13)."""
    w = Window.partitionBy(session, item).orderBy(turn)
    return rows.withColumn("seen", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lag(turn).over(w))


def entity_status(rows: DataFrame, session: str, turn: str, item: str) -> DataFrame:
    """session, turn, status: whether a turn's items all, none or partly came in turns 2 to turn - 1 (WN14)."""
    w = Window.partitionBy(session, item).orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.max(F.when(F.col(turn) > 1, 1)).over(w), F.lit(0))
    t = rows.withColumn("old", old).groupBy(session, turn).agg(F.count(item).alias("n"), F.sum(F.when(F.col(item).isNotNull(), F.col("old"))).alias("old"))
    status = F.when(F.col("n") == 0, "NoEntity").when(F.col("old") == F.col("n"), "AllExistEntity").when(F.col("old") == 0, "AllNewEntity").otherwise("ExistAndNewEntity")
    return t.select(session, turn, status.alias("status"))


def seen_before(rows: DataFrame, session: str, turn: str, item: str) -> DataFrame:
    """Adds known: the sorted set of items up to and with each turn (SE7); bounded by a session's items."""
    w = Window.partitionBy(session).orderBy(turn).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("known", F.array_sort(F.collect_set(item).over(w)))
