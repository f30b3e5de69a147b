"""Session windows, event windows and relational extensions (WN13-15, SE7, DL6-8, CS12, streaming's batch forms)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import sessions as Z
from textloom.plans.base import Registry, constraints
from textloom.runtime import table
from textloom.streaming import jobs

R = Registry()
# A session is an article; its turns are its sentence positions, its items their entities.
_T = "t AS (SELECT DISTINCT docid, sentence_position AS turn, lower(trim(e)) AS item FROM (SELECT docid, sentence_position, unnest(entity_set) AS e FROM search_sentence WHERE sentence_position IS NOT NULL) WHERE trim(e) <> '')"


def _turns(spark, d):
    t = table(spark, d, "search_sentence").where("sentence_position is not null").select("docid", F.col("sentence_position").alias("turn"), F.explode("entity_set").alias("e"))
    return t.select("docid", "turn", F.lower(F.trim("e")).alias("item")).where("item <> ''").distinct()


@R.add(f"WITH {_T} SELECT docid, turn, item, count(*) OVER (PARTITION BY docid, item ORDER BY turn) AS seen, lag(turn) OVER (PARTITION BY docid, item ORDER BY turn) AS last FROM t")
def wn13_recency(spark, d):
    return Z.recency(_turns(spark, d), "docid", "turn", "item")


@R.add(f"WITH {_T}, o AS (SELECT docid, turn, item, coalesce(max(CASE WHEN turn > 1 THEN 1 END) OVER (PARTITION BY docid, item ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM t) SELECT docid, turn, CASE WHEN sum(old) = count(*) THEN 'AllExistEntity' WHEN sum(old) = 0 THEN 'AllNewEntity' ELSE 'ExistAndNewEntity' END AS status FROM o GROUP BY docid, turn")
def wn14_entity_status(spark, d):
    return Z.entity_status(_turns(spark, d), "docid", "turn", "item")


@R.add("WITH t AS (SELECT DISTINCT _id, docid, sentence_position AS turn, category, raw_sentence FROM search_sentence) SELECT _id, lag(raw_sentence) OVER (PARTITION BY docid ORDER BY turn, _id) AS previous FROM t")
def wn15_previous_turn(spark, d):
    t = table(spark, d, "search_sentence").select("_id", "docid", F.col("sentence_position").alias("turn"), "category", "raw_sentence").distinct()
    w = Window.partitionBy("docid").orderBy(F.col("turn").asc_nulls_last(), "_id")
    return t.select("_id", F.lag("raw_sentence").over(w).alias("previous"))


@R.add(f"WITH {_T}, f AS (SELECT docid, item, min(turn) AS first FROM t GROUP BY ALL), u AS (SELECT DISTINCT docid, turn FROM t) SELECT u.docid, u.turn, string_agg(f.item, ',' ORDER BY f.item) AS known FROM u JOIN f ON f.docid = u.docid AND f.first <= u.turn GROUP BY ALL")
def se07_seen_sets(spark, d):
    t = Z.seen_before(_turns(spark, d), "docid", "turn", "item")
    return t.select("docid", "turn", F.array_join("known", ",").alias("known")).distinct()


@R.add("WITH q AS (SELECT dump_id, version, row_number() OVER (PARTITION BY dump_id ORDER BY received_at DESC) AS rn, received_at FROM qa_dump) SELECT dump_id, CASE WHEN version IS NULL THEN 'none' WHEN version >= 'v2' THEN 'new' ELSE 'old' END AS answer FROM q WHERE rn = 1")
def dl07_gated_answer(spark, d):
    w = Window.partitionBy("dump_id").orderBy(F.desc("received_at"))
    t = table(spark, d, "qa_dump").select("dump_id", "version", F.row_number().over(w).alias("rn")).where("rn = 1")
    return t.select("dump_id", F.when(F.col("version").isNull(), "none").when(F.col("version") >= "v2", "new").otherwise("old").alias("answer"))


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def sx01_tumbling(spark, d):
    return jobs.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@R.add("SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) GROUP BY start")
def sx02_sliding(spark, d):
    return jobs.sliding(table(spark, d, "events"))


@R.add("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def sx03_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"))


@R.add("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def js01_json_fields(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@R.add("SELECT kbid, CAST(to_json({'kbid': kbid, 'popular': popular}) AS VARCHAR) AS j FROM kg_entity WHERE popular IS NOT NULL")
def pf18_json_projection(spark, d):
    return table(spark, d, "kg_entity").where("popular is not null").select("kbid", F.to_json(F.struct("kbid", "popular")).alias("j"))


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def rx01_grouping_sets(spark, d):
    l = table(spark, d, "lineitem")
    g = l.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@R.add("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def rx02_outer_joins(spark, d):
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("m"))  # pre-aggregated before the join
    j = c.join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("m").alias("orders"))
    return n.join(j, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def rx03_anti_and_except(spark, d):
    c = table(spark, d, "customer")
    none = c.join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return none.exceptAll(c.where("c_acctbal < 0").select("c_custkey")).distinct()


@R.add("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders")
def rx04_window_frames(spark, d):
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("moving"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).alias("quarter"))
