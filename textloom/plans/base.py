"""Registration of queries beside their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL that must give the same rows (none where SQL can't express it)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return keep


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """``search_sentence`` with each ``_id`` once, as last imported."""
    w = Window.partitionBy("_id").orderBy(F.desc("import_date"), F.desc("token_number"))
    return table(spark, d, "search_sentence").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """_id, docid, pos_no, word, pos, ner, is_stop: the stored tokens of each distinct sentence, words in lower case."""
    s = sentences(spark, d).select("_id", "docid", F.posexplode("tokens").alias("pos_no", "t"))
    return s.select("_id", "docid", "pos_no", F.lower("t.word").alias("word"), "t.pos", "t.ner", "t.is_stop")


def terms(spark: SparkSession, d: str) -> DataFrame:
    """The tokens that count for search: neither blank, nor punctuation (wp), nor stop words."""
    return tokens(spark, d).where("word is not null and trim(word) <> '' and coalesce(pos, '') <> 'wp' and not coalesce(is_stop, false)")


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """``search_constraint`` with each id once, as last issued; null, empty and 0 become null."""
    w = Window.partitionBy("constraint_id").orderBy(F.desc("issued_at"))
    c = table(spark, d, "search_constraint").withColumn("__rn", F.row_number().over(w)).where("__rn = 1 and constraint_id is not null").drop("__rn")
    for k in ("source", "category"):
        c = c.withColumn(k, F.nullif(F.lower(F.trim(k)), F.lit("")))
    for k in ("days_ago", "entity_number", "sentence_length_max", "sentence_length_min", "sentence_position"):
        c = c.withColumn(k, F.when(F.col(k) > 0, F.col(k)))
    ids = F.array_distinct(F.filter(F.transform("entity_list", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    topics = F.filter("topic_category", lambda x: x.isNotNull())
    return c.withColumn("entity_list", F.when(F.size(ids) > 0, ids)).withColumn("topic_category", F.when(F.size(topics) > 0, topics))


#: The same tables for SQL, to stand behind WITH.
S_SQL = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY import_date DESC, token_number DESC NULLS LAST) AS rn FROM search_sentence) WHERE rn = 1)"
TOK_SQL = (
    S_SQL
    + """, tok AS (SELECT _id, docid, pos_no, lower(t.word) AS word, t.pos AS pos, t.ner AS ner, t.is_stop AS is_stop
FROM (SELECT _id, docid, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos_no FROM s))"""
)
TERM_SQL = TOK_SQL + ", term AS (SELECT * FROM tok WHERE word IS NOT NULL AND trim(word) <> '' AND coalesce(pos, '') <> 'wp' AND NOT coalesce(is_stop, false))"
C_SQL = """c AS (SELECT constraint_id, nullif(lower(trim(source)), '') AS source, nullif(lower(trim(category)), '') AS category,
CASE WHEN days_ago > 0 THEN days_ago END AS days_ago, CASE WHEN entity_number > 0 THEN entity_number END AS entity_number,
CASE WHEN sentence_length_max > 0 THEN sentence_length_max END AS sentence_length_max, CASE WHEN sentence_length_min > 0 THEN sentence_length_min END AS sentence_length_min,
CASE WHEN sentence_position > 0 THEN sentence_position END AS sentence_position, issued_at, entity_list AS raw_entities, topic_category AS raw_topics
FROM (SELECT *, row_number() OVER (PARTITION BY constraint_id ORDER BY issued_at DESC) AS rn FROM search_constraint) WHERE rn = 1 AND constraint_id IS NOT NULL),
ce AS (SELECT DISTINCT constraint_id, lower(trim(e)) AS kbid FROM (SELECT constraint_id, unnest(raw_entities) AS e FROM c) WHERE trim(e) <> ''),
ct AS (SELECT DISTINCT constraint_id, t AS topic FROM (SELECT constraint_id, unnest(raw_topics) AS t FROM c) WHERE t IS NOT NULL)"""
