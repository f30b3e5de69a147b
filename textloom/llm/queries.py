"""Queries of the llm operators over whole tables, and SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import cooccur, history, lines, mixing, names, sentences, spans, tokens
from textloom.runtime import materialize, table


def _members(spark: SparkSession, d: str, kind: str) -> DataFrame:
    if kind == "sentence":
        return cooccur.basket_items(table(spark, d, "search_sentence"), "sentence_index", "entity_set")
    return cooccur.basket_items(table(spark, d, "search_constraint"), "constraint_id", "entity_list")


def _pairs(spark: SparkSession, d: str, min_count: int, min_lift: float) -> DataFrame:
    parts = [cooccur.pair_statistics(_members(spark, d, k), min_count, min_lift).withColumn("basket_kind", F.lit(k)) for k in ("sentence", "constraint")]
    p = parts[0].unionByName(parts[1])
    return p.select("basket_kind", F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "n_ab", "n_a", "n_b", "n", "lift", "log_odds")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in at least 5 baskets and at least 3 times as often as chance."""
    return _pairs(spark, d, 5, 3.0).select("basket_kind", "entity_a", "entity_b")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its counts, lift and corrected log odds."""
    p = _pairs(spark, d, 1, 0.0)
    return p.withColumn("lift", F.round("lift", 6)).withColumn("log_odds", F.round("log_odds", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every stored sentence and document."""
    records = materialize(sentences.stored_texts(table(spark, d, "search_sentence"), table(spark, d, "documents")), "records")
    return sentences.sentence_units(records, sentences.train_on(records))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose line is in at least 6 articles of its source."""
    return lines.found_lines(table(spark, d, "search_sentence"))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Repeated multi-line blocks by source."""
    return lines.maximal_blocks(table(spark, d, "search_sentence"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Articles without the repeated lines."""
    return lines.cleaned_articles(table(spark, d, "search_sentence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys whose names mean the same person or body."""
    return names.name_pairs(names.typed_names(table(spark, d, "kg_name"), table(spark, d, "page")), table(spark, d, "nickname"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every readable name's key with its entity."""
    return names.name_groups(names.typed_names(table(spark, d, "kg_name"), table(spark, d, "page")), table(spark, d, "nickname"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that repeat an accepted one, with it."""
    return history.repeated_articles(table(spark, d, "search_sentence"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    counted = tokens.encode(docs.where("source is not null and doc_id is not null").withColumn("key", F.struct("doc_id", "source")), "key", "text", only_counts=True)
    return materialize(counted.select("key.doc_id", "key.source", "n_tokens").where("n_tokens > 0"), "sizes")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, n_tokens, copies of the mixture."""
    sizes = _sizes(spark, d)
    return mixing.sample_mix(sizes, mixing.plan_mix(sizes, table(spark, d, "mix_target")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source of the mixture."""
    sizes = _sizes(spark, d)
    plan = mixing.plan_mix(sizes, table(spark, d, "mix_target"))
    return mixing.report_mix(mixing.sample_mix(sizes, plan), plan)


def p8_reachable_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares at the largest total at which every target is reached."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_target")
    plan = mixing.plan_mix(sizes, targets, mixing.largest_reachable_total(sizes, targets))
    return mixing.report_mix(mixing.sample_mix(sizes, plan), plan)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that hold one same run of 150 code points."""
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the sets that hold one same run of 150 code points: class, its number of documents, and each of them."""
    c = spans.shared_classes(table(spark, d, "documents"))
    return c.select(F.xxhash64("phrase", "cls").alias("class_id"), F.col("n").alias("class_documents"), "doc_id")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in another one too."""
    return spans.shared_amount(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p3_found, p3_blocks, p3_clean, p4_found, p4_groups, p5_found, p7_ids, p8_mix, p8_shares, p8_reachable_shares, p9_found, p9_classes, p9_shared)}

_MEMBERS = """WITH m AS (
  SELECT DISTINCT 'sentence' AS basket_kind, sentence_index AS basket, lower(trim(e)) AS item
  FROM (SELECT sentence_index, unnest(entity_set) AS e FROM search_sentence WHERE sentence_index IS NOT NULL) WHERE trim(e) <> ''
  UNION ALL
  SELECT DISTINCT 'constraint', constraint_id, lower(trim(e))
  FROM (SELECT constraint_id, unnest(entity_list) AS e FROM search_constraint WHERE constraint_id IS NOT NULL) WHERE trim(e) <> ''),
n AS (SELECT basket_kind, count(DISTINCT basket) AS n FROM m GROUP BY 1),
i AS (SELECT basket_kind, item, count(*) AS c FROM m GROUP BY 1, 2),
ab AS (SELECT x.basket_kind, x.item AS entity_a, y.item AS entity_b, count(*) AS n_ab FROM m x JOIN m y
  ON x.basket_kind = y.basket_kind AND x.basket = y.basket AND x.item < y.item GROUP BY 1, 2, 3),
p AS (SELECT ab.*, a.c AS n_a, b.c AS n_b, n.n FROM ab JOIN n USING (basket_kind)
  JOIN i a ON a.basket_kind = ab.basket_kind AND a.item = entity_a JOIN i b ON b.basket_kind = ab.basket_kind AND b.item = entity_b)
"""
ORACLE = {
    "p1_found": _MEMBERS + "SELECT basket_kind, entity_a, entity_b FROM p WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p1_pairs": _MEMBERS
    + """SELECT basket_kind, entity_a, entity_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift,
round(ln((n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))), 6) AS log_odds FROM p""",
}
