"""Answer evaluation and other metrics over the question records and documents (AG33-38, WN7-8, TK6, JN21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.plans.base import Registry
from textloom.plans.qa import QUESTIONS_SQL, questions
from textloom.plans.text_queries import _ANSWER
from textloom.runtime import table

R = Registry()
_NORM = _ANSWER.replace("{{", "{").replace("}}", "}")


def _n(c):
    return _NORM.replace("{}", c)


# questions with golds; the question's first 12 characters stand in for a prediction of every third question, the gold for others
_Q = f"""{QUESTIONS_SQL},
qq AS (SELECT id, question, coalesce(len(answers), 0) > 0 AS has, answers, TRY_CAST(substr(id, 2) AS BIGINT) AS no FROM q),
pr AS (SELECT *, CASE WHEN no % 3 = 0 THEN substr(question, 1, 12) WHEN no % 7 = 0 THEN '' ELSE coalesce(answers[1].text, 'x') END AS predicted, (no % 101) / 101.0::DOUBLE AS na FROM qq),
g AS (SELECT id, predicted, unnest(CASE WHEN len(list_filter(answers, lambda x: {_n('x.text')} <> '')) > 0 THEN list_transform(list_filter(answers, lambda x: {_n('x.text')} <> ''), lambda x: x.text) ELSE [''] END) AS gold FROM pr),
gn AS (SELECT id, {_n('gold')} AS g, {_n("coalesce(predicted, '')")} AS p FROM g),
gw AS (SELECT *, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw FROM gn),
gs AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(gw), lambda w: least(len(list_filter(gw, lambda x: x = w)), len(list_filter(pw, lambda x: x = w))))), 0)::DOUBLE AS same FROM gw),
sc AS (SELECT id, max(CAST(g = p AS INT)) AS exact, max(CASE WHEN len(gw) = 0 OR len(pw) = 0 THEN CAST(len(gw) = len(pw) AS INT)::DOUBLE WHEN same = 0 THEN 0 ELSE 2 * (same / len(pw)) * (same / len(gw)) / (same / len(pw) + same / len(gw)) END) AS f1 FROM gs GROUP BY id),
ev AS (SELECT pr.id, pr.has, pr.predicted, pr.na, sc.exact, sc.f1 FROM pr JOIN sc USING (id))"""


def _questions(spark, d):
    q = questions(spark, d).withColumn("no", F.expr("try_cast(substring(id, 2) as bigint)")).withColumn("has", F.coalesce(F.size("answers") > 0, F.lit(False)))
    first = F.coalesce(F.get("answers", F.lit(0))["text"], F.lit("x"))
    return q.select("id", "has", "answers", F.when(F.col("no") % 3 == 0, F.substring("question", 1, 12)).when(F.col("no") % 7 == 0, "").otherwise(first).alias("predicted"), (F.col("no") % 101 / 101.0).alias("na"))


def _evaluated(spark, d):
    q = _questions(spark, d)
    from textloom.functions.text import normalize_answer

    real = F.filter("answers", lambda x: normalize_answer(x["text"]) != "")
    golds = F.when(F.size(real) > 0, F.transform(real, lambda x: x["text"])).otherwise(F.array(F.lit("")))
    s = M.answer_scores(q.select("id", "predicted", F.explode(golds).alias("gold")), "gold", "predicted")
    return q.drop("answers").join(M.best_over_golds(s, "id"), "id")


@R.add(f"WITH {_Q} SELECT id, exact, round(f1, 6) AS f1 FROM ev")
def ag34_answer_scores(spark, d):
    return _evaluated(spark, d).select("id", "exact", F.round("f1", 6).alias("f1"))


@R.add(f"WITH {_Q}, z AS (SELECT has, CASE WHEN na > 0.7 THEN CAST(NOT has AS INT)::DOUBLE ELSE exact END AS exact, CASE WHEN na > 0.7 THEN CAST(NOT has AS INT)::DOUBLE ELSE f1 END AS f1 FROM ev) SELECT has, count(*) AS total, round(100 * avg(exact), 6) AS exact, round(100 * avg(f1), 6) AS f1 FROM z GROUP BY GROUPING SETS ((), (has))")
def ag35_split_means(spark, d):
    e = _evaluated(spark, d)
    for c in ("exact", "f1"):
        e = e.withColumn(c, M.with_no_answer_threshold(F.col(c).cast("double"), F.col("na"), F.col("has"), 0.7))
    return M.split_means(e, "has", ["exact", "f1"]).select("has", "total", F.round("exact", 6).alias("exact"), F.round("f1", 6).alias("f1"))


@R.add(f"WITH {_Q} SELECT CAST(least(floor(na * 20), 19) AS INT) AS bin, round(count(*) / (SELECT count(*) FROM ev)::DOUBLE, 6) AS share FROM ev GROUP BY 1")
def ag36_histogram(spark, d):
    return M.histogram(_evaluated(spark, d), "na").withColumn("share", F.round("share", 6))


_PR = f"{_Q}, per AS (SELECT na, count(*) AS n, sum(CASE WHEN has THEN f1 ELSE 0 END) AS tp FROM ev GROUP BY na), cv AS (SELECT na AS threshold, sum(tp) OVER (ORDER BY na) / sum(n) OVER (ORDER BY na)::DOUBLE AS precision, sum(tp) OVER (ORDER BY na) / (SELECT count(*) FROM ev WHERE has)::DOUBLE AS recall FROM per)"


@R.add(f"WITH {_PR} SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM cv")
def wn07_precision_recall(spark, d):
    c = M.precision_recall(_evaluated(spark, d), "id", "f1", "na", "has")
    return c.select(*[F.round(x, 6).alias(x) for x in ("threshold", "precision", "recall")])


@R.add(f"WITH {_PR} SELECT round(100 * sum(precision * step), 5) AS ap FROM (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY threshold), 0) AS step FROM cv)")
def wn07b_average_precision(spark, d):
    c = M.precision_recall(_evaluated(spark, d), "id", "f1", "na", "has")
    return M.average_precision(c).select(F.round("ap", 5).alias("ap"))


@R.add(f"WITH {_Q}, n AS (SELECT count(*) AS total, count(*) FILTER (NOT has) AS none FROM ev), r AS (SELECT na, none + sum(CASE WHEN has THEN f1 WHEN predicted <> '' THEN -1 ELSE 0 END) OVER (ORDER BY na, id) AS cur, none, total FROM ev, n) SELECT round(100 * greatest(max(cur), max(none)) / max(total), 5) AS best, round(CASE WHEN max(cur) > max(none) THEN (SELECT na FROM r ORDER BY cur DESC, na LIMIT 1) ELSE 0 END, 6) AS threshold FROM r")
def wn08_best_threshold(spark, d):
    b = M.best_threshold(_evaluated(spark, d), "id", "f1", "na", "has", "predicted")
    return b.select(F.round("best", 5).alias("best"), F.round("threshold", 6).alias("threshold"))


@R.add(
    """WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(replace(title, '  ', ' '), ' '), lambda w: CASE WHEN length(w) = 1 THEN 'S' WHEN length(w) >= 2 THEN 'B' || repeat('M', length(w) - 2) || 'E' ELSE '' END), '') AS gold FROM documents WHERE title IS NOT NULL),
p AS (SELECT doc_id, gold, regexp_replace(regexp_replace(gold, 'BMME', 'BEBE', 'g'), 'BE', 'SS', 'g') AS pred FROM l),
ge AS (SELECT doc_id, list_filter(range(1, length(gold) + 1), lambda i: substr(gold, i, 1) IN ('E', 'S')) AS g, list_filter(range(1, length(pred) + 1), lambda i: substr(pred, i, 1) IN ('E', 'S')) AS q FROM p),
sp AS (SELECT doc_id, list_transform(range(1, len(g) + 1), lambda k: (CASE WHEN k = 1 THEN 1 ELSE g[k - 1] + 1 END) || '-' || g[k]) AS gs, list_transform(range(1, len(q) + 1), lambda k: (CASE WHEN k = 1 THEN 1 ELSE q[k - 1] + 1 END) || '-' || q[k]) AS ps FROM ge)
SELECT doc_id, round(CASE WHEN len(list_intersect(gs, ps)) > 0 THEN 2.0::DOUBLE * len(list_intersect(gs, ps)) / (len(gs) + len(ps)) ELSE 0 END, 6) AS f1 FROM sp"""
)
def ag37_segmentation_f1(spark, d):
    """Labels of titles against the same with four-letter words cut in two and two-letter words in one."""
    from textloom.functions.text import segment_labels

    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.array_join(segment_labels("title"), "").alias("gold"))
    t = t.withColumn("pred", F.regexp_replace(F.regexp_replace("gold", "BMME", "BEBE"), "BE", "SS"))
    return t.select("doc_id", F.round(M.segmentation_f1(F.col("gold"), F.col("pred")), 6).alias("f1"))


_CF = "c AS (SELECT n_chars > 600 AS gold, length(title) > 40 AS pred FROM documents WHERE n_chars IS NOT NULL AND title IS NOT NULL), m AS (SELECT count(*) FILTER (gold AND pred)::DOUBLE AS tp, count(*) FILTER (NOT gold AND pred)::DOUBLE AS fp, count(*) FILTER (gold AND NOT pred)::DOUBLE AS fn, count(*) FILTER (NOT gold AND NOT pred)::DOUBLE AS tn FROM c)"


@R.add(f"WITH {_CF} SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(((tp + tn) / (tp + fp + fn + tn) + 2 * tp / (2 * tp + fp + fn)) / 2, 6) AS acc_and_f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m")
def ag33_confusion(spark, d):
    t = table(spark, d, "documents").where("n_chars is not null and title is not null")
    c = M.confusion(t, F.col("n_chars") > 600, F.length("title") > 40)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "f1", "acc_and_f1", "mcc")])


@R.add("SELECT lang AS label, count(*) AS n, count(*) FILTER (n_chars < 200) AS errors, round(avg(CASE WHEN n_chars < 200 THEN 0.0::DOUBLE ELSE 1 END), 6) AS accuracy FROM documents WHERE n_chars IS NOT NULL GROUP BY lang")
def ag38_accuracy_by_label(spark, d):
    short = F.col("n_chars") < 200
    return table(spark, d, "documents").where("n_chars is not null").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"), F.count_if(short).alias("errors"), F.round(F.avg((~short).cast("double")), 6).alias("accuracy"))


_SPAN = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), lg AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), st AS (SELECT * FROM (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM lg WHERE i < 32) WHERE rn <= 5), en AS (SELECT * FROM (SELECT vec_id, i - 32 AS i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM lg WHERE i >= 32) WHERE rn <= 5)"


def _span_ends(spark, d):
    from textloom.operators.vectors import dimensions

    l = dimensions(table(spark, d, "embeddings"), ["vec_id"], "embedding")
    w = Window.partitionBy("vec_id").orderBy(F.desc("x"), "dim")
    s = l.where("dim < 32").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("vec_id", F.col("dim").alias("s"), F.col("x").alias("xs"))
    e = l.where("dim >= 32").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("vec_id", (F.col("dim") - 32).alias("e"), F.col("x").alias("xe"))
    return s.join(e, "vec_id").where("e >= s and e - s + 1 <= 15").select("vec_id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), (F.col("xs") + F.col("xe")).alias("score"))


@R.add(f"WITH {_SPAN} SELECT st.vec_id, st.i AS s, en.i AS e, round(st.x + en.x, 6) AS score FROM st JOIN en USING (vec_id) WHERE en.i >= st.i AND en.i - st.i + 1 <= 15")
def jn21_start_end_pairs(spark, d):
    """The five best starts with the five best ends of each vector read as logits, valid spans only."""
    return _span_ends(spark, d).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_SPAN}, c AS (SELECT st.vec_id, st.i AS s, en.i AS e, round(st.x + en.x, 6) AS score FROM st JOIN en USING (vec_id) WHERE en.i >= st.i AND en.i - st.i + 1 <= 15), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) AS rank FROM c), nl AS (SELECT vec_id, round(v[1] + v[33], 6) AS null_score FROM e) SELECT b.vec_id, s, e, score, rank, null_score - max(score) OVER (PARTITION BY b.vec_id) > 0 AS no_answer FROM b JOIN nl USING (vec_id) WHERE rank <= 3")
def tk06_best_spans(spark, d):
    """The three best spans, and whether the null score beats the best by more than 0."""
    c = _span_ends(spark, d).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("vec_id")
    b = c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "s", "e")).cast("bigint")).where("rank <= 3")
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = table(spark, d, "embeddings").select("vec_id", F.round(v[0] + v[32], 6).alias("null_score"))
    return b.join(n, "vec_id").withColumn("no_answer", F.col("null_score") - F.max("score").over(w) > 0).drop("null_score")
