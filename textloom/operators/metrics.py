"""Evaluation: answer match, thresholds, curves, segmentation, agreement. Empty inputs give null scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import add_running_sum

from textloom.functions.text import normalize_answer


def multiset_common(a: Column, b: Column) -> Column:
    """How many words two lists share, each as often as in both (SE5)."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def answer_scores(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """exact and f1 of normalised answers (AG34); an empty answer matches only an empty one."""
    t = pairs.withColumn("__g", normalize_answer(F.coalesce(gold, F.lit("")))).withColumn("__p", normalize_answer(F.coalesce(predicted, F.lit(""))))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    t = t.withColumn("__gw", words("__g")).withColumn("__pw", words("__p"))
    t = t.withColumn("__same", multiset_common(F.col("__gw"), F.col("__pw")))
    p, r = F.col("__same") / F.size("__pw"), F.col("__same") / F.size("__gw")
    f1 = F.when((F.size("__gw") == 0) | (F.size("__pw") == 0), (F.size("__gw") == F.size("__pw")).cast("double")).when(F.col("__same") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return t.withColumn("exact", (F.col("__g") == F.col("__p")).cast("int")).withColumn("f1", f1).drop("__g", "__p", "__gw", "__pw", "__same")


def best_over_golds(scored: DataFrame, key: str) -> DataFrame:
    """The best exact and f1 of each question over its golds."""
    return scored.groupBy(key).agg(F.max("exact").alias("exact"), F.max("f1").alias("f1"))


def with_no_answer_threshold(score: Column, no_answer: Column, has_answer: Column, threshold: float) -> Column:
    """The score, or whether there is no answer where none is predicted (AG35)."""
    return F.when(no_answer > threshold, (~has_answer).cast("double")).otherwise(score)


def split_means(df: DataFrame, has_answer: str, scores: list[str]) -> DataFrame:
    """Means in percent over all questions and by whether they have an answer, in one pass (AG35)."""
    aggs = [F.count("*").alias("total"), *[(100 * F.avg(s)).alias(s) for s in scores]]
    return df.groupingSets([[], [has_answer]], has_answer).agg(*aggs)


def precision_recall(df: DataFrame, key: str, score: str, no_answer: str, has_answer: str) -> DataFrame:
    """threshold, precision, recall and its step at each distinct no-answer probability (WN7). Sums are taken per probability first."""
    per = df.groupBy(no_answer).agg(F.count("*").alias("n"), F.sum(F.when(F.col(has_answer), F.col(score)).otherwise(0.0)).alias("tp"))
    true = df.agg(F.sum(F.col(has_answer).cast("double")).alias("true"))  # one row
    run = add_running_sum(per, [no_answer], {"n": "seen", "tp": "hits"}).join(F.broadcast(true))
    return run.select(F.col(no_answer).alias("threshold"), (F.col("hits") / F.col("seen")).alias("precision"), F.try_divide("hits", "true").alias("recall"), F.try_divide("tp", "true").alias("step"))


def average_precision(curve: DataFrame) -> DataFrame:
    """ap: precision summed over the steps of recall, in percent (WN7)."""
    return curve.agg((100 * F.sum(F.col("precision") * F.col("step"))).alias("ap"))


def best_threshold(df: DataFrame, key: str, score: str, no_answer: str, has_answer: str, predicted: str) -> DataFrame:
    """best (percent) and threshold: the highest running score when answers are given up to a no-answer probability (WN8)."""
    diff = F.when(F.col(has_answer), F.col(score)).when(F.col(predicted) != "", -1.0).otherwise(0.0)
    total = df.agg(F.count("*").alias("total"), F.sum((~F.col(has_answer)).cast("double")).alias("none"))
    run = add_running_sum(df.withColumn("diff", diff), [no_answer, key], {"diff": "cur"}).join(F.broadcast(total)).withColumn("cur", F.col("cur") + F.col("none"))
    best = run.agg(F.max("cur").alias("cur"), F.max_by(no_answer, F.struct("cur", (-F.col(no_answer)).alias("n"))).alias("at"), F.max("none").alias("none"), F.max("total").alias("total"))
    better = F.col("cur") > F.col("none")
    return best.select((100 * F.greatest("cur", "none") / F.col("total")).alias("best"), F.when(better, F.col("at")).otherwise(0.0).alias("threshold"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (from 0) and share of values between 0 and 1 (AG36)."""
    b = df.withColumn("bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return b.join(F.broadcast(total)).select("bin", (F.col("n") / F.col("total")).alias("share"))


def word_spans(labels: Column) -> Column:
    """begin and end places of the words of a B, M, E, S label string."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(labels), F.lit(1))), lambda i: F.substr(labels, i, F.lit(1)).isin("E", "S"))
    return F.transform(ends, lambda e, i: F.struct(F.when(i == 0, F.lit(1)).otherwise(F.get(ends, i - 1) + 1).alias("b"), e.alias("e")))


def segmentation_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the word spans of two label strings (AG37); 0 where none is common."""
    g, p = word_spans(gold), word_spans(predicted)
    same = F.size(F.array_intersect(g, p))
    return F.when(same > 0, 2.0 * same / (F.size(g) + F.size(p))).otherwise(0.0)


def confusion(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, f1, mcc of two truth values (AG33)."""
    c = df.agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", gold & predicted), ("fp", ~gold & predicted), ("fn", gold & ~predicted), ("tn", ~gold & ~predicted))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    acc = F.try_divide(tp + tn, tp + fp + fn + tn)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return c.select("tp", "fp", "fn", "tn", acc.alias("accuracy"), f1.alias("f1"), ((acc + f1) / 2).alias("acc_and_f1"), F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)).alias("mcc"))
