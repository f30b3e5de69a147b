"""Vectors: similarity, pooling, evaluation and losses (MA4-5, TK4-5, JN17-19, AG26-32, AG40-42)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import vectors as V
from textloom.plans.base import TERM_SQL, Registry, terms
from textloom.runtime import materialize, table

R = Registry()
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
#: Pairs of an evaluation set: each vector with the next one.
_P = f"{_E}, p AS (SELECT a.vec_id, a.label = b.label AS same, a.v AS va, b.v AS vb FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), m AS (SELECT vec_id, same, list_cosine_similarity(va, vb) AS cosine, -list_sum(list_transform(range(len(va)), lambda i: abs(va[i + 1] - vb[i + 1]))) AS l1, -sqrt(list_sum(list_transform(range(len(va)), lambda i: (va[i + 1] - vb[i + 1]) ** 2))) AS l2, list_sum(list_transform(range(len(va)), lambda i: va[i + 1] * vb[i + 1])) AS dot FROM p)"


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _pairs(spark, d):
    a = _emb(spark, d).select("vec_id", F.col("label").alias("la"), F.col("embedding").alias("va"))
    b = _emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"), F.col("embedding").alias("vb"))
    j = a.join(b, "vec_id")
    return j.select("vec_id", (F.col("la") == F.col("lb")).alias("same"), V.cosine("va", "vb").alias("cosine"), (-V.manhattan("va", "vb")).alias("l1"), (-V.euclidean("va", "vb")).alias("l2"), V.dot("va", "vb").alias("dot"))


@R.add(f"WITH {_P} SELECT vec_id, round(cosine, 6) AS cosine, round(l1, 6) AS l1, round(l2, 6) AS l2, round(dot, 6) AS dot FROM m")
def ma05_similarities(spark, d):
    return _pairs(spark, d).select("vec_id", *[F.round(c, 6).alias(c) for c in ("cosine", "l1", "l2", "dot")])


@R.add(f"WITH {_E}, s AS (SELECT q.vec_id AS query, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM e q, e c WHERE q.vec_id % 20 = 0) SELECT query, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def tk04_nearest(spark, d):
    """Every vector whose id is divisible by 20 against all vectors, in blocks."""
    e = _emb(spark, d)
    return V.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").select("query", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@R.add(f"WITH {_E}, s AS (SELECT q.vec_id AS query, c.vec_id, c.label, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM e q, e c WHERE q.vec_id % 20 = 0), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5), v AS (SELECT query, label, count(*) AS n, avg(cosine) AS mean FROM k GROUP BY ALL HAVING count(*) > 1 AND (query % 3 <> 0 OR label % 2 = 0)) SELECT query, label, n, round(mean, 5) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mean DESC, label) AS rn FROM v) WHERE rn = 1 AND mean >= 0.2")
def ag20_knn_vote(spark, d):
    """Queries divisible by three count as negated and odd labels as not: those don't agree."""
    from textloom.operators.linking import knn_votes

    e = _emb(spark, d)
    s = V.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id")
    return knn_votes(s.select("query", F.col("vec_id").alias("sample"), "label", F.round("cosine", 6).alias("score")), 5, 0.2, (F.col("query") % 3 != 0) | (F.col("label") % 2 == 0)).withColumn("mean", F.round("mean", 5))


@R.add(f"WITH {TERM_SQL} SELECT docid, word, CAST(count(*) AS DOUBLE) AS weight FROM term GROUP BY ALL")
def ag26_bag_of_words(spark, d):
    return terms(spark, d).groupBy("docid", "word").agg(F.count("*").cast("double").alias("weight"))


_D = f"{_E}, dm AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM e)"


@R.add(f"WITH {_D} SELECT label, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(sum(x) / sqrt(count(*)), 6) AS mean_sqrt FROM dm GROUP BY ALL")
def ag27_pooling(spark, d):
    return V.pooled(_emb(spark, d), "label", "embedding").select("label", F.col("dim").cast("bigint").alias("dim"), *[F.round(c, 6).alias(c) for c in ("mean", "max", "mean_sqrt")])


@R.add(f"WITH {_D} SELECT label, dim, round(sum(x * w) / greatest(sum(w), 1e-9), 6) AS mean FROM (SELECT *, 1 + vec_id % 7 AS w FROM dm) GROUP BY ALL")
def ag28_weighted_pooling(spark, d):
    e = _emb(spark, d).withColumn("w", 1 + F.col("vec_id") % 7)
    return V.pooled(e, "label", "embedding", "w").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


@R.add(
    f"""WITH {_P}, g AS (SELECT *, CAST(same AS INT)::DOUBLE AS gold FROM m), r AS (SELECT gold, cosine, l1, l2, dot, rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0::DOUBLE AS rg, rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2.0::DOUBLE AS rc, rank() OVER (ORDER BY l2) + (count(*) OVER (PARTITION BY l2) - 1) / 2.0::DOUBLE AS rl FROM g)
SELECT round(corr(gold, cosine), 6) AS pearson_cosine, round(corr(gold, l1), 6) AS pearson_l1, round(corr(gold, l2), 6) AS pearson_l2, round(corr(gold, dot), 6) AS pearson_dot, round(corr(rg, rc), 6) AS spearman_cosine, round(corr(rg, rl), 6) AS spearman_l2 FROM r"""
)
def ag29_correlations(spark, d):
    p = _pairs(spark, d).withColumn("gold", F.col("same").cast("int").cast("double"))
    p = materialize(p, "pairs")
    for value, name in (("gold", "rg"), ("cosine", "rc"), ("l2", "rl")):
        p = V.with_average_rank(p, value, name)
    c = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return p.agg(c("gold", "cosine", "pearson_cosine"), c("gold", "l1", "pearson_l1"), c("gold", "l2", "pearson_l2"), c("gold", "dot", "pearson_dot"), c("rg", "rc", "spearman_cosine"), c("rg", "rl", "spearman_l2"))


@R.add(f"WITH {_P}, t AS (SELECT median(l1) AS m1, median(l2) AS m2 FROM m) SELECT round(avg(CASE WHEN (cosine > 0.9) = same THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_cosine, round(avg(CASE WHEN (l1 > m1) = same THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_l1, round(avg(CASE WHEN (l2 > m2) = same THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_l2 FROM m, t")
def ag30_binary_accuracy(spark, d):
    p = _pairs(spark, d)
    t = p.agg(F.median("l1").alias("m1"), F.median("l2").alias("m2"))
    right = lambda c, cut, n: F.round(F.avg(((F.col(c) > cut) == F.col("same")).cast("double")), 6).alias(n)
    return p.join(F.broadcast(t)).agg(right("cosine", F.lit(0.9), "acc_cosine"), right("l1", F.col("m1"), "acc_l1"), right("l2", F.col("m2"), "acc_l2"))


_TRI = f"{_E}, t AS (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM e), n AS (SELECT a.vec_id, a.v, a.pos, b.v AS neg FROM t a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.pos IS NOT NULL AND a.label <> b.label), q AS (SELECT vec_id, 1 - list_cosine_similarity(v, pos) AS cp, 1 - list_cosine_similarity(v, neg) AS cn, sqrt(list_sum(list_transform(range(len(v)), lambda i: (v[i + 1] - pos[i + 1]) ** 2))) AS ep, sqrt(list_sum(list_transform(range(len(v)), lambda i: (v[i + 1] - neg[i + 1]) ** 2))) AS en FROM n)"


def _triplets(spark, d):
    e = _emb(spark, d)
    w = Window.partitionBy("label").orderBy("vec_id")
    a = e.withColumn("pos", F.lead("embedding").over(w)).where("pos is not null")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"), F.col("embedding").alias("neg"))
    t = a.join(b, "vec_id").where("label <> lb")
    return t.select("vec_id", (1 - V.cosine("embedding", "pos")).alias("cp"), (1 - V.cosine("embedding", "neg")).alias("cn"), V.euclidean("embedding", "pos").alias("ep"), V.euclidean("embedding", "neg").alias("en"))


@R.add(f"WITH {_TRI} SELECT count(*) AS n, round(avg(CASE WHEN cp < cn THEN 1.0::DOUBLE ELSE 0 END), 6) AS cosine, round(avg(CASE WHEN ep < en THEN 1.0::DOUBLE ELSE 0 END), 6) AS euclidean FROM q")
def ag31_triplet_accuracy(spark, d):
    return _triplets(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("cp") < F.col("cn")).cast("double")), 6).alias("cosine"), F.round(F.avg((F.col("ep") < F.col("en")).cast("double")), 6).alias("euclidean"))


@R.add(f"WITH {_TRI} SELECT round(avg(greatest(0, ep - en + 1)), 6) AS triplet_margin FROM q")
def ag42_triplet_margin(spark, d):
    return _triplets(spark, d).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("ep") - F.col("en") + 1)), 6).alias("triplet_margin"))


@R.add(f"WITH {_P} SELECT round(avg((cosine - CAST(same AS INT)) ** 2), 6) AS mse FROM m")
def ag42b_cosine_mse(spark, d):
    p = _pairs(spark, d)
    return p.agg(F.round(F.avg(F.pow(F.col("cosine") - F.col("same").cast("int"), 2)), 6).alias("mse"))


@R.add(f"WITH {_E}, p AS (SELECT a.vec_id, a.v AS u, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, len(u) + len(w) + len(u) + len(u) AS size, round(list_sum(list_transform(range(len(u)), lambda i: abs(u[i + 1] - w[i + 1]))), 6) AS difference, round(list_sum(list_transform(range(len(u)), lambda i: u[i + 1] * w[i + 1])), 6) AS product FROM p")
def ag42c_pair_features(spark, d):
    """The features u, v, |u - v|, u v of a pair."""
    a = _emb(spark, d).select("vec_id", F.col("embedding").alias("u"))
    b = _emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    u, w = V._v("u"), V._v("w")
    diff, prod = F.zip_with(u, w, lambda x, y: F.abs(x - y)), F.zip_with(u, w, lambda x, y: x * y)
    f = a.join(b, "vec_id").select("vec_id", F.concat(u, w, diff, prod).alias("f"), diff.alias("diff"), prod.alias("prod"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return f.select("vec_id", F.size("f").cast("bigint").alias("size"), total("diff").alias("difference"), total("prod").alias("product"))


_B = f"{_E}, b AS (SELECT *, vec_id // 64 AS batch FROM e), d AS (SELECT x.batch, x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb, sqrt(list_sum(list_transform(range(len(x.v)), lambda i: (x.v[i + 1] - y.v[i + 1]) ** 2))) AS dist FROM b x JOIN b y ON x.batch = y.batch)"


def _batches(spark, d):
    return V.batch_pairs(_emb(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 64)), "vec_id", "batch", "embedding", "label")


@R.add(f"WITH {_B} SELECT batch, a, round(sum(dist), 5) AS total, round(max(dist), 6) AS farthest FROM d GROUP BY ALL")
def jn19_batch_distances(spark, d):
    """All pairs inside batches of 64."""
    return _batches(spark, d).groupBy("batch", "a").agg(F.round(F.sum("distance"), 5).alias("total"), F.round(F.max("distance"), 6).alias("farthest"))


@R.add(f"WITH {_B}, h AS (SELECT batch, a, max(CASE WHEN la = lb AND a <> b THEN dist END) AS pos, min(CASE WHEN la <> lb THEN dist END) AS neg FROM d GROUP BY ALL) SELECT batch, round(avg(greatest(coalesce(pos, 0) - coalesce(neg, 0) + 5, 0)), 6) AS loss, count(*) AS anchors FROM h GROUP BY batch")
def ag40_batch_hard(spark, d):
    return V.batch_hard_loss(_batches(spark, d)).withColumn("loss", F.round("loss", 6))


@R.add(f"WITH {_B}, t AS (SELECT p.batch, greatest(p.dist - n.dist + 0.2, 0) AS x FROM d p JOIN d n ON n.batch = p.batch AND n.a = p.a WHERE p.la = p.lb AND p.a <> p.b AND n.la <> n.lb) SELECT batch, count(*) AS valid, count(*) FILTER (x > 1e-16) AS positive, round(sum(x) / (count(*) FILTER (x > 1e-16) + 1e-16), 6) AS loss FROM t GROUP BY batch")
def ag40b_batch_all(spark, d):
    return V.batch_all_loss(_batches(spark, d), 0.2).withColumn("loss", F.round("loss", 6))


@R.add(f"WITH {_E}, b AS (SELECT *, vec_id // 64 AS batch FROM e), s AS (SELECT x.batch, x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(len(x.v)), lambda i: x.v[i + 1] * y.v[i + 1])) AS dot FROM b x JOIN b y ON x.batch = y.batch), l AS (SELECT batch, a, max(CASE WHEN a = b THEN dot END) AS own, max(dot) AS mx FROM s GROUP BY ALL), z AS (SELECT s.batch, s.a, max(own) AS own, max(mx) + ln(sum(exp(dot - mx))) AS lse FROM s JOIN l USING (batch, a) GROUP BY ALL) SELECT batch, round(avg(lse) - avg(own), 6) AS loss FROM z GROUP BY batch")
def ag41_ranking_loss(spark, d):
    e = _emb(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 64))
    a = e.select("batch", F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = e.select("batch", F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    s = a.join(b, "batch").select("batch", "a", "b", V.dot("va", "vb").alias("dot")).withColumn("mx", F.max("dot").over(Window.partitionBy("batch", "a")))
    z = s.groupBy("batch", "a").agg(F.max(F.when(F.col("a") == F.col("b"), F.col("dot"))).alias("own"), (F.max("mx") + F.ln(F.sum(F.exp(F.col("dot") - F.col("mx"))))).alias("lse"))
    return z.groupBy("batch").agg(F.round(F.avg("lse") - F.avg("own"), 6).alias("loss"))


_L = f"{_D}, lg AS (SELECT vec_id, label, dim, x * 10 AS logit FROM dm)"


@R.add(f"WITH {_L} SELECT vec_id, dim, round(exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM lg)")
def ma04_softmax(spark, d):
    l = V.dimensions(_emb(spark, d), ["vec_id"], "embedding").withColumn("logit", F.col("x") * 10)
    w = Window.partitionBy("vec_id")
    l = l.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return l.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


@R.add(f"WITH {_L} SELECT vec_id, dim FROM (SELECT vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, dim) AS rn FROM lg) WHERE rn <= 5")
def tk05_best_indexes(spark, d):
    order = F.array_sort(F.transform(V._v("embedding"), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return _emb(spark, d).select("vec_id", F.explode(F.slice(F.transform(order, lambda s: s["i"].cast("bigint")), 1, 5)).alias("dim"))


@R.add(f"WITH {_L} SELECT vec_id, dim FROM (SELECT vec_id, dim, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM lg) WHERE r <= 10")
def tk07_top_k_logits(spark, d):
    l = V.dimensions(_emb(spark, d), ["vec_id"], "embedding")
    return l.withColumn("r", F.rank().over(Window.partitionBy("vec_id").orderBy(F.desc("x")))).where("r <= 10").select("vec_id", F.col("dim").cast("bigint").alias("dim"))


@R.add(f"WITH {_L}, s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM lg), p AS (SELECT vec_id, dim, logit, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM s), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT vec_id, dim FROM c WHERE before IS NULL OR before <= 0.9")
def wn17_nucleus(spark, d):
    l = V.dimensions(_emb(spark, d), ["vec_id"], "embedding").withColumn("logit", F.col("x") * 10)
    w = Window.partitionBy("vec_id")
    l = l.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("p", F.round(F.col("e") / F.sum("e").over(w), 9))
    before = F.sum("p").over(w.orderBy(F.desc("logit"), "dim").rowsBetween(Window.unboundedPreceding, -1))
    return l.withColumn("before", before).where("before is null or before <= 0.9").select("vec_id", F.col("dim").cast("bigint").alias("dim"))


@R.add(f"WITH {_L}, a AS (SELECT vec_id, label, arg_max(dim, logit) % 10 AS guess FROM lg GROUP BY ALL) SELECT label, count(*) AS n, count(*) FILTER (guess = label) AS correct, round(avg(CASE WHEN guess = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM a GROUP BY label")
def ag32_label_accuracy(spark, d):
    """Accuracy by label of the largest dimension, taken modulo 10 (AG32, AG38, CS26)."""
    v = V._v("embedding")
    g = _emb(spark, d).select("label", ((F.array_position(v, F.array_max(v)) - 1) % 10).alias("guess"))
    hit = F.col("guess") == F.col("label")
    return g.groupBy("label").agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@R.add(f"WITH {_L}, s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM lg), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY vec_id")
def ag39_entropy(spark, d):
    l = V.dimensions(_emb(spark, d), ["vec_id"], "embedding").withColumn("logit", F.col("x") * 10)
    w = Window.partitionBy("vec_id")
    l = l.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return l.groupBy("vec_id").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)), 6).alias("entropy"))
