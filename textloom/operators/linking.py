"""Mentions, entities and their relations: commonness, priors, ranking, graph steps and search.

Nulls: null mentions and ids link to nothing; a total of 0 gives null shares. Every ordering has a tie-break by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def mention_counts(names: DataFrame) -> DataFrame:
    """mention, kbid, n: popularity where known, else 1, summed (AG9). ``names``: kbid, mention, popular."""
    return names.groupBy("mention", "kbid").agg(F.sum(F.coalesce("popular", F.lit(1))).alias("n"))


def conditional(counts: DataFrame, given: str, n: str = "n", name: str = "p") -> DataFrame:
    """Each count as its share among the rows of the same ``given`` (AG12)."""
    total = F.sum(n).over(Window.partitionBy(given))
    return counts.withColumn(name, F.try_divide(F.col(n), F.nullif(total, F.lit(0))))


def entity_prior(counts: DataFrame) -> DataFrame:
    """kbid, prior: each entity's share of all counts (AG13); one total is broadcast."""
    per = counts.groupBy("kbid").agg(F.sum("n").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("kbid", F.try_divide("n", "total").alias("prior"))


def frequent_only(counts: DataFrame, over: int) -> DataFrame:
    """Counts above a threshold (PF5); mentions without any are gone."""
    return counts.where(F.col("n") > over)


def candidates(mentions: DataFrame, mention_table: DataFrame, n: int = 10) -> DataFrame:
    """mention, kbid, commonness: the best n + 1 entities of each mention, shares summing to 1 (JN3, AG14).

    The lower-cased mention is looked up first, its stripped form only where that is missing. ``mentions``: mention,
    lower, stripped; ``mention_table``: mention, kbid, score.
    """
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "kbid")
    best = mention_table.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n + 1).drop("rn")
    known = mention_table.select(F.col("mention").alias("lower")).distinct().withColumn("hit", F.lit(True))
    key = mentions.join(known, "lower", "left").withColumn("key", F.when(F.col("hit"), F.col("lower")).otherwise(F.col("stripped"))).select("mention", "key").distinct()
    found = key.join(best.withColumnRenamed("mention", "key"), "key").select("mention", "kbid", "score")
    return conditional(found, "mention", "score", "commonness")


def rank_candidates(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """confidence (1 plus weighted features, normalised per mention) and rank of each candidate (AG15, AG16)."""
    conf = F.lit(1.0)
    for c, w in weights.items():
        conf = conf + F.col(c) * F.lit(w)
    t = conditional(found.withColumn("conf", conf), "mention", "conf", "confidence").drop("conf")
    w = Window.partitionBy("mention").orderBy(F.desc("confidence"), "kbid")
    return t.withColumn("rank", F.row_number().over(w))


def objects_of(triples: DataFrame, entities: DataFrame, predicate: str | None = None, wanted_type: Column | None = None, k: int = 10) -> DataFrame:
    """subj, pred, obj, popular, rank: the k most popular objects of each subject and predicate (JN13)."""
    t = triples if predicate is None else triples.where(F.col("pred") == predicate)
    o = t.join(entities.select(F.col("kbid").alias("obj"), "popular", "types"), "obj")
    if wanted_type is not None:
        o = o.where(wanted_type)
    w = Window.partitionBy("subj", "pred").orderBy(F.desc_nulls_last("popular"), "obj")
    return o.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("subj", "pred", "obj", "popular", "rank")


def two_steps(first: DataFrame, second: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """subj, mid, obj, score, rank: paths over two relations, obj other than subj, by the sum of popularities (JN14)."""
    a = first.select("subj", F.col("obj").alias("mid")).distinct()
    b = second.select(F.col("subj").alias("mid"), "obj").distinct()
    pop = lambda c: popular.select(F.col("kbid").alias(c), F.coalesce("popular", F.lit(0)).alias(f"p_{c}"))
    p = a.join(b, "mid").where("subj <> obj").join(pop("mid"), "mid").join(pop("obj"), "obj")
    p = p.withColumn("score", F.col("p_mid") + F.col("p_obj"))
    w = Window.partitionBy("subj").orderBy(F.desc("score"), "mid", "obj")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("subj", "mid", "obj", "score", "rank")


def analogies(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, pred, obj: for given pairs (a, b) that a relation joins, what the same relation joins to a third subject x (JN15).

    ``pairs``: a, b, x. Objects equal to a, b or x are left out.
    """
    r = pairs.join(triples.select(F.col("subj").alias("a"), "pred", F.col("obj").alias("b")), ["a", "b"]).select("a", "b", "x", "pred").distinct()
    o = r.join(triples.select(F.col("subj").alias("x"), "pred", "obj"), ["x", "pred"])
    return o.where((F.col("obj") != F.col("a")) & (F.col("obj") != F.col("b")) & (F.col("obj") != F.col("x"))).select("x", "pred", "obj").distinct()


def breadth_first(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes within so many steps of the seeds, each at its least depth (DL9, SE6).

    The frontier is what was reached and not visited before; each round is written to the shared folder.
    """
    edges = materialize(edges.select("subj", "obj").distinct(), "edges") if depth > 1 else edges
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for step in range(1, depth + 1):
        near = frontier.select(F.col("node").alias("subj")).join(edges, "subj").select(F.col("obj").alias("node")).distinct()
        frontier = materialize(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def resolve_redirects(links: DataFrame, redirects: DataFrame, ids: DataFrame) -> DataFrame:
    """Each link's title after one redirect, and its page id, null where there is none (JN4)."""
    t = links.join(redirects.select(F.col("source").alias("title"), "target"), "title", "left").withColumn("final", F.coalesce("target", "title")).drop("target")
    return t.join(ids.select(F.col("title").alias("final"), "id"), "final", "left")


def majority(votes: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, votes: the label with strictly most votes; a tie gives none (AG17)."""
    c = votes.groupBy(key, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), label)
    r = c.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("votes").over(w))
    return r.where((F.col("rn") == 1) & (F.col("next").isNull() | (F.col("votes") > F.col("next")))).select(key, label, "votes")


def knn_votes(scored: DataFrame, k: int = 5, least: float = 1.5, agrees: Column | None = None) -> DataFrame:
    """query, label, n, mean: of the k best samples, labels with more than one, the best mean above a bound (AG20).

    ``agrees``: a condition on query and label that the label taken must meet (agreement of negation); the next best one
    is taken where it doesn't.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "sample")
    near = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    v = near.groupBy("query", "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).where("n > 1")
    if agrees is not None:
        v = v.where(agrees)
    b = Window.partitionBy("query").orderBy(F.desc("mean"), "label")
    return v.withColumn("rn", F.row_number().over(b)).where((F.col("rn") == 1) & (F.col("mean") >= least)).drop("rn")


def bio_mentions(tokens: DataFrame, doc: str, at: str, word: str, tag: str) -> DataFrame:
    """doc, begin, end (token places, end exclusive), etype, text of B-/I- and S- tagged stretches (AG18).

    A stretch begins at B or S, or at I or E behind another type or nothing; blanks join its words.
    """
    w = Window.partitionBy(doc).orderBy(at)
    head, kind = F.substring(tag, 1, 1), F.substring(tag, 3, 30)
    t = tokens.withColumn("h", head).withColumn("k", kind)
    t = t.withColumn("ph", F.lag("h").over(w)).withColumn("pk", F.lag("k").over(w))
    inside = F.col("h").isin("B", "I", "E", "S")
    opens = inside & (F.col("h").isin("B", "S") | F.col("ph").isNull() | ~F.col("ph").isin("B", "I") | (F.col("pk") != F.col("k")))
    t = t.withColumn("island", F.sum(opens.cast("int")).over(w)).where(inside)
    g = t.groupBy(doc, "island").agg(F.min(at).alias("begin"), (F.max(at) + 1).alias("end"), F.min("k").alias("etype"), F.array_sort(F.collect_list(F.struct(at, word))).alias("r"))
    return g.select(doc, "begin", "end", "etype", F.array_join(F.transform("r", lambda x: x[word]), " ").alias("text"))


# Tags of nouns, names, places, foreign words and abbreviations.
NOUN_TAGS = ("n", "nh", "ni", "nl", "ns", "nz", "ws", "j")


def phrase_chunks(tokens: DataFrame, doc: str, at: str, word: str, pos: str) -> DataFrame:
    """doc, begin, end, text: stretches of neighbouring tokens of one noun tag (WN3, DL10)."""
    w = Window.partitionBy(doc).orderBy(at)
    nouns = F.col(pos).isin(*NOUN_TAGS)
    t = tokens.withColumn("first", F.coalesce(F.col(pos) != F.lag(pos).over(w), F.lit(True)))
    t = t.withColumn("run", F.sum(F.col("first").cast("int")).over(w)).where(nouns)
    g = t.groupBy(doc, "run").agg(F.min(at).alias("begin"), (F.max(at) + 1).alias("end"), F.array_sort(F.collect_list(F.struct(at, word))).alias("r"))
    return g.select(doc, "begin", "end", F.array_join(F.transform("r", lambda x: x[word]), "").alias("text"))
