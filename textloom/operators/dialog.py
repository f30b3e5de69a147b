"""Dialogue decisions as columns, and search that tightens or picks.

A decision is an ordered ``when``: the first condition that holds names the route. Null conditions count as false.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def turn_route(started: Column, single_entity: Column, answerable: Column, intent: Column, qa_score: Column, question: Column, least: float = 0.5) -> Column:
    """init, answer, intent, answer, qa, question or statement, in this order (DL1)."""
    return (
        F.when(~_yes(started), "init").when(_yes(single_entity) & _yes(answerable), "answer").when(intent.isNotNull(), "intent").when(_yes(answerable), "answer")
        .when(_yes(qa_score >= least), "qa").when(_yes(question), "question").otherwise("statement")
    )


def general_route(status: Column, has_history: Column, found: Column, extended: Column) -> Column:
    """Search, extension or a fresh start by which entities a turn brings (DL2): new ones are searched, known ones extended, both in that order."""
    ext = F.when(_yes(extended), "extension").otherwise("init")
    return (
        F.when(status == "NoEntity", F.when(_yes(has_history), ext).otherwise("init")).when(status == "AllExistEntity", ext)
        .when(status == "AllNewEntity", F.when(_yes(found), "search").otherwise("init")).when(status == "ExistAndNewEntity", F.when(_yes(found), "search").otherwise(ext)).otherwise("init")
    )


def answer_policy(entities: Column, yes_no: Column, act: Column, policies: Column) -> Column:
    """The policy that lets a turn answer the last question, null if none does (DL3). ``policies``: map from condition to intent."""
    has = lambda c: F.map_contains_key(policies, F.lit(c))
    statement, question = _yes(act == "Statement"), _yes(act == "Question")
    return (
        F.when((entities > 0) & has("HasEntity"), policies["HasEntity"]).when((entities == 0) & has("NoEntity"), policies["NoEntity"])
        .when(_yes(yes_no == "Yes") & statement & has("Yes"), policies["Yes"]).when(_yes(yes_no == "No") & statement & has("No"), policies["No"])
        .when(_yes(yes_no == "Unclear") & ~question & has("Unclear"), policies["Unclear"])
    )


def grounding_matches(questions: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Each text's first rule, by its longest keyword in the text (DL4-5, TK8). ``rules``: rule, keyword; a bounded table, broadcast."""
    w = Window.partitionBy("id").orderBy(F.desc(F.length("keyword")), "rule")
    j = questions.join(F.broadcast(rules), F.expr(f"contains({text}, keyword)"))
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "rule", "keyword")


def extended(two: DataFrame, one: DataFrame, subjects: DataFrame) -> DataFrame:
    """subj, obj, status: the best object over two steps, else over one, else none (DL8)."""
    a = two.where("rank = 1").select("subj", F.col("obj").alias("far"))
    b = one.where("rank = 1").select("subj", F.col("obj").alias("near"))
    j = subjects.join(a, "subj", "left").join(b, "subj", "left")
    return j.select("subj", F.coalesce("far", "near").alias("obj"), F.when(F.col("far").isNotNull(), "two").when(F.col("near").isNotNull(), "one").otherwise("none").alias("status"))


def tightened(hits: DataFrame, request: str, date: str, position: str, most: int = 50, length: str | None = None, today: int | None = None) -> DataFrame:
    """The hits of each request after its bounds were tightened step by step until at most ``most`` are left (PF2).

    Each step raises the least date by one, up to ``today``, and lowers the last position by one, down to 1; a step that
    left as many hits as the one before raises the least ``length`` (entity_len) by one first. If none are left, the hits
    of the step before stand. ``hits`` carries since and upto, and with ``length`` also least: the request's first bounds.
    The steps are taken on the numbers of hits of each (date, position, length); without ``length`` only two bounds move.

    Starting again without the last entity when there are no hits needs no step: fewer entities can't have more hits.
    """
    columns = [F.col("since").cast("long").alias("since"), F.col("upto").cast("long").alias("upto"), (F.col("least") if length else F.lit(0)).cast("long").alias("least")]
    places = [F.col(date).cast("long").alias("d"), F.col(position).cast("long").alias("p"), (F.coalesce(F.col(length), F.lit(0)) if length else F.lit(0)).cast("long").alias("e")]
    counts = hits.select(F.col(request), *columns, *places).groupBy(request, "since", "upto", "least", "d", "p", "e").agg(F.count("*").alias("n"))
    kind = counts.schema[request].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        d, p, e, n = (rows[c].to_numpy() for c in ("d", "p", "e", "n"))
        now = tuple(int(rows[c].iloc[0]) for c in ("since", "upto", "least"))
        before, left_before = now, 0
        while True:
            in_ = (d >= now[0]) & (p <= now[1]) & (e >= now[2])
            d, p, e, n = d[in_], p[in_], e[in_], n[in_]
            left = int(n.sum())
            if left <= most:
                now = before if left == 0 else now
                break
            since, upto, least = now
            if length and left == left_before:
                least += 1
            if today is None or since < today:
                since += 1
            upto -= upto > 1
            if (since, upto, least) == now and left == left_before:  # nothing can move
                break
            before, left_before, now = now, left, (since, upto, least)
        return pd.DataFrame({request: [rows[request].iloc[0]], "__d": [now[0]], "__p": [now[1]], "__e": [now[2]]})

    ends = materialize(counts.groupBy(request).applyInPandas(fold, f"`{request}` {kind}, __d long, __p long, __e long"), "ends")
    kept = (F.col(date) >= F.col("__d")) & (F.col(position) <= F.col("__p"))
    if length:
        kept = kept & (F.coalesce(F.col(length), F.lit(0)) >= F.col("__e"))
    return hits.join(ends, request).where(kept).drop("__d", "__p", "__e")


def picked(ranked: DataFrame, seen: DataFrame, group: str, item: str, rank: str, k: int, seed: int = 7) -> DataFrame:
    """One unseen item of each group by hash among its first k, or 2k, 4k ... until one is unseen; a seen one if all are (TK2)."""
    t = ranked.join(seen.select(group, item).distinct().withColumn("old", F.lit(1)), [group, item], "left").withColumn("old", F.coalesce("old", F.lit(0)))
    tier = F.ceil(F.greatest(F.log2(F.col(rank) / F.lit(float(k))), F.lit(0.0)))
    w = Window.partitionBy(group).orderBy("old", "tier", F.xxhash64(group, item, F.lit(seed)), item)
    return t.withColumn("tier", F.when(F.col("old") == 0, tier).otherwise(F.lit(0))).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(group, item, (F.col("old") == 1).alias("repeated"))


def act_classifier(rows: DataFrame, text: str, label: str, features: int = 1 << 16):
    """A fitted pipeline of word 1- to 3-grams and one-versus-rest linear machines (ML1-2)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    grams = [NGram(n=n, inputCol="words", outputCol=f"g{n}") for n in (2, 3)]
    counts = [HashingTF(inputCol=c, outputCol=f"v_{c}", numFeatures=features) for c in ("words", "g2", "g3")]
    stages = [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\s+"), *grams, *counts, VectorAssembler(inputCols=[c.getOutputCol() for c in counts], outputCol="features"), StringIndexer(inputCol=label, outputCol="target", handleInvalid="keep"), OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), labelCol="target", featuresCol="features")]
    return Pipeline(stages=stages).fit(rows)


def dictionary_first(rows: DataFrame, exact: DataFrame, text: str, predicted: str, margin: str, least: float = 0.7) -> DataFrame:
    """label: the exact match if there is one, else the prediction if its margin is over a bound, else null (ML3, PF21). ``exact``: key (lower case), label."""
    j = rows.withColumn("key", F.lower(F.trim(text))).join(exact.select("key", F.col("label").alias("known")), "key", "left")
    return j.withColumn("label", F.coalesce("known", F.when(F.col(margin) > least, F.col(predicted)))).drop("key", "known")


def response_text(kind: Column, parts: dict[str, Column]) -> Column:
    """The text of a response by its kind (CS9); null for an unknown kind."""
    out = None
    for name, c in parts.items():
        out = F.when(kind == name, c) if out is None else out.when(kind == name, c)
    return out


def filled_slots(template: Column, slots: dict[str, Column]) -> Column:
    """A template with its <slots> replaced; a null value leaves the slot (ST34, CS10)."""
    for name, c in slots.items():
        template = F.when(c.isNotNull(), F.replace(template, F.lit(f"<{name}>"), c)).otherwise(template)
    return template


def intent_execution(requests: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """constraint_id, entity, sentence, answer of each request (DL4). ``requests``: constraint_id, entity; ``rows``: entity, _id, news_date.

    The sentence is one of the entity's ``most`` newest, told by the request's number; ``answer`` is search, sorry where
    the entity has no sentence, or general where there is no entity.
    """
    newest = Window.partitionBy("entity").orderBy(F.desc_nulls_last("news_date"), "_id")
    n = rows.groupBy("entity").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    top = rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most).join(n, "entity").select("entity", F.col("_id").alias("sentence"), "rn", "n")
    j = requests.join(n, "entity", "left").withColumn("rn", F.col("constraint_id") % F.col("n") + 1).drop("n")
    j = j.join(top.drop("n"), ["entity", "rn"], "left")
    answer = F.when(F.col("entity").isNull(), "general").when(F.col("sentence").isNull(), "sorry").otherwise("search")
    return j.select("constraint_id", "entity", "sentence", answer.alias("answer"))
