"""Choice and span features over the question records, candidates by type, and signs around mentions (AR4-5, AG26-27, JN26, PF11, PF20, SC8b, ST44, WN18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import dialog as D
from textloom.operators import features as X
from textloom.operators import linking as L
from textloom.plans.base import C_SQL, S_SQL, TERM_SQL, Registry, constraints, sentences, terms, tokens
from textloom.plans.more_queries import _BIO
from textloom.plans.qa import QUESTIONS_SQL, questions
from textloom.runtime import add_running_sum, table

R = Registry()

_CH = f"""{QUESTIONS_SQL}, c0 AS (SELECT DISTINCT id, string_split(context, ' ') AS c, string_split(question, ' ') AS s, list_transform(coalesce(answers, []) || [{{'text': question, 'answer_start': NULL}}], lambda x: x.text) AS es FROM q WHERE context IS NOT NULL AND question IS NOT NULL),
c1 AS (SELECT id, c, s, unnest(es) AS e, unnest(range(len(es))) AS choice FROM c0), c2 AS (SELECT id, choice, len(c) AS lc, len(s) + len(string_split(e, ' ')) AS le, c FROM c1 WHERE e IS NOT NULL),
c3 AS (SELECT id, choice, c, least(lc, greatest(61 - le, 31)) AS lc, least(le, greatest(61 - lc, 30)) AS le FROM c2)"""


@R.add(f"WITH {_CH} SELECT id, choice, lc + le + 3 AS used, le + 1 AS second, CASE WHEN lc > 0 THEN c[1] ELSE '[SEP]' END AS first FROM c3")
def ar05_choices(spark, d):
    """Contexts with the question and each answer as an ending, the question itself as the last one, at 64 tokens."""
    words = lambda c: F.split(c, " ")
    own = F.transform(F.coalesce(F.transform("answers", lambda x: x["text"]), F.array().cast("array<string>")), lambda x: F.split(x, " "))
    q = questions(spark, d).where("context is not null and question is not null")
    q = q.select("id", words("context").alias("c"), words("question").alias("s"), F.concat(own, F.array(words("question"))).alias("e")).distinct()
    f = X.choice_features(q, "id", "c", "s", "e", 64)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint")
    return f.select("id", F.col("choice").cast("bigint").alias("choice"), total("input_mask").alias("used"), total("segment_ids").alias("second"), F.col("tokens")[1].alias("first"))


_SP = f"""{QUESTIONS_SQL}, s0 AS (SELECT DISTINCT id, string_split(context, ' ') AS doc, string_split(question, ' ')[1:8] AS qt, len(string_split(substr(context, 1, b), ' ')) - 1 AS fw, len(string_split(substr(context, 1, b), ' ')) - 1 + len(string_split(t, ' ')) - 1 AS lw
FROM (SELECT id, context, question, answers[1].text AS t, answers[1].answer_start AS b FROM q WHERE context IS NOT NULL AND question IS NOT NULL)),
s1 AS (SELECT *, 32 - len(qt) - 3 AS w, len(doc) AS n FROM s0), s2 AS (SELECT *, unnest(range(0, n, 12)) AS start FROM s1), s3 AS (SELECT *, least(w, n - start) AS size FROM s2 WHERE start = 0 OR start - 12 + w < n)"""


@R.add(f"WITH {_SP} SELECT id, start, len(qt) + size + 3 AS used, len(qt) + 2 AS masked, CASE WHEN fw >= start AND lw < start + size THEN fw - start + len(qt) + 2 ELSE 0 END AS begin_at, CASE WHEN fw >= start AND lw < start + size THEN lw - start + len(qt) + 2 ELSE 0 END AS end_at FROM s3")
def ar04_span_labels(spark, d):
    """Windows of 32 tokens over contexts, with the first answer's place in each."""
    a = F.get("answers", F.lit(0))
    q = questions(spark, d).where("context is not null and question is not null")
    first = F.size(F.split(F.substr("context", F.lit(1), a["answer_start"].cast("int")), " ")) - 1
    q = q.select("id", F.split("context", " ").alias("doc"), F.split("question", " ").alias("q"), first.alias("fw"), (first + F.size(F.split(a["text"], " ")) - 1).alias("lw")).distinct()
    f = X.span_features(q, "id", "q", "doc", "fw", "lw", 32, 12, 8)
    masked = F.aggregate("p_mask", F.lit(0), lambda s, x: s + x).cast("bigint")
    return f.select("id", F.col("start").cast("bigint").alias("start"), F.size("tokens").cast("bigint").alias("used"), masked.alias("masked"), "begin_at", "end_at")


@R.add(f"WITH {_BIO}, m AS (SELECT _id, min(pos_no) AS b, arg_min(ner, pos_no) AS ner FROM b3 JOIN tok USING (_id, pos_no) WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island) SELECT m._id, m.b, coalesce(p.word = '《', false) AS marked FROM m LEFT JOIN tok p ON p._id = m._id AND p.pos_no = m.b - 1")
def pf11_title_signs(spark, d):
    """Mentions, and whether the token before them is 《, as it must be for titles of works."""
    t = tokens(spark, d)
    m = L.bio_mentions(t, "_id", "pos_no", "word", "ner").select("_id", F.col("begin").alias("b"))
    before = t.select("_id", (F.col("pos_no") + 1).alias("b"), F.col("word").alias("sign"))
    return m.join(before, ["_id", "b"], "left").select("_id", F.col("b").cast("bigint").alias("b"), F.coalesce(F.col("sign") == "《", F.lit(False)).alias("marked"))


@R.add(f"WITH {S_SQL}, m AS (SELECT _id, regexp_extract(raw_sentence, '(.)[不没木|](.)') AS pattern FROM s) SELECT _id, pattern FROM m WHERE pattern <> ''")
def st44_a_not_a(spark, d):
    """The sign of a yes-no question's A-not-A form with its neighbours, the first in each sentence."""
    found = F.regexp_extract("raw_sentence", r"(.)[不没木|](.)", 0)
    return sentences(spark, d).select("_id", found.alias("pattern")).where("pattern <> ''")


@R.add()
def ml02_question_types(spark, d):
    """Question types: rows labelled by their signs, a classifier of first and last words fitted on half of them and applied to all."""
    t = tokens(spark, d).where("word is not null and word <> ''").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos_no", "word"))).alias("r"))
    words = F.transform("r", lambda x: x["word"])
    place = lambda xs, mark: F.transform(xs, lambda x, i: F.concat(F.lit(mark), i.cast("string"), F.lit("="), x))
    text = F.array_join(F.concat(place(F.slice(words, 1, 3), "first"), place(F.reverse(F.slice(F.reverse(words), 1, 3)), "last"), words), " ")
    raw = F.col("raw_sentence")
    label = F.when(raw.rlike(r"还是| or "), "alternative").when(raw.rlike(r"[什谁哪何几]|(?i)\b(what|who|when|where|why|how)\b"), "open").when(raw.rlike("[?？؟]"), "yes-no").otherwise("none")
    rows = sentences(spark, d).where("raw_sentence is not null").select("_id", label.alias("label")).join(t.select("_id", text.alias("text")), "_id")
    half = F.pmod(F.xxhash64("_id"), F.lit(2)) == 0
    model = D.act_classifier(rows.where(half), "text", "label", 1 << 12)
    names = F.array(*[F.lit(x) for x in model.stages[-2].labels])
    return model.transform(rows).select("_id", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


_DL4 = f"""{S_SQL}, {C_SQL}, e1 AS (SELECT constraint_id, list(kbid ORDER BY kbid) AS es FROM ce GROUP BY 1), e2 AS (SELECT c.constraint_id, es[CAST(c.constraint_id % len(es) AS INT) + 1] AS entity FROM c LEFT JOIN e1 USING (constraint_id) WHERE c.constraint_id % 20 = 0),
se AS (SELECT DISTINCT _id, lower(trim(e)) AS kbid FROM (SELECT _id, unnest(entity_set) AS e FROM s) WHERE trim(e) <> ''),
top AS (SELECT kbid, _id, rn, least(n, 3) AS n FROM (SELECT kbid, se._id, row_number() OVER (PARTITION BY kbid ORDER BY news_date DESC NULLS LAST, se._id) AS rn, count(*) OVER (PARTITION BY kbid) AS n FROM se JOIN s ON s._id = se._id) WHERE rn <= 3)"""


@R.add(f"WITH {_DL4} SELECT constraint_id, entity, _id AS sentence, CASE WHEN entity IS NULL THEN 'general' WHEN _id IS NULL THEN 'sorry' ELSE 'search' END AS answer FROM e2 LEFT JOIN top ON top.kbid = entity AND rn = constraint_id % n + 1")
def dl04_intent_execution(spark, d):
    """One entity of each request of the stated query set, one of its three newest sentences, or what is said instead."""
    ids = F.array_sort("entity_list")
    c = constraints(spark, d).where("constraint_id % 20 = 0").select("constraint_id", F.get(ids, (F.col("constraint_id") % F.size(ids)).cast("int")).alias("entity"))
    se = sentences(spark, d).select("_id", "news_date", F.explode("entity_set").alias("e")).select("_id", "news_date", F.lower(F.trim("e")).alias("entity")).where("entity <> ''").distinct()
    se = se.join(c.select("entity").distinct(), "entity", "left_semi")
    return D.intent_execution(c, se)


_TY = "ty AS (SELECT DISTINCT kbid, unnest(types) AS type FROM kg_entity), wt AS (SELECT type FROM ty GROUP BY type HAVING count(*) >= 3)"


@R.add(f"WITH {_TY} SELECT type, count(*) AS entities, min(kbid) AS one FROM ty JOIN wt USING (type) JOIN (SELECT DISTINCT lower(trim(e)) AS kbid FROM (SELECT unnest(entity_list) AS e FROM search_constraint)) r USING (kbid) GROUP BY type")
def jn26_typed_candidates(spark, d):
    """Entities that requests name, met with the types that at least three entities have, one of each by least id."""
    ty = table(spark, d, "kg_entity").select("kbid", F.explode("types").alias("type")).distinct()
    wanted = ty.groupBy("type").agg(F.count("*").alias("n")).where("n >= 3").select("type")
    asked = table(spark, d, "search_constraint").select(F.explode("entity_list").alias("e")).select(F.lower(F.trim("e")).alias("kbid")).distinct()
    return ty.join(wanted, "type", "left_semi").join(asked, "kbid", "left_semi").groupBy("type").agg(F.count("*").alias("entities"), F.min("kbid").alias("one"))


@R.add("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS upto FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL")
def wn18_running_lengths(spark, d):
    """Running length of each source's documents, over range partitions; the source's start is taken off."""
    t = table(spark, d, "documents").where("source is not null and n_chars is not null").select("source", "doc_id", "n_chars")
    run = add_running_sum(t, ["source", "doc_id"], {"n_chars": "upto"})
    before = run.groupBy("source").agg(F.min(F.col("upto") - F.col("n_chars")).alias("start"))
    return run.join(before, "source").select("source", "doc_id", (F.col("upto") - F.col("start")).cast("bigint").alias("upto"))


@R.add(f"WITH {TERM_SQL} SELECT docid, word, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT docid, word FROM term)")
def ag26b_word_sets(spark, d):
    """Bag of words with set weights: a word counts once."""
    return terms(spark, d).select("docid", "word").distinct().withColumn("weight", F.lit(1.0))


@R.add("WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) SELECT f.label, CAST(i AS BIGINT) AS dim, round(e.embedding[i + 1]::DOUBLE, 6) AS cls FROM f JOIN embeddings e USING (vec_id), (SELECT unnest(range(0, 64)) AS i) WHERE i < len(e.embedding)")
def ag27b_first_vector(spark, d):
    """Pooling by the first vector of each group."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return e.select("label", F.posexplode("v").alias("dim", "x")).select("label", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("cls"))


@R.add(f"WITH {C_SQL}, u AS (SELECT constraint_id, 'no entity' AS warning FROM ce WHERE kbid NOT IN (SELECT kbid FROM kg_entity WHERE kbid IS NOT NULL) UNION ALL SELECT constraint_id, 'no sentence of the source' FROM c WHERE source IS NOT NULL AND source NOT IN (SELECT DISTINCT lower(trim(source)) FROM search_sentence WHERE source IS NOT NULL) UNION ALL SELECT constraint_id, 'lengths crossed' FROM c WHERE sentence_length_max < sentence_length_min) SELECT constraint_id, warning, count(*) AS n FROM u GROUP BY ALL")
def pf20b_request_warnings(spark, d):
    """Requests that name unknown entities or sources, or cross their lengths."""
    c = constraints(spark, d)
    known = table(spark, d, "kg_entity").select("kbid").distinct()
    source = table(spark, d, "search_sentence").select(F.lower(F.trim("source")).alias("source")).distinct()
    none = c.select("constraint_id", F.explode("entity_list").alias("kbid")).join(known, "kbid", "left_anti").select("constraint_id", F.lit("no entity").alias("warning"))
    other = c.where("source is not null").join(source, "source", "left_anti").select("constraint_id", F.lit("no sentence of the source").alias("warning"))
    crossed = c.where("sentence_length_max < sentence_length_min").select("constraint_id", F.lit("lengths crossed").alias("warning"))
    return none.unionByName(other).unionByName(crossed).groupBy("constraint_id", "warning").agg(F.count("*").alias("n"))


@R.add(f"WITH {S_SQL}, m AS (SELECT lower(trim(n)) AS mention, kbid FROM (SELECT kbid, unnest(names) AS n FROM kg_entity) WHERE trim(n) <> '') SELECT mention, min(kbid) AS kbid FROM m WHERE mention LIKE 'a%' GROUP BY mention")
def sc08b_mention_query(spark, d):
    """A predicate on mentions, of each the first record."""
    m = table(spark, d, "kg_entity").select("kbid", F.explode("names").alias("n")).select(F.lower(F.trim("n")).alias("mention"), "kbid")
    w = Window.partitionBy("mention").orderBy("kbid")
    return m.where("mention like 'a%'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("mention", "kbid")
