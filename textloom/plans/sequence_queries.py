"""Tokenisers, markup, dialogue decisions and models over whole tables (ST4-10, ST14-16, ST24-29, ST33-34, DL1-8, PF2, TK2, ML1-3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import tokenize as K
from textloom.functions import wiki as W
from textloom.operators import dialog as D
from textloom.operators import linking as L
from textloom.plans import session_queries as SQ
from textloom.plans.base import C_SQL, S_SQL, TERM_SQL, TOK_SQL, Registry, sentences, terms, tokens
from textloom.plans.linking_queries import _T as TRIPLES_SQL
from textloom.plans.linking_queries import _popular, triples
from textloom.runtime import add_dense_ids, materialize, table

R = Registry()


def _words(spark, d):
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.posexplode(F.split("title", " ")).alias("i", "word"))
    return t.where("word <> ''")


@R.add()
def st14_basic_tokens(spark, d):
    return K.tokenise_distinct(_words(spark, d), "doc_id", "word", K.basic_tokens)


@R.add()
def st15_word_pieces(spark, d):
    """Titles in pieces of a vocabulary of single letters and the most frequent pairs of letters."""
    letters = tokens(spark, d).where("word is not null").select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    pairs = tokens(spark, d).where("length(word) >= 2").groupBy(F.substring("word", 1, 2).alias("c")).count().orderBy(F.desc("count"), "c").limit(2_000).select("c")
    units = [r["c"] for r in letters.unionByName(pairs).collect()]
    vocabulary = frozenset(units) | frozenset("##" + u for u in units)
    return K.tokenise_distinct(_words(spark, d), "doc_id", "word", lambda w: [p for b in K.basic_tokens(w) for p in K.word_pieces(b, vocabulary)])


@R.add()
def st16_merged_pairs(spark, d):
    """Titles by pair merges ranked by how often the pair of letters stands in stored words."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    t = tokens(spark, d).where("length(word) >= 2").select(chars.alias("c"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b"))))
    top = t.select(pair.alias("p")).groupBy("p.a", "p.b").count().orderBy(F.desc("count"), "a", "b").limit(5_000).collect()
    ranks = {(r["a"], r["b"]): i for i, r in enumerate(top)}
    return K.tokenise_distinct(_words(spark, d), "doc_id", "word", lambda w: K.merged_pairs(list(w.lower()), ranks))


_WORDS = f"{TERM_SQL}, v AS (SELECT word, count(*) AS n FROM term WHERE length(word) >= 4 GROUP BY word)"


def _dictionary(spark, d):
    """word, weight: every stored word of four or more letters."""
    return terms(spark, d).where("length(word) >= 4").select("word").distinct().withColumn("weight", F.lit(1.0))


@R.add(f"WITH {_WORDS}, t AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, word, len(list_filter(range(1, CAST(length(text) AS BIGINT) + 1), lambda i: substr(text, i, length(word)) = word)) AS n FROM t JOIN v ON contains(text, word)")
def jn23_dictionary_matches(spark, d):
    """How often each stored word stands in each text, overlaps counted, by automata in shards."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("text"))
    m = K.dictionary_matches(t, "doc_id", "text", _dictionary(spark, d))
    return m.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@R.add()
def st29_weighted_segments(spark, d):
    """Stored words on the best path through each title."""
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.lower("title").alias("title"))
    return K.weighted_segments(t, "doc_id", "title", _dictionary(spark, d))


@R.add(f"WITH {TERM_SQL}, ids AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM term)), t AS (SELECT doc_id, unnest(string_split(title, ' ')) AS w, unnest(range(len(string_split(title, ' ')))) AS i FROM documents WHERE title IS NOT NULL) SELECT doc_id, i, coalesce(a.id, b.id) AS id FROM t LEFT JOIN ids a ON a.word = w LEFT JOIN ids b ON b.word = lower(w) WHERE coalesce(a.id, b.id) IS NOT NULL")
def st24_vocabulary_ids(spark, d):
    """Words of titles as ids of all stored words; others are left out."""
    ids = materialize(add_dense_ids(terms(spark, d).select("word").distinct(), ["word"], "id", 1), "ids")
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.posexplode(F.split("title", " ")).alias("i", "w"))
    j = t.join(ids.select(F.col("word").alias("w"), F.col("id").alias("a")), "w", "left").withColumn("low", F.lower("w"))
    j = j.join(ids.select(F.col("word").alias("low"), F.col("id").alias("b")), "low", "left")
    return j.select("doc_id", F.col("i").cast("bigint").alias("i"), F.coalesce("a", "b").alias("id")).where("id is not null")


@R.add()
def st09_wiki_links(spark, d):
    """Texts with every capitalised word pair as a link, cleaned again: articles and links with offsets."""
    linked = F.regexp_replace("text", r"\b(\p{Lu}\p{Ll}+) (\p{Lu}\p{Ll}+)\b", "[[$1_$2|$1 $2]]")
    pages = table(spark, d, "documents").where("text is not null").select("doc_id", linked.alias("text"))
    r = W.read_pages(pages, "doc_id", "text")
    l = r.select("doc_id", "article", F.explode("links").alias("l"))
    same = F.expr("substring(article, l.begin + 1, l.end - l.begin)") == F.col("l.text")
    return l.groupBy("doc_id").agg(F.count("*").alias("links"), F.count_if(same).alias("in_place"), F.countDistinct("l.title").alias("titles"))


@R.add("SELECT doc_id, len(regexp_extract_all(text, '(==+)[ \\t]*([^=\\n]*)[ \\t]*==+')) AS sections FROM documents WHERE text IS NOT NULL")
def st10_sections(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(==+)[ \t]*([^=\n]*)[ \t]*==+"), F.lit(0)))
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.cast("bigint").alias("sections"))


@R.add("SELECT DISTINCT kbid, CASE WHEN popular IS NULL THEN 'what about ' || names[1] || ' <popular>?' ELSE 'what about ' || names[1] || ' ' || popular || '?' END AS question FROM kg_entity WHERE names[1] IS NOT NULL")
def st34_filled_slots(spark, d):
    t = D.filled_slots(F.lit("what about <name> <popular>?"), {"name": F.get("names", F.lit(0)), "popular": F.col("popular").cast("string")})
    return table(spark, d, "kg_entity").where(F.get("names", F.lit(0)).isNotNull()).select("kbid", t.alias("question")).distinct()


@R.add("SELECT kbid, t.q AS question FROM kg_entity, (VALUES ('who is <name>?'), ('who was <name>?'), ('tell me who is <name>?'), ('tell me who was <name>?')) t(q)")
def st33_expanded_templates(spark, d):
    rows = [(q,) for q in K.expanded_templates("<|tell me >who <is|was> <name>?")]
    return table(spark, d, "kg_entity").select("kbid").join(F.broadcast(spark.createDataFrame(rows, "question string")))  # four templates


# --- dialogue


def _turn_rows(spark, d):
    status = SQ.wn14_entity_status(spark, d)
    s = sentences(spark, d).where("sentence_position is not null").groupBy("docid", F.col("sentence_position").alias("turn")).agg(F.max("raw_sentence").alias("text"), F.max("entity_len").alias("n"), F.max("category").alias("category"))
    return s.join(status, ["docid", "turn"], "left").withColumn("status", F.coalesce("status", F.lit("NoEntity")))


_TURN = f"""{S_SQL}, {SQ._T}, o AS (SELECT docid, turn, item, coalesce(max(CASE WHEN turn > 1 THEN 1 END) OVER (PARTITION BY docid, item ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM t),
stt AS (SELECT docid, turn, CASE WHEN sum(old) = count(*) THEN 'AllExistEntity' WHEN sum(old) = 0 THEN 'AllNewEntity' ELSE 'ExistAndNewEntity' END AS status FROM o GROUP BY docid, turn),
tr0 AS (SELECT docid, sentence_position AS turn, max(raw_sentence) AS text, max(entity_len) AS n, max(category) AS category FROM s WHERE sentence_position IS NOT NULL GROUP BY ALL),
turns AS (SELECT tr0.*, coalesce(status, 'NoEntity') AS status FROM tr0 LEFT JOIN stt USING (docid, turn))"""


@R.add(f"WITH {_TURN} SELECT docid, turn, CASE WHEN turn <= 1 THEN 'init' WHEN n = 1 AND status = 'AllExistEntity' THEN 'answer' WHEN category = 'sports' THEN 'intent' WHEN status = 'AllExistEntity' THEN 'answer' WHEN length(text) / 400.0 >= 0.5 THEN 'qa' WHEN regexp_matches(text, '[?？؟]') THEN 'question' ELSE 'statement' END AS route FROM turns")
def dl01_turn_route(spark, d):
    t = _turn_rows(spark, d)
    known = F.col("status") == "AllExistEntity"
    route = D.turn_route(F.col("turn") > 1, F.col("n") == 1, known, F.when(F.col("category") == "sports", "sports"), F.length("text") / 400.0, F.col("text").rlike("[?？؟]"))
    return t.select("docid", "turn", route.alias("route"))


@R.add(f"WITH {_TURN} SELECT docid, turn, CASE WHEN status = 'NoEntity' THEN CASE WHEN turn > 2 AND n % 2 = 0 THEN 'extension' ELSE 'init' END WHEN status = 'AllExistEntity' THEN CASE WHEN n % 2 = 0 THEN 'extension' ELSE 'init' END WHEN status = 'AllNewEntity' THEN CASE WHEN length(text) > 60 THEN 'search' ELSE 'init' END ELSE CASE WHEN length(text) > 60 THEN 'search' WHEN n % 2 = 0 THEN 'extension' ELSE 'init' END END AS route FROM turns")
def dl02_general_route(spark, d):
    t = _turn_rows(spark, d)
    return t.select("docid", "turn", D.general_route(F.col("status"), F.col("turn") > 2, F.length("text") > 60, F.col("n") % 2 == 0).alias("route"))


@R.add(f"WITH {_TURN} SELECT docid, turn, CASE WHEN coalesce(n, 0) > 0 THEN 'a' WHEN regexp_matches(text, '!') AND NOT regexp_matches(text, '[?？؟]') THEN 'b' WHEN regexp_matches(text, '[?？؟]') THEN NULL ELSE NULL END AS policy FROM turns")
def dl03_answer_policy(spark, d):
    t = _turn_rows(spark, d)
    policies = F.create_map(F.lit("HasEntity"), F.lit("a"), F.lit("Yes"), F.lit("b"))
    act = F.when(F.col("text").rlike("[?？؟]"), "Question").otherwise("Statement")
    return t.select("docid", "turn", D.answer_policy(F.coalesce("n", F.lit(0)), F.when(F.col("text").rlike("!"), "Yes"), act, policies).alias("policy"))


@R.add("WITH r(rule, keyword) AS (VALUES ('film', 'film'), ('studio', 'film studio'), ('school', 'university'), ('firm', 'company')), k AS (SELECT DISTINCT kbid AS id, lower(name) AS text FROM kg_name WHERE name IS NOT NULL) SELECT id, rule, keyword FROM (SELECT id, rule, keyword, row_number() OVER (PARTITION BY id ORDER BY length(keyword) DESC, rule) AS rn FROM k JOIN r ON contains(text, keyword)) WHERE rn = 1")
def dl05_keyword_rules(spark, d):
    rules = spark.createDataFrame([("film", "film"), ("studio", "film studio"), ("school", "university"), ("firm", "company")], "rule string, keyword string")  # fixed rules
    k = table(spark, d, "kg_name").where("name is not null").select(F.col("kbid").alias("id"), F.lower("name").alias("text")).distinct()
    return D.grounding_matches(k, rules)


@R.add(f"WITH {TRIPLES_SQL}, one AS (SELECT subj, obj FROM (SELECT tr.subj, obj, row_number() OVER (PARTITION BY subj, pred ORDER BY popular DESC NULLS LAST, obj) AS rn FROM tr JOIN pop ON pop.kbid = tr.obj WHERE pred = 'placed') WHERE rn = 1), two AS (SELECT subj, obj FROM (SELECT a.subj, b.obj, row_number() OVER (PARTITION BY a.subj ORDER BY pa.popular + pb.popular DESC, a.obj, b.obj) AS rn FROM tr a JOIN tr b ON b.subj = a.obj AND b.pred = 'holds' JOIN pop pa ON pa.kbid = a.obj JOIN pop pb ON pb.kbid = b.obj WHERE a.pred = 'placed') WHERE rn = 1), sb AS (SELECT 'c' || c_custkey AS subj FROM customer) SELECT sb.subj, coalesce(two.obj, one.obj) AS obj, CASE WHEN two.obj IS NOT NULL THEN 'two' WHEN one.obj IS NOT NULL THEN 'one' ELSE 'none' END AS status FROM sb LEFT JOIN two USING (subj) LEFT JOIN one USING (subj)")
def dl08_extension(spark, d):
    t, pop = triples(spark, d), _popular(spark, d)
    one = L.objects_of(t, pop, "placed", None, 1)
    two = L.two_steps(t.where("pred = 'placed'"), t.where("pred = 'holds'"), pop, 1)
    return D.extended(two, one, table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subj")))


@R.add()
def pf02_tightened_search(spark, d):
    """Hits of the stated query set of requests (ids divisible by 20), with and without entities, bounds tightened until at most 50 are left."""
    from textloom.operators.index import match_constraints
    from textloom.plans.base import constraints
    from textloom.plans.index_queries import QUERY_STEP, TODAY

    # both are read by several joins and twice in all: written once, so their sizes are known too
    c = materialize(constraints(spark, d).where(F.col("constraint_id") % QUERY_STEP == 0), "requests")
    s = materialize(sentences(spark, d).select("_id", "source", "category", "entity_set", "topic_category", "news_date", "entity_len", "sentence_length", "sentence_position"), "rows")
    since = F.coalesce(F.date_format(F.date_sub(F.to_date(F.lit(str(TODAY)), "yyyyMMdd"), F.col("days_ago")), "yyyyMMdd").cast("int"), F.lit(20210101))
    bounds = c.select("constraint_id", since.alias("since"), F.coalesce("sentence_position", F.lit(60)).alias("upto"), F.coalesce("entity_number", F.lit(0)).alias("least"))
    h = match_constraints(c, s, TODAY, ("news_date", "sentence_position", "entity_len")).join(bounds, "constraint_id")
    h = h.where("news_date is not null and sentence_position is not null")
    return D.tightened(h, "constraint_id", "news_date", "sentence_position", length="entity_len", today=TODAY).select("constraint_id", "_id")


@R.add()
def tk02_random_unseen(spark, d):
    """One document of each source among its ten longest, other than those fetched late."""
    docs = table(spark, d, "documents").where("source is not null")
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    ranked = docs.select("source", "doc_id", F.row_number().over(w).alias("rank"))
    seen = docs.where("fetched_at >= '2022-01-01'").select("source", "doc_id")
    return D.picked(ranked, seen, "source", "doc_id", "rank", 10)


@R.add("SELECT word, n FROM (SELECT word, length(word) AS n FROM (SELECT DISTINCT unnest(string_split(title, ' ')) AS word FROM documents WHERE title IS NOT NULL)) ORDER BY n DESC, word LIMIT 100")
def tk08_longest_first(spark, d):
    w = table(spark, d, "documents").where("title is not null").select(F.explode(F.split("title", " ")).alias("word")).distinct()
    return w.select("word", F.length("word").cast("bigint").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@R.add("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL")
def tk10_length_batches(spark, d):
    """Rows laid out by length, so that a task's texts are alike; the content is the same."""
    return table(spark, d, "documents").where("n_chars is not null").repartitionByRange("n_chars").sortWithinPartitions("n_chars").select("doc_id", "n_chars")


@R.add("SELECT kbid, string_agg(a, '|' ORDER BY i) AS aliases FROM (SELECT kbid, unnest(aliases[1:2]) AS a, unnest(range(len(aliases[1:2]))) AS i FROM kg_entity) WHERE a IS NOT NULL GROUP BY kbid")
def tk11_first_aliases(spark, d):
    a = F.filter(F.slice("aliases", 1, 2), lambda x: x.isNotNull())
    return table(spark, d, "kg_entity").where(F.size(a) > 0).select("kbid", F.array_join(a, "|").alias("aliases"))


@R.add()
def ml01_linear_machines(spark, d):
    """Document language by word n-grams and linear machines, fitted on even ids and applied to all."""
    rows = table(spark, d, "documents").where("title is not null and lang is not null").select("doc_id", "title", "lang")
    model = D.act_classifier(rows.where("doc_id % 2 = 0"), "title", "lang", 1 << 12)
    out = model.transform(rows)
    labels = model.stages[-2].labels
    name = F.array(*[F.lit(x) for x in labels])
    return out.select("doc_id", "lang", F.get(name, F.col("prediction").cast("int")).alias("predicted"))


@R.add("WITH e AS (SELECT DISTINCT category AS key, 'known:' || category AS label FROM documents WHERE category IS NOT NULL) SELECT doc_id, coalesce(e.label, CASE WHEN (doc_id % 10) / 10.0 > 0.7 THEN lang END) AS label FROM documents LEFT JOIN e ON e.key = lower(trim(documents.title))")
def ml03_dictionary_first(spark, d):
    docs = table(spark, d, "documents")
    exact = docs.where("category is not null").select(F.col("category").alias("key"), F.concat(F.lit("known:"), "category").alias("label")).distinct()
    t = docs.select("doc_id", "title", "lang", (F.col("doc_id") % 10 / 10.0).alias("margin"))
    return D.dictionary_first(t, exact, "title", "lang", "margin").select("doc_id", "label")


@R.add()
def ag44_agglomeration(spark, d):
    """Ward clusters inside batches of 64 vectors, each one bounded group."""
    from textloom.operators.vectors import agglomerate

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("vec_id")
        got = agglomerate(list(rows["embedding"]), min(5, len(rows)))
        ids = rows["vec_id"].tolist()
        return pd.DataFrame({"vec_id": ids, "cluster": [ids[got[i]] for i in range(len(ids))]})

    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("batch"))
    return e.groupBy("batch").applyInPandas(run, "vec_id bigint, cluster bigint")
