"""Mentions, knowledge graph, joins by span and classification by votes (AG8-18, AG20-23, JN*, PF5, PF11-14, DL9-10, TK3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import linking as L
from textloom.plans.base import C_SQL, S_SQL, TOK_SQL, Registry, constraints, sentences, tokens
from textloom.plans.index_queries import _NAMES, entity_names
from textloom.plans.qa import QUESTIONS_SQL, questions
from textloom.runtime import table

R = Registry()


def _mentions(spark, d):
    e = table(spark, d, "kg_entity")
    both = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")))
    m = e.select("kbid", "popular", F.explode(both).alias("m"))
    return m.select("kbid", "popular", F.lower(F.trim("m")).alias("mention")).where("mention <> ''").distinct()


_M = "mm AS (SELECT DISTINCT kbid, popular, lower(trim(m)) AS mention FROM (SELECT kbid, popular, unnest(list_concat(coalesce(names, []), coalesce(aliases, []))) AS m FROM kg_entity) WHERE trim(m) <> ''), mc AS (SELECT mention, kbid, CAST(sum(coalesce(popular, 1)) AS BIGINT) AS n FROM mm GROUP BY ALL)"


def _counts(spark, d):
    return L.mention_counts(_mentions(spark, d))


@R.add(f"WITH {S_SQL} SELECT kbid, count(DISTINCT _id) AS n FROM (SELECT _id, lower(trim(unnest(entity_set))) AS kbid FROM s) WHERE kbid <> '' GROUP BY kbid")
def ag08_entity_sentences(spark, d):
    e = sentences(spark, d).select("_id", F.explode("entity_set").alias("e")).select("_id", F.lower(F.trim("e")).alias("kbid")).where("kbid <> ''").distinct()
    return e.groupBy("kbid").agg(F.count("*").alias("n"))


@R.add(f"WITH {_M} SELECT * FROM mc")
def ag09_mention_counts(spark, d):
    return _counts(spark, d)


@R.add(f"WITH {TOK_SQL} SELECT ner AS tag, word, count(*) AS n FROM tok WHERE ner IS NOT NULL AND ner <> 'O' AND word IS NOT NULL GROUP BY ALL")
def ag10_anchor_counts(spark, d):
    return tokens(spark, d).where("ner is not null and ner <> 'O' and word is not null").groupBy(F.col("ner").alias("tag"), "word").agg(F.count("*").alias("n"))


@R.add(f"WITH {_M} SELECT kbid, count(*) AS mentions, string_agg(mention, '|' ORDER BY mention) AS listed FROM mc GROUP BY kbid")
def ag11_transpose(spark, d):
    return _counts(spark, d).groupBy("kbid").agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_list("mention")), "|").alias("listed"))


@R.add(f"WITH {_M} SELECT mention, kbid, round(n / nullif(sum(n) OVER (PARTITION BY mention), 0)::DOUBLE, 6) AS p_entity, round(n / nullif(sum(n) OVER (PARTITION BY kbid), 0)::DOUBLE, 6) AS p_mention FROM mc")
def ag12_conditional(spark, d):
    t = L.conditional(L.conditional(_counts(spark, d), "mention", name="p_entity"), "kbid", name="p_mention")
    return t.select("mention", "kbid", F.round("p_entity", 6).alias("p_entity"), F.round("p_mention", 6).alias("p_mention"))


@R.add(f"WITH {_M} SELECT kbid, round(sum(n) / (SELECT sum(n) FROM mc)::DOUBLE, 9) AS prior FROM mc GROUP BY kbid")
def ag13_entity_prior(spark, d):
    return L.entity_prior(_counts(spark, d)).withColumn("prior", F.round("prior", 9))


_CAND = f"""{_M}, mt AS (SELECT mention, kbid, n / nullif(sum(n) OVER (PARTITION BY mention), 0)::DOUBLE AS score FROM mc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC NULLS LAST, kbid) AS rn FROM mt) WHERE rn <= 11),
k AS (SELECT DISTINCT name AS mention, lower(name) AS low, trim(regexp_replace(lower(name), ' +', ' ', 'g')) AS stripped FROM (SELECT unnest(names) AS name FROM kg_entity) WHERE trim(name) <> ''),
kk AS (SELECT mention, CASE WHEN low IN (SELECT mention FROM mt) THEN low ELSE stripped END AS key FROM k),
found AS (SELECT kk.mention, best.kbid, score FROM kk JOIN best ON best.mention = kk.key),
cand AS (SELECT mention, kbid, score / nullif(sum(score) OVER (PARTITION BY mention), 0) AS commonness FROM found)"""


def _candidates(spark, d):
    mt = L.conditional(_counts(spark, d), "mention", name="score").select("mention", "kbid", "score")
    k = table(spark, d, "kg_entity").select(F.explode("names").alias("mention")).where("trim(mention) <> ''").distinct()
    k = k.select("mention", F.lower("mention").alias("lower"), F.trim(F.regexp_replace(F.lower("mention"), " +", " ")).alias("stripped"))
    return L.candidates(k, mt)


@R.add(f"WITH {_CAND} SELECT mention, kbid, round(commonness, 6) AS commonness FROM cand")
def ag14_candidates(spark, d):
    return _candidates(spark, d).select("mention", "kbid", F.round("commonness", 6).alias("commonness"))


@R.add(f"WITH {_CAND}, c AS (SELECT mention, kbid, 1.0::DOUBLE + coalesce(commonness, 0) AS conf FROM cand), r AS (SELECT mention, kbid, round(conf / sum(conf) OVER (PARTITION BY mention), 6) AS confidence FROM c) SELECT *, row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, kbid) AS rank FROM r")
def ag16_ranked_candidates(spark, d):
    t = L.rank_candidates(_candidates(spark, d).withColumn("commonness", F.coalesce("commonness", F.lit(0.0))), {"commonness": 1.0})
    w = Window.partitionBy("mention").orderBy(F.desc("confidence"), "kbid")
    t = t.withColumn("confidence", F.round("confidence", 6)).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return t.select("mention", "kbid", "confidence", "rank")


@R.add(f"WITH {_M} SELECT mention, kbid, n FROM mc WHERE n > 1000")
def pf05_frequent_only(spark, d):
    return L.frequent_only(_counts(spark, d), 1000)


@R.add(f"WITH {_M} SELECT mention, string_agg(kbid, ',' ORDER BY n DESC, kbid) AS kbids FROM mc GROUP BY mention")
def tk03_sorted_candidates(spark, d):
    t = _counts(spark, d).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kbid"))).alias("r"))
    return t.select("mention", F.array_join(F.transform("r", lambda x: x["kbid"]), ",").alias("kbids"))


_VOTES = f"{S_SQL}, v AS (SELECT s._id, h AS label FROM (SELECT _id, lower(trim(unnest(entity_set))) AS kbid FROM s) s JOIN (SELECT kbid, unnest(hypernyms) AS h FROM kg_entity) e USING (kbid) WHERE h IS NOT NULL), vc AS (SELECT _id, label, count(*) AS votes FROM v GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY votes DESC, label) AS rn, lead(votes) OVER (PARTITION BY _id ORDER BY votes DESC, label) AS nx FROM vc), won AS (SELECT _id, label, votes FROM vr WHERE rn = 1 AND (nx IS NULL OR votes > nx))"


def _votes(spark, d):
    e = sentences(spark, d).select("_id", F.explode("entity_set").alias("e")).select("_id", F.lower(F.trim("e")).alias("kbid"))
    h = table(spark, d, "kg_entity").select("kbid", F.explode("hypernyms").alias("label")).where("label is not null")
    return e.join(h, "kbid").select("_id", "label")


@R.add(f"WITH {_VOTES} SELECT * FROM won")
def ag17_majority_vote(spark, d):
    return L.majority(_votes(spark, d), "_id", "label")


@R.add("SELECT doc_id, label, n FROM (SELECT doc_id, label, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rn FROM (SELECT doc_id, 'number' AS label, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'question', len(regexp_extract_all(text, '[?？؟]')) FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'speech', len(regexp_extract_all(text, '[“「«]')) FROM documents WHERE text IS NOT NULL)) WHERE rn = 1 AND n > 0")
def ag17b_pattern_votes(spark, d):
    """The pattern that occurs most in each text."""
    docs = table(spark, d, "documents").where("text is not null")
    n = lambda label, p: F.struct((-F.regexp_count("text", F.lit(p))).cast("bigint").alias("n"), F.lit(label).alias("label"))
    best = F.array_min(F.array(n("number", "[0-9]+"), n("question", "[?？؟]"), n("speech", "[“「«]")))
    return docs.select("doc_id", best.alias("b")).select("doc_id", F.col("b.label").alias("label"), (-F.col("b.n")).alias("n")).where("n > 0")


@R.add(f"WITH {_VOTES} SELECT s._id, coalesce(s.category, won.label, s.topic_category[1], 'other') AS category FROM s LEFT JOIN won ON won._id = s._id")
def ag17c_cascade(spark, d):
    s = sentences(spark, d).select("_id", "category", "topic_category")
    won = L.majority(_votes(spark, d), "_id", "label").select("_id", "label")
    return s.join(won, "_id", "left").select("_id", F.coalesce("category", "label", F.get("topic_category", F.lit(0)), F.lit("other")).alias("category"))


_BIO = f"""{TOK_SQL}, b AS (SELECT _id, pos_no, word, substr(ner, 1, 1) AS h, substr(ner, 3) AS k FROM tok),
b2 AS (SELECT *, lag(h) OVER w AS ph, lag(k) OVER w AS pk FROM b WINDOW w AS (PARTITION BY _id ORDER BY pos_no)),
b3 AS (SELECT *, sum(CASE WHEN h IN ('B', 'I', 'E', 'S') AND (h IN ('B', 'S') OR ph IS NULL OR ph NOT IN ('B', 'I') OR pk <> k) THEN 1 ELSE 0 END) OVER (PARTITION BY _id ORDER BY pos_no) AS island FROM b2)"""


@R.add(f"WITH {_BIO} SELECT _id, min(pos_no) AS \"begin\", max(pos_no) + 1 AS \"end\", min(k) AS etype, string_agg(word, ' ' ORDER BY pos_no) AS text FROM b3 WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island")
def ag18_tagged_mentions(spark, d):
    return L.bio_mentions(tokens(spark, d), "_id", "pos_no", "word", "ner")


_CHUNKS = f"""{TOK_SQL}, ch AS (SELECT _id, pos_no, word, pos, CASE WHEN pos IS DISTINCT FROM lag(pos) OVER w OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM tok WINDOW w AS (PARTITION BY _id ORDER BY pos_no)),
cr AS (SELECT *, sum(f) OVER (PARTITION BY _id ORDER BY pos_no) AS run FROM ch)"""


@R.add(f"WITH {_CHUNKS} SELECT _id, min(pos_no) AS \"begin\", max(pos_no) + 1 AS \"end\", coalesce(string_agg(word, '' ORDER BY pos_no), '') AS text FROM cr WHERE pos IN ('n', 'nh', 'ni', 'nl', 'ns', 'nz', 'ws', 'j') GROUP BY _id, run")
def wn03_noun_chunks(spark, d):
    return L.phrase_chunks(tokens(spark, d), "_id", "pos_no", "word", "pos")


@R.add(f"WITH {S_SQL}, t AS (SELECT kbid, unnest(types) AS type FROM kg_entity) SELECT s._id, t.type, count(DISTINCT kbid) AS n, string_agg(DISTINCT kbid, ',' ORDER BY kbid) AS kbids FROM (SELECT DISTINCT _id, lower(trim(unnest(entity_set))) AS kbid FROM s) s JOIN t USING (kbid) WHERE t.type IS NOT NULL GROUP BY ALL")
def ag21_entities_by_type(spark, d):
    e = sentences(spark, d).select("_id", F.explode("entity_set").alias("e")).select("_id", F.lower(F.trim("e")).alias("kbid")).distinct()
    t = table(spark, d, "kg_entity").select("kbid", F.explode("types").alias("type")).where("type is not null")
    g = e.join(t, "kbid").groupBy("_id", "type").agg(F.array_sort(F.collect_set("kbid")).alias("k"))
    return g.select("_id", "type", F.size("k").cast("bigint").alias("n"), F.array_join("k", ",").alias("kbids"))


@R.add(f"WITH {S_SQL} SELECT docid, category, string_agg(CAST(sentence_position AS VARCHAR), ',' ORDER BY sentence_position, _id) AS positions FROM s WHERE category IS NOT NULL GROUP BY ALL")
def ag22_positions_by_label(spark, d):
    s = sentences(spark, d).where("category is not null")
    g = s.groupBy("docid", "category").agg(F.array_sort(F.collect_list(F.struct("sentence_position", "_id"))).alias("r"))
    return g.select("docid", "category", F.array_join(F.transform(F.filter("r", lambda x: x["sentence_position"].isNotNull()), lambda x: x["sentence_position"].cast("string")), ",").alias("positions"))


@R.add("SELECT count(*) AS rows, count(*) FILTER (names IS NULL OR len(names) = 0) AS no_names, count(*) FILTER (aliases IS NULL OR len(aliases) = 0) AS no_aliases, count(*) FILTER (types IS NULL OR len(types) = 0) AS no_types, count(*) FILTER (popular IS NULL) AS no_popular FROM kg_entity")
def ag23_missing_properties(spark, d):
    none = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) <= 0)
    return table(spark, d, "kg_entity").agg(F.count("*").alias("rows"), none("names").alias("no_names"), none("aliases").alias("no_aliases"), none("types").alias("no_types"), F.count_if(F.isnull("popular")).alias("no_popular"))


@R.add(f"WITH {S_SQL}, q AS (SELECT docid, count(*) AS w FROM s GROUP BY docid) SELECT c AS ch, CAST(sum(w) AS BIGINT) AS n FROM (SELECT docid, unnest(string_split(raw_sentence, '')) AS c FROM s WHERE sentence_position = 1) JOIN q USING (docid) WHERE c <> '' GROUP BY c")
def ag24_weighted_characters(spark, d):
    """Characters of titles, weighted by their article's sentences."""
    s = sentences(spark, d)
    q = s.groupBy("docid").agg(F.count("*").alias("w"))
    c = s.where("sentence_position = 1").select("docid", F.explode(F.split("raw_sentence", "")).alias("ch")).where("ch <> ''")
    return c.join(q, "docid").groupBy("ch").agg(F.sum("w").alias("n"))


@R.add(f"WITH {S_SQL} SELECT kbid, count(*) AS shown FROM (SELECT lower(trim(unnest(entity_set))) AS kbid FROM s) WHERE kbid <> '' GROUP BY kbid ORDER BY shown DESC, kbid LIMIT 100")
def ag43_display_counts(spark, d):
    e = sentences(spark, d).select(F.explode("entity_set").alias("e")).select(F.lower(F.trim("e")).alias("kbid")).where("kbid <> ''")
    return e.groupBy("kbid").agg(F.count("*").alias("shown")).orderBy(F.desc("shown"), "kbid").limit(100)


# --- graph: entities that share an article; orders, customers and parts as a typed graph


def triples(spark, d):
    """subj, pred, obj over orders: customer -placed-> order -holds-> part -from-> supplier."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    v = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = o.select(v("c", "o_custkey").alias("subj"), F.lit("placed").alias("pred"), v("o", "o_orderkey").alias("obj"))
    b = l.select(v("o", "l_orderkey").alias("subj"), F.lit("holds").alias("pred"), v("p", "l_partkey").alias("obj"))
    c = l.select(v("p", "l_partkey").alias("subj"), F.lit("from").alias("pred"), v("s", "l_suppkey").alias("obj"))
    return a.unionByName(b.distinct()).unionByName(c.distinct())


_T = """tr AS (SELECT DISTINCT 'c' || o_custkey AS subj, 'placed' AS pred, 'o' || o_orderkey AS obj FROM orders
UNION SELECT 'o' || l_orderkey, 'holds', 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 'from', 's' || l_suppkey FROM lineitem),
pop AS (SELECT 'p' || p_partkey AS kbid, CAST(p_size AS BIGINT) AS popular FROM part UNION ALL SELECT 'o' || o_orderkey, CAST(o_orderkey % 97 AS BIGINT) FROM orders)"""


def _popular(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("kbid"), F.col("p_size").cast("bigint").alias("popular"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("kbid"), (F.col("o_orderkey") % 97).alias("popular"))
    return p.unionByName(o).withColumn("types", F.array(F.substring("kbid", 1, 1)))


@R.add(f"WITH {_T} SELECT subj, pred, obj, popular, rank FROM (SELECT tr.*, popular, row_number() OVER (PARTITION BY subj, pred ORDER BY popular DESC NULLS LAST, obj) AS rank FROM tr JOIN pop ON pop.kbid = tr.obj WHERE pred = 'holds') WHERE rank <= 3")
def jn13_objects(spark, d):
    return L.objects_of(triples(spark, d), _popular(spark, d), "holds", F.array_contains("types", "p"), 3).withColumn("rank", F.col("rank").cast("bigint"))


@R.add(f"WITH {_T} SELECT subj, mid, obj, score, rank FROM (SELECT a.subj, a.obj AS mid, b.obj, pa.popular + pb.popular AS score, row_number() OVER (PARTITION BY a.subj ORDER BY pa.popular + pb.popular DESC, a.obj, b.obj) AS rank FROM tr a JOIN tr b ON b.subj = a.obj AND b.pred = 'holds' JOIN pop pa ON pa.kbid = a.obj JOIN pop pb ON pb.kbid = b.obj WHERE a.pred = 'placed') WHERE rank <= 3")
def jn14_two_steps(spark, d):
    t = triples(spark, d)
    return L.two_steps(t.where("pred = 'placed'"), t.where("pred = 'holds'"), _popular(spark, d), 3).withColumn("rank", F.col("rank").cast("bigint"))


@R.add(
    f"""WITH {_T}, f AS (SELECT subj, min(obj) AS obj FROM tr WHERE pred = 'holds' GROUP BY subj), g AS (SELECT subj, obj, lead(subj) OVER (ORDER BY subj) AS x FROM (SELECT * FROM f WHERE subj IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0)))
SELECT DISTINCT g.x, r.pred, o.obj FROM g JOIN tr r ON r.subj = g.subj AND r.obj = g.obj JOIN tr o ON o.subj = g.x AND o.pred = r.pred WHERE o.obj <> g.obj AND o.obj <> g.subj AND o.obj <> g.x"""
)
def jn15_analogies(spark, d):
    """Orders of the stated set (key divisible by 20), each with its first part, and the next order as third subject."""
    from textloom.runtime import add_dense_ids

    t = triples(spark, d)
    want = table(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subj"))
    f = t.where("pred = 'holds'").join(want, "subj", "left_semi").groupBy("subj").agg(F.min("obj").alias("obj"))
    n = add_dense_ids(f, ["subj"], "i")
    g = n.join(n.select((F.col("i") - 1).alias("i"), F.col("subj").alias("x")), "i").select(F.col("subj").alias("a"), F.col("obj").alias("b"), "x")
    return L.analogies(t, g)


@R.add(
    f"""WITH RECURSIVE {_T}, w(node, depth) AS (SELECT DISTINCT 'c' || c_custkey, 0 FROM customer WHERE c_custkey % 20 = 0 UNION SELECT tr.obj, w.depth + 1 FROM w JOIN tr ON tr.subj = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY node"""
)
def dl09_breadth_first(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return L.breadth_first(seeds, triples(spark, d).select("subj", "obj"), 3)


@R.add("SELECT kbid, CASE WHEN list_has_any(coalesce(types, []), [58, 63]) THEN popular::DOUBLE ELSE popular * 0.1::DOUBLE - 50 END AS weight FROM kg_entity WHERE popular IS NOT NULL")
def ma07_popularity_weight(spark, d):
    e = table(spark, d, "kg_entity").where("popular is not null")
    focus = F.coalesce(F.arrays_overlap("types", F.array(F.lit(58), F.lit(63))), F.lit(False))
    return e.select("kbid", F.when(focus, F.col("popular").cast("double")).otherwise(F.col("popular") * F.lit(0.1) - 50).alias("weight"))


@R.add(f"WITH {_NAMES}, {C_SQL} SELECT ce.constraint_id, ce.kbid, coalesce(min(nm.name), ce.kbid) AS shown FROM ce LEFT JOIN nm ON nm.kbid = ce.kbid GROUP BY ce.constraint_id, ce.kbid")
def cs04_object_names(spark, d):
    c = constraints(spark, d).select("constraint_id", F.explode("entity_list").alias("kbid"))
    n = entity_names(spark, d).groupBy("kbid").agg(F.min("name").alias("name"))
    return c.join(n, "kbid", "left").select("constraint_id", "kbid", F.coalesce("name", "kbid").alias("shown"))


# --- wiki pages


_RED = "pg AS (SELECT DISTINCT page_id, page_title AS title, page_is_redirect AS red FROM page WHERE page_namespace = 0 AND page_title IS NOT NULL), key AS (SELECT *, lower(regexp_replace(title, '[^\\p{L}]', '', 'g')) AS k FROM pg), tg AS (SELECT k, min(page_id) AS target FROM key WHERE NOT red GROUP BY k)"


def _page_keys(spark, d):
    p = table(spark, d, "page").where("page_namespace = 0 and page_title is not null").select("page_id", F.col("page_title").alias("title"), F.col("page_is_redirect").alias("red")).distinct()
    return p.withColumn("k", F.lower(F.regexp_replace("title", r"[^\p{L}]", "")))


@R.add(f"WITH {_RED} SELECT key.page_id, key.title, tg.target FROM key LEFT JOIN tg USING (k) WHERE key.red")
def jn04_redirect_targets(spark, d):
    """Redirect pages and the page whose title has the same letters, null where there is none."""
    p = _page_keys(spark, d)
    tg = p.where("not red").groupBy("k").agg(F.min("page_id").alias("target"))
    return p.where("red").join(tg, "k", "left").select("page_id", "title", "target")


@R.add(f"WITH {_RED} SELECT page_id, title FROM key WHERE NOT red AND title NOT IN (SELECT title FROM key WHERE red) AND NOT contains(title, '(')")
def jn05_articles_only(spark, d):
    p = _page_keys(spark, d)
    return p.where("not red and not contains(title, '(')").join(p.where("red").select("title"), "title", "left_anti").select("page_id", "title")


_SECT = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
hd AS (SELECT doc_id, i, regexp_extract(line, '^[ ]*(=+)[^=]+=+[ \r]*$', 1) AS lev FROM l WHERE regexp_matches(line, '^[ ]*=+[^=]+=+[ \r]*$')),
sec AS (SELECT doc_id, i AS start, coalesce(lead(i) OVER (PARTITION BY doc_id, lev ORDER BY i), lead(i) OVER (PARTITION BY doc_id ORDER BY i), 1000000000) AS stop FROM hd)"""


def _lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _sections(spark, d):
    p = r"^[ ]*(=+)[^=]+=+[ \r]*$"
    h = _lines(spark, d).where(F.col("line").rlike(p)).withColumn("lev", F.regexp_extract("line", p, 1))
    same, any_ = Window.partitionBy("doc_id", "lev").orderBy("i"), Window.partitionBy("doc_id").orderBy("i")
    stop = F.coalesce(F.lead("i").over(same), F.lead("i").over(any_), F.lit(1_000_000_000))
    return h.select("doc_id", F.col("i").alias("start"), stop.alias("stop"))


@R.add(f"WITH {_SECT} SELECT doc_id, start, stop FROM sec")
def wn02_section_ends(spark, d):
    return _sections(spark, d).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@R.add(f"WITH {_SECT} SELECT sec.doc_id, sec.start, count(*) AS lines FROM sec JOIN l ON l.doc_id = sec.doc_id AND l.i > sec.start AND l.i < sec.stop GROUP BY ALL")
def jn08_section_lines(spark, d):
    """Interval join of sections and the lines inside them."""
    l, s = _lines(spark, d), _sections(spark, d).withColumnRenamed("doc_id", "sd")
    j = l.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("i") > F.col("start")) & (F.col("i") < F.col("stop")))
    return j.groupBy("doc_id", F.col("start").cast("bigint").alias("start")).agg(F.count("*").alias("lines"))


@R.add(f"WITH {_BIO}, m AS (SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM b3 WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island), cc AS ({_CHUNKS.replace(TOK_SQL + ',', 'WITH').strip()} SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM cr WHERE pos IN ('n', 'nh', 'ni', 'nl', 'ns', 'nz', 'ws', 'j') GROUP BY _id, run) SELECT m._id, m.b, m.e, count(*) AS chunks FROM m JOIN cc ON cc._id = m._id AND m.b >= cc.b AND m.e <= cc.e GROUP BY ALL")
def jn06_mentions_in_chunks(spark, d):
    """Range join by containment: tagged mentions that lie inside a noun chunk."""
    t = tokens(spark, d)
    m = L.bio_mentions(t, "_id", "pos_no", "word", "ner").select("_id", F.col("begin").alias("b"), F.col("end").alias("e"))
    c = L.phrase_chunks(t, "_id", "pos_no", "word", "pos").select(F.col("_id").alias("cid"), F.col("begin").alias("cb"), F.col("end").alias("ce"))
    j = m.join(c, (F.col("_id") == F.col("cid")) & (F.col("b") >= F.col("cb")) & (F.col("e") <= F.col("ce")))
    return j.groupBy("_id", F.col("b").cast("bigint").alias("b"), F.col("e").cast("bigint").alias("e")).agg(F.count("*").alias("chunks"))


@R.add(f"WITH {_BIO}, m AS (SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM b3 WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island), cc AS ({_CHUNKS.replace(TOK_SQL + ',', 'WITH').strip()} SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM cr WHERE pos IN ('n', 'nh', 'ni', 'nl', 'ns', 'nz', 'ws', 'j') GROUP BY _id, run) SELECT cc._id, cc.b, cc.e FROM cc WHERE NOT EXISTS (SELECT 1 FROM m WHERE m._id = cc._id AND m.b < cc.e AND cc.b < m.e)")
def jn11_chunks_without_mention(spark, d):
    """Anti join by overlap: noun chunks that meet no mention."""
    t = tokens(spark, d)
    m = L.bio_mentions(t, "_id", "pos_no", "word", "ner").select(F.col("_id").alias("mid"), F.col("begin").alias("mb"), F.col("end").alias("me"))
    c = L.phrase_chunks(t, "_id", "pos_no", "word", "pos").select("_id", F.col("begin").cast("bigint").alias("b"), F.col("end").cast("bigint").alias("e"))
    return c.join(m, (F.col("_id") == F.col("mid")) & (F.col("mb") < F.col("e")) & (F.col("b") < F.col("me")), "left_anti")


@R.add(
    f"""WITH {QUESTIONS_SQL}, a AS (SELECT DISTINCT qid, context, x.answer_start AS b, x.answer_start + length(x.text) AS e FROM (SELECT id AS qid, context, unnest(answers) AS x FROM q WHERE context IS NOT NULL)),
w AS (SELECT context, wi, wb, wb + length(word) AS we FROM (SELECT context, wi, words[wi + 1] AS word, coalesce(list_sum(list_transform(words[1:wi], lambda z: length(z) + 1)), 0) AS wb FROM (SELECT context, string_split(context, ' ') AS words, unnest(range(len(string_split(context, ' ')))) AS wi FROM (SELECT DISTINCT context FROM a))))
SELECT qid, b, e, min(wi) AS first_word, max(wi) AS last_word FROM a JOIN w ON w.context = a.context AND w.wb < a.e AND a.b < w.we GROUP BY qid, b, e, a.context"""
)
def jn07_answer_words(spark, d):
    """Range join by overlap: the first and last word each answer touches."""
    a = questions(spark, d).select("context", F.col("id").alias("qid"), F.explode("answers").alias("x")).select("qid", "context", F.col("x.answer_start").alias("b"), (F.col("x.answer_start") + F.length("x.text")).alias("e"))
    a = a.where("context is not null").distinct()
    words = F.split("context", " ")
    c = a.select("context").distinct().select("context", F.posexplode(words).alias("wi", "word"))
    w = Window.partitionBy("context").orderBy("wi").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("wb", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0))).withColumn("we", F.col("wb") + F.length("word")).withColumnRenamed("context", "wc")
    j = a.join(c, (F.col("context") == F.col("wc")) & (F.col("wb") < F.col("e")) & (F.col("b") < F.col("we")))
    return j.groupBy("qid", "b", "e", "context").agg(F.min("wi").cast("bigint").alias("first_word"), F.max("wi").cast("bigint").alias("last_word")).drop("context")


@R.add(f"WITH {TOK_SQL}, v AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM (SELECT word FROM tok WHERE word IS NOT NULL GROUP BY word HAVING count(*) >= 10)) SELECT doc_id, i, coalesce(a.id, b.id, 1) AS id FROM (SELECT doc_id, unnest(string_split(title, ' ')) AS w, unnest(range(len(string_split(title, ' ')))) AS i FROM documents WHERE title IS NOT NULL) t LEFT JOIN v a ON a.word = t.w LEFT JOIN v b ON b.word = lower(t.w)")
def jn24_case_variants(spark, d):
    """A word's id by its own form, else by its lower-case form, else 1."""
    from textloom.runtime import add_dense_ids

    v = add_dense_ids(tokens(spark, d).where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where("n >= 10").select("word"), ["word"], "id", 2)
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.posexplode(F.split("title", " ")).alias("i", "w"))
    t = t.join(v.select(F.col("word").alias("w"), F.col("id").alias("a")), "w", "left").withColumn("low", F.lower("w"))
    t = t.join(v.select(F.col("word").alias("low"), F.col("id").alias("b")), "low", "left")
    return t.select("doc_id", F.col("i").cast("bigint").alias("i"), F.coalesce("a", "b", F.lit(1)).alias("id"))


@R.add(f"WITH {S_SQL}, tm(type, topic) AS (VALUES (58, 'film'), (63, 'music'), (39, 'song')), t AS (SELECT kbid, unnest(types) AS type FROM kg_entity) SELECT _id, kbid, coalesce(min(topic), 'other') AS topic FROM (SELECT DISTINCT _id, lower(trim(unnest(entity_set))) AS kbid FROM s) s LEFT JOIN t USING (kbid) LEFT JOIN tm USING (type) WHERE kbid <> '' GROUP BY ALL")
def jn25_type_topics(spark, d):
    topics = spark.createDataFrame([(58, "film"), (63, "music"), (39, "song")], "type int, topic string")  # a fixed dimension
    e = sentences(spark, d).select("_id", F.explode("entity_set").alias("e")).select("_id", F.lower(F.trim("e")).alias("kbid")).where("kbid <> ''").distinct()
    t = table(spark, d, "kg_entity").select("kbid", F.explode("types").alias("type")).join(F.broadcast(topics), "type")
    best = t.groupBy("kbid").agg(F.min("topic").alias("topic"))
    return e.join(best, "kbid", "left").select("_id", "kbid", F.coalesce("topic", F.lit("other")).alias("topic"))


@R.add("SELECT e.kbid, string_agg(json_extract_string(raw, '$.name[0][0]'), '') AS json_name FROM kg_entity e WHERE json_type(raw, '$.name[0]') = 'ARRAY' GROUP BY 1 UNION ALL SELECT kbid, json_extract_string(raw, '$.name[0].name') FROM kg_entity WHERE json_type(raw, '$.name[0]') = 'OBJECT'")
def js02_list_or_object(spark, d):
    """The first name of a raw value that holds lists or objects."""
    e = table(spark, d, "kg_entity").where("raw is not null")
    v = F.try_parse_json("raw")
    first = F.coalesce(F.try_variant_get(v, "$.name[0][0]", "string"), F.try_variant_get(v, "$.name[0].name", "string"))
    there = F.coalesce(F.get_json_object("raw", "$.name[0]"), F.lit("")).rlike(r"^[\[{]")
    return e.where(there).select("kbid", first.alias("json_name"))
