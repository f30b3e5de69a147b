"""What the other modules leave: rules on contexts, coreference joins, choice and span features, exports as content (PF11-19, JN9-26, ST20-44, AR3-5, MA1, CS*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import features as X
from textloom.operators import linking as L
from textloom.plans.base import C_SQL, S_SQL, TERM_SQL, TOK_SQL, Registry, constraints, sentences, terms, tokens
from textloom.plans.linking_queries import _BIO, _CHUNKS
from textloom.runtime import table

R = Registry()


@R.add(f"WITH {_BIO}, m AS (SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM b3 WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island) SELECT _id, b, e, b >= 2 AND e <= 12 AS inside, b < 12 AND 2 < e AS overlaps FROM m")
def pf12_span_relations(spark, d):
    """How mentions stand to the span [2, 12)."""
    m = L.bio_mentions(tokens(spark, d), "_id", "pos_no", "word", "ner")
    b, e = F.col("begin"), F.col("end")
    return m.select("_id", b.cast("bigint").alias("b"), e.cast("bigint").alias("e"), ((b >= 2) & (e <= 12)).alias("inside"), ((b < 12) & (e > 2)).alias("overlaps"))


@R.add("SELECT e.kbid, w.t AS wanted, w.t IS NULL OR coalesce(list_contains(e.types, w.t), false) AS fits FROM kg_entity e, (VALUES (58), (63), (NULL)) w(t)")
def pf14_type_check(spark, d):
    w = spark.createDataFrame([(58,), (63,), (None,)], "wanted int")  # three requirements
    return table(spark, d, "kg_entity").join(F.broadcast(w)).select("kbid", "wanted", (F.col("wanted").isNull() | F.coalesce(F.array_contains("types", F.col("wanted")), F.lit(False))).alias("fits"))


@R.add(f"WITH {C_SQL} SELECT constraint_id, entity_number IS NULL OR sentence_position IS NULL OR entity_number <= sentence_position AS valid FROM c")
def pf19_guards(spark, d):
    c = constraints(spark, d)
    ok = F.col("entity_number").isNull() | F.col("sentence_position").isNull() | (F.col("entity_number") <= F.col("sentence_position"))
    return c.select("constraint_id", ok.alias("valid"))


@R.add("WITH l AS (SELECT DISTINCT lower(trim(name)) AS name, min(kbid) AS kbid FROM kg_name WHERE trim(name) <> '' GROUP BY 1) SELECT p.page_id, p.title, l.kbid FROM (SELECT DISTINCT page_id, lower(trim(replace(page_title, '_', ' '))) AS title FROM page WHERE page_title IS NOT NULL) p LEFT JOIN l ON l.name = p.title")
def jn09_titles_left_join(spark, d):
    p = table(spark, d, "page").where("page_title is not null").select("page_id", F.lower(F.trim(F.translate("page_title", "_", " "))).alias("title")).distinct()
    l = table(spark, d, "kg_name").select(F.lower(F.trim("name")).alias("title"), "kbid").where("title <> ''").groupBy("title").agg(F.min("kbid").alias("kbid"))
    return p.join(l, "title", "left").select("page_id", "title", "kbid")


_MC = f"{_BIO}, m AS (SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e, min(k) AS etype FROM b3 WHERE h IN ('B', 'I', 'E', 'S') GROUP BY _id, island), cc AS ({_CHUNKS.replace(TOK_SQL + ',', 'WITH').strip()} SELECT _id, min(pos_no) AS b, max(pos_no) + 1 AS e FROM cr WHERE pos IN ('n', 'nh', 'ni', 'nl', 'ns', 'nz', 'ws', 'j') GROUP BY _id, run)"


def _mentions_chunks(spark, d):
    t = tokens(spark, d)
    span = [F.col("begin").cast("bigint").alias("b"), F.col("end").cast("bigint").alias("e")]
    return L.bio_mentions(t, "_id", "pos_no", "word", "ner").select("_id", *span, "etype"), L.phrase_chunks(t, "_id", "pos_no", "word", "pos").select("_id", *span)


@R.add(f"WITH {_MC} SELECT m._id, m.b, m.e, min(etype) AS etype FROM cc JOIN m ON m._id = cc._id AND m.b = cc.b AND m.e = cc.e GROUP BY ALL")
def jn10_exact_spans(spark, d):
    """Chunks that are exactly a mention, with the first type."""
    m, c = _mentions_chunks(spark, d)
    return c.join(m, ["_id", "b", "e"]).groupBy("_id", "b", "e").agg(F.min("etype").alias("etype"))


@R.add(f"WITH {_MC} SELECT m._id, m.b, m.e, count(cc.b) AS attached FROM m LEFT JOIN cc ON cc._id = m._id AND cc.b >= m.e AND cc.b < m.e + 3 GROUP BY ALL")
def jn12_attached_chunks(spark, d):
    """Chunks that begin within three tokens behind a mention."""
    m, c = _mentions_chunks(spark, d)
    c = c.select(F.col("_id").alias("cid"), F.col("b").alias("cb"))
    j = m.join(c, (F.col("_id") == F.col("cid")) & (F.col("cb") >= F.col("e")) & (F.col("cb") < F.col("e") + 3), "left")
    return j.groupBy("_id", "b", "e").agg(F.count("cb").alias("attached"))


_SIM = "f AS (SELECT word, count(DISTINCT kbid) AS df FROM t GROUP BY word), n AS (SELECT count(DISTINCT kbid) AS n FROM t), i AS (SELECT word, greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM f, n), tf AS (SELECT kbid, word, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT kbid, sum(tf) AS len FROM tf GROUP BY 1)"


@R.add(f"WITH t AS (SELECT kbid, lower(w) AS word FROM (SELECT kbid, unnest(string_split(name, ' ')) AS w FROM (SELECT DISTINCT kbid, name FROM kg_name WHERE name IS NOT NULL)) WHERE w <> ''), {_SIM}, q AS (SELECT DISTINCT tf.kbid AS query, word, idf FROM tf JOIN i USING (word) WHERE CAST(substr(tf.kbid, 2) AS BIGINT) % 20 = 0 AND idf > 0), nq AS (SELECT query, sqrt(sum(idf * idf)) AS norm FROM q GROUP BY 1), s AS (SELECT q.query, tf.kbid, sum(q.idf * 2.0::DOUBLE * tf.tf / ((0.5::DOUBLE + 0.5::DOUBLE * l.len / 2.0::DOUBLE) + tf.tf)) AS raw FROM q JOIN tf USING (word) JOIN l ON l.kbid = tf.kbid GROUP BY 1, 2) SELECT s.query, s.kbid AS doc, round(raw / norm, 6) AS score FROM s JOIN nq USING (query)")
def ma01_pair_similarity(spark, d):
    """BM25 similarity of names: the stated query set (ids divisible by 20) against all that share a word (MA1, JN17)."""
    from textloom.operators.index import bm25_scores, document_frequencies, idf, term_frequencies

    k = table(spark, d, "kg_name").where("name is not null").select("kbid", "name").distinct()
    t = k.select("kbid", F.explode(F.split("name", " ")).alias("w")).where("w <> ''").select("kbid", F.lower("w").alias("word"))
    n = t.select("kbid").distinct().count()
    tf = term_frequencies(t, "kbid").withColumnRenamed("kbid", "doc")
    q = t.where("cast(substring(kbid, 2) as bigint) % 20 = 0").select(F.col("kbid").alias("query"), "word").distinct()
    idfs = document_frequencies(t, "kbid").select("word", idf(n, "df").alias("idf"))
    lengths = tf.groupBy("doc").agg(F.sum("tf").alias("length"))
    return bm25_scores(q, tf, lengths, idfs, 2.0).withColumn("score", F.round("score", 6))


@R.add("""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[a-zA-Z0-9'' !"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]+'), lambda x: length(x) > 1 OR x = ' ')) AS runs FROM documents WHERE text IS NOT NULL""")
def st20_ascii_runs(spark, d):
    r = F.regexp_extract_all("text", F.lit(r"""[a-zA-Z0-9' !"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""), F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(r, lambda x: (F.length(x) > 1) | (x == " "))).cast("bigint").alias("runs"))


@R.add("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL) SELECT doc_id, i, coalesce(CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b, length(line) AS size FROM l")
def st22_line_offsets(spark, d):
    """Paragraphs with their offsets."""
    l = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return l.select("doc_id", F.col("i").cast("bigint").alias("i"), F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("b"), F.length("line").cast("bigint").alias("size"))


@R.add("SELECT doc_id, len(string_split(replace(replace(title, 'and', chr(1) || 'and' || chr(1)), 'the', chr(1) || 'the' || chr(1)), chr(1))) AS pieces FROM documents WHERE title IS NOT NULL")
def st26_added_tokens(spark, d):
    """Texts split around added tokens, which stay whole."""
    t = F.replace(F.replace("title", F.lit("and"), F.lit("\x01and\x01")), F.lit("the"), F.lit("\x01the\x01"))
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.size(F.split(t, "\x01")).cast("bigint").alias("pieces"))


@R.add(f"WITH {TOK_SQL} SELECT _id, string_agg(CASE WHEN ner IS NOT NULL AND ner <> 'O' THEN '<' || ner || '>' ELSE word END, ' ' ORDER BY pos_no) AS template FROM tok WHERE word IS NOT NULL AND coalesce(pos, '') <> 'wp' AND NOT coalesce(is_stop, false) GROUP BY _id")
def st36_sentence_templates(spark, d):
    """Sentences with tagged tokens as slots, without stop words and punctuation."""
    shown = F.when(F.col("ner").isNotNull() & (F.col("ner") != "O"), F.concat(F.lit("<"), "ner", F.lit(">"))).otherwise(F.col("word"))
    t = tokens(spark, d).where("word is not null and coalesce(pos, '') <> 'wp' and not coalesce(is_stop, false)")
    g = t.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos_no", shown.alias("s")))).alias("r"))
    return g.select("_id", F.array_join(F.transform("r", lambda x: x["s"]), " ").alias("template"))


@R.add(f"WITH {S_SQL} SELECT _id, regexp_matches(raw_sentence, '[?？؟]') AS mark, contains(raw_sentence, '还是') AS alternative, contains(raw_sentence, '是') AS copula FROM s")
def st43_question_features(spark, d):
    s = sentences(spark, d)
    return s.select("_id", F.col("raw_sentence").rlike("[?？؟]").alias("mark"), F.col("raw_sentence").contains("还是").alias("alternative"), F.col("raw_sentence").contains("是").alias("copula"))


@R.add(f"WITH {S_SQL}, n AS (SELECT _id, least(len(tokens), 12) AS la, least(len(tokens), 9) AS lb FROM s WHERE len(tokens) > 0) SELECT _id, CASE WHEN la + lb > 16 THEN 16 ELSE la + lb END AS total FROM n")
def ar03_bounded_pairs(spark, d):
    """Pairs cut from hashed ends until they fit: only the size is fixed by the rule."""
    n = sentences(spark, d).where("size(tokens) > 0").select("_id", F.least(F.size("tokens"), F.lit(12)).alias("la"), F.least(F.size("tokens"), F.lit(9)).alias("lb"))
    x, y = X.truncated_sizes(F.col("la"), F.col("lb"), 16)
    return n.select("_id", (x + y).cast("bigint").alias("total"))


@R.add("SELECT mention, kbid, round((1.0::DOUBLE / popular) / sum(1.0::DOUBLE / popular) OVER (PARTITION BY mention), 6) AS share FROM (SELECT DISTINCT lower(trim(n)) AS mention, kbid, popular FROM (SELECT kbid, popular, unnest(names) AS n FROM kg_entity) WHERE popular > 0 AND trim(n) <> '')")
def ag15_reciprocal_shares(spark, d):
    e = table(spark, d, "kg_entity").where("popular > 0").select("kbid", "popular", F.explode("names").alias("n"))
    e = e.select(F.lower(F.trim("n")).alias("mention"), "kbid", "popular").where("mention <> ''").distinct().withColumn("w", 1.0 / F.col("popular"))
    return L.conditional(e, "mention", "w", "share").select("mention", "kbid", F.round("share", 6).alias("share"))


@R.add(f"WITH {S_SQL} SELECT docid, count(*) AS sentences, string_agg('<p>' || raw_sentence || '</p>', '' ORDER BY sentence_position, _id) AS html FROM s WHERE import_date > 20210601 GROUP BY docid")
def cs02_article_pages(spark, d):
    s = sentences(spark, d).where("import_date > 20210601").groupBy("docid").agg(F.count("*").alias("sentences"), F.array_sort(F.collect_list(F.struct("sentence_position", "_id", "raw_sentence"))).alias("r"))
    return s.select("docid", "sentences", F.array_join(F.transform("r", lambda x: F.concat(F.lit("<p>"), x["raw_sentence"], F.lit("</p>"))), "").alias("html"))


@R.add("WITH u(name, canonical) AS (VALUES ('game', 'play'), ('tv', 'screen'), ('film', 'screen')) SELECT doc_id, coalesce(u.canonical, d.category) AS topic FROM documents d LEFT JOIN u ON u.name = d.category")
def cs03_canonical_predicates(spark, d):
    u = spark.createDataFrame([("game", "play"), ("tv", "screen"), ("film", "screen")], "category string, canonical string")  # a fixed mapping
    return table(spark, d, "documents").join(F.broadcast(u), "category", "left").select("doc_id", F.coalesce("canonical", "category").alias("topic"))


@R.add(f"WITH {C_SQL} SELECT ce.constraint_id, ce.kbid, e.kbid IS NULL AS missing FROM ce LEFT JOIN kg_entity e ON e.kbid = ce.kbid")
def cs13_lookups(spark, d):
    c = constraints(spark, d).select("constraint_id", F.explode("entity_list").alias("kbid"))
    e = table(spark, d, "kg_entity").select("kbid", F.lit(True).alias("there"))
    return c.join(e, "kbid", "left").select("constraint_id", "kbid", F.col("there").isNull().alias("missing"))


_LAY = "w AS (SELECT doc_id, list_transform(list_filter(string_split(title, ' '), lambda x: x <> ''), lambda x: length(x)) AS a FROM documents WHERE title IS NOT NULL)"


@R.add(f"WITH {_LAY} SELECT doc_id, array_to_string(list_concat(list_concat([101], a), [102]), ' ') AS single, array_to_string(list_concat(list_concat(a, [4]), [3]), ' ') AS last FROM w")
def cs18_special_layouts(spark, d):
    """Special ids around one list: first, and last."""
    a = F.transform(F.filter(F.split("title", " "), lambda x: x != ""), lambda x: F.length(x))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    t = table(spark, d, "documents").where("title is not null").select("doc_id", a.alias("a"))
    return t.select("doc_id", show(F.concat(F.array(F.lit(101)), "a", F.array(F.lit(102)))).alias("single"), show(F.concat("a", F.array(F.lit(4), F.lit(3)))).alias("last"))


@R.add(f"WITH {TERM_SQL}, v AS (SELECT word, count(*) AS n FROM term GROUP BY word HAVING count(*) >= 3) SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM v")
def cs20_vocabulary_file(spark, d):
    """A vocabulary in order of frequency, numbered from 0."""
    from textloom.runtime import add_dense_ids

    v = terms(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").withColumn("down", -F.col("n"))
    return add_dense_ids(v, ["down", "word"], "id").select("word", "id")


@R.add(f"WITH {S_SQL} SELECT count(*) AS instances, count(DISTINCT docid) AS documents, CAST(max(len(tokens)) AS BIGINT) AS longest FROM s WHERE len(tokens) > 0")
def cs24_instance_summary(spark, d):
    s = sentences(spark, d).where("size(tokens) > 0")
    return s.agg(F.count("*").alias("instances"), F.countDistinct("docid").alias("documents"), F.max(F.size("tokens")).cast("bigint").alias("longest"))


@R.add("SELECT vec_id, list_position(list_transform(embedding, lambda x: x::DOUBLE), list_max(list_transform(embedding, lambda x: x::DOUBLE))) - 1 AS best FROM embeddings")
def cs26_argmax(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("best"))


@R.add("SELECT label, round(exp(sum(abs(embedding[1]::DOUBLE) * vec_id) / sum(vec_id)), 6) AS perplexity FROM embeddings GROUP BY label HAVING sum(vec_id) > 0")
def cs27_perplexity(spark, d):
    """exp of the length-weighted mean loss."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.sum(F.abs(F.col("embedding")[0].cast("double")) * F.col("vec_id")).alias("x"), F.sum("vec_id").alias("n")).where("n > 0")
    return e.select("label", F.round(F.exp(F.col("x") / F.col("n")), 6).alias("perplexity"))


@R.add("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 100")
def tk12_first_examples(spark, d):
    return table(spark, d, "documents").select("doc_id", "title").orderBy("doc_id").limit(100)


@R.add("SELECT title, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM (SELECT doc_id, '<' || coalesce(lang, 'und') || '> ' || title AS title FROM documents WHERE title IS NOT NULL) GROUP BY title")
def cs38_renderings(spark, d):
    t = F.concat(F.lit("<"), F.coalesce("lang", F.lit("und")), F.lit("> "), "title")
    return table(spark, d, "documents").where("title is not null").groupBy(t.alias("title")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@R.add(f"WITH {_CHUNKS}, c AS (SELECT _id, run, min(pos_no) AS b, count(*) AS n, string_agg(word, '' ORDER BY pos_no) AS text FROM cr WHERE pos IN ('n', 'nh', 'ni', 'nl', 'ns', 'nz', 'ws', 'j') AND word IS NOT NULL GROUP BY _id, run) SELECT _id, mention, count(*) AS n FROM (SELECT _id, text AS mention FROM c UNION ALL SELECT cr._id, word FROM cr JOIN c ON c._id = cr._id AND c.run = cr.run WHERE c.n > 1 AND word IS NOT NULL) GROUP BY ALL")
def dl10_mention_candidates(spark, d):
    """Every noun chunk, and of chunks of several tokens each token."""
    t = tokens(spark, d)
    w = Window.partitionBy("_id").orderBy("pos_no")
    run = t.withColumn("f", F.coalesce(F.col("pos") != F.lag("pos").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("f").over(w))
    run = run.where(F.col("pos").isin(*L.NOUN_TAGS) & F.col("word").isNotNull())
    g = run.groupBy("_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_no", "word"))), lambda x: x["word"]).alias("words"))
    every = F.when(F.size("words") > 1, F.concat(F.array(F.array_join("words", "")), "words")).otherwise(F.col("words"))
    return g.select("_id", F.explode(every).alias("mention")).groupBy("_id", "mention").agg(F.count("*").alias("n"))
