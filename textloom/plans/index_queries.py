"""Scans, predicates, index building and search (SC*, PF*, AG1-7, JN1-2, TK1, MA1-2, CD1, WN1, SE*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import index as I
from textloom.plans.base import C_SQL, S_SQL, TERM_SQL, TOK_SQL, Registry, constraints, sentences, terms, tokens
from textloom.runtime import add_dense_ids, materialize, table

R = Registry()
TODAY = 20220712
#: The stated query set of searches: documents whose id is divisible by 20.
QUERY_STEP = 20


@R.add("SELECT DISTINCT _id, docid, news_date, raw_sentence FROM search_sentence WHERE category = 'music' AND news_date >= 20220101")
def sc01_find_by_predicate(spark, d):
    return table(spark, d, "search_sentence").where("category = 'music' and news_date >= 20220101").select("_id", "docid", "news_date", "raw_sentence").distinct()


@R.add("SELECT doc_id, title, lang FROM documents WHERE source = 'lantern_wire'")
def sc02_property_equality(spark, d):
    return table(spark, d, "documents").where(F.col("source") == "lantern_wire").select("doc_id", "title", "lang")


@R.add("SELECT kbid, popular, raw FROM kg_entity")
def sc03_full_scan(spark, d):
    return table(spark, d, "kg_entity").select("kbid", "popular", "raw")


_NAMES = "nm AS (SELECT DISTINCT kbid, lower(trim(n)) AS name, popular FROM (SELECT kbid, popular, unnest(names) AS n FROM kg_entity) WHERE trim(n) <> '')"


def entity_names(spark, d):
    e = table(spark, d, "kg_entity").select("kbid", "popular", F.explode("names").alias("n"))
    return e.select("kbid", "popular", F.lower(F.trim("n")).alias("name")).where("name <> ''").distinct()


@R.add(f"WITH {_NAMES} SELECT name, kbid, popular, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY popular DESC NULLS LAST, kbid) AS rn, count(*) OVER (PARTITION BY name) AS n FROM nm) WHERE rn = 1")
def sc04_most_popular_by_name(spark, d):
    w = Window.partitionBy("name")
    e = entity_names(spark, d).withColumn("rn", F.row_number().over(w.orderBy(F.desc_nulls_last("popular"), "kbid"))).withColumn("n", F.count("*").over(w))
    return e.where("rn = 1").select("name", "kbid", "popular", "n")


@R.add(f"WITH {_NAMES}, h AS (SELECT kbid, unnest(hypernyms) AS hypernym FROM kg_entity) SELECT DISTINCT name, hypernym FROM nm JOIN h USING (kbid) WHERE hypernym IS NOT NULL")
def sc04b_property_by_name(spark, d):
    h = table(spark, d, "kg_entity").select("kbid", F.explode("hypernyms").alias("hypernym"))
    return entity_names(spark, d).join(h, "kbid").where("hypernym is not null").select("name", "hypernym").distinct()


@R.add("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(raw)) AS key FROM kg_entity WHERE raw IS NOT NULL) GROUP BY key")
def sc05_property_keys(spark, d):
    k = table(spark, d, "kg_entity").where("raw is not null").select(F.explode(F.json_object_keys("raw")).alias("key"))
    return k.groupBy("key").agg(F.count("*").alias("n"))


@R.add(f"WITH {C_SQL} SELECT ce.constraint_id, ce.kbid, e.popular, names[1] AS first_name FROM ce JOIN kg_entity e ON e.kbid = ce.kbid")
def sc06_point_lookup(spark, d):
    c = constraints(spark, d).select("constraint_id", F.explode("entity_list").alias("kbid"))
    return c.join(table(spark, d, "kg_entity"), "kbid").select("constraint_id", "kbid", "popular", F.get("names", F.lit(0)).alias("first_name"))


@R.add("SELECT kbid, CAST(t AS INT) AS type FROM (SELECT kbid, unnest(types) AS t FROM kg_entity) WHERE t IS NOT NULL")
def sc07_entity_types(spark, d):
    return table(spark, d, "kg_entity").select("kbid", F.explode("types").alias("type")).where("type is not null")


@R.add(f"WITH {_NAMES}, k AS (SELECT DISTINCT lower(trim(name)) AS name FROM kg_name WHERE trim(name) <> '') SELECT k.name, count(nm.kbid) AS candidates, string_agg(nm.kbid, ',' ORDER BY nm.kbid) AS kbids FROM k LEFT JOIN nm USING (name) GROUP BY 1")
def sc08_mention_candidates(spark, d):
    k = table(spark, d, "kg_name").select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    j = k.join(entity_names(spark, d), "name", "left").groupBy("name").agg(F.count("kbid").alias("candidates"), F.array_join(F.array_sort(F.collect_list("kbid")), ",").alias("kbids"))
    return j.withColumn("kbids", F.when(F.col("candidates") > 0, F.col("kbids")))


@R.add("SELECT kbid, names[1] AS name FROM kg_entity WHERE len(names) > 0")
def sc08c_first_name(spark, d):
    return table(spark, d, "kg_entity").where(F.size("names") > 0).select("kbid", F.col("names")[0].alias("name"))


@R.add("SELECT DISTINCT sentence_index FROM search_sentence WHERE category = 'sports' AND entity_len >= 2 AND sentence_index IS NOT NULL")
def sc09_sentence_set(spark, d):
    return table(spark, d, "search_sentence").where("category = 'sports' and entity_len >= 2 and sentence_index is not null").select("sentence_index").distinct()


@R.add(f"WITH {S_SQL} SELECT _id, news_date FROM s WHERE category = 'sports' ORDER BY news_date DESC, _id LIMIT 50")
def sc10_newest_50(spark, d):
    return sentences(spark, d).where("category = 'sports'").select("_id", "news_date").orderBy(F.desc("news_date"), "_id").limit(50)


@R.add(f"WITH {TERM_SQL}, w AS (SELECT DISTINCT lower(unnest(string_split(title, ' '))) AS word FROM documents WHERE doc_id % {QUERY_STEP} = 0) SELECT word, _id, count(*) AS tf FROM term JOIN w USING (word) GROUP BY ALL")
def sc11_posting_lists(spark, d):
    w = table(spark, d, "documents").where(F.col("doc_id") % QUERY_STEP == 0).select(F.explode(F.split(F.lower("title"), " ")).alias("word")).distinct()
    return I.term_frequencies(terms(spark, d)).join(w, "word", "left_semi").select("word", "_id", "tf")


@R.add(f"WITH {S_SQL} SELECT sentence_index, _id, raw_sentence FROM s WHERE sentence_index % {QUERY_STEP} = 0")
def sc11b_sentence_by_index(spark, d):
    s = sentences(spark, d)
    want = s.where(F.col("sentence_index") % QUERY_STEP == 0).select("sentence_index").distinct()
    return s.join(want, "sentence_index").select("sentence_index", "_id", "raw_sentence")


@R.add("SELECT max(CAST(strftime(ts, '%Y%m%d') AS INT)) AS version, count(*) AS rows FROM events WHERE strftime(ts, '%Y%m%d') = (SELECT max(strftime(ts, '%Y%m%d')) FROM events)")
def sc12_newest_version(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").cast("int").alias("day"))
    return e.groupBy("day").agg(F.count("*").alias("rows")).agg(F.max("day").alias("version"), F.max_by("rows", "day").alias("rows"))


@R.add(f"WITH {TERM_SQL}, p AS (SELECT word, _id AS doc, count(*) AS tf FROM term GROUP BY ALL) SELECT word, sentence_index AS sentence, tf FROM p JOIN s ON s._id = p.doc WHERE sentence_index IS NOT NULL")
def sc14_postings_codec(spark, d):
    """Encode every word's postings as 8-byte values and decode them again."""
    s = sentences(spark, d).where("sentence_index is not null").select("_id", "sentence_index")
    p = I.term_frequencies(terms(spark, d)).join(s, "_id").select("word", I.encode_posting(F.col("sentence_index"), F.col("tf")).alias("b"))
    return p.select("word", F.explode(I.decode_postings(F.col("b"))).alias("p")).select("word", "p.sentence", F.col("p.tf").cast("bigint").alias("tf"))


@R.add(
    """WITH t AS (SELECT DISTINCT n_chars AS off FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT off, row_number() OVER (ORDER BY off) - 1 AS i FROM t)
SELECT off FROM r WHERE i % 100 = 0 UNION ALL SELECT -1"""
)
def sc17_block_index(spark, d):
    """Every 100th distinct offset, and -1 for the end."""
    t = table(spark, d, "documents").where("n_chars is not null").select(F.col("n_chars").alias("off")).distinct()
    return add_dense_ids(t, ["off"], "i").where("i % 100 = 0").select("off").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("off")))


@R.add(r"SELECT DISTINCT page_id, page_title AS title FROM page WHERE page_namespace = 0 AND NOT contains(page_title, '''')")
def sc19_sql_dump(spark, d):
    """Pages written as INSERT tuples, read back as id and title of namespace 0."""
    p = table(spark, d, "page").where("page_title is not null and not contains(page_title, \"'\")")
    line = p.select(F.concat(F.lit("INSERT INTO `page` VALUES "), F.format_string("(%d,%d,'%s',0)", "page_id", "page_namespace", "page_title"), F.lit(";")).alias("line"))
    from textloom.sources.readers import page_dump_tuples

    return page_dump_tuples(line, "line").where("namespace = 0").select(F.col("id").alias("page_id"), "title").distinct()


@R.add("SELECT DISTINCT page_latest AS at, page_id AS id, page_title AS title FROM page WHERE page_title IS NOT NULL AND page_latest IS NOT NULL")
def sc20_index_lines(spark, d):
    from textloom.sources.readers import index_lines

    p = table(spark, d, "page").where("page_title is not null and page_latest is not null")
    return index_lines(p.select(F.concat_ws(":", "page_latest", "page_id", "page_title").alias("line")), "line").distinct()


@R.add("SELECT DISTINCT kbid, name FROM (SELECT kbid, unnest(names) AS name FROM kg_entity) WHERE NOT contains(name, '|') AND NOT contains(name, '}') AND name <> ''")
def sc27_bracket_pairs(spark, d):
    """Values of the form {{name||id}}, several in one text, read back as pairs."""
    e = table(spark, d, "kg_entity").select("kbid", F.explode("names").alias("name")).where("not contains(name, '|') and not contains(name, '}') and name <> ''")
    text = e.groupBy("kbid").agg(F.array_join(F.collect_list(F.concat(F.lit("{{"), "name", F.lit("||"), "kbid", F.lit("}}"))), "; ").alias("t"))
    pair = F.explode(F.regexp_extract_all("t", F.lit(r"\{\{(.*?\|\|.*?)\}\}"), F.lit(1)))
    parts = text.select(pair.alias("p")).select(F.split("p", r"\|\|").alias("p"))
    return parts.select(F.col("p")[1].alias("kbid"), F.col("p")[0].alias("name")).distinct()


@R.add("SELECT source AS label, CAST(dense_rank() OVER (ORDER BY first_seen) - 1 AS BIGINT) AS label_id FROM (SELECT source, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def sc32_label_ids(spark, d):
    """Labels numbered as they first appear."""
    f = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("first_seen"))
    return add_dense_ids(f, ["first_seen"], "label_id").select(F.col("source").alias("label"), "label_id")


@R.add("SELECT doc_id, n_chars, round((n_chars - mn) / (mx - mn)::DOUBLE, 6) AS scaled FROM documents, (SELECT min(n_chars) AS mn, max(n_chars) AS mx FROM documents) WHERE n_chars IS NOT NULL")
def sc29_scaled_scores(spark, d):
    docs = table(spark, d, "documents").where("n_chars is not null")
    ends = docs.agg(F.min("n_chars").alias("mn"), F.max("n_chars").alias("mx"))
    return docs.join(F.broadcast(ends)).select("doc_id", "n_chars", F.round((F.col("n_chars") - F.col("mn")) / (F.col("mx") - F.col("mn")), 6).alias("scaled"))


@R.add(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l)
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines FROM b WHERE trim(line) <> '' GROUP BY 1, 2"""
)
def sc38_blank_line_blocks(spark, d):
    from textloom.sources.readers import blank_line_blocks

    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "line"))
    return blank_line_blocks(lines, "doc_id", "i", "line").groupBy("doc_id", "block").agg(F.count("*").alias("lines"))


# --- predicates


@R.add(
    f"""WITH {S_SQL}, {C_SQL}, se AS (SELECT DISTINCT _id, lower(trim(e)) AS kbid FROM (SELECT _id, unnest(entity_set) AS e FROM s) WHERE trim(e) <> ''),
st AS (SELECT DISTINCT _id, unnest(topic_category) AS topic FROM s), q AS (SELECT *, constraint_id IN (SELECT constraint_id FROM ce) AS named, constraint_id IN (SELECT constraint_id FROM ct) AS themed FROM c WHERE constraint_id % {QUERY_STEP} = 0),
me AS (SELECT DISTINCT ce.constraint_id, se._id FROM ce JOIN se USING (kbid) WHERE ce.constraint_id % {QUERY_STEP} = 0),
mt AS (SELECT DISTINCT ct.constraint_id, st._id FROM ct JOIN st USING (topic) WHERE ct.constraint_id % {QUERY_STEP} = 0)
SELECT q.constraint_id, s._id FROM q CROSS JOIN s LEFT JOIN me ON me.constraint_id = q.constraint_id AND me._id = s._id LEFT JOIN mt ON mt.constraint_id = q.constraint_id AND mt._id = s._id
WHERE (q.named OR q.themed OR q.source IS NOT NULL OR q.category IS NOT NULL OR q.days_ago IS NOT NULL OR q.entity_number IS NOT NULL OR (q.sentence_length_max IS NOT NULL AND q.sentence_length_min IS NOT NULL) OR q.sentence_position IS NOT NULL)
AND (NOT q.named OR me._id IS NOT NULL) AND (NOT q.themed OR mt._id IS NOT NULL)
AND (q.source IS NULL OR lower(trim(s.source)) = q.source) AND (q.category IS NULL OR s.category = q.category)
AND (q.days_ago IS NULL OR s.news_date >= CAST(strftime(DATE '2022-07-12' - CAST(q.days_ago AS INT), '%Y%m%d') AS INT))
AND (q.entity_number IS NULL OR s.entity_len >= q.entity_number)
AND (q.sentence_length_max IS NULL OR q.sentence_length_min IS NULL OR s.sentence_length BETWEEN q.sentence_length_min AND q.sentence_length_max)
AND (q.sentence_position IS NULL OR s.sentence_position <= q.sentence_position)"""
)
def pf01_constraint_search(spark, d):
    """The stated query set of requests (ids divisible by 20), with and without entities, against all sentences."""
    return I.match_constraints(constraints(spark, d).where(F.col("constraint_id") % QUERY_STEP == 0), sentences(spark, d), TODAY)


@R.add(f"WITH {C_SQL} SELECT constraint_id, CASE WHEN days_ago > 30 THEN 'newest' ELSE 'search' END AS route FROM c")
def pf03_date_route(spark, d):
    return constraints(spark, d).select("constraint_id", F.when(F.col("days_ago") > 30, "newest").otherwise("search").alias("route"))


@R.add(f"WITH {TERM_SQL} SELECT word, count(*) AS n FROM term GROUP BY word")
def pf07_token_filter(spark, d):
    return terms(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, category FROM documents WHERE category NOT IN ('game', 'tv')")
def pf08_category_exclusion(spark, d):
    return table(spark, d, "documents").where(~F.col("category").isin("game", "tv")).select("doc_id", "category")


@R.add(
    """SELECT DISTINCT doc_id FROM documents WHERE news_date >= 20210601 AND ((source = 'lantern_wire' AND category = 'sports') OR source = 'nebula_wiki' OR (source = 'amber_talk' AND category = 'music'))"""
)
def pf09_source_rules(spark, d):
    rules = spark.createDataFrame([("lantern_wire", "sports"), ("nebula_wiki", None), ("amber_talk", "music")], "source string, rule string")  # three rules
    docs = table(spark, d, "documents").where("news_date >= 20210601")
    return docs.join(F.broadcast(rules), "source").where("rule is null or rule = category").select("doc_id").distinct()


@R.add("SELECT kbid FROM kg_entity WHERE types IS NULL OR len(types) = 0 OR len(list_filter(types, lambda t: t NOT IN (39, 58, 63))) > 0")
def pf10_type_exclusion(spark, d):
    excluded = F.array(*[F.lit(x) for x in (39, 58, 63)])
    t = F.col("types")
    return table(spark, d, "kg_entity").where(t.isNull() | (F.size(t) == 0) | (F.size(F.array_except(t, excluded)) > 0)).select("kbid")


@R.add("SELECT kbid, CASE WHEN list_contains(types, 58) THEN true ELSE false END AS wanted FROM kg_entity")
def pf13_desired_type(spark, d):
    return table(spark, d, "kg_entity").select("kbid", F.coalesce(F.array_contains("types", 58), F.lit(False)).alias("wanted"))


@R.add(f"WITH {S_SQL} SELECT _id FROM s WHERE len(tokens) > 40")
def pf15_length_filter(spark, d):
    return sentences(spark, d).where(F.size("tokens") > 40).select("_id")


@R.add(f"WITH {S_SQL}, {C_SQL}, se AS (SELECT DISTINCT lower(trim(e)) AS kbid FROM (SELECT unnest(entity_set) AS e FROM s)) SELECT DISTINCT kbid FROM ce WHERE kbid NOT IN (SELECT kbid FROM se WHERE kbid IS NOT NULL)")
def pf20_dangling_references(spark, d):
    used = sentences(spark, d).select(F.explode("entity_set").alias("e")).select(F.lower(F.trim("e")).alias("kbid")).distinct()
    return constraints(spark, d).select(F.explode("entity_list").alias("kbid")).distinct().join(used, "kbid", "left_anti")


# --- index


@R.add(f"WITH {TERM_SQL} SELECT word, count(DISTINCT docid) AS df FROM term GROUP BY word")
def ag01_document_frequency(spark, d):
    return I.document_frequencies(terms(spark, d), "docid")


@R.add(f"WITH {TERM_SQL}, f AS (SELECT word, count(DISTINCT docid) AS df FROM term GROUP BY word UNION ALL SELECT '<UNKNOWN>', 100), n AS (SELECT count(DISTINCT docid) AS n FROM s) SELECT word, df, round(greatest(0.0::DOUBLE, ln(greatest((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE), 1e-300))), 6) AS idf FROM f, n")
def ag02_idf(spark, d):
    n = sentences(spark, d).select("docid").distinct().count()
    t = I.idf_table(I.document_frequencies(terms(spark, d), "docid"), n)
    return t.withColumn("idf", F.round(F.coalesce(F.when(F.lit(n) - F.col("df") + 0.5 > 0, F.col("idf")), F.lit(0.0)), 6))


@R.add(f"WITH {TERM_SQL}, w AS (SELECT DISTINCT word FROM term) SELECT word, row_number() OVER (ORDER BY word) AS id FROM w")
def ag03_vocabulary_ids(spark, d):
    return add_dense_ids(terms(spark, d).select("word").distinct(), ["word"], "id", 1)


@R.add(f"WITH {TERM_SQL} SELECT _id, word, count(*) AS tf FROM term GROUP BY ALL")
def ag04_term_frequency(spark, d):
    return I.term_frequencies(terms(spark, d))


@R.add(
    f"""WITH {TERM_SQL}, p AS (SELECT term.word, term._id AS doc, count(*) AS tf, max(s.import_date) AS day FROM term JOIN s ON s._id = term._id GROUP BY ALL),
u AS (SELECT word, doc, tf, 0 AS r FROM p WHERE day >= 20220101 UNION ALL SELECT word, doc, tf + 1, 1 FROM p)
SELECT word, doc, tf FROM (SELECT *, row_number() OVER (PARTITION BY word, doc ORDER BY r) AS rn FROM u) WHERE rn = 1"""
)
def ag05_merge_index(spark, d):
    """New postings before old ones: where both hold a posting, the new one stands."""
    day = sentences(spark, d).select("_id", F.col("import_date").alias("day"))
    p = I.term_frequencies(terms(spark, d)).join(day, "_id").withColumnRenamed("_id", "doc")
    return I.merge_postings([p.where("day >= 20220101"), p.withColumn("tf", F.col("tf") + 1)])


@R.add(f"WITH {TERM_SQL}, p AS (SELECT word, _id, count(*) AS tf FROM term GROUP BY ALL) SELECT word, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY word")
def ag06_index_summary(spark, d):
    return I.term_frequencies(terms(spark, d)).groupBy("word").agg(F.count("*").alias("postings"), F.sum("tf").alias("total"))


@R.add(f"WITH {TERM_SQL}, c AS (SELECT word, count(*) AS n FROM term GROUP BY word) SELECT word, n FROM c WHERE n > 2 ORDER BY n DESC, word LIMIT 1000")
def ag25_vocabulary(spark, d):
    c = terms(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n > 2")
    return c.orderBy(F.desc("n"), "word").limit(1000)


@R.add(f"WITH {S_SQL} SELECT source, count(*) AS n, CAST(sum(sentence_length) AS BIGINT) AS total, round(sum(sentence_length) / count(*)::DOUBLE, 6) AS average FROM s GROUP BY source")
def ag19_running_average(spark, d):
    """Totals of months, merged to an average per source, as a stored total and count would be."""
    s = sentences(spark, d).groupBy("source", F.floor(F.col("news_date") / 100).alias("month")).agg(F.count("*").alias("n"), F.sum("sentence_length").alias("total"))
    return s.groupBy("source").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("average", F.round(F.col("total") / F.col("n"), 6))


@R.add(f"WITH {TERM_SQL}, f AS (SELECT word, count(DISTINCT docid) AS df FROM term GROUP BY word HAVING count(DISTINCT docid) >= 2) SELECT term._id, term.pos_no, term.word, f.df FROM term JOIN f USING (word)")
def jn01_known_tokens(spark, d):
    t = terms(spark, d)
    f = I.document_frequencies(t, "docid").where("df >= 2")
    return t.join(f, "word").select("_id", "pos_no", "word", "df")


def _query_terms(spark, d):
    q = table(spark, d, "documents").where((F.col("doc_id") % QUERY_STEP == 0) & F.col("title").isNotNull())
    return q.select(F.col("doc_id").alias("query"), F.explode(F.split(F.lower("title"), " ")).alias("word")).where("word <> ''").distinct()


def _bm25(spark, d):
    """Scores of every query with every sentence it meets. Terms are counted once; only the queries' words get further."""
    tf = materialize(terms(spark, d).groupBy(F.col("_id").alias("doc"), "word").agg(F.count("*").alias("tf")), "terms")
    lengths = materialize(tf.groupBy("doc").agg(F.sum("tf").alias("length")), "lengths")
    average = lengths.agg(F.avg("length").alias("a")).first()["a"] or 1.0
    n = table(spark, d, "search_sentence").select("_id").distinct().count()
    q = _query_terms(spark, d)
    postings = materialize(tf.join(q.select("word").distinct(), "word", "left_semi"), "postings")
    idfs = postings.groupBy("word").agg(F.count("*").alias("df")).select("word", I.idf(n, "df").alias("idf"))
    return I.bm25_scores(q, postings, lengths, idfs, average), sentences(spark, d)


_BM25 = f"""{TERM_SQL}, n AS (SELECT count(*) AS n FROM s), l AS (SELECT _id, count(*) AS len FROM term GROUP BY 1), a AS (SELECT avg(len) AS a FROM l),
p AS (SELECT word, _id, count(*) AS tf FROM term GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT word, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM f, n),
q0 AS (SELECT DISTINCT doc_id AS query, lower(unnest(string_split(title, ' '))) AS word FROM documents WHERE doc_id % {QUERY_STEP} = 0 AND title IS NOT NULL),
q AS (SELECT query, word, idf FROM q0 JOIN i USING (word) WHERE word <> '' AND idf > 0), nq AS (SELECT query, sqrt(sum(idf * idf)) AS norm FROM q GROUP BY 1),
sc AS (SELECT q.query, p._id AS doc, sum(q.idf * 2.0::DOUBLE * p.tf / ((0.5::DOUBLE + 0.5::DOUBLE * l.len / a.a) + p.tf)) AS raw FROM q JOIN p USING (word) JOIN l ON l._id = p._id, a GROUP BY 1, 2),
bm AS (SELECT query, doc, round(raw / norm, 6) AS score FROM sc JOIN nq USING (query))"""


@R.add(f"WITH {_BM25}, r AS (SELECT bm.*, s.news_date, s.sentence_length, row_number() OVER (PARTITION BY query ORDER BY score DESC, s.news_date DESC, s.sentence_length DESC, doc) AS rank FROM bm JOIN s ON s._id = bm.doc) SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def tk01_bm25_top10(spark, d):
    """The flagship: titles of the stated query set as queries against all stored sentences, the ten best of each."""
    scores, s = _bm25(spark, d)
    scores = scores.withColumn("score", F.round("score", 6)).join(s.select(F.col("_id").alias("doc"), "news_date", "sentence_length"), "doc")
    best = I.top_k(scores, ["query"], [F.desc("score"), F.desc("news_date"), F.desc("sentence_length"), F.col("doc")], 10)
    return best.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


@R.add(f"WITH {_BM25} SELECT query, count(*) AS hits, round(max(score), 5) AS best FROM bm GROUP BY query")
def ma02_bm25_scores(spark, d):
    scores, _ = _bm25(spark, d)
    return scores.withColumn("score", F.round("score", 6)).groupBy("query").agg(F.count("*").alias("hits"), F.round(F.max("score"), 5).alias("best"))


@R.add(f"WITH {S_SQL} SELECT _id, row_number() OVER (ORDER BY docid, sentence_position, _id) - 1 + (SELECT max(sentence_index) + 1 FROM s) AS sentence_index FROM s WHERE sentence_index IS NULL")
def wn01_dense_sequence(spark, d):
    """Rows not yet numbered get the numbers behind the last one."""
    s = sentences(spark, d).select("_id", "docid", "sentence_position", "sentence_index")
    last = s.agg(F.max("sentence_index").alias("m")).first()["m"]
    open_rows = s.where("sentence_index is null").drop("sentence_index")
    return add_dense_ids(open_rows, ["docid", "sentence_position", "_id"], "sentence_index", (last if last is not None else -1) + 1).select("_id", "sentence_index")


# --- sets and sinks as semantics


@R.add("SELECT kbid AS id FROM kg_entity UNION SELECT DISTINCT kbid FROM kg_name")
def se01_union(spark, d):
    return table(spark, d, "kg_entity").select(F.col("kbid").alias("id")).unionByName(table(spark, d, "kg_name").select(F.col("kbid").alias("id"))).distinct()


@R.add(f"WITH {TERM_SQL} SELECT DISTINCT word FROM term JOIN s ON s._id = term._id WHERE s.import_date < 20220101 EXCEPT SELECT DISTINCT word FROM term JOIN s ON s._id = term._id WHERE s.import_date >= 20220101")
def se02_words_not_updated(spark, d):
    t = terms(spark, d).join(sentences(spark, d).select("_id", "import_date"), "_id")
    return t.where("import_date < 20220101").select("word").distinct().join(t.where("import_date >= 20220101").select("word"), "word", "left_anti")


@R.add("SELECT a.kbid AS a, len(list_intersect(list_distinct(a.types), [58, 63, 39])) AS common FROM kg_entity a WHERE a.types IS NOT NULL")
def se03_type_intersection(spark, d):
    t = F.array_intersect("types", F.array(*[F.lit(x) for x in (58, 63, 39)]))
    return table(spark, d, "kg_entity").where("types is not null").select(F.col("kbid").alias("a"), F.size(t).cast("long").alias("common"))


@R.add("SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(title, ' ')) AS word FROM documents WHERE category = 'sports' INTERSECT ALL SELECT unnest(string_split(title, ' ')) FROM documents WHERE category = 'music') GROUP BY word")
def se05_multiset_intersection(spark, d):
    w = lambda c: table(spark, d, "documents").where(F.col("category") == c).select(F.explode(F.split("title", " ")).alias("word"))
    return w("sports").intersectAll(w("music")).groupBy("word").agg(F.count("*").alias("n"))


@R.add("SELECT _id, import_date FROM (SELECT _id, import_date, row_number() OVER (PARTITION BY _id ORDER BY import_date) AS rn FROM search_sentence WHERE import_date >= 20220101) WHERE rn = 1 AND _id NOT IN (SELECT _id FROM search_sentence WHERE import_date < 20220101)")
def sk01_insert_if_absent(spark, d):
    """The rows of a new batch that the store doesn't hold, each id once."""
    from textloom.operators.stores import absent_rows

    t = table(spark, d, "search_sentence").select("_id", "import_date")
    return absent_rows(t.where("import_date >= 20220101"), t.where("import_date < 20220101"), "_id", "import_date")


@R.add("SELECT kbid, CASE WHEN popular IS NULL THEN 0 ELSE popular END AS popular FROM kg_entity")
def sk02_update_rows(spark, d):
    from textloom.operators.stores import updated_rows

    return updated_rows(table(spark, d, "kg_entity"), F.col("popular").isNull(), {"popular": F.lit(0)}).select("kbid", "popular")


@R.add("SELECT doc_id, title FROM documents WHERE title NOT IN (SELECT title FROM documents WHERE title IS NOT NULL AND news_date < 20210401)")
def sk11_resume_by_output(spark, d):
    docs = table(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", "title").join(docs.where("news_date < 20210401").select("title"), "title", "left_anti")


@R.add("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 3")
def sk12_keep_best(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return I.top_k(docs, ["source"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "n_chars")
