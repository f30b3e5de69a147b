"""Readers and writers of file formats: tables written in a format, read back, and held against the table (SC13-47, SK4-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import index as I
from textloom.operators import stores as ST
from textloom.plans.base import TERM_SQL, Registry, terms
from textloom.runtime import materialize, put_text, scratch_path, table
from textloom.sources import readers as RD

R = Registry()


def _text(df, *cols, sep="\t", name="lines"):
    """Rows as lines of a text folder."""
    path = scratch_path(df.sparkSession, name)
    df.select(F.concat_ws(sep, *cols).alias("value")).write.text(path)
    return path


def _nations(spark, d):
    """The rows of ``nation`` (a table of fixed size) in order, on the driver."""
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


@R.add("SELECT p_partkey AS word_id, p_partkey * 16 AS at, CAST(p_size AS BIGINT) AS size FROM part")
def sc13_index_file(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 16).alias("b"), F.col("p_size").alias("c"))
    return RD.index_file(spark, _text(t, "a", "b", "c"))


@R.add("SELECT CAST(count(*) OVER () AS BIGINT) AS n, CAST(n_nationkey AS BIGINT) AS token_id, n_name AS token, CAST(n_regionkey + 1 AS BIGINT) AS df FROM nation")
def sc15_document_frequency_file(spark, d):
    rows = _nations(spark, d)
    path = put_text(spark, scratch_path(spark, "df") + "/df", "\n".join([str(len(rows)), "a bad line", *(f"{r['n_nationkey']}\t{r['n_name']}\t{r['n_regionkey'] + 1}" for r in rows)]) + "\n")
    n, df = RD.df_file(spark, path)
    return df.select(F.lit(n).cast("bigint").alias("n"), "token_id", "token", "df")


@R.add("SELECT DISTINCT r_regionkey AS region FROM region")
def sc16_file_listing(spark, d):
    """A table written in a folder per region: which regions have a file."""
    path = scratch_path(spark, "files")
    table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(path)
    return RD.files(spark, path, r"r_regionkey=\d+/part-.*\.txt$").select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("region")).distinct()


@R.add("SELECT page_id AS id, page_title AS title, CASE WHEN page_is_redirect THEN page_title END AS redirect, page_id % 7 = 0 AS disambiguation, CASE WHEN page_id % 7 = 0 THEN 'see {{disambig}}' ELSE 'text' END AS text FROM page WHERE page_namespace = 0 AND page_title IS NOT NULL AND page_id IS NOT NULL")
def sc18_xml_pages(spark, d):
    t = table(spark, d, "page").where("page_title is not null and page_id is not null and page_namespace is not null")
    text = F.when(F.col("page_id") % 7 == 0, "see {{disambig}}").otherwise("text")
    x = t.select(F.col("page_id").alias("id"), F.col("page_namespace").alias("ns"), F.col("page_title").alias("title"), F.when(F.col("page_is_redirect"), F.struct(F.lit("").alias("_VALUE"), F.col("page_title").alias("_title"))).alias("redirect"), F.struct(F.struct(text.alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"))
    path = scratch_path(spark, "xml")
    x.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return RD.span_pages(spark, path)


@R.add("SELECT 'run' AS run, c_custkey::VARCHAR AS mention_id, c_name AS mention, 'doc' || c_nationkey AS doc, 3 AS begin, 3 + CAST(length(c_name) AS INT) AS end, CASE WHEN c_custkey % 3 <> 0 THEN 'm.' || c_custkey END AS kbid, 'PER' AS etype, 'NAM' AS mtype, 0.5::DOUBLE AS confidence FROM customer")
def sc24_tab_mentions(spark, d):
    t = table(spark, d, "customer")
    span = F.concat(F.lit("doc"), "c_nationkey", F.lit(":3-"), F.length("c_name") + 2)
    path = _text(t, F.lit("run"), "c_custkey", "c_name", span, F.when(F.col("c_custkey") % 3 == 0, "NIL0001").otherwise(F.concat(F.lit("m."), "c_custkey")), F.lit("PER"), F.lit("NAM"), F.lit("0.5"))
    return RD.tab_mentions(spark.read.text(path))


@R.add("SELECT CAST(n_regionkey AS VARCHAR) AS doc, n_nationkey * 10 AS begin, n_nationkey * 10 + 5 AS end, n_name AS text, 'GPE' AS etype FROM nation WHERE n_nationkey % 2 = 0")
def sc25_parser_json(spark, d):
    """One parser file per region; every second nation has a type that is mapped."""
    n = table(spark, d, "nation")
    m = F.struct(F.col("n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, "COUNTRY").otherwise("OTHER").alias("ner"), (F.col("n_nationkey") * 10).alias("characterOffsetBegin"), (F.col("n_nationkey") * 10 + 5).alias("characterOffsetEnd"))
    docs = n.groupBy(F.col("n_regionkey").cast("string").alias("docid")).agg(F.array(F.struct(F.collect_list(m).alias("entitymentions"))).alias("sentences"))
    path = scratch_path(spark, "parser")
    docs.withColumn("folder", F.col("docid")).write.partitionBy("folder").json(path)
    return RD.parsed_entities(spark, f"{path}/*", {"COUNTRY": "GPE"})


@R.add("SELECT n_name AS name, n_nationkey AS key FROM nation WHERE n_nationkey % 3 = 0")
def sc28_crawled_pairs(spark, d):
    """Records whose file name also stands in a second folder."""
    path = scratch_path(spark, "crawled")
    for r in _nations(spark, d):
        put_text(spark, f"{path}/first/{r['n_nationkey']}.json", f'{{"name": "{r["n_name"]}", "key": {r["n_nationkey"]}}}')
        if r["n_nationkey"] % 3 == 0:
            put_text(spark, f"{path}/second/{r['n_nationkey']}.json", '{"other": 1}')
    return RD.crawled_pairs(spark, f"{path}/first", f"{path}/second").select("name", F.col("key").cast("int").alias("key"))


@R.add("SELECT CAST(n_nationkey AS BIGINT) AS line_no, n_name AS s1, 'second ' || n_nationkey AS s2, CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def sc30_parallel_files(spark, d):
    rows = _nations(spark, d)
    path = scratch_path(spark, "parallel")
    put = lambda name, lines: put_text(spark, f"{path}/{name}", "\n".join(lines) + "\n")
    return RD.parallel_lines(spark, put("a", [r["n_name"] for r in rows]), put("b", [f" second {r['n_nationkey']}" for r in rows]), put("c", [str(r["n_regionkey"]) for r in rows]))


@R.add("SELECT s_name AS anchor, 'p' || s_nationkey AS positive, 'n' || s_suppkey AS negative FROM supplier")
def sc31_triplets(spark, d):
    path = _text(table(spark, d, "supplier"), "s_name", F.concat(F.lit("p"), "s_nationkey"), F.concat(F.lit("n"), "s_suppkey"))
    return RD.triplets(spark, path).select("anchor", "positive", "negative")


@R.add("SELECT CAST(n_nationkey + 1 AS BIGINT) AS line_no, n_name AS s1, 'with ' || n_name AS s2, n_regionkey % 3 AS label_id FROM nation WHERE n_regionkey % 3 < 2")
def sc33_labelled_pairs(spark, d):
    """A file with byte order mark and header; the third label isn't mapped."""
    names = {0: "no", 1: "yes", 2: "unsure"}
    lines = ["﻿id\ts1\ts2\tlabel", *(f"{r['n_nationkey']}\t{r['n_name']}\twith {r['n_name']}\t{names[r['n_regionkey'] % 3]}" for r in _nations(spark, d)), "short line"]
    return RD.labelled_pairs(spark, put_text(spark, scratch_path(spark, "pairs") + "/t", "\n".join(lines)), (1, 2, 3), {"no": 0, "yes": 1})


@R.add("SELECT c_name AS s1, c_mktsegment AS s2, c_nationkey % 10 AS label_id FROM customer")
def sc34_ten_classes(spark, d):
    path = _text(table(spark, d, "customer"), F.concat(F.lit("c"), F.col("c_nationkey") % 10), "c_name", "c_mktsegment")
    return RD.labelled_pairs(spark, path, (1, 2, 0), {f"c{i}": i for i in range(10)}, header=False).drop("line_no")


def _csv(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True, escape='"')
    return path


@R.add("SELECT p_partkey::VARCHAR AS id, p_name AS context, 'It, \"so\"' AS start, array_to_string([p_brand, p_type, 'x', 'y'], '|') AS endings, CAST(p_size % 4 AS INT) AS label FROM part")
def sc36_choice_file(spark, d):
    t = table(spark, d, "part")
    no = F.lit("-")
    df = t.select(no.alias("c0"), no.alias("c1"), F.col("p_partkey").alias("c2"), no.alias("c3"), F.col("p_name").alias("c4"), F.lit('It, "so"').alias("c5"), no.alias("c6"), F.col("p_brand").alias("c7"), F.col("p_type").alias("c8"), F.lit("x").alias("c9"), F.lit("y").alias("c10"), (F.col("p_size") % 4).alias("c11"))
    return RD.choice_examples(spark, _csv(df, "choices")).withColumn("endings", F.array_join("endings", "|"))


@R.add("SELECT p_name || ' a b c' AS story, p_brand AS ending_0, p_type AS ending_1, CAST(p_size % 2 AS INT) AS label FROM part")
def sc37_story_file(spark, d):
    t = table(spark, d, "part")
    df = t.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("s1"), F.lit("a").alias("s2"), F.lit("b").alias("s3"), F.lit("c").alias("s4"), F.col("p_brand").alias("e1"), F.col("p_type").alias("e2"), (F.col("p_size") % 2 + 1).alias("right"))
    return RD.story_endings(spark, _csv(df, "stories"))


_TITLE = "SELECT doc_id AS key, list_filter(string_split(title, ' '), lambda x: x <> '') AS t FROM documents WHERE title IS NOT NULL"


@R.add(f"WITH w AS ({_TITLE}) SELECT key, array_to_string(t[1:8], ' ') AS tokens, list_sum(list_transform(range(least(len(t), 8)), lambda i: CAST(i >= len(t) // 2 AS INT)))::BIGINT AS second, CAST(least(len(t), 8) AS INT) AS used, t[2] AS masked, key % 2 = 0 AS is_next FROM w WHERE len(t) > 1")
def sc39_instances(spark, d):
    """Titles as training instances of JSON lines: second half as second segment, the second word masked."""
    t = table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("key"), F.filter(F.split("title", " "), lambda x: x != "").alias("tokens")).where(F.size("tokens") > 1)
    half = F.floor(F.size("tokens") / 2)
    rows = t.select("key", "tokens", F.transform("tokens", lambda x, i: (i >= half).cast("int")).alias("segment_ids"), F.array(F.lit(1)).alias("masked_lm_positions"), F.array(F.col("tokens")[1]).alias("masked_lm_labels"), (F.col("key") % 2 != 0).alias("is_random_next"))
    path = scratch_path(spark, "instances")
    ST.dump(rows, path, "json")
    i = RD.instances(spark, path, 8)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return i.select("key", F.array_join("tokens", " ").alias("tokens"), total("segment_ids").cast("bigint").alias("second"), total("input_mask").alias("used"), F.col("lm_labels")[1].alias("masked"), "is_next")


@R.add("SELECT 'w' || vec_id AS word, CAST(len(embedding) AS INT) AS size, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings UNION ALL SELECT 'PADDING_TOKEN', CAST(max(len(embedding)) AS INT), 0 FROM embeddings")
def sc40_word_vectors(spark, d):
    e = table(spark, d, "embeddings")
    path = scratch_path(spark, "vectors")
    line = F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.transform("embedding", lambda x: x.cast("double").cast("string")))
    e.coalesce(1).select(line.alias("value")).write.text(path)
    return RD.word_vectors(spark, path, padding="PADDING_TOKEN").select("word", F.size("vector").alias("size"), F.round(F.col("vector")[0], 5).alias("first"))


@R.add("SELECT n_name AS token, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def sc42_vocabulary_file(spark, d):
    return RD.vocabulary(spark, put_text(spark, scratch_path(spark, "vocabulary") + "/v", "\n".join(r["n_name"] for r in _nations(spark, d))))


@R.add("SELECT 'r' || n_regionkey AS id, min(n_name) AS name FROM (SELECT n_regionkey, first(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1) GROUP BY 1")
def sc47_dialog_graph(spark, d):
    """Nodes named by region: of those with one id the first in the file stays."""
    nodes = ", ".join(f'{{"id": "r{r["n_regionkey"]}", "name": "{r["n_name"]}"}}' for r in _nations(spark, d))
    return RD.dialog_graph(spark, put_text(spark, scratch_path(spark, "graph") + "/g.json", f'{{"nodes": [{nodes}]}}'), "nodes", "struct<id:string,name:string>")


@R.add(f"WITH {TERM_SQL}, p AS (SELECT word, sentence_index AS sentence, least(count(*), 255) AS tf FROM term JOIN s USING (_id) WHERE sentence_index IS NOT NULL GROUP BY ALL) SELECT word, sentence, CAST(tf AS INT) AS tf FROM p")
def sk04_binary_index(spark, d):
    """Postings written as 8 bytes each, read back and decoded."""
    from textloom.plans.base import sentences

    at = sentences(spark, d).where("sentence_index is not null").select("_id", F.col("sentence_index").alias("sentence"))
    p = terms(spark, d).join(at, "_id").groupBy("word", "sentence").agg(F.count("*").cast("int").alias("tf"))
    kept = materialize(p.select("word", I.encode_posting(F.col("sentence"), F.col("tf")).alias("posting")), "postings")
    return kept.select("word", F.inline(I.decode_postings(F.col("posting"))))


@R.add("SELECT kind, s_name AS name, s_suppkey AS key, round(s_acctbal, 2) AS value FROM supplier, (SELECT unnest(['csv', 'html', 'json', 'tsv']) AS kind)")
def sk05_dumps(spark, d):
    """A table written as JSON lines, tab and comma files and table rows, and read back from each."""
    t = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.round("s_acctbal", 2).alias("value"))
    schema, out = t.schema, None
    for kind in ("csv", "html", "json", "tsv"):
        path = scratch_path(spark, f"dump-{kind}")
        ST.dump(t, path, kind)
        if kind == "html":
            cell = F.regexp_extract_all("value", F.lit("<td>([^<]*)</td>"), F.lit(1))
            back = spark.read.text(path).select(*[cell[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
        else:
            back = spark.read.schema(schema).json(path) if kind == "json" else spark.read.schema(schema).csv(path, sep="," if kind == "csv" else "\t", header=True, escape='"')
        back = back.withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@R.add("SELECT doc_id, CAST(len(list_filter(string_split(title, ' '), lambda x: x <> '')) AS INT) AS n, list_filter(string_split(title, ' '), lambda x: x <> '')[1] AS first FROM documents")
def sk06_array_records(spark, d):
    """Titles as arrays of words; a null title is an empty array."""
    path = scratch_path(spark, "arrays")
    ST.write_arrays(table(spark, d, "documents").select("doc_id", F.filter(F.split("title", " "), lambda x: x != "").alias("words")), path)
    back = spark.read.parquet(path)
    empty = F.size("words") == 0
    return back.select("doc_id", F.when(~empty, F.size("words")).alias("n"), F.get("words", F.lit(0)).alias("first"))


@R.add("SELECT n_nationkey AS key, n_name AS name FROM nation")
def sk07_reload(spark, d):
    """A store replaced by a table with unique keys."""
    path = scratch_path(spark, "store")
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    ST.reload_unique(t.limit(0), path, "key")
    ST.reload_unique(t, path, "key")
    return spark.read.parquet(path)


@R.add("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE c_name END AS name FROM customer")
def sk08_store_copy(spark, d):
    """A collection copied to a store that holds half its keys."""
    path = scratch_path(spark, "store")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    t.where("key % 2 = 0").withColumn("name", F.lit("old")).write.parquet(path)
    ST.append_absent(t, path, "key", "name")
    return spark.read.parquet(path)


@R.add("SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def sk10_event_logs(spark, d):
    """Events appended in two goes to logs of one folder a day."""
    path = scratch_path(spark, "logs")
    e = table(spark, d, "events").where("ts is not null").select("event_id", "ts", "event_type")
    for part in (0, 1):
        ST.append_daily(e.where(F.col("event_id") % 2 == part), path, "ts")
    back = spark.read.schema("event_id bigint, ts timestamp, event_type string, day int").csv(path, sep="\t")
    return back.groupBy("day", "event_type").agg(F.count("*").alias("n"))
