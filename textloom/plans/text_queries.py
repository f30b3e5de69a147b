"""Text functions over whole tables (ST*, PF6, PF16-17, WN12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.base import Registry
from textloom.runtime import table

R = Registry()
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_COLLAPSE = r"trim(regexp_replace({}, '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g'))"


def _names(spark, d):
    return table(spark, d, "kg_name").where("name is not null").select("name").distinct()


N = "n AS (SELECT DISTINCT name FROM kg_name WHERE name IS NOT NULL)"


@R.add(f"WITH {N} SELECT name, " + _COLLAPSE.format(r"replace(lower(name), '\', '')") + " AS mention FROM n")
def st01_strip_mention(spark, d):
    return _names(spark, d).select("name", T.strip_mention("name").alias("mention"))


@R.add(
    f"WITH {N} SELECT DISTINCT name, variant FROM (SELECT name, "
    + _COLLAPSE.format(r"""regexp_replace(name, ' \([^)]*\)|<[^)]*>|,|"|\.|''|:|-', '', 'g')""")
    + f" AS variant FROM n UNION ALL SELECT name, array_to_string(list_filter(string_split({_COLLAPSE.format('name')}, ' '), lambda w: w NOT IN ({_STOP})), ' ') FROM n)"
)
def st02_expand_mention(spark, d):
    return _names(spark, d).select("name", F.explode(T.expand_mention("name")).alias("variant"))


@R.add(
    f"""WITH {N}, l AS (SELECT DISTINCT CASE WHEN regexp_matches(name, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN replace(name, ' ', '') ELSE name END AS name FROM n),
v AS (SELECT * FROM l WHERE NOT regexp_matches(name, '^[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]') AND length(name) >= 2 AND NOT regexp_matches(name, '^[0-9]+$'))
SELECT DISTINCT entry FROM (SELECT name AS entry FROM v UNION ALL SELECT replace(name, '·', '-') FROM v WHERE contains(name, '·') UNION ALL SELECT replace(name, '·', '') FROM v WHERE contains(name, '·'))"""
)
def st03_lexicon(spark, d):
    s = _names(spark, d).select(T.strip_lexicon("name").alias("name")).where(T.is_valid_lexicon("name"))
    return s.select(F.explode(T.expand_lexicon("name")).alias("entry")).distinct()


@R.add("SELECT page_id, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM (SELECT DISTINCT page_id, trim(replace(page_title, '_', ' ')) AS t FROM page WHERE page_title IS NOT NULL)")
def st08_normalise_wikilink(spark, d):
    return table(spark, d, "page").where("page_title is not null").select("page_id", T.normalise_wikilink("page_title").alias("title")).distinct()


_ANSWER = _COLLAPSE.format(r"""regexp_replace(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g')""")


@R.add("SELECT doc_id, " + _ANSWER.replace("{}", "title").replace("{{", "{").replace("}}", "}") + " AS answer FROM documents WHERE title IS NOT NULL")
def st11_normalize_answer(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", T.normalize_answer("title").alias("answer"))


def _nested_replace(column, pairs):
    for a, b in pairs:
        column = "replace({}, '{}', '{}')".format(column, a.replace("'", "''"), b.replace("'", "''"))
    return column


@R.add(f"SELECT doc_id, md5({_nested_replace('text', T.CLEAN_UP)}) AS cleaned FROM documents WHERE text IS NOT NULL")
def st12_clean_up(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.clean_up_tokenization("text")).alias("cleaned"))


@R.add(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[—–―]', '-', 'g'), '…', '...', 'g'), '´', '''', 'g'),
'(-+|~+|!+|"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)', ' \1 ', 'g'), '[ \t\r\f]*\n[ \t\r\f\n]*', chr(32) || chr(10) || chr(32), 'g'), '[ \t\r\f]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS standard
FROM documents WHERE text IS NOT NULL"""
)
def st13_text_standardize(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.text_standardize("text")).alias("standard"))


@R.add("SELECT doc_id, length(translate(title, '｀＇ ', '“”')) AS n, translate(title, '｀＇ ', '“”') AS joined FROM documents WHERE title IS NOT NULL")
def st18_characters(spark, d):
    c = T.characters("title")
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.size(c).cast("long").alias("n"), F.array_join(c, "").alias("joined"))


@R.add(
    """SELECT doc_id, array_to_string(list_transform(string_split(replace(title, '  ', ' '), ' '), lambda w: CASE WHEN length(w) = 1 THEN 'S' WHEN length(w) >= 2 THEN 'B' || repeat('M', length(w) - 2) || 'E' ELSE '' END), '') AS labels
FROM documents WHERE title IS NOT NULL"""
)
def st19_segment_labels(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.array_join(T.segment_labels("title"), "").alias("labels"))


@R.add("SELECT doc_id, s AS piece, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？]*[。！？]|[^。！？]+$')) AS s FROM documents WHERE text IS NOT NULL) WHERE s <> '' GROUP BY ALL")
def st21_chinese_sentences(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(T.chinese_sentences("text")).alias("piece"))
    return s.groupBy("doc_id", "piece").agg(F.count("*").alias("n"))


@R.add(
    r"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS toks FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(title,
'([\p{P}\p{S}])', ' \1 ', 'g'), ' ([ʼ’‘´′'']) ', '\1', 'g'), '[\s\x{A0}\x{3000}]+', ' ', 'g')), ' '), lambda w: w <> '') AS t FROM documents WHERE title IS NOT NULL)"""
)
def st23_unitok(spark, d):
    t = T.unitok("title")
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("toks"))


@R.add(r"SELECT doc_id, regexp_replace(lower(text), '[^\x{4E00}-\x{9FD5}a-zA-Z0-9]', '', 'g') AS kept FROM documents WHERE text IS NOT NULL")
def st32_letters_only(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.letters_only("text").alias("kept"))


@R.add("SELECT doc_id, regexp_extract(text, '^[^。.，,（(]*') AS clause FROM documents WHERE text IS NOT NULL")
def st35_first_clause(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.first_clause("text").alias("clause"))


@R.add(
    """SELECT docid, string_agg('<br>' || raw_sentence, '' ORDER BY sentence_position, _id) AS html FROM
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY import_date DESC, token_number DESC NULLS LAST) AS rn FROM search_sentence) WHERE rn = 1) WHERE raw_sentence <> '' GROUP BY docid"""
)
def st37_html_lines(spark, d):
    from textloom.plans.base import sentences

    s = sentences(spark, d).select("docid", F.struct("sentence_position", "_id", "raw_sentence").alias("r"))
    per = s.groupBy("docid").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return per.select("docid", T.html_with_breaks(F.transform("r", lambda x: x["raw_sentence"])).alias("html"))


@R.add("SELECT DISTINCT kbid, printf('%07d', CAST(substr(kbid, 2) AS BIGINT)) AS run_id, concat_ws(chr(9), kbid, coalesce(names[1], ''), CAST(popular AS VARCHAR)) AS tab FROM kg_entity")
def st38_tab_format(spark, d):
    e = table(spark, d, "kg_entity")
    run = F.format_string("%07d", F.expr("cast(substring(kbid, 2) as bigint)"))
    return e.select("kbid", run.alias("run_id"), F.concat_ws("\t", "kbid", F.coalesce(F.get("names", F.lit(0)), F.lit("")), F.col("popular").cast("string")).alias("tab")).distinct()


@R.add("SELECT doc_id, len(string_split(title, ' ')) AS n FROM documents WHERE title IS NOT NULL")
def st42_space_tokens(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.size(F.split("title", " ")).cast("long").alias("n"))


@R.add(r"SELECT doc_id, regexp_matches(text, '[\x{4E00}-\x{9FFF}]') AS chinese FROM documents WHERE text IS NOT NULL")
def pf16_contains_chinese(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.contains_chinese("text").alias("chinese"))


@R.add(
    """SELECT doc_id, CASE WHEN contains(title, '不') THEN contains(text, '不') WHEN contains(title, '没') THEN contains(text, '没') ELSE true END AS agrees
FROM documents WHERE title IS NOT NULL AND text IS NOT NULL"""
)
def pf17_confirm_negation(spark, d):
    return table(spark, d, "documents").where("title is not null and text is not null").select("doc_id", T.confirm_negation("title", "text").alias("agrees"))


@R.add(
    """SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(0, greatest(len(w) - 1, 0)), lambda i: w[i + 1] || '_' || w[i + 2])) AS gram
FROM (SELECT string_split(title, ' ') AS w FROM documents WHERE title IS NOT NULL)) GROUP BY gram"""
)
def wn12_ngrams(spark, d):
    g = table(spark, d, "documents").where("title is not null").select(F.explode(T.ngrams(F.split("title", " "), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, concat_ws(chr(10), title, text) AS body FROM documents")
def cs01_document_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", "title", "text").alias("body"))


@R.add(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '[ \t\n\r\f]+', ' ', 'g'), ' '), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL")
def cs17_whitespace_tokens(spark, d):
    w = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("long").alias("n"))


@R.add(r"SELECT page_id, page_title AS title FROM (SELECT DISTINCT page_id, page_title FROM page WHERE page_title <> '' AND NOT starts_with(page_title, 'File:') AND NOT starts_with(page_title, 'Image:'))")
def pf04_filter_title(spark, d):
    t = F.col("page_title")
    return table(spark, d, "page").where((t != "") & ~t.startswith("File:") & ~t.startswith("Image:")).select("page_id", t.alias("title")).distinct()


@R.add("SELECT vec_id, list_reduce(list_transform(embedding, lambda x: abs(x::DOUBLE)), lambda a, b: a + b) > 0 AS nonzero, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2 FROM embeddings")
def ma03_norms(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    l1 = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    l2 = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", (l1 > 0).alias("nonzero"), F.round(l1, 6).alias("l1"), F.round(l2, 6).alias("l2"))


@R.add("SELECT doc_id, CAST(floor(n_chars / 1024.0) AS BIGINT) AS kb FROM documents WHERE n_chars IS NOT NULL")
def ma06_size_units(spark, d):
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", F.floor(F.col("n_chars") / 1024).alias("kb"))


@R.add("SELECT doc_id, CAST(strftime(fetched_at - INTERVAL 36 HOUR, '%Y%m%d') AS INT) AS since FROM documents WHERE fetched_at IS NOT NULL")
def dt01_relative_date(spark, d):
    return table(spark, d, "documents").where("fetched_at is not null").select("doc_id", F.date_format(F.col("fetched_at") - F.expr("interval 36 hours"), "yyyyMMdd").cast("int").alias("since"))


@R.add(
    """SELECT DISTINCT page_id, coalesce(TRY_CAST(substr(page_touched, 1, 8) AS INT), 19700101) AS day, lpad(CAST(CAST(substr(page_touched, 5, 2) AS INT) AS VARCHAR), 2, '0') AS month FROM page WHERE length(page_touched) = 14"""
)
def dt02_date_parts(spark, d):
    p = table(spark, d, "page").where("length(page_touched) = 14")
    return p.select("page_id", F.expr("coalesce(try_cast(substring(page_touched, 1, 8) as int), 19700101)").alias("day"), F.lpad(F.expr("cast(cast(substring(page_touched, 5, 2) as int) as string)"), 2, "0").alias("month")).distinct()


@R.add("SELECT kbid, sha256('kg:' || kbid) || '.' || sha256(coalesce(raw, '')) AS file FROM kg_entity")
def cd02_url_to_filename(spark, d):
    return table(spark, d, "kg_entity").select("kbid", F.concat(F.sha2(F.concat(F.lit("kg:"), "kbid"), 256), F.lit("."), F.sha2(F.coalesce("raw", F.lit("")), 256)).alias("file"))
