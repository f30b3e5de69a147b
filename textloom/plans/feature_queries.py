"""Feature arrays and sequence windows (AR1-15, WN5-6, WN9-11, WN16, MA9-10, AG25, DT, ML4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import features as X
from textloom.plans.base import S_SQL, TOK_SQL, Registry, sentences, tokens
from textloom.runtime import add_dense_ids, table

R = Registry()
#: Words as numbers: a stable hash into a fixed range, the same in both engines.
_WORDS = "w AS (SELECT doc_id, list_filter(string_split(title, ' '), lambda x: x <> '') AS a, list_filter(string_split(coalesce(category, ''), ' '), lambda x: x <> '') AS b FROM documents WHERE title IS NOT NULL), ids AS (SELECT doc_id, list_transform(a, lambda x: length(x) + 1000) AS a, list_transform(list_concat(b, a), lambda x: length(x) + 2000) AS b FROM w)"


def _ids(spark, d):
    t = table(spark, d, "documents").where("title is not null")
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    t = t.select("doc_id", words("title").alias("a"), words(F.coalesce("category", F.lit(""))).alias("b"))
    return t.select("doc_id", F.transform("a", lambda x: F.length(x) + 1000).alias("a"), F.transform(F.concat("b", "a"), lambda x: F.length(x) + 2000).alias("b"))


_CUT = "c AS (SELECT doc_id, a[1:least(len(a), greatest(13 - len(b), 7))] AS a, b[1:least(len(b), greatest(13 - len(a), 6))] AS b FROM ids), x AS (SELECT doc_id, list_concat(list_concat(list_concat([101], a), [102]), list_concat(b, [102])) AS ids, list_concat(list_transform(range(len(a) + 2), lambda i: 0), list_transform(range(len(b) + 1), lambda i: 1)) AS seg FROM c)"


@R.add(f"WITH {_WORDS}, {_CUT} SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(16 - len(ids)), lambda i: 0)), ' ') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(16 - len(ids)), lambda i: 0)), ' ') AS input_mask, array_to_string(list_concat(seg, list_transform(range(16 - len(ids)), lambda i: 0)), ' ') AS segment_ids FROM x")
def ar01_pair_features(spark, d):
    f = X.pair_features(F.col("a"), F.col("b"), 16)
    return _ids(spark, d).select("doc_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(n) for n, c in f.items()])


@R.add(f"WITH {_WORDS} SELECT doc_id, least(len(a), greatest(13 - len(b), 7)) AS la, least(len(b), greatest(13 - len(a), 6)) AS lb FROM ids")
def ar02_truncated_pair(spark, d):
    la, lb = X.truncated_sizes(F.size("a"), F.size("b"), 13)
    return _ids(spark, d).select("doc_id", la.cast("bigint").alias("la"), lb.cast("bigint").alias("lb"))


_SPANS = f"{S_SQL}, n AS (SELECT _id, len(tokens) AS n FROM s WHERE len(tokens) > 0), sp AS (SELECT _id, n, start // 8 AS span, start, least(16, n - start) AS size FROM (SELECT _id, n, unnest(range(0, n, 8)) AS start FROM n) WHERE start = 0 OR start - 8 + 16 < n)"


def _spans(spark, d):
    s = sentences(spark, d).where("size(tokens) > 0").select("_id", F.size("tokens").alias("n"))
    return s.select("_id", F.posexplode(X.doc_spans(F.col("n"), 16, 8)).alias("span", "x")).select("_id", "span", "x.start", "x.size")


@R.add(f"WITH {_SPANS} SELECT _id, span, start, size FROM sp")
def wn05_sliding_spans(spark, d):
    return _spans(spark, d).select("_id", *[F.col(c).cast("bigint").alias(c) for c in ("span", "start", "size")])


@R.add(f"WITH {_SPANS}, t AS (SELECT _id, span, start, size, unnest(range(start, start + size)) AS token FROM sp) SELECT _id, token, span FROM (SELECT *, row_number() OVER (PARTITION BY _id, token ORDER BY least(token - start, start + size - 1 - token) * 100 + size DESC, span) AS rn FROM t) WHERE rn = 1")
def wn06_max_context(spark, d):
    return X.max_context(_spans(spark, d), "_id").select("_id", F.col("token").cast("bigint").alias("token"), F.col("span").cast("bigint").alias("span"))


@R.add(f"WITH {S_SQL} SELECT docid, sentence_position, raw_sentence AS a, nxt AS b FROM (SELECT *, lead(raw_sentence) OVER (PARTITION BY docid ORDER BY sentence_position, _id) AS nxt FROM s) WHERE nxt IS NOT NULL")
def wn09_consecutive_pairs(spark, d):
    w = Window.partitionBy("docid").orderBy("sentence_position", "_id")
    return sentences(spark, d).withColumn("b", F.lead("raw_sentence").over(w)).where("b is not null").select("docid", "sentence_position", F.col("raw_sentence").alias("a"), "b")


@R.add()
def ar07_next_sentence(spark, d):
    """Half of the pairs with a line of another article, by hash."""
    s = sentences(spark, d).select("docid", F.col("_id").alias("at"), "raw_sentence")
    return X.next_sentence_pairs(s, "docid", "at", "raw_sentence")


@R.add()
def ar06_masked_tokens(spark, d):
    """15 % of each sentence's tokens masked, by hash."""
    t = tokens(spark, d).where("word is not null").select("_id", "pos_no", "word")
    return X.masked(t, "_id", "pos_no", "word")


@R.add(f"WITH {TOK_SQL}, t AS (SELECT docid, word, row_number() OVER (PARTITION BY docid ORDER BY _id, pos_no) - 1 AS i, lead(word) OVER (PARTITION BY docid ORDER BY _id, pos_no) AS nxt FROM tok WHERE word IS NOT NULL) SELECT docid, i // 35 AS batch, string_agg(word, ' ' ORDER BY i) AS data, string_agg(nxt, ' ' ORDER BY i) AS target FROM t WHERE nxt IS NOT NULL GROUP BY ALL")
def wn11_language_windows(spark, d):
    t = tokens(spark, d).where("word is not null").select("docid", F.struct("_id", "pos_no").alias("at"), "word")
    g = X.language_windows(t, "docid", "at", "word", 35)
    return g.select("docid", "batch", F.array_join("data", " ").alias("data"), F.array_join("target", " ").alias("target"))


@R.add()
def wn10_packed_chunks(spark, d):
    """Sentences of an article packed in order until a chunk reaches 64 tokens."""
    s = sentences(spark, d).groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("sentence_position", "_id", F.coalesce("token_number", F.lit(0)).cast("bigint").alias("n")))).alias("r"))
    z = s.select("docid", F.explode(F.arrays_zip(F.transform("r", lambda x: x["_id"]).alias("id"), X.packed_chunks(F.transform("r", lambda x: x["n"]), 64).alias("chunk"))).alias("z"))
    return z.select("docid", F.col("z")["id"].alias("_id"), F.col("z")["chunk"].alias("chunk"))


@R.add("SELECT doc_id, len(list_filter(string_split(regexp_replace(title, '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda x: x <> '')) AS words, length(title) AS chars FROM documents WHERE title <> ''")
def wn16_char_to_word(spark, d):
    """Words and characters by the map from characters to words."""
    m = X.char_to_word(F.col("title"))
    t = table(spark, d, "documents").where("title <> ''").select("doc_id", m.alias("m"))
    return t.select("doc_id", (F.array_max("m") + 1).cast("bigint").alias("words"), F.size("m").cast("bigint").alias("chars"))


@R.add(f"WITH {_WORDS} SELECT doc_id, array_to_string(list_concat(a, list_transform(range((SELECT max(len(a)) FROM ids) - len(a)), lambda i: 0)), ' ') AS padded, len(a) AS n FROM ids")
def ar08_padded(spark, d):
    i = _ids(spark, d)
    most = i.agg(F.max(F.size("a")).alias("most"))
    p = F.concat("a", F.array_repeat(F.lit(0), F.col("most") - F.size("a")))
    return i.join(F.broadcast(most)).select("doc_id", F.array_join(F.transform(p, lambda x: x.cast("string")), " ").alias("padded"), F.size("a").cast("bigint").alias("n"))


@R.add(f"WITH {TOK_SQL}, v AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM (SELECT word FROM tok WHERE word IS NOT NULL GROUP BY word HAVING count(*) > 5)) SELECT tok._id, pos_no, coalesce(v.id, 1) AS id FROM tok LEFT JOIN v USING (word)")
def ar09_token_ids(spark, d):
    t = tokens(spark, d)
    v = add_dense_ids(t.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where("n > 5").select("word"), ["word"], "id", 2)
    return t.join(v, "word", "left").select("_id", F.col("pos_no").cast("bigint").alias("pos_no"), F.coalesce("id", F.lit(1)).alias("id"))


@R.add("SELECT label, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label HAVING count(*) >= 2")
def ar11_label_groups(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("vec_id")).alias("m")).where("n >= 2")
    return g.select("label", "n", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@R.add()
def ar10_positive_negative(spark, d):
    """For each vector a positive of its label and a negative of another, by hash."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.withColumn("h", F.xxhash64("vec_id", F.lit(7)))
    w = Window.partitionBy("label").orderBy("h", "vec_id")
    pos = n.withColumn("positive", F.coalesce(F.lead("vec_id").over(w), F.first("vec_id").over(w))).where("positive <> vec_id")
    firsts = n.groupBy("label").agg(F.min_by("vec_id", "h").alias("negative"))  # a row per label
    other = firsts.select(F.col("label").alias("other"), "negative")
    best = Window.partitionBy("vec_id").orderBy(F.xxhash64("vec_id", "other"))
    j = pos.join(F.broadcast(other), F.col("label") != F.col("other")).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return j.select("vec_id", "label", "positive", "negative")


@R.add("SELECT doc_id, title || ' <eos>' AS line FROM documents WHERE title IS NOT NULL")
def ar12_lines_with_end(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.array_join(F.concat(F.split("title", " "), F.array(F.lit("<eos>"))), " ").alias("line"))


@R.add(f"WITH {TOK_SQL} SELECT _id, pos_no, word, string_agg(coalesce(word, ''), ' ') OVER (PARTITION BY _id ORDER BY pos_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM tok")
def wn04_context_window(spark, d):
    w = Window.partitionBy("_id").orderBy("pos_no").rowsBetween(-2, 2)
    return tokens(spark, d).select("_id", F.col("pos_no").cast("bigint").alias("pos_no"), "word", F.array_join(F.collect_list(F.coalesce("word", F.lit(""))).over(w), " ").alias("around"))


@R.add(f"WITH {S_SQL} SELECT _id, coalesce(CAST(sum(length(x) + 1) OVER (PARTITION BY _id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b, x AS word FROM (SELECT _id, unnest(string_split(raw_sentence, ' ')) AS x, unnest(range(len(string_split(raw_sentence, ' ')))) AS i FROM s)")
def st39_token_spans(spark, d):
    """Where each word of a sentence begins."""
    t = sentences(spark, d).select("_id", F.posexplode(F.split("raw_sentence", " ")).alias("i", "word"))
    w = Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("_id", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)).alias("b"), "word")


_STEPS = "st AS (SELECT DISTINCT doc_id AS step FROM documents)"


@R.add(f"WITH {_STEPS} SELECT step, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE greatest(0, (1000 - step) / 900.0::DOUBLE) END, 6) AS linear, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE 1 END, 6) AS warmup, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE greatest(0, 0.5::DOUBLE * (1 + cos(pi() * 0.5::DOUBLE * 2 * ((step - 100) / 900.0::DOUBLE)))) END, 6) AS cosine FROM st")
def ma09_schedules(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("step")).distinct()
    f = lambda kind: F.round(X.learning_rate(F.col("step"), kind, 100, 1000), 6).alias(kind)
    return t.select("step", f("linear"), f("warmup"), f("cosine"))


@R.add(f"WITH {_STEPS} SELECT step, round(ln((step + 2) / (step + 1)::DOUBLE) / ln(1000001::DOUBLE), 9) AS p FROM st")
def ma10_log_uniform(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("step")).distinct().select("step", F.round(X.log_uniform(F.col("step"), 1_000_000), 9).alias("p"))


@R.add(f"WITH {TOK_SQL}, lx(word, emotion) AS (VALUES ('the', 'calm'), ('и', 'calm'), ('in', 'joy'), ('der', 'fear')) SELECT _id, emotion, count(*) AS n FROM tok JOIN lx USING (word) GROUP BY ALL")
def ml04_keyword_tags(spark, d):
    lexicon = spark.createDataFrame([("the", "calm"), ("и", "calm"), ("in", "joy"), ("der", "fear")], "word string, emotion string")  # a fixed lexicon
    return tokens(spark, d).join(F.broadcast(lexicon), "word").groupBy("_id", "emotion").agg(F.count("*").alias("n"))


@R.add(f"WITH {TOK_SQL} SELECT tok._id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos_no) AS words FROM tok WHERE coalesce(pos, '') <> 'wp' AND word IS NOT NULL GROUP BY _id")
def cs06_without_punctuation(spark, d):
    t = tokens(spark, d).where("coalesce(pos, '') <> 'wp' and word is not null").groupBy("_id").agg(F.count("*").alias("kept"), F.array_sort(F.collect_list(F.struct("pos_no", "word"))).alias("r"))
    return t.select("_id", "kept", F.array_join(F.transform("r", lambda x: x["word"]), " ").alias("words"))


@R.add("SELECT source, kept AS doc_id FROM (SELECT source, min(doc_id) AS kept FROM documents WHERE source IS NOT NULL GROUP BY source)")
def cs07_first_wins(spark, d):
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
