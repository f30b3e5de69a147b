"""Inverted index, document frequency and BM25 as DataFrame programs.

Nulls: a null word is no term; a sentence without terms has length 0 and matches nothing. Ties are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_frequencies(terms: DataFrame, doc: str = "_id", word: str = "word") -> DataFrame:
    """doc, word, tf (AG4): combined before the shuffle."""
    return terms.groupBy(doc, word).agg(F.count("*").alias("tf"))


def document_frequencies(terms: DataFrame, doc: str, word: str = "word") -> DataFrame:
    """word, df: documents that hold the word at least once (AG1)."""
    return terms.select(doc, word).distinct().groupBy(word).agg(F.count("*").alias("df"))


def idf(n: Column | int, df: Column | str) -> Column:
    """max(0, ln((N - df + 0.5) / (df + 0.5))) (AG2)."""
    n = F.lit(n) if isinstance(n, int) else n
    df = F.col(df) if isinstance(df, str) else df
    return F.greatest(F.lit(0.0), F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5))))


def idf_table(df_table: DataFrame, n_docs: int, unknown_df: int = 100) -> DataFrame:
    """word, df, idf, with a row ``<UNKNOWN>`` of the given df."""
    unknown = df_table.sparkSession.createDataFrame([("<UNKNOWN>", unknown_df)], "word string, df long")
    return df_table.select("word", "df").unionByName(unknown).withColumn("idf", idf(n_docs, "df"))


def merge_postings(parts: list[DataFrame]) -> DataFrame:
    """word, doc, tf of several postings tables; where two hold the same posting, the earlier in the list wins (AG5, AG6)."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("word", "doc", "tf", F.lit(i).alias("__rank"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("word", "doc").agg(F.min_by("tf", "__rank").alias("tf"))


def bm25_scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame, idfs: DataFrame, average: float, k1: float = 1.0, b: float = 0.5) -> DataFrame:
    """query, doc, score (MA2): sum of idf (k1 + 1) tf / (K + tf) over common words, divided by the query's idf norm.

    K = k1 (1 - b + b length / average). ``queries``: query, word (distinct); ``postings``: word, doc, tf; ``lengths``:
    doc, length; ``idfs``: word, idf. A query whose words all have idf 0 scores 0 and gives no rows.
    """
    q = queries.join(idfs, "word").where("idf > 0")
    norms = q.groupBy("query").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    hits = q.join(postings, "word").join(lengths, "doc")
    k = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.lit(average))
    part = F.col("idf") * F.lit(k1 + 1.0) * F.col("tf") / (k + F.col("tf"))
    return hits.groupBy("query", "doc").agg(F.sum(part).alias("raw")).join(norms, "query").select("query", "doc", (F.col("raw") / F.col("norm")).alias("score"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def encode_posting(sentence: Column, tf: Column) -> Column:
    """A posting as 8 bytes: 7 of the sentence number, big-endian, and 1 of the frequency (at most 255) (CD1, SK4)."""
    return F.unhex(F.concat(F.lpad(F.hex(sentence), 14, "0"), F.lpad(F.hex(F.least(tf, F.lit(255))), 2, "0")))


def decode_postings(data: Column) -> Column:
    """The postings of a binary value, as array<struct<sentence, tf>> (SC14); null gives null, an empty value an empty array."""
    n = F.floor(F.octet_length(data) / 8).cast("int")
    h = F.hex(data)
    return F.when(n.isNull(), None).when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.struct(
                F.conv(F.substr(h, i * 16 + 1, F.lit(14)), 16, 10).cast("bigint").alias("sentence"), F.conv(F.substr(h, i * 16 + 15, F.lit(2)), 16, 10).cast("int").alias("tf")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<sentence:bigint,tf:int>>"))


def search_predicate(c: dict, today: int) -> Column | None:
    """One request's constraints as a predicate over sentences (PF1); None if it has none."""
    parts = []
    if c.get("source"):
        parts.append(F.lower(F.trim("source")) == c["source"])
    if c.get("category"):
        parts.append(F.col("category") == c["category"])
    if c.get("entity_list"):
        parts.append(F.arrays_overlap("entity_set", F.array(*map(F.lit, c["entity_list"]))))
    if c.get("topic_category"):
        parts.append(F.arrays_overlap("topic_category", F.array(*map(F.lit, c["topic_category"]))))
    if c.get("days_ago"):
        parts.append(F.col("news_date") >= F.date_format(F.date_sub(F.to_date(F.lit(str(today)), "yyyyMMdd"), abs(c["days_ago"])), "yyyyMMdd").cast("int"))
    if c.get("entity_number"):
        parts.append(F.col("entity_len") >= c["entity_number"])
    if c.get("sentence_length_max") and c.get("sentence_length_min"):
        parts.append(F.col("sentence_length").between(c["sentence_length_min"], c["sentence_length_max"]))
    if c.get("sentence_position"):
        parts.append(F.col("sentence_position") <= c["sentence_position"])
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


#: Blocks of sentences each source, category or topic is dealt into, so that a large one doesn't sit in one task.
BLOCKS = 16


def match_constraints(requests: DataFrame, rows: DataFrame, today: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """constraint_id and _id (and the columns ``carry``) of every sentence each request allows (PF1 for all requests at once).

    Requests with entities meet sentences by entity; those without, by source, category or topic, whichever they have
    first, in blocks; those with bounds alone meet all sentences. The other constraints are tested on what meets. Only a
    request with no constraint at all is refused; a length counts as one if it has both ends.
    """
    r = requests.select("constraint_id", "source", "category", "entity_list", "topic_category", "days_ago", "entity_number", "sentence_length_max", "sentence_length_min", "sentence_position")
    s = rows.select("_id", F.lower(F.trim("source")).alias("s_source"), F.col("category").alias("s_category"), "entity_set", F.col("topic_category").alias("s_topics"), "news_date", "entity_len", "sentence_length", F.col("sentence_position").alias("s_position"), *[F.col(c).alias(f"c_{c}") for c in carry])
    since = F.date_format(F.date_sub(F.to_date(F.lit(str(today)), "yyyyMMdd"), F.col("days_ago")), "yyyyMMdd").cast("int")
    bounds = F.col("sentence_length_max").isNotNull() & F.col("sentence_length_min").isNotNull()
    rest = (
        (F.col("source").isNull() | (F.col("s_source") == F.col("source")))
        & (F.col("category").isNull() | (F.col("s_category") == F.col("category")))
        & (F.col("topic_category").isNull() | F.arrays_overlap("s_topics", "topic_category"))
        & (F.col("days_ago").isNull() | (F.col("news_date") >= since))
        & (F.col("entity_number").isNull() | (F.col("entity_len") >= F.col("entity_number")))
        & (~bounds | F.col("sentence_length").between(F.col("sentence_length_min"), F.col("sentence_length_max")))
        & (F.col("sentence_position").isNull() | (F.col("s_position") <= F.col("sentence_position")))
    )
    out = ["constraint_id", "_id", *[F.col(f"c_{c}").alias(c) for c in carry]]
    by_entity = r.where("entity_list is not null").withColumn("e", F.explode("entity_list")).join(s.withColumn("e", F.explode(F.array_distinct(F.transform("entity_set", lambda x: F.lower(F.trim(x)))))), "e")
    by_entity = by_entity.where(rest).select(*out).dropDuplicates(["constraint_id", "_id"])
    none = r.where("entity_list is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = s.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(BLOCKS)).cast("int"))
    by_source = none.where("source is not null").join(dealt, (F.col("source") == F.col("s_source")) & (none["block"] == dealt["block"]) & rest)
    by_category = none.where("source is null and category is not null").join(dealt, (F.col("category") == F.col("s_category")) & (none["block"] == dealt["block"]) & rest)
    topics = none.where("source is null and category is null and topic_category is not null").withColumn("t", F.explode(F.array_distinct("topic_category")))
    by_topic = topics.join(dealt.withColumn("t", F.explode(F.array_distinct("s_topics"))), ["t", "block"]).where(rest).select(*out).dropDuplicates(["constraint_id", "_id"])
    alone = r.where("entity_list is null and source is null and category is null and topic_category is null").where(F.col("days_ago").isNotNull() | F.col("entity_number").isNotNull() | bounds | F.col("sentence_position").isNotNull())
    by_bounds = alone.join(s, rest)
    return by_entity.unionByName(by_source.select(*out)).unionByName(by_category.select(*out)).unionByName(by_topic).unionByName(by_bounds.select(*out))
