"""Readers of the text formats: dumps, index lines, tab and blank-line files, vectors, question and dialogue JSON.

Every reader takes a path or a DataFrame of lines and stays lazy. Malformed lines are left out, as each says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of each text file, read in splits (SC42, SC38).

    A split's lines are numbered by themselves; the numbers of lines in the splits before it (a row per split) are added.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("file", "split").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = t.withColumn("no", F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1)
    return own.join(starts, ["file", "split"]).select("file", (F.col("no") + F.col("start")).cast("bigint").alias("line_no"), "line")


def page_dump_tuples(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, namespace, title of the tuples of INSERT lines (SC19); titles keep their underscores."""
    one = F.explode(F.regexp_extract_all(column, F.lit(r"\((\d+,-?\d+,'(?:[^'\\]|\\.)*')"), F.lit(1)))
    t = lines.where(F.col(column).contains("INSERT INTO")).select(one.alias("t"))
    part = lambda i: F.regexp_extract("t", r"^(\d+),(-?\d+),'(.*)'$", i)
    return t.select(part(1).cast("bigint").alias("id"), part(2).cast("int").alias("namespace"), part(3).alias("title"))


def index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """at, id, title of ``offset:id:title`` lines (SC20); others are left out."""
    p = r"^(\d+):(\d+):(.*)$"
    t = lines.where(F.col(column).rlike(p))
    return t.select(F.regexp_extract(column, p, 1).cast("bigint").alias("at"), F.regexp_extract(column, p, 2).cast("bigint").alias("id"), F.regexp_extract(column, p, 3).alias("title"))


def df_file(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number of documents (first line) and token_id, token, df; lines without three fields are left out (SC15)."""
    lines = numbered_lines(spark, path)
    n = lines.where("line_no = 0").select(F.trim("line").cast("bigint").alias("n")).first()["n"]
    f = F.split(F.trim("line"), "\t")
    rows = lines.where("line_no > 0").where(F.size(f) == 3)
    return n, rows.select(f[0].cast("bigint").alias("token_id"), f[1].alias("token"), f[2].cast("bigint").alias("df"))


def index_file(spark: SparkSession, path: str) -> DataFrame:
    """word_id, at, size of an index's tab lines (SC13)."""
    return spark.read.schema("word_id bigint, at bigint, size bigint").csv(path, sep="\t", mode="DROPMALFORMED")


def files(spark: SparkSession, root: str, pattern: str = ".*") -> DataFrame:
    """path, size of the files under a folder whose path matches (SC16)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return b.where(F.col("path").rlike(pattern)).select("path", F.col("length").alias("size"))


def tab_pairs(spark: SparkSession, path: str, columns: tuple[int, int, int], names: tuple[str, str, str], header: bool = False) -> DataFrame:
    """Three columns of an unquoted tab file by place (SC29, SC33, SC34); shorter lines are left out."""
    lines = numbered_lines(spark, path).where("line <> ''")
    if header:
        lines = lines.where("line_no > 0")
    f = F.split(F.regexp_replace("line", "^\\x{FEFF}", ""), "\t")
    rows = lines.where(F.size(f) > max(columns))
    return rows.select("line_no", *[F.trim(f[i]).alias(n) for i, n in zip(columns, names)])


def sts_pairs(spark: SparkSession, path: str, least: float = 0.0, most: float = 5.0) -> DataFrame:
    """line_no, s1, s2, score scaled to 0..1 (SC29)."""
    t = tab_pairs(spark, path, (5, 6, 4), ("s1", "s2", "raw"))
    return t.select("line_no", "s1", "s2", ((F.expr("try_cast(raw as double)") - least) / (most - least)).alias("score"))


def parallel_lines(spark: SparkSession, first: str, second: str, labels: str) -> DataFrame:
    """line_no, s1, s2, label of three files joined by line number (SC30, JN20)."""
    one = lambda p, n: numbered_lines(spark, p).select("line_no", F.trim("line").alias(n)).where(F.col(n) != "")
    return one(first, "s1").join(one(second, "s2"), "line_no").join(one(labels, "label"), "line_no")


def triplets(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """line_no, anchor, positive, negative (SC31)."""
    return tab_pairs(spark, path, (0, 1, 2), ("anchor", "positive", "negative"), header)


def label_sentences(spark: SparkSession, path: str) -> DataFrame:
    """line_no, label, label_id (as labels first appear), sentence (SC32)."""
    f = F.split("line", "\t")
    t = numbered_lines(spark, path).where(F.size(f) >= 2).select("line_no", F.trim(f[0]).alias("label"), F.trim(f[1]).alias("sentence"))
    ids = t.groupBy("label").agg(F.min("line_no").alias("at"))
    ids = ids.withColumn("label_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at")) - 1)  # a row per label
    return t.join(F.broadcast(ids.drop("at")), "label")


def choice_examples(spark: SparkSession, path: str) -> DataFrame:
    """id, context, start, endings (four), label of a comma file with header (SC36)."""
    t = spark.read.csv(path, header=True, escape='"')
    c = t.columns
    return t.select(F.col(c[2]).alias("id"), F.col(c[4]).alias("context"), F.col(c[5]).alias("start"), F.array(*[F.col(c[i]) for i in range(7, 11)]).alias("endings"), (F.expr(f"try_cast(`{c[11]}` as int)") if len(c) > 11 else F.lit(None).cast("int")).alias("label"))


def story_endings(spark: SparkSession, path: str) -> DataFrame:
    """story, ending_0, ending_1, label (from 0) of a comma file with header (SC37)."""
    t = spark.read.csv(path, header=True, escape='"')
    c = t.columns
    return t.select(F.concat_ws(" ", *c[1:5]).alias("story"), F.col(c[5]).alias("ending_0"), F.col(c[6]).alias("ending_1"), (F.col(c[7]).cast("int") - 1).alias("label"))


def blank_line_blocks(lines: DataFrame, doc: str, no: str, line: str) -> DataFrame:
    """The lines that aren't blank, with the number of blank ones before as their block (SC38)."""
    w = Window.partitionBy(doc).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    blank = (F.trim(line) == "").cast("bigint")
    return lines.withColumn("block", F.sum(blank).over(w)).where(F.trim(line) != "")


def corpus_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, block, lines (in order) of blank-line-separated texts (SC38)."""
    t = blank_line_blocks(numbered_lines(spark, path), "file", "line_no", "line")
    return t.groupBy("file", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))


def word_vectors(spark: SparkSession, path: str, most: int | None = None, padding: str | None = None) -> DataFrame:
    """line_no, word, vector of a text of vectors; lines of another dimension than the first are left out (SC40).

    ``padding``: a word of zeros put before all others, as line -1.
    """
    f = F.split(F.rtrim("line"), " ")
    t = numbered_lines(spark, path).where("line <> ''").select("file", "line_no", f.alias("f"))
    t = t.join(t.where("line_no = 0").select("file", F.size("f").alias("size")), "file").where(F.size("f") == F.col("size"))
    if most is not None:
        t = t.where(F.col("line_no") < most)
    out = t.select("line_no", F.col("f")[0].alias("word"), F.transform(F.slice("f", 2, F.col("size") - 1), lambda x: x.cast("double")).alias("vector"))
    if padding is not None:
        zero = t.where("line_no = 0").limit(1).select(F.lit(-1).cast("bigint").alias("line_no"), F.lit(padding).alias("word"), F.array_repeat(F.lit(0.0), F.col("size") - 1).alias("vector"))
        out = zero.unionByName(out)
    return out


def labelled_pairs(spark: SparkSession, path: str, columns: tuple[int, int, int], labels: dict[str, int], header: bool = True) -> DataFrame:
    """line_no, s1, s2, label_id of a tab file; labels as mapped, lines of other labels are left out (SC33, SC34)."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    t = tab_pairs(spark, path, columns, ("s1", "s2", "label"), header)
    return t.select("line_no", "s1", "s2", F.try_element_at(names, F.col("label")).alias("label_id")).where("label_id is not null")


def instances(spark: SparkSession, path: str, size: int) -> DataFrame:
    """key, tokens, segment_ids, input_mask (both padded with 0 to ``size``), lm_labels (the label where a token is masked, else null), is_next of training instances, a JSON object a line (SC39)."""
    schema = "key bigint, tokens array<string>, segment_ids array<int>, masked_lm_positions array<int>, masked_lm_labels array<string>, is_random_next boolean"
    j = spark.read.schema(schema).json(path).where("tokens is not null")
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(c), F.lit(0)))), 1, size)
    at = F.when(F.size("masked_lm_positions") > 0, F.map_from_arrays("masked_lm_positions", "masked_lm_labels"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(at, i))
    return j.select("key", F.slice("tokens", 1, size).alias("tokens"), pad(F.col("segment_ids")).alias("segment_ids"), pad(F.transform("tokens", lambda x: F.lit(1))).alias("input_mask"), labels.alias("lm_labels"), (~F.col("is_random_next")).alias("is_next"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id (its line number) (SC42)."""
    return numbered_lines(spark, path).where("line <> ''").select(F.col("line").alias("token"), F.col("line_no").alias("id"))


def span_pages(spark: SparkSession, path: str) -> DataFrame:
    """id, title, redirect, disambiguation, text of the pages of namespace 0 in a wiki XML dump (SC18)."""
    schema = "id bigint, ns int, title string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    p = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).where("ns = 0")
    text = F.col("revision.text._VALUE")
    return p.select("id", "title", F.col("redirect._title").alias("redirect"), F.coalesce(text.rlike(r"(?i)\{\{(disambig|disambiguation|消歧)"), F.lit(False)).alias("disambiguation"), text.alias("text"))


def tab_mentions(lines: DataFrame, column: str = "value") -> DataFrame:
    """run, mention_id, mention, doc, begin, end (exclusive), kbid, etype, mtype, confidence of tab lines; NIL ids are null (SC24)."""
    f = F.split(column, "\t")
    span = r"^(.*):(\d+)-(\d+)$"
    rows = lines.where((F.size(f) >= 8) & f[3].rlike(span))
    return rows.select(
        f[0].alias("run"), f[1].alias("mention_id"), f[2].alias("mention"), F.regexp_extract(f[3], span, 1).alias("doc"), F.regexp_extract(f[3], span, 2).cast("int").alias("begin"), (F.regexp_extract(f[3], span, 3).cast("int") + 1).alias("end"),
        F.when(~f[4].startswith("NIL"), f[4]).alias("kbid"), f[5].alias("etype"), f[6].alias("mtype"), F.expr(f"try_cast(split({column}, '\\t')[7] as double)").alias("confidence"),
    )


def parsed_entities(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """doc, begin, end, text, etype of entity mentions in parser JSON, types mapped, unmapped ones left out (SC25)."""
    schema = "docid string, sentences array<struct<entitymentions:array<struct<text:string,ner:string,characterOffsetBegin:int,characterOffsetEnd:int>>>>"
    j = spark.read.schema(schema).json(path, multiLine=True).select("docid", F.explode("sentences").alias("s")).select("docid", F.explode("s.entitymentions").alias("m"))
    names = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return j.select(F.col("docid").alias("doc"), F.col("m.characterOffsetBegin").alias("begin"), F.col("m.characterOffsetEnd").alias("end"), "m.text", names[F.col("m.ner")].alias("etype")).where("etype is not null")


def dialog_graph(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """The members of one array of a dialogue graph's JSON, each id once, the first in the file (SC47)."""
    t = spark.read.schema(f"`{part}` array<{schema}>").json(path, multiLine=True).select(F.posexplode(part).alias("at", "x")).select("at", "x.*")
    w = Window.partitionBy("id").orderBy("at")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "at")


def crawled_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Records of the first folder whose file name also stands in the second (SC28)."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    a = spark.read.json(first, multiLine=True).withColumn("file", name)
    b = spark.read.json(second, multiLine=True).select(name.alias("file"))
    return a.join(b, "file", "left_semi")
