"""Lines repeated across one source's documents, found by a distributed suffix array over line identifiers.

Every line of a source is replaced by an identifier (equal for equal normalised lines). Each line starts a suffix: the
identifiers from there to the end of its document, at most ``DEPTH`` of them. The suffixes of all sources are sorted
together by range partitioning (sample sort), which is the suffix array; adjacent suffixes' common prefixes give the
LCP intervals, and an interval of depth k is a repeated block of k lines. The number of documents of an interval is the
number of its suffixes less one for each neighbouring pair of suffixes of the same document that share the block, so it
adds up over partitions and no source or line is ever gathered in one task. Blocks in at least ``min_docs`` documents
are deleted; a longer block's lines stand in at least as many documents, so each is an interval of depth 1 itself, and
deleting those deletes exactly the lines of all blocks.

Blocks of more lines are found level by level: where a block of ``DEPTH`` lines is repeated, the next ``DEPTH`` lines are
suffixes of their own, sorted under a 64-bit key of all lines before them, as long as any block still is repeated. Rows
keep their size, and a block's length has no limit.

Defined cases: rows with a null line, source, id or document are no lines; a row delivered again under its id counts
once (the last import); blank lines are lines like others; ties in position are ordered by id; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textloom.runtime import materialize

DEPTH = 8
_DIGITS, _SPACE = re.compile(r"\d+"), re.compile(r"\s+")


def normal_line(text: str) -> str:
    """NFKC, lower case, each run of digits as ``0``, each run of white space as one blank, trimmed."""
    t = unicodedata.normalize("NFKC", text).lower()
    return _SPACE.sub(" ", _DIGITS.sub("0", t)).strip()


@F.pandas_udf(LongType())
def line_id(text: pd.Series) -> pd.Series:
    """64-bit identifier of the normalised line; never 0, which pads short suffixes."""
    h = xxhash.xxh3_64_intdigest
    return pd.Series([None if t is None else ((h(normal_line(t).encode("utf-8", "surrogatepass")) or 1) ^ (1 << 63)) - (1 << 63) for t in text], dtype="Int64")


def source_lines(df: DataFrame) -> DataFrame:
    """sentence_id, source, docid, position, line of each distinct row of ``search_sentence``."""
    source = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    rows = df.select(F.col("_id").alias("sentence_id"), source.alias("source"), "docid", F.col("sentence_position").alias("position"), F.col("raw_sentence").alias("text"), F.col("import_date").alias("imported"))
    rows = rows.where("sentence_id is not null and source is not null and docid is not null and text is not null")
    rows = rows.withColumn("line", line_id("text")).drop("text")
    last = F.struct("imported", "source", "docid", "position", "line")
    # all of a row's copies have one id; partial maxima are taken before the shuffle
    return rows.groupBy("sentence_id").agg(F.max(last).alias("r")).select("sentence_id", "r.source", "r.docid", "r.position", "r.line")


def suffixes(lines: DataFrame, *more: str) -> DataFrame:
    """sentence_id, source, src (64-bit source), suffix (array<bigint>), fresh, and ``more``: docid, at (the line's number in its document)."""
    order = Window.partitionBy("source", "docid").orderBy(F.col("position").asc_nulls_last(), "sentence_id")
    s = lines.withColumn("suffix", F.collect_list("line").over(order.rowsBetween(0, DEPTH - 1))).withColumn("src", F.xxhash64("source"))
    if "at" in more:
        s = s.withColumn("at", F.row_number().over(order))
    return _fresh(s).select("sentence_id", "source", "src", "suffix", "fresh", *more)


def _fresh(s: DataFrame) -> DataFrame:
    """fresh: the least depth at which no earlier suffix of the document has the same prefix under the same ``src``."""
    before = F.lag(F.struct("src", "suffix")).over(Window.partitionBy("source", "docid").orderBy("src", "suffix", "sentence_id"))
    s = s.withColumn("__b", before).withColumn("before", F.when(F.col("__b.src") == F.col("src"), F.col("__b.suffix"))).drop("__b")
    same = sum((F.when(_prefix_equal(k), 1).otherwise(0) for k in range(1, DEPTH + 1)), F.lit(0))
    return s.withColumn("fresh", (same + 1).cast("tinyint")).drop("before")


def _prefix_equal(k: int):
    return F.coalesce((F.size("suffix") >= k) & (F.size("before") >= k) & (F.slice("suffix", 1, k) == F.slice("before", 1, k)), F.lit(False))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source and suffix as rows of a matrix (0 behind the end), suffix lengths, fresh depths."""
    lists = batch.column(1)
    offs, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    n = np.diff(offs)
    m = np.zeros((batch.num_rows, DEPTH + 1), dtype=np.int64)
    m[:, 0] = batch.column(0).to_numpy()
    rows = np.repeat(np.arange(len(n)), n)
    m[rows, 1 + np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    return m, n, batch.column(2).to_numpy()


def _intervals(min_docs: int):
    """Scan a partition of the suffix array: LCP intervals with their documents, those at the edges whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None
        docs = np.zeros(DEPTH + 1, dtype=np.int64)
        edge = np.ones(DEPTH + 1, dtype=bool)

        def emit(k: int, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(rows[:, 0]), pa.array(np.full(len(rows), k, np.int32)), pa.array(list(rows[:, 1 : k + 1]), pa.list_(pa.int64())), pa.array(counts)]
            return pa.RecordBatch.from_arrays(cols, names=["src", "depth", "block", "docs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m, n, fresh = _matrix(batch)
            prior = last if last is not None else m[0]
            full = np.vstack([prior[None], m])
            same = np.cumprod(full[1:] == full[:-1], axis=1)
            for k in range(1, DEPTH + 1):
                own = ((n >= k) & (fresh <= k)).astype(np.int64)
                cut = np.flatnonzero(same[:, k] == 0)
                first = 0 if last is None else 1
                starts = np.concatenate(([0], cut[cut > 0] if last is None or not len(cut) or cut[0] > 0 else cut[1:]))
                begins_new = bool(first and len(cut) and cut[0] == 0)
                sums = np.add.reduceat(own, starts)
                keys = m[starts]
                if first and not begins_new:
                    sums[0] += docs[k]
                elif begins_new and (docs[k] >= min_docs or edge[k]) and docs[k] > 0 and last[k] != 0:
                    yield emit(k, last[None], docs[k : k + 1].copy())
                if begins_new:
                    edge[k] = False
                done, open_ = sums[:-1], sums[-1]
                if len(done):
                    keep = (done >= min_docs) & (keys[:-1, k] != 0)
                    if edge[k]:
                        keep[0] = done[0] > 0 and keys[0, k] != 0
                    if keep.any():
                        yield emit(k, keys[:-1][keep], done[keep])
                    edge[k] = False
                docs[k] = open_
            last = m[-1]
        if last is not None:  # what stands at the end may go on in the next partition
            for k in range(1, DEPTH + 1):
                if docs[k] > 0 and last[k] != 0:
                    yield emit(k, last[None], docs[k : k + 1].copy())

    return run


def repeated_blocks(sfx: DataFrame, min_docs: int) -> DataFrame:
    """src, depth, block, docs of every block of up to ``DEPTH`` lines in at least ``min_docs`` documents of its source."""
    order = ["src", "suffix", "sentence_id"]
    ranged = sfx.select("src", "suffix", "fresh", "sentence_id").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranged.select("src", "suffix", "fresh").mapInArrow(_intervals(min_docs), "src bigint, depth int, block array<bigint>, docs bigint")
    return parts.groupBy("src", "depth", "block").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


def repeated_lines(df: DataFrame, min_docs: int = 6) -> tuple[DataFrame, DataFrame]:
    """The suffixes of all lines (written once) and the repeated blocks of ``search_sentence`` rows."""
    sfx = materialize(suffixes(source_lines(df)), "suffixes")
    return sfx, materialize(repeated_blocks(sfx, min_docs), "blocks")


def found_lines(df: DataFrame, min_docs: int = 6) -> DataFrame:
    """sentence_id of each line that stands in a repeated block of its source."""
    sfx, blocks = repeated_lines(df, min_docs)
    one = blocks.where("depth = 1").select("src", F.col("block")[0].alias("line"))
    return sfx.select("sentence_id", "src", F.col("suffix")[0].alias("line")).join(one, ["src", "line"], "left_semi").select("sentence_id")


def _key(depth: Column | str, block: str) -> Column:
    """64-bit key of all lines of a block: of its level's ``src`` and the first ``depth`` lines of the level."""
    return F.xxhash64("src", F.slice(block, 1, depth))


def block_levels(df: DataFrame, min_docs: int = 6) -> tuple[DataFrame, DataFrame]:
    """Places (key, sentence_id, source, docid, at: where the block begins) and blocks (key, parent: key without the last line, lines, docs) of every repeated block, whatever its length."""
    whole = sfx = materialize(suffixes(source_lines(df), "docid", "at"), "suffixes")
    level, places, every = 0, None, None
    while True:
        blocks = materialize(repeated_blocks(sfx, min_docs), "blocks")
        if level and blocks.isEmpty():
            return places, every
        parent = F.when(F.col("depth") > 1, _key(F.col("depth") - 1, "block")).when(F.lit(level > 0), F.col("src"))
        own = blocks.select(_key(F.col("depth"), "block").alias("key"), parent.alias("parent"), (F.col("depth") + level * DEPTH).alias("lines"), "docs")
        # only suffixes whose first line is repeated can begin a block
        one = blocks.where("depth = 1").select("src", F.col("block")[0].alias("line"))
        live = sfx.withColumn("line", F.col("suffix")[0]).join(one, ["src", "line"], "left_semi")
        starts = live.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("suffix")))).select(_key(F.col("depth"), "suffix").alias("key"), "sentence_id", "source", "docid", "at")
        places, every = (starts, own) if places is None else (places.unionByName(starts), every.unionByName(own))
        full = blocks.where(F.col("depth") == DEPTH).select("src", F.col("block").alias("suffix"))
        alive = sfx.join(full, ["src", "suffix"], "left_semi").withColumn("src", _key(F.lit(DEPTH), "suffix")).drop("suffix", "fresh")
        level += 1
        ahead = whole.select("source", "docid", (F.col("at") - level * DEPTH).alias("at"), "suffix").where("at > 0")
        sfx = materialize(_fresh(alive.join(ahead, ["source", "docid", "at"])).select("sentence_id", "source", "src", "suffix", "fresh", "docid", "at"), "suffixes")


def maximal_blocks(df: DataFrame, min_docs: int = 6) -> DataFrame:
    """source, lines (number), docs, first_id: blocks that no repeated longer block extends, to the right or to the left, in as many documents; ``first_id``: the least id at which the block begins."""
    places, blocks = block_levels(df, min_docs)
    best = blocks.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.max("docs").alias("more"))
    right = blocks.join(best, "key", "left").where("more is null or more < docs")
    at = materialize(places.join(right.select("key", "lines", "docs"), "key"), "places")
    # one more line before it and as many documents: what is found there holds this block everywhere
    before = at.select("source", "docid", (F.col("at") + 1).alias("at"), (F.col("lines") - 1).alias("lines"), "docs")
    inner = at.join(before, ["source", "docid", "at", "lines", "docs"], "left_semi").select("key").distinct()
    return at.join(inner, "key", "left_anti").groupBy("source", "key", "lines", "docs").agg(F.min("sentence_id").alias("first_id")).select("source", "lines", "docs", "first_id")


def cleaned_articles(df: DataFrame, min_docs: int = 6) -> DataFrame:
    """docid, kept_lines, removed_lines, text: each article without its repeated lines, the rest joined by line feeds in order.

    Rows without source are kept. An article of which nothing stays has an empty text.
    """
    gone = found_lines(df, min_docs).withColumn("gone", F.lit(True))
    # the delivery that ``source_lines`` takes, and the last one where no delivery has a source
    source = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    last = F.max(F.struct(F.col("source").isNotNull().alias("has"), "import_date", source.alias("source"), "docid", "sentence_position", line_id("raw_sentence").alias("line"), "raw_sentence")).alias("r")
    rows = df.where("_id is not null and docid is not null and raw_sentence is not null").groupBy(F.col("_id").alias("sentence_id")).agg(last)
    rows = rows.select("sentence_id", "r.docid", "r.sentence_position", "r.raw_sentence").join(gone, "sentence_id", "left")
    kept = F.when(F.col("gone").isNull(), F.struct(F.coalesce("sentence_position", F.lit(2**31 - 1)).alias("p"), "sentence_id", "raw_sentence"))
    per = rows.groupBy("docid").agg(F.count(kept).alias("kept_lines"), F.count("gone").alias("removed_lines"), F.array_sort(F.collect_list(kept)).alias("a"))
    return per.select("docid", "kept_lines", "removed_lines", F.array_join(F.transform("a", lambda x: x["raw_sentence"]), "\n").alias("text"))
