"""New batches of articles held against everything accepted before.

An article's vector is the set of its distinct runs of 5 characters. The index is an inverted file of cells: a vector
lies in ``BANDS`` cells, each the joint code of ``ROWS`` of its min-wise components, and the accepted articles' cells and
full texts are kept in two tables that grow by one folder a batch. A batch is probed cell by cell; a vector met there is
passed by only if its distance must be over the bound by size (|x| < t |y|), all others are compared exactly by their
full texts. What is accepted is appended. Where several batches are at hand, what doesn't depend on history (vectors, order,
pairs within a batch) is made for all of them at once, as each job leaves plans, threads and broadcasts in the driver's memory.

Cells around centroids with triangle bounds can't pass anything by here, as measured (README): vectors of unrelated texts
all lie at about the same distance from any centroid. Min-wise cells find a pair at the threshold of 0.6 with probability
1 - (1 - 0.6^4)^66 = 0.9999, one at 0.65 with 0.999998; the tests measure this recall.

What a batch costs: its own cells and texts; of history the cell codes of the buckets its cells fall in are read, and sifted
by a bitmap of the batch's cells, so that hardly more than the matching ones is shuffled; of texts only the buckets that
hold a candidate. A batch is written to folders of its own and counts once its marker file is there, so a
broken attempt leaves nothing behind and can be repeated; articles that are in the index already are passed by.
``compact`` joins the folders of all batches into one.

Within a batch articles count in order (date, then id): each repeats only what was accepted before it. Equal texts are
compared once, and every copy gets the matches that stand before that copy. While some cell is larger than
``HOT``, only the first of each cell is compared with the rest of it; a first of all its cells is accepted for certain,
and what repeats it drops out, so crowds of near copies are never paired with one another. What then still shares a large
cell without repeating its first is met in blocks.

Defined cases: null ids are no articles; a missing date comes after all dates; texts of fewer than 5 letters and digits
have no runs and repeat nothing; rows delivered again under one id count once; ties in position are ordered by id; an
empty batch gives no cases.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.spans import code_points, gram_hashes
from textloom.runtime import add_dense_ids, list_names, materialize, scratch_path, touch

RUN = 5
SHARE = 0.6
ROWS, BANDS = 4, 66
HOT = 200
#: Folders the cells and texts of one batch are spread over, so that reads can pass by those they don't need.
CELL_BUCKETS, TEXT_BUCKETS = 32, 8
NO_DATE = 2**31 - 1
#: Bits of the bitmap of a batch's cells that history is sifted by before any shuffle (512 KB).
FILTER_BITS = 1 << 22
#: Pairs of ids up to which first come, first accepted is settled on the driver; more are settled in rounds of joins.
FEW = 50_000

_STRIP = regex.compile(r"[^\p{L}\p{N}]+")
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = (_RANDOM.integers(1, 2**32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_JOIN = _RANDOM.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal_text(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return _STRIP.sub("", unicodedata.normalize("NFKC", text).lower())


def cells_of(text: str) -> tuple[int, np.ndarray]:
    """Number of distinct runs, and the vector's cells."""
    h = np.unique(gram_hashes(code_points(text), RUN)) if len(text) >= RUN else np.zeros(0, np.uint64)
    if not len(h):
        return 0, np.zeros(0, np.int64)
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(least, (_FACTORS[:, None] * low[None, a : a + 2048]).min(axis=1), out=least)
    code = np.arange(BANDS, dtype=np.uint64)
    for k, part in enumerate(least.reshape(BANDS, ROWS).T.astype(np.uint64)):
        code = (code ^ part) * _JOIN[k]
        code ^= code >> np.uint64(29)
    return len(h), code.view(np.int64)


def similarity(a: str, b: str) -> float:
    """Common distinct runs of 5 characters, as a share of all distinct runs of both."""
    x, y = ({t[i : i + RUN] for i in range(len(t) - RUN + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def articles(df: DataFrame) -> DataFrame:
    """docid, news_date, text: each article's distinct rows joined in order without gap."""
    rows = df.select(F.col("_id").alias("id"), "docid", "news_date", F.col("sentence_position").alias("p"), F.col("raw_sentence").alias("t"), F.col("import_date").alias("i")).where("docid is not null and id is not null")
    # a row's copies lie in its article: one shuffle by article serves both
    row = F.struct(F.coalesce("p", F.lit(2**31 - 1)).alias("p"), "id", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("t", F.lit("")).alias("t"))
    per = rows.groupBy("docid").agg(F.min("news_date").alias("news_date"), F.array_sort(F.collect_set(row)).alias("r"))
    ids = F.transform("r", lambda x: x["id"])
    last = F.filter("r", lambda x, k: F.array_position(F.slice(ids, k + 2, F.size(ids)), x["id"]) == 0)
    return per.select("docid", "news_date", F.array_join(F.transform(last, lambda x: x["t"]), "").alias("text"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["span", "docid", "news_date", "text", "copy", "n", "cells"]
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            part = b.slice(k, 1000)
            text = [normal_text(t or "") for t in part.column(3).to_pylist()]
            made = [cells_of(t) for t in text]
            copy = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in text]
            ends = np.concatenate(([0], np.cumsum([len(c) for _, c in made]))).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([c for _, c in made])))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(text), pa.array(copy, pa.binary()), pa.array([n for n, _ in made], pa.int32()), cells], names=names)


def _numbered(arts: DataFrame, start: int) -> DataFrame:
    """span, docid, news_date, n, at, id, copies, text, cells of articles (span, docid, news_date, text); written once, by span.

    ``at``: its number from ``start`` in order (date, then id), over all spans; ``id``: that of the first equal text of its
    span, of which there are ``copies``. Only firsts have text and cells; an article without runs has no numbers, but its text.
    """
    new = materialize(arts.mapInArrow(_vectors, "span int, docid string, news_date int, text string, copy binary, n int, cells array<bigint>"), "new")
    order = new.where("n > 0").select("span", "docid", "copy", F.coalesce("news_date", F.lit(NO_DATE)).alias("date"))
    order = add_dense_ids(order, ["date", "docid"], "at", start)
    w = Window.partitionBy("span", "copy")
    first = order.select("docid", "at", F.min("at").over(w).alias("id"), F.count("*").over(w).alias("copies"))
    own = F.coalesce(F.col("at") == F.col("id"), F.lit(True))
    rows = new.join(first, "docid", "left").select("docid", "news_date", "n", "at", "id", "copies", *[F.when(own, F.col(c)).alias(c) for c in ("text", "cells")], "span")
    path = scratch_path(arts.sparkSession, "arts")
    rows.write.partitionBy("span").parquet(path)
    return arts.sparkSession.read.schema(rows.schema).parquet(path)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
        keep = pa.array([similarity(x, y) >= SHARE for x, y in zip(a, c)], pa.bool_())
        yield b.select(["a", "b", "span", "docid_a", "docid_b"]).filter(keep)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, span) of ``texts`` (id, docid, text) that repeat each other, compared by full text, with their docids; written once."""
    ends = pairs.select("a", "b", "span", F.explode(F.array("a", "b")).alias("id"))
    of = lambda side: [F.max(F.when(F.col("id") == F.col(side), F.col(c))).alias(f"{c}_{side}") for c in ("docid", "text")]
    both = texts.join(ends, "id").groupBy("a", "b", "span").agg(*of("a"), *of("b"))
    return materialize(both.mapInArrow(_verify, _PAIRS), "pairs")


def _near() -> Column:
    """Whether the sizes of a and b allow a match."""
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    return (n >= SHARE * m - 1e-9) & (m >= SHARE * n - 1e-9)


def _side(cells: DataFrame, side: str, *more: str) -> DataFrame:
    return cells.select("cell", F.col("id").alias(side), F.col("n").alias(f"n_{side}"), *more)


def _cells(arts: DataFrame, *more: str) -> DataFrame:
    return arts.select("id", "n", *more, F.explode("cells").alias("cell"))


def _maybe_in(known: DataFrame, cells: DataFrame) -> DataFrame:
    """``known`` without the rows whose cell surely isn't among ``cells``, by a bitmap of ``FILTER_BITS`` bits sent to all tasks."""
    h = F.pmod(F.xxhash64("cell"), F.lit(FILTER_BITS))
    page, at = F.floor(h / 32768).cast("int"), (h % 32768).cast("int")
    bits = cells.select(page.alias("page"), at.cast("bigint").alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = known.withColumn("page", page).withColumn("at", at).join(F.broadcast(bits), "page")  # FILTER_BITS / 8 bytes at most
    return held.where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).drop("page", "at", "bits")


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


_TEXTS = "id bigint, docid string, news_date int, n int, text string, bucket int"
_CELLS = "cell bigint, id bigint, n int, bucket int"
_PAIRS = "a bigint, b bigint, span int, docid_a string, docid_b string"


class ArticleIndex:
    """The persisted index; ``path`` is a shared folder, a new one by default. An index that is there is gone on with.

    Accepted articles have numbers: the first batch they were added with in the upper bits, the place in the order of all added
    then below. Those without runs have none.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "article-index")

    def _done(self) -> list[tuple[int, int]]:
        """First and last batch of each committed folder, those joined by ``compact`` once."""
        spans = sorted((tuple(int(x) for x in name.split("-")) for name in list_names(self.spark, f"{self.path}/done")), key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int]] = []
        for low, high in spans:
            if not kept or low > kept[-1][1]:
                kept.append((low, high))
        return kept

    def _kept(self, name: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{name}/batches={low}-{high}" for low, high in self._done()]
        if not folders or buckets == []:
            return self.spark.createDataFrame([], ddl).drop("bucket")
        out = self.spark.read.schema(f"{ddl}, batches string").option("basePath", f"{self.path}/{name}").parquet(*folders).drop("batches")
        return (out.where(F.col("bucket").isin(buckets)) if buckets is not None else out).drop("bucket")

    def accepted(self) -> DataFrame:
        """id, docid, news_date, n, text of all accepted articles."""
        return self._kept("texts", _TEXTS)

    def texts_for(self, ids: DataFrame) -> DataFrame:
        """id, docid, text of the buckets that hold ``ids``."""
        found = ids.select(_bucket(F.col("id"), TEXT_BUCKETS)).distinct().collect()  # TEXT_BUCKETS rows at most
        return self._kept("texts", _TEXTS, [r["bucket"] for r in found]).select("id", "docid", "text")

    def cells_for(self, cells: DataFrame, articles: int) -> DataFrame:
        """cell, id, n of the buckets that hold ``cells``, the cells of so many articles; where they are many they fall in all buckets."""
        if articles > CELL_BUCKETS:
            return self._kept("cells", _CELLS)
        found = cells.select(_bucket(F.col("cell"), CELL_BUCKETS)).distinct().collect()  # CELL_BUCKETS rows at most
        return self._kept("cells", _CELLS, [r["bucket"] for r in found])

    def _write(self, batches: str, texts: DataFrame, cells: DataFrame, articles: int) -> None:
        key = F.coalesce("id", F.xxhash64("docid"))
        files = articles * BANDS // (CELL_BUCKETS * 4_000_000) + 1
        for name, df, key, n in (("texts", texts, key, TEXT_BUCKETS), ("cells", cells, F.col("cell"), CELL_BUCKETS)):
            df = df.withColumn("bucket", _bucket(key, n)).repartition("bucket", F.pmod(key, F.lit(files)))
            df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batches={batches}")

    def compact(self) -> None:
        """Join the folders of all batches into one; the old ones stay for readers that began before."""
        done = self._done()
        if len(done) > 1:
            low, high = done[0][0], done[-1][1]
            every = self._kept("texts", _TEXTS)
            self._write(f"{low}-{high}", every, self._kept("cells", _CELLS), every.count())
            touch(self.spark, f"{self.path}/done/{low}-{high}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Accept a batch (docid, news_date, text; of ``articles``) and return its cases: docid, repeats (an accepted docid).

        Articles that are in the index already are left out; the rest of a batch added again gives its cases again.
        """
        return self.add_spans(batch.withColumn("span", F.lit(0)))

    def add_spans(self, batches: DataFrame) -> DataFrame:
        """Accept batches one after another, those of the lower ``span`` first, as ``add`` would, and return the cases of all.

        What doesn't depend on what was accepted before (vectors, order, pairs within a batch) is made for all batches at once.
        """
        done = self._done()
        number = done[-1][1] + 1 if done else 0
        batches = batches.select("span", "docid", F.col("news_date").cast("int").alias("news_date"), "text").where("docid is not null")
        if done:
            batches = batches.join(self.accepted().select("docid"), "docid", "left_anti").select("span", "docid", "news_date", "text")
        rows = _numbered(batches, number << 40)
        arts = rows.where("at = id")
        met = _shared_cells(arts.select("span", "id", "n", "cells"))
        largest = {r["span"]: r["m"] for r in met.groupBy("span").agg(F.max("m").alias("m")).collect()}  # a row per span
        cool = [span for span, m in largest.items() if m <= HOT]
        pairs = _verified(materialize(_met_pairs(met.where(F.col("span").isin(cool))), "candidates"), arts.select("id", "docid", "text"))
        few = _few(pairs.select("span", "a", "b"))
        links, refused, old = [pairs], [], []
        counts = rows.groupBy("span").agg(F.count_if(F.col("at") == F.col("id")).alias("m")).collect()  # a row per span
        for k, (span, count) in enumerate(sorted((r["span"], r["m"]) for r in counts)):
            here = arts.where(F.col("span") == span)
            if number + k:
                old.append(self._repeats(here, count))
            if largest.get(span, 0) > HOT:
                out, more = self._compare_crowds(here, old[-1] if number + k else None)
                links += more
            else:
                own = few if few is None else [(r["a"], r["b"]) for r in few if r["span"] == span]
                out = _refused(pairs.where(F.col("span") == span), own, old[-1] if number + k else None)
            refused.append(out)
            stored = rows.where((F.col("span") == span) & F.expr("n = 0 or at = id")).join(out, "id", "left_anti")
            self._write(f"{number + k}-{number + k}", stored.select("id", "docid", "news_date", "n", "text"), _cells(stored.where("n > 0")), count)
            touch(self.spark, f"{self.path}/done/{number + k}-{number + k}")
        return self._cases(rows, _union(refused, "id bigint"), _union(links, _PAIRS), _union(old, _PAIRS))

    def _cases(self, rows: DataFrame, refused: DataFrame, links: DataFrame, old: DataFrame) -> DataFrame:
        """Cases (docid, repeats) of numbered articles, of which some ids were ``refused``: copies of accepted texts, and links to accepted articles and to history."""
        every = rows.where("n > 0").select("docid", "at", "id", "copies")
        names = rows.where("at = id and copies > 1").join(refused, "id", "left_anti").select("id", F.col("docid").alias("repeats"))
        cases = every.where("at > id").join(names, "id").select("docid", "repeats")
        # a later copy of a refused text may follow what the first came before
        links = links.select("a", "b", F.col("docid_b").alias("repeats")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("docid_a").alias("repeats"))).distinct()
        links = links.join(refused.withColumnRenamed("id", "b"), "b", "left_anti")
        links = links.unionByName(old.select("a", F.lit(-1).cast("bigint").alias("b"), F.col("docid_b").alias("repeats")))  # history came before all
        return materialize(cases.unionByName(every.join(links.withColumnRenamed("a", "id"), "id").where("at > b").select("docid", "repeats")), "cases")

    def _repeats(self, arts: DataFrame, count: int) -> DataFrame:
        """Pairs of articles (a, so many) and of accepted ones of the index (b) that repeat each other."""
        known = _side(_maybe_in(self.cells_for(_cells(arts), count), _cells(arts)), "b")
        probed = _side(_cells(arts, "span"), "a", "span").join(known, "cell").where(_near()).select("a", "b", "span").distinct()
        probed = materialize(probed, "candidates")
        texts = self.texts_for(probed.select(F.col("b").alias("id")))
        return _verified(probed, arts.select("id", "docid", "text").unionByName(texts))

    def _compare_crowds(self, arts: DataFrame, old: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
        """Refused ids of a batch with cells over ``HOT``, without pairing crowds; pairs that repeat each other, all of those with an accepted article among them."""
        texts = arts.select("id", "docid", "text")
        left, sure, gone = arts.select("span", "id", "n", "cells"), [], []
        if old is not None:
            gone.append(materialize(old.select(F.col("a").alias("id")).distinct(), "gone"))
            left = left.join(gone[0], "id", "left_anti")
        left, met = self._thin_out(left, texts, sure, gone)
        links = [_verified(materialize(_met_pairs(met), "candidates"), texts)]
        taken = left.select("id").join(_refused(links[0], None, None), "id", "left_anti")
        for more in sure:
            taken = taken.unionByName(more)
        taken = materialize(taken, "taken")
        for out in gone:  # what was thinned out is held against all that was accepted
            late = _side(_cells(arts.join(out, "id", "left_semi"), "copies", "span"), "a", "copies", "span")
            late = late.join(_side(_cells(arts.join(taken, "id", "left_semi")), "b"), "cell").where(((F.col("b") < F.col("a")) | (F.col("copies") > 1)) & _near())
            links.append(_verified(materialize(late.select("a", "b", "span").distinct(), "candidates"), texts))
        return materialize(arts.select("id").join(taken, "id", "left_anti"), "refused"), links

    @staticmethod
    def _thin_out(left: DataFrame, texts: DataFrame, sure: list[DataFrame], gone: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Take out of ``left`` the firsts of large cells and what repeats them, to ``sure`` and ``gone``, while that helps."""
        while True:
            met = _shared_cells(left)
            if _largest(met) <= HOT:
                return left, met
            led = materialize(met.where("lead <> id").select(F.col("id").alias("a"), F.col("lead").alias("b"), "span").distinct(), "led")
            unsure = led.select(F.col("a").alias("id")).distinct()
            hit = _verified(materialize(led.join(unsure.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "span"), "candidates"), texts)
            sure.append(materialize(left.select("id").join(unsure, "id", "left_anti"), "sure"))
            gone.append(materialize(hit.select(F.col("a").alias("id")).distinct(), "gone"))
            # what shares a cell with a first but doesn't repeat it stays; no progress means pairs must be made
            rest = materialize(left.join(sure[-1].unionByName(gone[-1]), "id", "left_anti"), "open")
            if rest.count() > 0.9 * left.count():
                return rest, _shared_cells(rest)
            left = rest


def _shared_cells(arts: DataFrame) -> DataFrame:
    """span, cell, id, n, lead (the first id), m (how many) of all cells that hold several articles of a span."""
    spread = _cells(arts, "span").repartition("span", "cell")  # one exchange for both sides
    lead = spread.groupBy("span", "cell").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    return materialize(spread.join(lead, ["span", "cell"]), "met")


def _met_pairs(met: DataFrame) -> DataFrame:
    """a > b of one span that share a cell and may match by size; large cells are met in blocks."""
    met = met.withColumn("blocks", F.ceil(F.col("m") / HOT).cast("bigint"))
    x = _side(met, "a", "span", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    y = _side(met, "b", "span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return x.join(y, ["span", "cell", "block"]).where((F.col("a") > F.col("b")) & _near()).select("a", "b", "span").distinct()


def _largest(met: DataFrame) -> int:
    return met.agg(F.max("m").alias("m")).first()["m"] or 0


def _without(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("id").alias(c)), c, "left_anti").select("a", "b")
    return pairs


def _few(df: DataFrame) -> list[Row] | None:
    """The rows, if they are ``FEW`` at most."""
    rows = df.limit(FEW + 1).collect()  # FEW + 1 rows at most
    return rows if len(rows) <= FEW else None


def _refused(pairs: DataFrame, few: list[tuple[int, int]] | None, old: DataFrame | None) -> DataFrame:
    """Ids refused in a batch whose ``pairs`` (``few``: the same, if they are few) repeat each other: a of ``old``, and by first come, first accepted; written once."""
    before = _few(old.select("a")) if few is not None and old is not None else []
    if few is not None and before is not None:
        out = {r["a"] for r in before}
        for a, b in sorted(few):  # what stands before a is settled
            if b not in out:
                out.add(a)
        return materialize(pairs.sparkSession.createDataFrame([(x,) for x in sorted(out)], "id bigint").coalesce(1), "refused")
    lost = [] if old is None else [materialize(old.select(F.col("a").alias("id")).distinct(), "gone")]
    open_pairs = _without(pairs, lost[0]) if lost else pairs.select("a", "b")
    while not open_pairs.isEmpty():
        waits = open_pairs.select(F.col("a").alias("b")).distinct()
        lost.append(materialize(open_pairs.join(waits, "b", "left_anti").select(F.col("a").alias("id")).distinct(), "out"))
        open_pairs = materialize(_without(open_pairs, lost[-1]), "left")
    return materialize(_union(lost, "id bigint", pairs.sparkSession), "refused")


def _union(parts: list[DataFrame], ddl: str, spark: SparkSession | None = None) -> DataFrame:
    """All rows of tables that were written, in one scan."""
    spark = spark or SparkSession.active()
    folders = {f.rpartition("/")[0] for df in parts for f in df.inputFiles()}
    return spark.read.schema(ddl).parquet(*sorted(folders)) if folders else spark.createDataFrame([], ddl)


def repeated_articles(df: DataFrame, months: int = 3, path: str | None = None) -> DataFrame:
    """docid_a < docid_b: each repeating article of ``search_sentence`` with the accepted ones it repeats.

    Each span of so many calendar months is one batch, articles without a date the last; the rows are the same for any span.
    """
    month = F.expr("news_date div 10000 * 12 + least(news_date div 100 % 100, 12)")  # never falls as the date grows
    every = articles(df).withColumn("span", F.coalesce(F.floor(month / months), F.lit(NO_DATE)).cast("int"))
    out = ArticleIndex(df.sparkSession, path).add_spans(every)
    return out.select(F.least("docid", "repeats").alias("docid_a"), F.greatest("docid", "repeats").alias("docid_b"))
