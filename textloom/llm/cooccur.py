"""Items that appear together: exact pair counts over baskets, and how far they exceed chance.

Items get dense 32-bit codes; a pair is one 64-bit code (smaller item first). Each task sorts the codes of a chunk and
keeps (code, run length), so sorted runs are spilled already combined. The shuffle brings equal codes together, Spark's
external sort merges the runs, and one pass over the sorted rows adds up run lengths. Baskets of more than ``BLOCK``
members are cut into blocks; pairs of blocks are spread over tasks, so no basket sits in one task as a whole.

Defined cases: items are trimmed and lower-cased, null and blank ones left out, repeats in a basket count once; a null
basket id is no basket; baskets without members do not count; a pair's items are ordered by code points; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.runtime import add_dense_ids, materialize

#: Members of a basket that one row may hold, and pair codes sorted at once in a task.
BLOCK = 256
CHUNK_PAIRS = 2_000_000


def basket_items(df: DataFrame, basket: str, items: str, keep: Column | None = None) -> DataFrame:
    """basket, item: the distinct members of each basket."""
    rows = df.where(F.col(basket).isNotNull() if keep is None else keep)
    item = F.lower(F.regexp_replace("item", r"(?U)^\s+|\s+$", ""))
    return rows.select(F.col(basket).alias("basket"), F.explode(items).alias("item")).withColumn("item", item).where("item <> ''").distinct()


def _pairs_within(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """Pair codes of lists of ascending int32 codes, in chunks."""
    flat = lists.flatten().to_numpy().astype(np.int64)
    offs = lists.offsets.to_numpy()
    n = np.diff(offs)
    for size in np.unique(n[n > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        rows = offs[:-1][n == size]
        step = max(1, CHUNK_PAIRS // len(i))
        for a in range(0, len(rows), step):
            m = flat[rows[a : a + step, None] + np.arange(size)]
            yield (m[:, i] << 32 | m[:, j]).ravel()


def _run_lengths(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.concatenate((at, [len(codes)])))


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combined sorted runs of the pairs within ``a``, or between ``a`` and ``b`` where ``b`` is set."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes, n = _run_lengths(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    def chunks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        cross = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        within = batch.filter(pa.array(~cross))
        if within.num_rows:
            yield from _pairs_within(within.column(0))
        for k in np.flatnonzero(cross):
            a = batch.column(0)[k].values.to_numpy().astype(np.int64)
            b = batch.column(1)[k].values.to_numpy().astype(np.int64)
            x, y = np.minimum(a[:, None], b[None]), np.maximum(a[:, None], b[None])
            yield (x << 32 | y).ravel()

    for batch in batches:
        for codes in chunks(batch):
            held.append(codes)
            size += len(codes)
            if size >= CHUNK_PAIRS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up run lengths of rows sorted by code; a run that goes on in the next batch is carried over."""
    names = ["code", "n"]
    code: int | None = None
    total = 0
    for b in batches:
        codes, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(codes):
            continue
        if code is not None:
            codes, n = np.concatenate(([code], codes)), np.concatenate(([total], n))
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        sums = np.add.reduceat(n, at)
        code, total = int(codes[at[-1]]), int(sums[-1])
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[at[:-1]]), pa.array(sums[:-1])], names=names)
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], names=names)


def _count_lists(lists: DataFrame) -> DataFrame:
    runs = lists.select("a", "b").mapInArrow(_sorted_runs, "code bigint, n bigint")
    # the external sort: hash-partitioned runs, merged per partition in code order
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_add_runs, "code bigint, n bigint")


def _basket_lists(members: DataFrame) -> DataFrame:
    """Rows (a, b) whose pairs are exactly the pairs of all baskets; no row holds more than ``BLOCK`` members a side."""
    sized = members.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(1 << 20)))
    sizes = members.groupBy("basket").count()
    small = sizes.where(F.col("count").between(2, BLOCK)).select("basket")
    large = sizes.where(F.col("count") > BLOCK).select("basket", (F.col("count") / (BLOCK // 2) + 1).cast("int").alias("blocks"))
    one = members.join(small, "basket", "left_semi").groupBy("basket").agg(F.array_sort(F.collect_list("code")).alias("a")).select("a", F.lit(None).cast("array<int>").alias("b"))
    cut = sized.join(large, "basket").withColumn("block", F.pmod("block", "blocks").cast("int")).groupBy("basket", "blocks", "block").agg(F.array_sort(F.collect_list("code")).alias("a"))
    cut = materialize(cut, "blocks")
    inner = cut.select("a", F.lit(None).cast("array<int>").alias("b"))
    # every two blocks of a basket meet under a key of their own, so that one basket's pairs of blocks are spread over tasks
    last = F.col("blocks") - 1
    x = cut.where(F.col("block") < last).select("basket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, last)).alias("j"), "a")
    y = cut.where("block > 0").select("basket", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("a").alias("b"))
    outer = x.join(y, ["basket", "i", "j"]).select("a", "b")
    return one.unionByName(inner).unionByName(outer)


def pair_statistics(members: DataFrame, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Each pair of items with its counts and its excess over chance.

    ``members``: of ``basket_items``. Columns: item_a < item_b, n_ab, n_a, n_b, n (baskets), lift = n_ab n / (n_a n_b),
    and log_odds: the natural log of the odds ratio of the 2 x 2 table with 0.5 added to each cell. ``min_count`` and
    ``min_lift`` are exact bounds; items that no kept pair can hold (n_a < min_count, or n < min_lift n_a) are left out
    before pairs are made, which loses none.
    """
    members = materialize(members, "members")
    n = members.select("basket").distinct().count()
    counts = members.groupBy("item").agg(F.count("*").alias("n_item")).where((F.col("n_item") >= min_count) & (F.col("n_item") * float(min_lift) <= n))
    items = materialize(add_dense_ids(counts, ["item"], "code").withColumn("code", F.col("code").cast("int")), "items")
    coded = materialize(members.join(items.select("item", "code"), "item").select("basket", "code"), "coded")
    pairs = _count_lists(_basket_lists(coded)).where(F.col("n") >= min_count)
    pairs = pairs.select(F.shiftright("code", 32).cast("int").alias("code_a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("code_b"), F.col("n").alias("n_ab"))
    side = lambda s: items.select(F.col("code").alias(f"code_{s}"), F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    out = pairs.join(side("a"), "code_a").join(side("b"), "code_b").withColumn("n", F.lit(n).cast("bigint"))
    ab, a, b, t = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    lift = ab * t / (a * b)
    odds = (ab + 0.5) * (t - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    out = out.where(ab * t >= min_lift * a * b)
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.ln(odds).alias("log_odds"))
