"""Vector operators: similarities, pooling, losses, nearest neighbours. Arithmetic in double; sums in a fixed order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import add_running_sum


def _v(x: Column | str) -> Column:
    return F.transform(F.col(x) if isinstance(x, str) else x, lambda e: e.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products (MA5)."""
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Corpus vectors held at once in a task.
SLICE = 20_000


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """query, key, cosine, rank of the k nearest corpus rows of each query (JN18, TK4).

    The corpus is dealt into slices of about ``SLICE`` vectors, every query is sent to each slice, and a task streams the
    queries past the slice it holds as matrix products, keeping k of each query; so memory is bounded and what is shuffled
    last is k rows a query and slice. A query's own row counts like others; null vectors are left out.
    """
    kind = corpus.schema[key].dataType.simpleString()
    c = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), _v(vector).alias("v"))
    slices = max(1, -(-c.count() // SLICE))
    c = c.select(F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"), "key", "v")
    q = queries.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), F.col(key).alias("key"), _v(vector).alias("v"))
    rows = c.unionByName(q).repartition(slices, "slice").sortWithinPartitions("slice", "asks")

    def matrix(vectors: pa.ListArray) -> np.ndarray:
        return vectors.flatten().to_numpy().reshape(len(vectors), -1)

    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held_keys, held, y, keys = None, [], [], None, None
        for b in batches:
            where, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if own != where[lo]:
                    own, held_keys, held, y = where[lo], [], [], None
                if not asks[lo]:
                    held_keys.append(part.column(2).to_numpy(zero_copy_only=False))
                    held.append(matrix(part.column(3)))
                    continue
                if not held:
                    continue
                if y is None:
                    y, keys = unit(np.concatenate(held)), np.concatenate(held_keys)
                    order = np.argsort(keys, kind="stable")
                    y, keys = y[order], keys[order]
                for a in range(0, part.num_rows, 512):
                    some = part.slice(a, 512)
                    s = np.nan_to_num(unit(matrix(some.column(3))) @ y.T, nan=-2.0)
                    best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]  # equal ones by key
                    n = best.shape[1]
                    asked = some.column(2).take(pa.array(np.repeat(np.arange(some.num_rows), n)))
                    yield pa.RecordBatch.from_arrays([asked, pa.array(keys[best.ravel()]).cast(asked.type), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query", key, "cosine"])

    best = rows.mapInArrow(score, f"query {kind}, `{key}` {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dimensions(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, dim, x: one row a dimension."""
    return df.select(*keys, F.posexplode(_v(vector)).alias("dim", "x"))


def pooled(df: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """group, dim, mean, max, mean_sqrt of token vectors (AG27), weighted where a weight column is given (AG28)."""
    d = dimensions(df, [group, *([weight] if weight else [])], vector)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = F.greatest(F.sum(w), F.lit(1e-9))
    return d.groupBy(group, "dim").agg((F.sum(F.col("x") * w) / total).alias("mean"), F.max("x").alias("max"), (F.sum(F.col("x") * w) / F.sqrt(total)).alias("mean_sqrt"))


def with_average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of a column's values, ties at their mean; equal values are counted first."""
    per = add_running_sum(df.groupBy(value).agg(F.count("*").alias("__n")), [value], {"__n": "__upto"})
    return df.join(per.select(value, (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(name)), value)


def batch_pairs(df: DataFrame, key: str, batch: str, vector: str, label: str) -> DataFrame:
    """All ordered pairs inside each batch with their Euclidean distance (JN19); batches are bounded by what makes them."""
    a = df.select(F.col(batch).alias("batch"), F.col(key).alias("a"), F.col(label).alias("la"), F.col(vector).alias("va"))
    b = df.select(F.col(batch).alias("batch"), F.col(key).alias("b"), F.col(label).alias("lb"), F.col(vector).alias("vb"))
    return a.join(b, "batch").select("batch", "a", "b", "la", "lb", euclidean("va", "vb").alias("distance"))


def batch_hard_loss(pairs: DataFrame, margin: float = 5.0) -> DataFrame:
    """batch, loss: mean over anchors of max(0, farthest positive - nearest negative + margin) (AG40)."""
    per = pairs.groupBy("batch", "a").agg(F.max(F.when((F.col("la") == F.col("lb")) & (F.col("a") != F.col("b")), F.col("distance"))).alias("pos"), F.min(F.when(F.col("la") != F.col("lb"), F.col("distance"))).alias("neg"))
    most = F.coalesce("pos", F.lit(0.0)) - F.coalesce("neg", F.lit(0.0)) + F.lit(margin)
    return per.groupBy("batch").agg(F.avg(F.greatest(most, F.lit(0.0))).alias("loss"), F.count("*").alias("anchors"))


def batch_all_loss(pairs: DataFrame, margin: float = 5.0) -> DataFrame:
    """batch, loss (mean of positive triplets), valid, positive of all triplets of a batch (AG40)."""
    p = pairs.where("la = lb and a <> b").select("batch", "a", F.col("b").alias("p"), F.col("distance").alias("dp"))
    n = pairs.where("la <> lb").select("batch", "a", F.col("distance").alias("dn"))
    t = p.join(n, ["batch", "a"]).withColumn("x", F.greatest(F.col("dp") - F.col("dn") + F.lit(margin), F.lit(0.0)))
    return t.groupBy("batch").agg(F.count("*").alias("valid"), F.count_if(F.col("x") > 1e-16).alias("positive"), F.sum("x").alias("total")).withColumn("loss", F.col("total") / (F.col("positive") + F.lit(1e-16))).drop("total")


def agglomerate(rows, k: int):
    """Ward linkage of one bounded group's vectors into k clusters; labels by first member (AG44)."""
    x = [np.array(v, dtype=float) for v in rows]
    size = [1] * len(x)
    member = [[i] for i in range(len(x))]
    while len(x) > k:
        best = min(((size[i] * size[j] / (size[i] + size[j]) * float(((x[i] - x[j]) ** 2).sum()), i, j) for i in range(len(x)) for j in range(i)), key=lambda t: t)
        _, i, j = best
        x[j] = (x[i] * size[i] + x[j] * size[j]) / (size[i] + size[j])
        size[j] += size[i]
        member[j] += member[i]
        del x[i], size[i], member[i]
    return {i: min(m) for m in member for i in m}
