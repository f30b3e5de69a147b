"""Session, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; keyword arguments are Spark settings with ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary one on a single machine; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system; nothing happens if it is gone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file, the sign that what it names is complete."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write one small text file; returns its path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


#: Scratch paths made so far.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder, removed when the driver exits or by ``clear_scratch``."""
    if not _MADE:
        atexit.register(clear_scratch, spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch folders of this driver; results that weren't written elsewhere can't be read afterwards."""
    while _MADE:
        delete_path(spark, _MADE.pop())


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, columns stay prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def add_dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Dense ids ``start..`` in the given order without a single-task window.

    Rows are range-partitioned and written once; each partition's row count gives the next one's offset (one row per
    partition is broadcast). The order must be total for a stable result. An empty table yields no rows.
    """
    part, at = f"__part_{name}", f"__at_{name}"
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn(part, F.spark_partition_id()), "ranged")
    sizes = kept.groupBy(part).count().collect()  # one row per partition
    total, rows = start, []
    for r in sorted(sizes, key=lambda r: r[part]):
        rows.append((r[part], total))
        total += r["count"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(rows or [(-1, 0)], f"{part} int, {at} long")
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(*order)
    return (
        kept.withColumn("__n", F.row_number().over(w))
        .join(F.broadcast(offsets), part)
        .withColumn(name, F.col(at) + F.col("__n") - 1)
        .drop(part, at, "__n")
    )


def add_running_sum(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums in the given order, the row itself included, without a single-task window. ``values``: new column by summed column.

    Like ``add_dense_ids``: range partitions are summed by themselves, and one offset a partition is added. Null counts 0.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    sums = kept.groupBy("__part").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("double").alias(n) for v, n in values.items()]).collect()  # one row per partition
    rows, total = [], [0.0] * len(values)
    for r in sorted(sums, key=lambda r: r["__part"]):
        rows.append((r["__part"], *total))
        total = [t + r[n] for t, n in zip(total, values.values())]
    offsets = df.sparkSession.createDataFrame(rows or [(-1, *total)], "__part int, " + ", ".join(f"`__at_{n}` double" for n in values.values()))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(offsets), "__part")
    for v, n in values.items():
        out = out.withColumn(n, F.col(f"__at_{n}") + F.coalesce(F.sum(v).over(w), F.lit(0.0)))
    return out.drop("__part", *[f"__at_{n}" for n in values.values()])
