"""Store semantics without a database: insert if absent, update by predicate, upsert, keep the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import path_exists


def absent_rows(batch: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch whose key the store lacks, each key once, the first by ``order`` (SK1, JN16). Null keys are left out."""
    w = Window.partitionBy(key).orderBy(order)
    new = batch.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return new.join(store.select(key), key, "left_anti")


def updated_rows(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """All rows, with the values set where the predicate holds; a null predicate counts as false (SK2)."""
    for c, v in values.items():
        df = df.withColumn(c, F.when(where, v).otherwise(F.col(c)))
    return df


def upsert(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The store with the batch's rows in place of rows of the same key (SK7 without dropping)."""
    return store.join(batch.select(key), key, "left_anti").unionByName(batch)


def append_absent(batch: DataFrame, path: str, key: str, order: str) -> int:
    """Append to a Parquet store the batch's rows it lacks; returns how many. A store that doesn't exist yet is made."""
    spark = batch.sparkSession
    store = spark.read.parquet(path) if path_exists(spark, path) else batch.limit(0)
    new = absent_rows(batch, store, key, order)
    new = new.cache()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def dump(df: DataFrame, path: str, kind: str) -> None:
    """Write rows as text, a row a line: ``json`` objects, ``tsv`` or ``csv`` (with header, nulls empty), or ``html`` table rows (SK5)."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind in ("csv", "tsv"):
        df.write.mode("overwrite").csv(path, sep="," if kind == "csv" else "\t", header=True, escape='"')
    elif kind == "html":
        safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in df.columns]
        df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(kind)


def write_arrays(df: DataFrame, path: str) -> None:
    """Model-ready rows: arrays stay arrays, in Parquet; a null array is an empty one (SK6)."""
    cols = [F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").parquet(path)


def reload_unique(df: DataFrame, path: str, key: str) -> None:
    """Replace a store; rows that share a key, or have none, are refused before anything is written (SK7)."""
    if not df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} isn't unique")
    df.write.mode("overwrite").parquet(path)


def append_daily(df: DataFrame, path: str, time: str) -> None:
    """Append events to a tab log with one folder a day (SK10); rows without a time go to the folder of no day."""
    df.withColumn("day", F.date_format(time, "yyyyMMdd")).write.mode("append").partitionBy("day").csv(path, sep="\t", nullValue="")
