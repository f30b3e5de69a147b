"""Structured Streaming: incremental index, session state, event windows.

The batch forms of the same plans are registered as queries; here they run on streams. Late rows: a watermark on event
time bounds how late a row may be; later ones are dropped by Spark. Turns of a session that come out of order are
refused as an error row, not silently reordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import term_frequencies
from textloom.operators.stores import absent_rows
from textloom.runtime import path_exists

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 4) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total by fixed windows of event time."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, n by overlapping windows."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, stop, n: sessions that end after a gap without events."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def index_stream(terms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Postings of arriving sentences (_id, word) appended to an index; a sentence that was indexed before is left out, so a batch that runs again changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(path).select("_id").distinct() if path_exists(spark, path) else batch.select("_id").limit(0)
        new = term_frequencies(batch.join(known, "_id", "left_anti")).withColumn("batch", F.lit(number))
        new.repartition("word").write.mode("append").parquet(path)

    return terms.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_stream(rows: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Insert-if-absent of a stream into a store (SK1)."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        store = spark.read.parquet(path) if path_exists(spark, path) else batch.limit(0)
        absent_rows(batch, store, key, order).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dialog_state(turns: DataFrame) -> DataFrame:
    """conv_id, turn, status, known of a stream of (conv_id, turn, entities): keyed state with out-of-order turns refused (DL6).

    State: the last turn and the entities seen. A turn that isn't the next one gives status 'out of order' and leaves
    the state as it is.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, seen = state.get if state.exists else (0, [])
        known = set(seen)
        out = []
        for r in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.turn):
            if r.turn != turn + 1:
                out.append((key[0], r.turn, "out of order", len(known)))
                continue
            items = {x for x in (r.entities if r.entities is not None else []) if x}
            old = items & known
            status = "NoEntity" if not items else "AllExistEntity" if old == items else "AllNewEntity" if not old else "ExistAndNewEntity"
            known |= items
            turn = r.turn
            out.append((key[0], r.turn, status, len(known)))
        state.update((turn, sorted(known)))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "status", "known"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id bigint, turn int, status string, known int", "turn int, seen array<string>", "append", "NoTimeout")
