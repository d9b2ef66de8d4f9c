"""Extension: the same aggregations over streams.

``tumbling``, ``sliding``, ``once`` and ``followed`` work on batches and on streams
alike. ``ingest`` merges each micro-batch of staged rows by the batch importer, whose
"oldest wins" rule makes a replayed batch harmless. Late rows count while the watermark
holds their window open; batch recomputation covers whatever comes later.

Results of a stream lie in files, a folder a batch: a batch that runs again after a
failure writes its folder anew, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(total, 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Counts and sums by overlapping windows and type: each row counts in every window that holds it."""
    rows = events.withWatermark("ts", late) if late else events
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    out = rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(total, 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def once(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """``rows`` without those whose ``keys`` came before, within ``late`` of each other on a stream."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def followed(first: DataFrame, second: DataFrame, key: str, within: str, late: str | None = None) -> DataFrame:
    """(key, first_ts, second_ts, first_id, second_id): rows of ``first`` (key, ts, id) and
    the rows of ``second`` of that key that follow ``within`` so long. On streams each side
    keeps what may yet meet a row of the other, and no more: watermarks bound the state, by
    ``late`` unless the streams have theirs."""
    marked = lambda df: df.withWatermark("ts", late) if df.isStreaming and late else df
    side = lambda df, name: marked(df).select(F.col(key).alias(f"{name}_key"), F.col("ts").alias(f"{name}_ts"), F.col("id").alias(f"{name}_id"))
    gap = F.expr(f"second_ts >= first_ts AND second_ts <= first_ts + INTERVAL {within}")
    met = side(first, "first").join(side(second, "second"), (F.col("first_key") == F.col("second_key")) & gap)
    return met.select(F.col("first_key").alias(key), "first_ts", "second_ts", "first_id", "second_id")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's runs of events with no pause of ``gap``."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def to_files(rows: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write a stream's batches to ``path``/batch=<n>. ``mode``: "append", or "update",
    where a row may come again; the row of the last batch is the one that holds."""

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def from_files(spark: SparkSession, path: str, schema, keys: list[str] | None = None) -> DataFrame:
    """What ``to_files`` has written: of rows that came again by ``keys``, the last."""
    names = [f.name for f in schema.fields]
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*").select(*names)


def replay(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The events table as a stream, run to its end: what the windows hold then."""
    rows = tumbling(event_stream(spark, sf_dir), late="40 days")
    to_files(rows, f"{path}/windows", f"{path}/checkpoint", "update").awaitTermination()
    return from_files(spark, f"{path}/windows", rows.schema, ["window_start", "event_type"])


def replay_followed(spark: SparkSession, sf_dir: str, path: str, first: str, second: str, within: str) -> DataFrame:
    """Pairs of the events table as two streams, repeated events counted once."""
    of = lambda kind: once(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type") == kind).withColumn("id", F.col("event_id")), ["event_id"], "40 days")
    rows = followed(of(first), of(second), "user_id", within)
    to_files(rows, f"{path}/pairs", f"{path}/checkpoint", "append").awaitTermination()
    return from_files(spark, f"{path}/pairs", rows.schema)


def ingest(rows: DataFrame, merge: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of ``rows`` with ``merge``, such as a workspace's ``import_rows``."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            # The order of a batch's rows stands in for the order in a file.
            merge(batch if "line" in batch.columns else batch.withColumn("line", F.monotonically_increasing_id()))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
