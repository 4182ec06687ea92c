"""Structured Streaming forms of the monitoring and scrubbing operators.

Event time comes in as ``TIMESTAMP_NTZ`` in the driver tables; ``withWatermark``
needs ``TIMESTAMP``, so every stream casts ``ts`` first (session time zone UTC).
Sinks are parquet tables under the shared checkpoint folder, written with
``availableNow`` so that a test or a scheduled job processes what is there and
stops; the streaming checkpoint makes a restarted job resume exactly once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators.scrub import scrub_table
from ticketlake.session import checkpoint_dir


def stage_as_stream_source(df: DataFrame, name: str) -> str:
    """Write a batch table into a folder a ``readStream`` can watch (tests and replays)."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"src-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A replay of a folder.  No limit of files a trigger: files do not come in the order of event
    time, and a later trigger would find the watermark ahead of its rows and drop them."""
    return (spark.readStream.schema(schema).parquet(path)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def run_available_now(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query to completion over the data present, then read the sink."""
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    q = (df.writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/chk").outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")


def run_latest(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run to completion in update mode and return each key's last row, so that windows which the
    watermark has not closed yet are there too.  Each trigger's changes are one folder, written
    anew if the trigger is repeated."""
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/trigger={batch}")
    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", base + "/chk").outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.option("basePath", base + "/out").parquet(base + "/out/*").drop("trigger")
    rest = [c for c in df.columns if c not in keys]
    return (out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns))


def scrub_stream(tickets: DataFrame, path: str, max_batches: int | None = None, **scrub) -> DataFrame:
    """P19 as a stream: every trigger's tickets go through the batch ``scrub_table`` (``scrub``: its
    arguments) into a folder of their own under ``path``, then the whole sink is read.

    A trigger that is repeated after a failure writes its folder anew, and the streaming checkpoint
    beside it says where to go on, so each ticket is in the sink once however often the job is
    restarted.  ``max_batches`` fails the run after so many triggers (for tests of a restart).
    """
    done = []

    def write(rows: DataFrame, batch: int) -> None:
        scrub_table(rows, **scrub).write.mode("overwrite").parquet(f"{path}/out/trigger={batch}")
        done.append(batch)
        if max_batches is not None and len(done) >= max_batches:
            raise RuntimeError(f"stopped after trigger {batch}")
    q = (tickets.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    spark = tickets.sparkSession
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/*").drop("trigger")


def dedupe_prediction_stream(log_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A prediction log stream deduplicated on ``request_id``; rows later than
    the watermark are dropped, state is bounded by the watermark."""
    return log_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def tier3_rate_stream(log_stream: DataFrame, delay: str = "1 hour", max_rate: float = 0.40) -> DataFrame:
    """M1 as a stream: tumbling hourly windows closed by the watermark (append mode)."""
    g = (log_stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"))
         .agg(F.count("*").alias("n"), F.avg(F.col("tier_used").startswith("groq").cast("double")).alias("rate")))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), F.col("n").cast("long").alias("n"),
                    F.round("rate", 9).alias("tier3_rate"), (F.col("rate") > max_rate).alias("alert"))


def feedback_join_stream(log_stream: DataFrame, feedback_stream: DataFrame, within: str = "1 hour",
                         delay: str = "2 hours") -> DataFrame:
    """Prediction x feedback for the same ticket, feedback arriving within
    ``within`` after the prediction; both sides watermarked, so join state is
    dropped once it can no longer match."""
    p = log_stream.withWatermark("ts", delay).select(
        "request_id", F.col("ticket_id").alias("p_ticket"), F.col("ts").alias("p_ts"), "predicted_category")
    f = feedback_stream.withWatermark("ts", delay).select(
        "feedback_id", F.col("ticket_id").alias("f_ticket"), F.col("ts").alias("f_ts"), "corrected_category")
    cond = ((F.col("p_ticket") == F.col("f_ticket")) & (F.col("f_ts") >= F.col("p_ts"))
            & (F.col("f_ts") <= F.col("p_ts") + F.expr(f"INTERVAL {within}")))
    return p.join(f, cond, "inner").select(
        "request_id", "feedback_id", F.col("p_ticket").alias("ticket_id"), "predicted_category", "corrected_category")
