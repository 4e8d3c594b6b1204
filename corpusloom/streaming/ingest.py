"""Structured Streaming: incremental ingest by id, sessions and the blocked-run stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parquet_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """New files of a folder (or a file pattern), by the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_rows(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """Each key once; state is dropped ``delay`` after its time, the latest lateness expected."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, out: str, ledger: str, key: str, checkpoint: str) -> None:
    """Append rows whose key the ledger lacks, then the keys; a repeated batch writes nothing
    twice, since its rows are written under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(ledger).where(F.col("batch") != number).select(key)
            rows = rows.join(done.distinct(), key, "left_anti")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows = rows.withColumn("batch", F.lit(number))
        rows.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.read.parquet(f"{out}/batch={number}").select(key).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Runs of events of a user without a pause of ``gap``; with ``delay`` late events are waited for."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, delay) if delay else e
    s = e.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("events"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to parquet, and read that."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def blocked_runs(results: DataFrame, key: str, order: str, status: str, limit: int = 5) -> DataFrame:
    """``(key, order, streak, stop)`` of a bounded batch: the number of ``blocked`` results in
    a row, and whether the run should stop."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocked = F.col(status) == "blocked"
    island = results.withColumn("island", F.sum((~blocked).cast("int")).over(w))
    run = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(blocked.cast("int")).over(run)
    return island.withColumn("streak", streak).withColumn("stop", F.col("streak") >= limit).select(key, order, "streak", "stop")


def stop_signals(stream: DataFrame, key: str, order: str, status: str, limit: int = 5) -> DataFrame:
    """The same over a stream, the streak kept as state: a row for each time a key reaches the limit."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for f in frames:
            for at, s in f.sort_values(order)[[order, status]].itertuples(index=False):
                streak = streak + 1 if s == "blocked" else 0
                if streak == limit:
                    out.append((k[0], at))
        state.update((streak,))
        yield pd.DataFrame(out, columns=[key, order])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", "streak int", "append", GroupStateTimeout.NoTimeout)
