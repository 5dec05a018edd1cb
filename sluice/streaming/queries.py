"""The same queries over streams: watermarks, windows, time-to-live deduplication and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Event files that arrive below a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are dropped."""
    made = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return made.select(F.unix_seconds("w.start").alias("bucket"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each user's sessions, which a gap ends.

    Spark's window also takes in a row exactly at its end; it ends a microsecond early here, so that a gap of full length ends a session.
    """
    made = stream.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} -1 microsecond").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str], ttl: str = "8 hours") -> DataFrame:
    """The first row of each key within its time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def throttled_alerts(stream: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """(user_id, sec) of alerts that are sent: each user is silent for so many minutes after one.

    The state of a user is the time of the last alert sent; it is dropped when the silence is over.
    """
    width = minutes * 60

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(x for part in parts for x in part["sec"])
        sent = []
        for sec in times:
            if last is None or sec - last > width:
                sent.append(sec)
                last = sec
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int(last + width + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(sent), "sec": sent})

    rows = stream.withWatermark("ts", late).select("ts", "user_id", F.unix_seconds("ts").alias("sec"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, sec long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def guarded(rows: DataFrame, latest: str) -> DataFrame:
    """rows with column verdict: `future` for times beyond what can be, `broken` for missing ones, else `ok`."""
    verdict = F.when(F.col("ts").isNull(), "broken").when(F.col("ts") > F.lit(latest).cast("timestamp"), "future").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def run_with_dead_letters(stream: DataFrame, path: str, dead: str, checkpoint: str) -> None:
    """Rows with the verdict `ok` go to path, others to the dead letters.

    A batch's rows lie in a folder of its own, which is written anew if the batch is run again after a failure.
    """

    def split(batch: DataFrame, number: int) -> None:
        for where, keep in ((path, "verdict = 'ok'"), (dead, "verdict <> 'ok'")):
            batch.filter(keep).write.mode("overwrite").parquet(f"{where}/batch={number}")

    stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_updates(counts: DataFrame, path: str, checkpoint: str, every: str | None = None) -> None:
    """In update mode each batch writes only the groups that it changed; `every` names a processing-time interval for a run without end."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    if every:
        writer.trigger(processingTime=every).start()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates (keys, values, batch) of each group the last."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, "__v.*")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, then stop; the rows are in an in-memory table (for tests and small replays)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there into Parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
