"""Structured Streaming operators, and the batch forms that give the same results on a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """The column as a timestamp with zone, as watermarks need it."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Stream without repeated keys within the watermark; later repeats are dropped with late rows."""
    return event_time(stream, column).withWatermark(column, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, key: str, column: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key in tumbling windows of event time."""
    return event_time(stream, column).withWatermark(column, late).groupBy(F.window(column, window), key).agg(F.count("*").alias("n"))


def debounced(stream: DataFrame, key: str, latest: str, gap: str = "500 milliseconds", column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row per burst of edits: the last version of a key once `gap` has passed without another."""
    return event_time(stream, column).withWatermark(column, late).groupBy(F.session_window(column, gap), key).agg(
        F.max_by(latest, F.struct(column, latest)).alias("latest"), F.count("*").alias("n")
    )


def sessions(events: DataFrame, key: str, gap_seconds: int, column: str = "ts") -> DataFrame:
    """The batch form of debounced(): bursts by gaps between neighbours."""
    w = Window.partitionBy(key).orderBy("__us")
    e = events.withColumn("__us", F.unix_micros(F.col(column).cast("timestamp")))
    begins = (F.col("__us") - F.lag("__us").over(w) >= gap_seconds * 1_000_000).cast("int")
    e = e.withColumn("session", F.sum(F.coalesce(begins, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(key, "session").agg(F.min("__us").alias("first_us"), F.max("__us").alias("last_us"), F.count("*").alias("n"))


def over_limit(events: DataFrame, key: str, limit: int = 10, seconds: int = 60, column: str = "ts") -> DataFrame:
    """Events that exceed `limit` of their key within the last `seconds`, themselves included."""
    us = F.unix_micros(F.col(column).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("__us", us).withColumn("recent", F.count("*").over(w)).where(F.col("recent") > limit).drop("__us")


def limited(stream: DataFrame, key: str, limit: int = 10, seconds: int = 60, column: str = "ts"):
    """The stream with `allowed` by a sliding window per key; state holds the times of allowed events alone, at most `limit` of them."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k, frames, state):
        times = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values("us", kind="stable")
            allowed = []
            for us in pdf.us:
                times = [t for t in times if t > us - seconds * 1_000_000]
                ok = len(times) < limit
                if ok:
                    times.append(int(us))
                allowed.append(ok)
            yield pd.DataFrame({"key": [k[0]] * len(pdf), "us": pdf.us, "allowed": allowed})
        state.update((times,))

    flat = event_time(stream, column).select(F.col(key).cast("string").alias("key"), F.unix_micros(column).alias("us"))
    return flat.groupBy("key").applyInPandasWithState(run, "key string, us long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, name: str, mode: str = "append") -> None:
    """Process all that is there, into Parquet files or, for changing results, the files of the last batch."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/{name}.state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/{name}").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/{name}")).start()
    query.awaitTermination()
