"""Streaming forms: deduplicated search and feed streams, rate analysis per key, debug events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder (or pattern) as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose key is new; with ts the state is dropped behind the watermark."""
    if ts is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and return what came out (a memory table: for checks and small results)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into Parquet files."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def in_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with n_window: events of the key in the last seconds, this one included."""
    return events.withColumn("n_window", F.expr(f"count(1) over (partition by {key} order by {ts} range between interval {seconds} seconds preceding and current row)"))


def _fold(events: DataFrame, key: str, ts: str, id_: str, step) -> DataFrame:
    """A sequential decision per event of a key in order of time: Spark sorts, the worker streams with a small state."""
    key_type, id_type = events.schema[key].dataType.simpleString(), events.schema[id_].dataType.simpleString()
    rows = events.select(key, id_, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).repartition(key).sortWithinPartitions(key, "us", id_)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for f in frames:
            out = []
            for k, us in zip(f[key].tolist(), f["us"].tolist(), strict=True):
                if k != now:
                    now, state = k, None
                state, ok = step(state, us)
                out.append(ok)
            yield pd.DataFrame({key: f[key], id_: f[id_], "accepted": out})

    return rows.mapInPandas(run, f"{key} {key_type}, {id_} {id_type}, accepted boolean")


def sliding_limit(events: DataFrame, key: str, ts: str, id_: str, most: int, seconds: float) -> DataFrame:
    """(key, id, accepted): at most ``most`` accepted events of a key in any window of these seconds."""
    width = int(seconds * 1e6)

    def step(state, us):
        held = [t for t in (state or []) if t > us - width]
        ok = len(held) < most
        return ([*held, us] if ok else held), ok

    return _fold(events, key, ts, id_, step)


def token_bucket(events: DataFrame, key: str, ts: str, id_: str, rate: float, burst: float) -> DataFrame:
    """(key, id, accepted): a bucket of ``burst`` tokens a key, refilled at ``rate`` a second; an event takes one."""

    def step(state, us):
        tokens, last = state or (burst, us)
        tokens = min(burst, tokens + rate * (us - last) / 1e6)
        ok = tokens >= 1
        return (tokens - ok, us), ok

    return _fold(events, key, ts, id_, step)


def debug_events(results: DataFrame, key: str, phase: str, ok) -> DataFrame:
    """start and done or error events of a phase per row."""
    return results.select(key, F.lit(phase).alias("step"), F.explode(F.array(F.lit("start"), F.when(ok, "done").otherwise("error"))).alias("status"))


def search_stream(results: DataFrame, keys: list[str], most: int, path: str, checkpoint: str) -> DataFrame:
    """Streamed search results: new keys only, at most ``most`` in all; a batch writes its own folder, and those before it say how many are out.

    A batch that is tried again takes the place of what it wrote before.  searches.search_events() does the same per request, in state.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            out = spark.read.schema("batch long").parquet(path).where(F.col("batch") < batch_id).count()
        except Exception as e:  # nothing is out yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out = 0
        batch = batch.persist()  # the whole batch runs, so that every partition's state is committed
        batch.count()
        batch.limit(max(0, most - out)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    q = results.dropDuplicates(keys).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return results.sparkSession.read.schema(results.schema).option("basePath", path).parquet(path)
