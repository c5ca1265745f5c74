"""Streamed search with a stop: per request the books that are new, until there are enough of them or its time is over.

A request's state is the keys of the books that are out (no more than ``most``), whether it is done, and a timer at its deadline.  Results of a
request are looked at in order of their time.  Since no more than ``most`` different books of a request can come out, each task first
keeps that many of its own, so that a request with a third of all results sends few rows to the task that counts them.  State and
output go forward together with the checkpoint: a batch that is tried again emits its rows once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Results and seconds of a request, fixed values.
MOST, SECONDS = 80, 120
#: Rows that a task keeps before it sends them on.
_HELD = 200_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["source_id", "name", "author", "url"]
EVENTS = "request string, event string, seq long, source_id string, name string, author string, url string, total long"


def _least(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of each request the first ``most`` different books, each at its first time, and its first and last rows, which tell the time."""
    rows = rows.sort_values(["request", "ts", "source_id", "url"], kind="stable")
    books = rows[rows["url"].fillna("").str.strip() != ""].drop_duplicates(["request", "source_id", "url"])
    books = books[books.groupby("request").cumcount() < most]
    ends = [rows.drop_duplicates(["request"], keep=k) for k in ("first", "last")]
    return pd.concat([books, *ends]).drop_duplicates().reset_index(drop=True)


def first_of_each(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(request, ts, source_id, name, author, url) thinned out inside each task to what can matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n > _HELD:
                held = [_least(pd.concat(held), most)]
                n = len(held[0])
                if n > _HELD // 2:
                    yield held.pop()
                    n = 0
        if held:
            yield _least(pd.concat(held), most)

    return rows.mapInPandas(run, rows.schema)


class Search(StatefulProcessor):
    """The results of one request, as they come, and its end.

    All that is known of a request is one value, since every look at the state is a trip to the JVM; the keys that are out are a JSON text in it.
    """

    def __init__(self, most: int = MOST, seconds: float = SECONDS):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "n long, until long, done boolean, seen string")

    def _row(self, key, event: str, seq: int, book=(None, None, None, None), total=None) -> Row:
        return Row(request=key[0], event=event, seq=seq, **dict(zip(_FIELDS, book, strict=True)), total=total)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.at.get()
        n, until, done, said = held or (0, None, False, "[]")
        if done:
            for _ in rows:
                pass
            return
        seen = {tuple(x) for x in json.loads(said)}
        # nulls last, as in the tasks that thin out
        for r in sorted(rows, key=lambda r: (r["us"], r["source_id"] is None, r["source_id"] or "", r["url"] is None, r["url"] or "")):
            if until is None:
                until = r["us"] + round(self.seconds * 1e6)
            known = (r["source_id"], r["url"])
            if r["us"] > until:
                done = True
                break
            if not (r["url"] or "").strip() or known in seen:
                continue
            seen.add(known)
            yield self._row(key, "result", n, [r[k] for k in _FIELDS])
            n += 1
            if n >= self.most:
                done = True
                break
        if done:
            if held:
                self.handle.deleteTimer(until // 1000)
            yield self._row(key, "done", n, total=n)
        elif not held:
            self.handle.registerTimer(until // 1000)
        self.at.update((n, until, done, "[]" if done else json.dumps([*seen])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, until, done, _ = self.at.get()
        if not done:
            self.at.update((n, until, True, "[]"))
            yield self._row(key, "done", n, total=n)

    def close(self) -> None:
        pass


def search_events(results: DataFrame, most: int = MOST, seconds: float = SECONDS, late: str = "0 seconds") -> DataFrame:
    """A stream of EVENTS of a stream (request, ts, source_id, name, author, url): 'result' per new book, 'done' with the total.

    A book is known by source and URL; one without a URL is left out.  A request ends with its ``most``-th book, or ``seconds`` after
    its first result, when the watermark or a later result of its own says so; what comes then is not looked at.
    """
    spark = results.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = results.select(F.col("request").cast("string").alias("request"), F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("string").alias(c) for c in _FIELDS])
    timed = first_of_each(rows.where("request is not null and ts is not null"), most).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("request").transformWithState(Search(most, seconds), EVENTS, "append", "EventTime")


def run_search(spark: SparkSession, results: DataFrame, path: str, checkpoint: str, **options) -> DataFrame:
    """The events of a search over what is there by now, as Parquet."""
    q = search_events(results, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(EVENTS).parquet(path)
