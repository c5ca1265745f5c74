"""Streamed search over files whose times overlap, and what its state costs a request."""

import datetime

import duckdb
import pytest
from leafmill.plans import catalogue
from leafmill.streaming import searches
from pyspark.sql import Row


@pytest.mark.parametrize("files", [1, 4])
def test_files_that_overlap_in_time_lose_nothing(spark, sf, tmp_path, files):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(files, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["search_streamed"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    r = con.execute(catalogue.oracle_sql()["search_streamed"])
    cols = [d[0] for d in r.description]
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, r.fetchall()))


class Held:
    """A state handle that counts the trips."""

    def __init__(self):
        self.trips, self.value, self.timers = 0, None, []

    def __getattr__(self, name):
        def call(*args):
            if name in ("getValueState", "getMapState"):
                return self
            self.trips += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            if name == "registerTimer":
                self.timers.append(args[0])
            if name == "deleteTimer":
                self.timers.remove(args[0])
            return None

        return call


def test_a_request_takes_three_trips_to_its_state_a_batch():
    at = datetime.datetime(2024, 5, 1)
    row = lambda us, url, source="s": Row(ts=at, us=us, source_id=source, name="", author="", url=url)
    held, search = Held(), searches.Search(most=40, seconds=1)
    search.init(held)
    out = list(search.handleInputRows(("q",), iter([row(k, f"/{k}") for k in range(30)] + [row(31, None), row(30, " "), row(5, "/5"), row(32, "/5", None)]), None))
    assert [r["seq"] for r in out] == list(range(31)) and held.trips == 3 and held.timers == [1000]
    # known ones stay known in the next batch; a microsecond behind the deadline is behind it
    out = list(search.handleInputRows(("q",), iter([row(1_000_001, "/x"), row(1_000_000, "/y"), row(40, "/5", None), row(41, "/7")]), None))
    assert [(r["event"], r["seq"], r["url"], r["total"]) for r in out] == [("result", 31, "/y", None), ("done", 32, None, 32)]
    assert held.trips == 6 and held.timers == [] and not list(search.handleInputRows(("q",), iter([row(50, "/z")]), None))
