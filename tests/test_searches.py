"""Streamed search: stop at enough results or at the deadline, restarts, hot requests, and rules kept in a table."""

import datetime
import random

import pandas as pd
import pytest
from leafmill.operators import replacing
from leafmill.streaming import searches, streams
from pyspark.sql import functions as F

SCHEMA = "request string, ts timestamp, source_id string, name string, author string, url string"
T0 = datetime.datetime(2024, 5, 1)


def brute(rows, most, seconds):
    """Events of rows that come in order of their time, and the time that the stream has come to."""
    out, by = [], {}
    for request, ts, source, name, _, url in sorted(rows, key=lambda r: (r[1], r[2], r[5] or "")):
        q = by.setdefault(request, {"until": ts + datetime.timedelta(seconds=seconds), "seen": set(), "done": False})
        if q["done"]:
            continue
        if ts > q["until"]:
            q["done"] = True
            out.append((request, "done", len(q["seen"]), None, None, len(q["seen"])))
        elif (url or "").strip() and (source, url) not in q["seen"]:
            out.append((request, "result", len(q["seen"]), name, url, None))
            q["seen"].add((source, url))
            if len(q["seen"]) >= most:
                q["done"] = True
                out.append((request, "done", most, None, None, most))
    now = max(r[1] for r in rows)
    return out + [(k, "done", len(q["seen"]), None, None, len(q["seen"])) for k, q in by.items() if not q["done"] and q["until"] <= now]


def made(n, seed, requests=6):
    rng = random.Random(seed)
    rows = [(f"q{rng.randrange(requests)}", T0 + datetime.timedelta(seconds=k, milliseconds=rng.randrange(1000)), f"s{rng.randrange(3)}", f"n{k}", "", rng.choice([None, " ", *[f"/b{j}" for j in range(12)]])) for k in range(n)]
    return [(r[0], r[1], r[2], f"{r[2]}{r[5]}", "", r[5]) for r in rows]


def lay(spark, rows, path, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(path)


def events(df):
    return sorted(map(tuple, df.select("request", "event", "seq", "name", "url", "total").collect()), key=str)


@pytest.mark.parametrize(("most", "seconds"), [(5, 1000), (80, 60), (9, 100)])
def test_requests_end_at_enough_books_or_at_their_deadline(spark, tmp_path, most, seconds):
    rows = made(400, most)
    lay(spark, rows, f"{tmp_path}/in")
    stream = streams.read_parquet_stream(spark, f"{tmp_path}/in", files=100)
    assert events(searches.run_search(spark, stream, f"{tmp_path}/out", f"{tmp_path}/state", most=most, seconds=seconds)) == sorted(brute(rows, most, seconds), key=str)


def test_a_restart_goes_on_where_the_checkpoint_stands(spark, tmp_path):
    rows = made(300, 1)
    out = None
    for k, part in enumerate((rows[:100], rows[100:180], rows[180:])):
        lay(spark, part, f"{tmp_path}/in", parts=1)
        stream = streams.read_parquet_stream(spark, f"{tmp_path}/in", files=1)
        out = searches.run_search(spark, stream, f"{tmp_path}/out", f"{tmp_path}/state", most=10, seconds=150)
        assert events(out) == sorted(brute(rows[: (100, 180, 300)[k]], 10, 150), key=str)


def test_a_task_keeps_few_rows_of_a_hot_request():
    rows = pd.DataFrame([*[("hot", T0 + datetime.timedelta(seconds=k), "s", "", "", f"/{k % 1000}") for k in range(5000)], ("cold", T0, "s", "", "", None)], columns=["request", "ts", "source_id", "name", "author", "url"])
    kept = searches._least(rows.sample(frac=1, random_state=1), 20)
    hot = kept[kept["request"] == "hot"]
    assert hot["url"].tolist()[:20] == [f"/{k}" for k in range(20)] and len(hot) == 21 and hot["ts"].max() == rows["ts"].max()
    assert kept[kept["request"] == "cold"]["url"].tolist() == [None]


# ---- replace rules in a table ----

RULES = [
    (1, "b+", "<$0>", "all", 1, False, True),
    (2, "A", "b", "x", 1, True, True),
    (3, "(c)(d)?", "$2$1$9", "x", 5, False, True),
    (4, "[", "\\$1", "all", 9, False, True),
    (5, "z", "never", "all", 99, False, False),
    (6, "", "never", "all", 99, False, True),
    (7, "e", None, None, None, False, True),
    (8, "q", "only y", "y", 3, False, True),
    (9, "q", "null", "y", 7, None, None),
]


def test_rules_of_a_table_apply_in_order_and_by_scope(spark):
    rules = spark.createDataFrame(RULES, "id long, pattern string, replacement string, scope string, order int, case_insensitive boolean, enabled boolean")
    texts = spark.createDataFrame([(1, "acdbb[zeq", "x", "k"), (2, "acdbb[zeq", "y", "k"), (3, "acdbb[zeq", "none", "k"), (4, "acdbb[zeq", None, "k"), (5, None, "x", "k"), (6, "", "x", "k")], "id int, text string, scope string, rules string")
    got = {r["id"]: r["text"] for r in replacing.apply_rules(texts, rules, "text", "scope").collect()}
    plain = "acd<bb>\\$1zq"
    assert got == {1: "<b>dc<bb>\\$1zq", 2: plain.replace("q", "only y"), 3: plain, 4: plain, 5: None, 6: ""}
    assert {r["id"] for r in replacing.apply_rules(texts, rules.limit(0), "text", "scope").where("text = 'acdbb[zeq'").collect()} == {1, 2, 3, 4}
    assert [r["id"] for r in replacing.listed(rules, enabled_only=True).where("scope = 'all'").collect()] == [6, 4, 1]


def test_texts_are_not_dealt_by_scope(spark):
    texts = spark.range(40).select("id", F.concat(F.lit("a"), F.col("id")).alias("text"), F.lit("s1").alias("scope"))
    rules = spark.createDataFrame([(1, "a", "b", "s1", 0, False, True)], "id long, pattern string, replacement string, scope string, order int, case_insensitive boolean, enabled boolean")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = replacing.apply_rules(texts, rules, "text", "scope")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert {r["text"] for r in got.collect()} == {f"b{k}" for k in range(40)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
