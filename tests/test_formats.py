import json
import os

import pytest
from leafmill.sources import formats
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def read(spark, path, schema=None, **options):
    r = spark.read.format("json_collection").options(**options)
    return (r.schema(schema) if schema else r).load(str(path))


def test_arrays_wrappers_lines_and_odd_files(spark, tmp_path):
    rows = [{"name": "a", "url": "u", "enabled": True, "n": 3, "t": [1, "2"], "o": {"k": 1}}, {"name": None, "enabled": "False", "n": "x"}, "no object", {"name": 5}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"count": 4, "bookSources": rows}))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in [rows[0], rows[1], rows[3]]) + "\n\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "d.json").write_text(json.dumps({"name": "single", "url": "x"}))
    (tmp_path / "_hidden.json").write_text("broken")
    got = read(spark, tmp_path, "name string, enabled boolean, n long, t array<string>, o string")
    one = [("a", True, 3, ["1", "2"], '{"k": 1}'), (None, False, None, None, None), ("5", None, None, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(one * 3 + [("single", None, None, None, None)], key=str)
    assert read(spark, tmp_path).columns == ["name", "url", "group", "enabled"]
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="no collection"):
        read(spark, tmp_path / "lost").count()


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_of_bytes_take_every_line_once(spark, tmp_path, split):
    lines = [json.dumps({"name": "é" * (k % 40), "n": k}, ensure_ascii=False) for k in range(60)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    fs, _ = formats.opened(str(tmp_path))
    parts = formats.parts_of(str(tmp_path), formats.files_of(str(tmp_path)), split)
    assert [o["n"] for p in parts for o in formats.objects(str(tmp_path), p)] == list(range(60))
    if split >= 64:
        df = read(spark, tmp_path, "n long", split=split)
        assert sorted(r["n"] for r in df.collect()) == list(range(60)) and (df.rdd.getNumPartitions() > 1) == (split < 1 << 20)


def test_a_write_commits_or_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(0, 100, 1, 4).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"))
    good.write.format("json_collection").mode("append").save(path)
    assert sorted(map(tuple, read(spark, path, "id long, name string").collect())) == sorted(map(tuple, good.collect()))
    before = sorted(os.listdir(path))
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("json_collection").mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    good.limit(3).write.format("json_collection").mode("overwrite").save(path)
    assert read(spark, path, "id long").count() == 3


def test_a_stream_goes_on_after_its_offset(spark, tmp_path):
    def run():
        s = spark.readStream.format("json_collection").schema("n long").load(str(tmp_path / "in"))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["n"] for r in spark.read.schema("n long").parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{9 - k}.json").write_text(json.dumps([{"n": 2 * k}, {"n": 2 * k + 1}]))
        os.utime(tmp_path / f"in/{9 - k}.json", (1000 + k, 1000 + k))
        assert run() == list(range(2 * k + 2))
    assert run() == list(range(6))


def test_tasks_without_rows_write_nothing_and_commit(spark, tmp_path):
    rows = spark.range(0, 3, 1, 6).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    rows.where("name <> 'n1'").write.format("json_collection").mode("append").save(str(tmp_path / "c"))
    assert sorted(r[0] for r in read(spark, tmp_path / "c", "name string").collect()) == ["n0", "n2"]
    rows.where("name = 'x'").write.format("json_collection").mode("append").save(str(tmp_path / "none"))
    assert read(spark, tmp_path / "none", "name string").count() == 0
    assert not [f for f in os.listdir(tmp_path / "c") if f.startswith("_")]
