"""UDFs over texts work on short pieces of Spark's batches, and JSON rules read a document once for every path."""

import pyarrow as pa
import pytest
from leafmill.functions import batches, extract, json_paths, urls
from leafmill.operators import books, by_source
from leafmill.plans import catalogue
from leafmill.sources import feeds, files
from pyspark.sql import functions as F

TEXT = "<p><b>word</b> " + "x" * 100_000 + "</p>\n"


def test_pieces_are_short_and_lose_no_row():
    rows = ["a" * n for n in (0, 5, 70, 200, 0, 1)] + [None]
    got = list(batches.pieces(iter([(pa.array(rows), pa.array(range(7))), (pa.array([], pa.string()), pa.array([], pa.int64()))]), most=200))
    assert [x for t, _ in got for x in t.to_pylist()] == rows and [x for _, k in got for x in k.to_pylist()] == list(range(7))
    assert [len(t) for t, _ in got] == [2, 1, 1, 3]


@pytest.mark.parametrize(
    "name",
    ["decoded", "scored", "chapters", "dom_lists", "items", "extract_items", "content", "whitelisted", "split_long", "page_items"],
)
def test_what_a_task_gives_out_is_short(spark, monkeypatch, name):
    """A batch of 4 MB comes out in several pieces, all its rows once."""
    held, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: held.append(f) or real(f, kind))
    df = spark.createDataFrame([(1, "u", TEXT)], "page_id int, url string, html string")
    {
        "decoded": lambda: files.decoded(F.encode("html", "UTF-8")),
        "scored": lambda: files.scored(F.encode("html", "UTF-8")),
        "chapters": lambda: files.chapters(df.withColumn("format", F.lit("txt")), "html"),
        "dom_lists": lambda: extract.dom_lists(F.col("html"), [("css", "p@html")]),
        "items": lambda: extract.items(df, "html", "@css:p"),
        "extract_items": lambda: extract.extract_items(df, "html", "@css:p", {"b": "@css:b@text"}),
        "content": lambda: extract.content(df, "html", "p"),
        "whitelisted": lambda: extract.whitelisted(df, "html"),
        "split_long": lambda: books.split_long(df, "page_id", "html", 4000),
        "page_items": lambda: feeds.page_items(df),
    }[name]()
    is_bytes = name in ("decoded", "scored", "chapters")
    first = pa.array([TEXT.encode() if is_bytes else TEXT] * 40)
    batch = (first, pa.array([""] * 40)) if name in ("decoded", "content", "chapters") else first
    sizes = [len(x) for x in held[-1](iter([batch]))]
    assert sum(sizes) == 40 and max(sizes) <= 11


def test_a_charset_is_told_once_a_text(monkeypatch, spark):
    held, real, asked = [], F.arrow_udf, []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: held.append(f) or real(f, kind))
    files.decoded(F.lit(b"a"))
    was = files.charset
    monkeypatch.setattr(files, "charset", lambda *a: asked.append(a) or was(*a))
    rows = [b"\xef\xbb\xbfa", "é".encode(), "中文".encode("gb18030"), None]
    got = [r for b in held[0](iter([(pa.array(rows), pa.array([""] * 4))])) for r in b.to_pylist()]
    assert got == [{"text": "a", "charset": "utf-8", "bom": 3}, {"text": "é", "charset": "utf-8", "bom": 0}, {"text": "中文", "charset": "gb18030", "bom": 0}, {"text": "", "charset": "utf-8", "bom": 0}]
    assert len(asked) == 4


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "paths"), [("json_chapters_rules", 5), ("json_chapters_default", 11), ("json_feed", 5)])
def test_a_document_is_read_once_a_path(spark, sf, name, paths):
    assert plan(catalogue.queries()[name](spark, sf)).count("get_json_object") == paths


def test_values_of_odd_json(spark):
    docs = ['{"a": "", "b": [null, 1.0, "x"], "c": {"d": 2.50}, "e": "[x", "f": []}', "[]", "x", None, '{"a": null, "b": "1.0"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i")
    col = lambda rule: [r[0] for r in df.select(json_paths.first_of(F.col("d"), rule)).collect()]
    assert col("$.b") == ["1", "", "", "", "1"]
    assert col("$.a&&$.e&&$.f&&$.c.d") == ["2.5", "", "", "", ""]
    assert col("$.a&&N{{$.b}}") == ['N[null,1.0,"x"]', "N", "N", "N", "N1.0"]
    assert [r[0] for r in df.select(json_paths.listed(F.col("d"), "$.f&&$.b")).collect()] == [[None, "1.0", "x"], [], [], [], []]
    assert [r[0] for r in df.select(json_paths.aliases(F.col("d"), ["a", "f", "b"])).collect()] == ["[]", "", "", "", "1.0"]


def test_a_reference_is_cleaned_once(spark, sf):
    assert plan(spark.range(1).select(urls.resolve(F.lit("http://a.example/b/c"), F.concat(F.lit(" ../"), F.col("id").cast("string"))).alias("u"))).count("translate(") == 1
    found = by_source.search_merged(*catalogue_shops(spark, sf), "a b")
    assert plan(found).count("translate(") <= 4


def catalogue_shops(spark, sf):
    from leafmill.plans import queries_flows

    return queries_flows._shops(spark, sf)
