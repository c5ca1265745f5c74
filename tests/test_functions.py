import datetime as dt

import pytest
from leafmill.functions import expressions, json_paths, lists, regexes, text, urls
from pyspark.sql import functions as F


def one(spark, value, **cols):
    return spark.createDataFrame([(value,)], "v string").select(*[c(F.col("v")).alias(k) for k, c in cols.items()]).first()


DOC = '{"book": {"title": "T", "pages": 35.0, "rating": 4.5, "ok": true, "none": null, "chapters": [{"n": 1, "t": "a"}, {"n": 2, "t": "b"}, {"n": 3, "t": "c"}], "tags": ["x", "y"]}}'


@pytest.mark.parametrize(
    ("rule", "want"),
    [("$.book.title", ["T"]), ("book.pages", ["35"]), ("$.book.rating", ["4.5"]), ("$.book.ok", ["true"]), ("$.book.none", []), ("$.book.tags[*]", ["x", "y"]), ("$.book.chapters[*].t", ["a", "b", "c"]), ("$.book.chapters[1].n", ["2"]), ("$.book.chapters[1:].t", ["b", "c"]), ("$.book.chapters[:2].n", ["1", "2"]), ("$.book.chapters[-5:-1].n", ["1", "2", "3"]), ("$.book.tags[1:9]", ["y"]), ("$.nothing", [])],
)
def test_json_query(spark, rule, want):
    assert one(spark, DOC, got=lambda v: json_paths.query(v, rule))["got"] == want


def test_json_more(spark):
    r = one(spark, "[[1, [2, 3]], 4]", flat=lambda v: json_paths.flat(json_paths.items(v, "$")), ok=json_paths.is_json)
    assert r["flat"] == ["1", "2", "3", "4"] and r["ok"]
    deep = "[" * 12 + '1, "[x"' + "]" * 12
    assert one(spark, f"[0, {deep}, []]", flat=lambda v: json_paths.flat(json_paths.items(v, "$")))["flat"] == ["0", "1", "[x"]
    r = one(spark, DOC, a=lambda v: json_paths.first_of(v, "x && $.book.title"), b=lambda v: json_paths.first_of(v, "<{{$.book.title}}>"), c=lambda v: json_paths.aliases(v, ["name", "title"]))
    assert (r["a"], r["b"], r["c"]) == ("T", "<T>", "")
    assert not one(spark, "{x", ok=json_paths.is_json)["ok"]


def test_regexes(spark):
    s = "id=7; id=42; name=Zed"
    r = one(
        spark,
        s,
        all=lambda v: regexes.find_all(v, "/id=([0-9]+)/"),
        whole=lambda v: regexes.find_all(v, "id=[0-9]+"),
        chain=lambda v: regexes.chain(v, ["name=.*", "[A-Z]\\w+"]),
        broken=lambda v: regexes.chain(v, ["zzz", "a"]),
        none=lambda v: regexes.chain(v, ["name", "zzz"]),
        tmpl=lambda v: regexes.template(v, "(\\w+)=(\\d+)", "$2-$1-$9"),
        rep=lambda v: regexes.replace_chain(v, [("id", "no"), ("[", "x"), ("(no)=", "$1:$5")]),
        look=lambda v: regexes.find_all(v, "(?<==)\\d+(?=;)"),
        groups=lambda v: regexes.groups(v, "(\\w+)=(\\d+)"),
    )
    assert (r["all"], r["whole"], r["chain"], r["broken"], r["none"]) == (["7", "42"], ["id=7", "id=42"], ["Zed"], None, [])
    assert (r["tmpl"], r["rep"], r["look"], r["groups"]) == ("7-id-", "no:7; no:42; name=Zed", ["7", "42"], ["id=7", "id", "7"])


def test_text(spark):
    r = one(spark, "\n\n\n a 　\n\n\n\n\n b\t\n", a=text.clean_lines, b=lambda v: text.collapse(F.replace(v, F.lit("　"), F.lit(""))))
    assert (r["a"], r["b"]) == ("a\n\n\nb", "a b")
    r = one(spark, "第12章  Start", n=text.normal_title, s=lambda v: text.title_similarity(v, F.lit("第3章 start")), t=text.title_rule)
    assert r["n"] == "start" and r["s"] == 1 and (r["t"]["title"], r["t"]["rule"]) == ("Start", "chapter_standard")
    r = one(spark, "3.5万字", x=text.number, y=lambda v: text.number(F.lit("none")), c=text.count_chars)
    assert r["x"] == 35000 and r["y"] is None and r["c"] == 5
    r = one(spark, "Tue, 02 Jan 2024 03:04:05 GMT", t=text.parse_time, u=lambda v: text.parse_time(F.lit("2024年1月2日")), w=lambda v: text.parse_time(F.lit("2024-01-02T03:04:05+02:00")))
    assert r["t"] == dt.datetime(2024, 1, 2, 3, 4, 5) and r["u"].day == 2 and r["w"].hour == 1
    r = one(spark, "{bad", h=text.headers, i=lambda v: text.is_isbn(F.lit("978-7-111-11111-1")), k=lambda v: text.split_key(F.lit("s::http://a::b")))
    assert r["h"] == {} and r["i"] and r["k"] == ["s", "http://a::b"]
    assert one(spark, "x(", r=lambda v: text.apply_rule(v, "x(", "y"))["r"] == "y"


@pytest.mark.parametrize(("line", "rule"), [("Chapter 5 The Sea", "english_chapter"), ("12. Name", "number_dot"), ("[3] Name", "square_bracket"), ("序章 风", "pure_title"), ("序章 大海，风", "special_chapter"), ("IV. Name", "roman_numeral"), ("see http://x", None), ("123", None)])
def test_title_rules(spark, line, rule):
    got = one(spark, line, t=text.title_rule)["t"]
    assert (got and got["rule"]) == rule


def test_expressions(spark):
    names = {"a": F.lit("5"), "name": F.lit("bo"), "n": F.lit(3)}
    df = spark.range(1)
    ok = {"'x' + name": "xbo", "n * 2 + 1": "7", "name.length": "2", "name[1]": "o", "n > 2 ? 'y' : 'z'": "y", "a - 1": "4", "!(n == 3)": "false", "java.md5Encode(name)": "ad7532d5b3860a408fbe01f9455dca36", "n >= 3 && name === 'bo'": "true"}
    for k, want in ok.items():
        assert df.select(expressions.as_text(expressions.compile_expression(k, names))).first()[0] == want, k
    for bad in ("var x = 1", "for (;;) {}", "fetch('x')", "(() => 1)()", "missing", "a = 1"):
        with pytest.raises(expressions.UnsupportedScript):
            expressions.compile_expression(bad, names)
    assert df.select(expressions.fill("u/{{name}}/<js>n + 1</js>", names)).first()[0] == "u/bo/4"


def test_urls(spark):
    t = urls.parse_template("http://h//a//{{k}}?p=<x,y>")
    r = spark.range(1).select(urls.evaluate(t, {"k": F.lit("q")}, F.lit(9)).alias("last"), urls.evaluate(t, {"k": F.lit("q")}, F.lit(9), "first").alias("first"), urls.single_slashes(F.lit("https://a//b///c")).alias("s"), urls.undouble(F.lit("http://a/https://b/c")).alias("u"), urls.resolve(F.lit("http://a/b/c"), F.lit("../d")).alias("r"), urls.absolutize(F.lit("http://a/#x"), F.lit("d")).alias("abs")).first()
    assert tuple(r) == ("http://h/a/q?p=y", "http://h/a/q?p=x", "https://a/b/c", "https://b/c", "http://a/d", "http://a/d")
    tabs = spark.range(1).select(urls.explore_tabs(F.lit("[{title:'A',url:''},{title:'Bee',url:'/b'}]")).alias("t")).select(urls.choose_tab(F.col("t"), F.lit("Be"))["url"]).first()[0]
    assert tabs == "/b"


def test_groups_and_turns_work_a_list_out_once_not_once_a_match(spark):
    df = spark.createDataFrame([("Ab Cd e",), ("",), (None,)], "v string")
    got = df.select(regexes.all_groups(F.col("v"), "([A-Z])([a-z]+)").alias("g"), lists.interleave([regexes.find_all(F.col("v"), "[A-Z]"), regexes.find_all(F.col("v"), "[a-z](?= )")]).alias("t"))
    assert [tuple(r) for r in got.collect()] == [([["Ab", "A", "b"], ["Cd", "C", "d"]], ["A", "b", "C", "d"]), ([], []), (None, None)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(" in plan and "get(regexp_extract_all" not in plan
