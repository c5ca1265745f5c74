import pytest
from leafmill.functions import dom, lists, regexes, urls
from leafmill.plans import rules
from pyspark.sql import functions as F

PAGE = """<div id=main class="content box"><h1 class=title>Tide &amp; Sand</h1><p class=intro>A <strong>short</strong> line</p>
<ul class="shelf"><li class=book data-id=7><a href="/b/1">One</a><li class=book><a href="/b/2">Two</a><li class=book><a href="/b/3">Three</a></ul>
<div class=text><p>first<br>more<p>second <b>bold<p>third</div><img data-src="/i.png" src="x.gif"><img src="/i.png"></div><script>var a = "</p><p class=intro>";</script>"""


@pytest.fixture(scope="module")
def page():
    return dom.parse(PAGE)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("h1@text", ["Tide & Sand"]),
        ("p.intro", ["A short line"]),
        (".shelf .book a@href", ["/b/1", "/b/2", "/b/3"]),
        ("li:0@text", ["One"]),
        ("li[-1]@text", ["Three"]),
        ("li[2,0,0]@text", ["Three", "One", "One"]),
        ("li[1:]@text", ["Two", "Three"]),
        ("li!0:2@text", ["Three"]),
        ("li[9]@text", []),
        ("ul > li[data-id='7'] a@text", ["One"]),
        (".text > p@text", ["first\nmore", "second bold", "third"]),
        ("#main.content.box > h1@class", ["title"]),
        ("li:nth-child(2) a, h1@text", ["Tide & Sand", "Two"]),
        ("p:not(.intro)@ownText", ["firstmore", "second", "third"]),
        ("li + li a@text", ["Two", "Three"]),
    ],
)
def test_css(page, rule, want):
    assert dom.css(page, rule) == want


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("//ul/li/a/@href", ["/b/1", "/b/2", "/b/3"]),
        ("//li[2]/a/text()", ["Two"]),
        ("//li[last()]/a", ["Three"]),
        ("//li[@data-id='7']/a", ["One"]),
        ("//li[not-there]", []),
        ("//a[contains(@href,'/b/')]/../a", ["One", "Two", "Three"]),
        ("//h1[@class='title'] | //p[contains(@class,'int')]", ["Tide & Sand", "A short line"]),
        ("//li[position()<3]/a", ["One", "Two"]),
    ],
)
def test_xpath(page, query, want):
    assert dom.xpath(page, query) == want


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("class.book@tag.a@text", "One\nTwo\nThree"),
        ("class.book.1@tag.a@href", "/b/2"),
        ("class.book.-1@a@text", "Three"),
        ("class.book.9@a@text", "One"),
        ("class.book!1@a@text", "One\nThree"),
        ("text.Two@href", "/b/2"),
        ("class.none@text||id.main@h1@text", "Tide & Sand"),
        ("class.text@p@textNodes", "first\nmore\nsecond\nthird"),
    ],
)
def test_chain(page, rule, want):
    assert dom.chain_value(page, rule) == want


def test_texts_inside_quotes_and_what_is_not_supported():
    root = dom.parse("<p><a href=x>a|b</a><a href='y or z'>c and d</a><a>e] f</a></p>")
    assert dom.xpath(root, "//a[contains(text(),'a|b')]") == ["a|b"]
    assert dom.xpath(root, "//a[text()='c and d' and @href='y or z'] | //a[contains(., '] f')]") == ["c and d", "e] f"]
    for query in ("//a[not(@href)]", "//a[normalize-space()='x']", "//a/following-sibling::a", "//a[count(b)=1]", "count(//a)"):
        with pytest.raises(ValueError):
            dom.xpath(root, query)
    with pytest.raises(ValueError):
        dom.select(root, "a:hover")


def test_content_and_images(page):
    assert dom.images(page) == ["x.gif", "/i.png"]  # src comes first
    lazy = dom.parse('<p><img data-lazy-src=c data-src=" a "><img data-echo="/b"><img src=a><img src=" "></p>')
    assert dom.images(lazy, "http://x/d/e") == ["http://x/d/a", "http://x/b"]
    assert "second bold" in dom.content_text(dom.select(page, ".text")[0]).split("\n\n")
    assert dom.parse(dom.parse("<p>a<p>b").outer().removeprefix("<#root>").removesuffix("</#root>")).text() == "ab"


@pytest.mark.parametrize(
    ("rule", "parts", "ops"),
    [("a", ["a"], []), ("a&&b", ["a", "b"], ["&&"]), ("a || b %% c", ["a", "b", "c"], ["||", "%%"]), ("a[x&&y]||b", ["a[x&&y]", "b"], ["||"]), ('a"&&"b', ['a"&&"b'], []), ("f(a||b)&&c", ["f(a||b)", "c"], ["&&"]), (r"a\&&b&&c", [r"a\&&b", "c"], ["&&"]), ("a&&&&b", ["a", "b"], ["&&"]), ("a(b||c", ["a(b", "c"], ["||"])],
)
def test_split(rule, parts, ops):
    assert rules.split(rule) == (parts, ops)


@pytest.mark.parametrize("rule", ["a&&", "||a"])
def test_split_errors(rule):
    with pytest.raises(ValueError):
        rules.split(rule)


@pytest.mark.parametrize(("rule", "mode"), [("@css:.a", "css"), ("$xpath://a", "xpath"), ("//div/a", "xpath"), ("$.a.b", "json"), ("@json:a", "json"), ("/a+/", "regex"), (":x(.*)", "regex"), ("class.a@href", "chain"), ("div a@text", "chain"), ("#id > p", "css"), ("<js>1</js>", "js")])
def test_mode(rule, mode):
    assert rules.parse(rule).mode == mode


def test_modes_of_a_column(spark):
    cases = ["@css:.a", "$xpath://a", "//div/a", "$.a.b", "@json:a", "/a+/", ":x(.*)", "class.a@href", "div a@text", "#id > p", "<js>1</js>", "/html/body", "!"]
    got = spark.createDataFrame([(c,) for c in cases], "r string").select("r", rules.mode_of(F.col("r")).alias("m")).collect()
    assert {r["r"]: r["m"] for r in got} == {c: rules.detect(c) for c in cases}


def test_inline_syntax():
    r = rules.parse("@put:{key} class.a@text##x+##y##z##")
    assert (r.puts, r.replaces, r.parts) == (("key",), (("x+", "y"), ("z", "")), ("class.a@text",))
    assert rules.parse("@get:{key}").gets == ("key",) and rules.parse("{{a + 1}}").expressions == ("a + 1",)
    assert rules.field_rules("{'name': 'a', url: 'b'}") == {"name": "a", "url": "b"}
    assert rules.field_rules("name:a@text&&url:b@href") == {"name": "a@text", "url": "b@href"}
    assert rules.field_rules("name::a@url::b") == {"name": "a", "url": "b"} and rules.field_rules("ul li") == {"bookList": "ul li"}
    assert rules.field_rule({"BookName": "x"}, "name") == "x" and rules.uses_script("@js:1") and not rules.uses_script("a b")


def test_url_parts():
    t = urls.parse_template("https://a//b?q={{key}}&p=<1,2,3>,{'method':'post', headers: {'A':'1'}, body:'k', retry: 2}")
    assert (t.method, t.headers, t.body, t.retry, t.pages, t.required) == ("POST", {"A": "1"}, "k", 2, ("1", "2", "3"), ["key"])
    assert regexes.n_groups(r"(a)(?:b)(?<n>c)\(d[(]") == 2 and regexes.java_replacement("(a)", "$1$2$x\\") == "$1\\$x\\\\"


def test_url_checks(spark):
    cases = {"http://example.com/a": True, "https://8.8.8.8": True, "ftp://x": False, "http://localhost/": False, "http://127.0.0.1/": False, "http://10.1.2.3": False, "http://192.168.0.1": False, "http://100.64.0.1/": False, "http://[::1]/": False, "": False, None: False, "http://169.254.1.1/x": False}
    got = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("ok", urls.is_allowed(F.col("u"))).collect()
    assert {r["u"]: r["ok"] for r in got} == cases


def test_lists(spark):
    row = spark.createDataFrame([(["a", "b", "", "b"], ["b", "c", ""], None)], "l array<string>, r array<string>, n array<string>").select(
        lists.intersection(F.col("l"), F.col("r")).alias("i"),
        lists.union(F.col("l"), F.col("r")).alias("u"),
        lists.containing(F.col("l"), "b").alias("c"),
        lists.first_list(F.array().cast("array<string>"), F.col("r")).alias("f"),
        lists.interleave([F.slice("l", 1, 3), F.col("r")]).alias("x"),
        lists.interleave([F.col("l"), F.col("r")]).alias("y"),
        lists.take(F.col("l"), lists.IndexSpec("indices", (1, -1, 9))).alias("t"),
        lists.take(F.col("l"), lists.IndexSpec("range", (), 2, 1)).alias("e"),
    ).first()
    assert (row["i"], row["u"], row["c"], row["f"]) == (["b"], ["a", "b", "c"], ["b", "b"], ["b", "c", ""])
    assert row["x"] == ["a", "b", "b", "c", "", ""] and row["y"] == ["a", "b", "", "b", "b", "c", ""]
    assert row["t"] == ["b", "b"] and row["e"] == []


def test_deep_pages_end_no_query(spark):
    from leafmill.functions import extract

    n = 8000
    deep = "<nav><ul><li><a href=/a>A</a></ul></nav><article>" + "<div>x " * n + "<p>last</p>"
    pages = spark.createDataFrame([(1, deep), (2, "<nav><a href=/b>B</a></nav><article><p>y</p></article>")], "id int, html string")
    got = extract.extract(pages, "html", {"links": "nav a@href", "end": "@css:article p@text", "x": "//nav//a/@href"}).orderBy("id").collect()
    assert [(r["links"], r["end"], r["x"]) for r in got] == [("/a", "last", "/a"), ("/b", "y", "/b")]
    text = extract.content(pages, "html", "article").orderBy("id").first()["content"]
    assert text.count("x") == n and text.endswith("last")
    clean = extract.whitelisted(pages, "html").orderBy("id").first()["html_clean"]
    assert clean.count("<div>") == clean.count("</div>") == n
    outer = extract.items(pages.where("id = 1"), "html", "@css:article").first()["item"]
    assert outer.startswith("<article><div>x ") and outer.endswith("</div></article>")
