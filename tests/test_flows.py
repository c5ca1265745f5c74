"""Flows over many sources against plain re-computation."""

import random
from urllib.parse import urljoin

import pytest
from leafmill.functions import text, urls
from leafmill.operators import alike, books, by_source
from leafmill.sources import fetching
from pyspark.sql import functions as F

BASES = ["http://a/b/c/d;p?q", "http://a", "http://a/", "https://a.b:80/x/", "http://a/b/../c/./d", "/a/b", "a/b", "", "http://a/b//c/d?x=/y/z", "ftp://h/p/q", "http://u@h/a#frag?x", "http://a/b/c?q#f"]
REFS = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/../x http:g http:/g https:g javascript:void(0) mailto:a@b HTTP://X/y http://x/a/../b a//b///c /a//b //h//x/../y é/ü /中/文.html a:b 1a:b ? # g? /a/b/ data:text/plain,x // ///x ..// a/../../b/ %2e%2e/x".split() + ["", "  /sp ace ", "a\tb\nc"]


def test_references_resolve_as_rfc_3986_says_without_python(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string").withColumn("got", urls.resolve(F.col("b"), F.col("r")))
    wrong = [tuple(x) for x in df.collect() if x["got"] != urljoin(x["b"], x["r"].strip())]
    assert not wrong
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([("http://a/b", None), (None, "/x"), (None, None)], "b string, r string")
    assert [r[0] for r in none.select(urls.resolve(F.col("b"), F.col("r"))).collect()] == [None, "/x", None]


# ---- rules of sources ----

PAGES = {
    "http://a.x/s/q+1": '{"l": [{"n": " One ", "u": "/1"}, {"n": " "}, {"n": "Two", "u": "http://b.x/2", "c": "i.png"}]}',
    "http://a.x/t?k=q+1": '[{"n": "Root", "u": "r"}]',
    "http://b.x/s/q+1": "1:x;22:y;",
    "http://c.x/s/q+1": "<ul><li><a href=/z>Z</a></ul>",
}
RULES = ['{"bookList": "$.l", "name": "$.n", "bookUrl": "$.u", "coverUrl": "$.c"}', '{"bookList": ":\\\\d+:\\\\w", "name": ":^\\\\d+", "bookUrl": ":\\\\w$"}', '{"bookList": "@css:ul li", "name": "tag.a@text", "bookUrl": "tag.a@href"}']


def sources(spark, rows):
    return spark.createDataFrame(rows, "id long, base_url string, search_url string, search_rule string, enabled boolean, order int")


@pytest.mark.parametrize("fused", [1, 2, 24])
def test_every_source_reads_its_page_by_its_own_rules(spark, fused):
    rows = [
        (1, "http://a.x/", "/s/{{key}}", RULES[0], True, 1),
        (2, "http://a.x", "s/{q}", RULES[0], True, 5),
        (3, "http://b.x", "http://b.x/s/{keyword},{'method':'post','body':'k={{key}}'}", RULES[1], True, 2),
        (4, "http://c.x", "/s/{key}", RULES[2], True, 3),
        (5, "http://c.x", "/s/{{key}}", RULES[2], False, 3),
        (6, "http://c.x", "/s/{{key}}", None, True, 3),
        (7, "http://c.x", "/s/{{key}}", '{"name": "x"}', True, 3),
        (8, "http://c.x", " ", RULES[0], True, 3),
        (9, "http://c.x", "@js:x", RULES[0], True, 3),
        (10, "http://lost.x", "/s", RULES[0], True, 3),
        (11, "http://a.x", "/t?k={{key}},{bad", '{"bookList": "$.none&&$", "name": "$.n", "bookUrl": "$.u"}', True, 0),
    ]
    pages = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    got = sorted(tuple(r) for r in by_source.search(sources(spark, rows), pages, "q 1", fused).select("source_id", "pos", "name", "url", "cover").collect())
    ab = [(0, " One ", "http://a.x/1", ""), (2, "Two", "http://b.x/2", "http://a.x/s/i.png")]
    assert got == [*[(1, *x) for x in ab], *[(2, *x) for x in ab], (3, 0, "1", "http://b.x/s/x", ""), (3, 1, "22", "http://b.x/s/y", ""), (4, 0, "Z", "http://c.x/z", ""), (11, 0, "Root", "http://a.x/r", "")]
    report = {r["source_id"]: (r["status"], r["method"], r["n_books"]) for r in by_source.search_report(sources(spark, rows), pages, "q 1").collect()}
    assert report == {1: ("ok", "GET", 2), 2: ("ok", "GET", 2), 3: ("ok", "POST", 2), 4: ("ok", "GET", 1), 6: ("no search rule", "GET", 0), 7: ("ok", "GET", 0), 8: ("no search URL", "GET", 0), 9: ("no search URL", "GET", 0), 10: ("no page", "GET", 0), 11: ("ok", "GET", 1)}
    merged = by_source.search_merged(sources(spark, rows), pages, "q 1", limit=3)
    assert [r["name"] for r in merged.collect()] == [" One ", "Two", "Z"]
    asked = by_source.fetched_results(sources(spark, rows), pages, "q 1").where("source_id = 3").first()
    assert (asked["url"], asked["request_body"]) == ("http://b.x/s/q+1", "k=q 1")


def test_pages_are_scanned_once_for_all_rule_sets(spark, tmp_path):
    spark.createDataFrame(list(PAGES.items()), "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    rows = [(k, "http://a.x", "/s/{{key}}", '{"bookList": "$.l", "name": "$.n%d&&$.n"}' % k, True, k) for k in range(9)]
    got = by_source.search(sources(spark, rows), pages, "q 1")
    assert got.count() == 18 and got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert by_source.search(sources(spark, []), pages, "q").count() == 0


# ---- alternates of a shelf ----


def similar(a, b):
    """text_similarity() in plain Python for titles without a chapter prefix."""
    a, b = a.lower().strip(" "), b.lower().strip(" ")
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.88
    return len(set(x) & set(y)) / len(set(x) | set(y))


def brute_alternates(shelf, candidates, least=0.45):
    out = set()
    for book, name, by, own in shelf:
        best = {}
        for source, pos, other, other_by in candidates:
            if source == own:
                continue
            names = similar(name or "", other or "")
            s = names if not (by or "").strip() else names * 0.65 + similar(by or "", other_by or "") * 0.35
            if names > 0 and s >= least and (source not in best or (s, -pos) > best[source]):
                best[source] = (s, -pos)
        out |= {(book, source, -p, round(s, 9)) for source, (s, p) in best.items()}
    return out


@pytest.mark.parametrize(("letters", "authors"), [("甲乙丙丁戊己庚辛壬癸子丑寅卯", False), ("甲乙丙丁戊己庚辛壬癸子丑寅卯", True), ("ab c", True)])
def test_alternates_of_a_shelf_are_those_of_each_book(spark, letters, authors):
    rng = random.Random(len(letters) + authors)
    title = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 7)))
    by = lambda: rng.choice([None, "", " ", "Ann", "ann lee", "甲", "Bo"]) if authors else None
    candidates = [(k % 5, k // 5, rng.choice([title(), None, "  "]) if k % 9 == 0 else title(), by()) for k in range(120)]
    shelf = [(k, title(), by(), k % 6) for k in range(60)] + [(60, None, None, 0), (61, candidates[1][2], None, 1), (61, candidates[1][2], None, 1)]
    got = alike.shelf_alternates(spark.createDataFrame(shelf, "book_id int, name string, author string, source_id int"), spark.createDataFrame(candidates, "source_id int, pos int, name string, author string"))
    rows = [(r["book_id"], r["source_id"], r["pos"], round(r["score"], 9)) for r in got.collect()]
    assert set(rows) == brute_alternates(shelf, candidates)
    assert len(rows) == len(set(rows)) + sum(r[0] == 61 for r in set(rows))


def test_title_pairs_find_all_and_make_few(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(300)]
    titles = sorted({"".join(rng.sample(letters, rng.randrange(2, 9))) for _ in range(400)} | {"第3章 " + "".join(letters[:3]), "".join(letters[:3]), letters[0]})
    both = spark.createDataFrame([(t,) for t in titles], "title string")
    pairs = both.crossJoin(both.withColumnRenamed("title", "other")).withColumn("alike", text.text_similarity(F.col("title"), F.col("other"))).where("alike >= 0.45")
    got = alike.title_pairs(both, both.withColumnRenamed("title", "other"), 0.45)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# ---- chains ----


def brute_chain(start, to, most):
    out = [start]
    while len(out) < most and (n := to.get(out[-1])) is not None and n not in out:
        out.append(n)
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 50])
def test_chains_by_doubling(spark, most, monkeypatch):
    rng = random.Random(most)
    to = {f"p{k}": f"p{rng.randrange(300)}" for k in range(250) if rng.random() < 0.97}
    to |= {f"l{k}": f"l{k + 1}" for k in range(80)} | {"self": "self", "x": "lost"}
    starts = [(f"k{k}", f"p{k}") for k in range(60)] + [("long", "l0"), ("other", "l60"), ("self", "self"), ("x", "x"), ("none", "nowhere")]
    links = [*to.items(), ("x", "z later"), ("l3", None), ("l3", "l4")]
    held = []
    monkeypatch.setattr(books, "settled", lambda df, f=books.settled: held.append(1) or f(df))
    got = books.follow_pages(spark.createDataFrame(starts, "k string, url string"), spark.createDataFrame(links, "url string, next_url string"), "k", most=most)
    rows = [tuple(r) for r in got.collect()]
    assert len(held) <= 2 * 7
    assert sorted(rows) == sorted((k, n, u) for k, s in starts for n, u in enumerate(brute_chain(s, to, most)))


# ---- fetching, charsets, listings ----


def test_the_first_settled_attempt_counts(spark):
    import gzip
    import zlib

    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(b"raw") + raw.flush()
    rows = [
        ("http://a.x/1", 1, 200, None, "text/html; charset=gbk", None, "中文".encode("gbk")),
        ("http://a.x/2", 2, 200, None, None, "gzip", gzip.compress("two é".encode())),
        ("http://a.x/2", 1, None, "read: connection reset by peer", None, None, None),
        ("http://a.x/3", 1, None, "unexpected EOF", None, None, None),
        ("http://a.x/3", 4, 200, None, None, None, b"too late"),
        ("http://a.x/4", 1, None, "certificate", None, None, b"partly"),
        ("http://a.x/4", 2, 200, None, None, None, b"never asked"),
        ("http://a.x/5", 1, 500, None, None, "deflate", zlib.compress(b"five")),
        ("http://a.x/6", 1, 200, None, None, "deflate", deflated),
        ("http://a.x/7", 1, 200, None, None, "gzip", b"not gzip"),
        ("http://a.x/8", 1, 200, None, None, None, None),
        ("http://a.x/8", 1, 200, None, None, None, None),
    ]
    responses = spark.createDataFrame(rows, "url string, attempt int, status int, error string, content_type string, content_encoding string, body binary")
    asked = spark.createDataFrame([(k, f"http://a.x/{k}", "mine") for k in range(1, 10)] + [(10, "http://10.0.0.1/", "mine"), (11, None, "mine"), (1, "http://a.x/1", "again")], "id int, url string, text2 string")
    got = fetching.fetched(asked, responses).collect()
    assert len(got) == 12
    by = {r["id"]: (r["outcome"], r["attempts"], r["status"], r["text"]) for r in got}
    assert by == {
        1: ("ok", 1, 200, "中文"),
        2: ("ok", 2, 200, "two é"),
        3: ("failed", 1, None, ""),
        4: ("failed", 1, None, ""),
        5: ("ok", 1, 500, "five"),
        6: ("ok", 1, 200, "raw"),
        7: ("ok", 1, 200, "not gzip"),
        8: ("ok", 1, 200, ""),
        9: ("no response", None, None, ""),
        10: ("refused", None, None, ""),
        11: ("refused", None, None, ""),
    }


def test_scores_tell_encodings_apart():
    from leafmill.sources import files

    said = "第一章 他说：你好。"
    cases = {("utf-8", said), ("gb18030", said * 3), ("hz", said), ("utf-16", said), ("utf-8", "plain"), ("utf-8", "é" * 5), ("gb18030", "a" * 5 + said)}
    want = {"gb18030": "gbk", "utf-16": "utf-16-le"}
    assert all(files.scored_charset(t.encode(c)) == want.get(c, c) for c, t in cases)
    scores = files.charset_scores(said.encode("gb18030"))
    assert scores["utf-8"] == 0 and scores["hz"] == 0 and scores["gbk"] == pytest.approx(1.0)
    assert files.charset_scores(b"")["utf-8"] == 0 and files.scored_charset(b"") == "utf-8" and files.scored_charset(b"\xff\x00\xff") == "utf-8"
    assert files.charset_scores(b"\x01" * 3 + b"a" * 97)["utf-8"] == pytest.approx(0.75)


@pytest.mark.parametrize("keyed", [True, False])
def test_listings_stop_where_they_are_full_or_empty(spark, keyed):
    rng = random.Random(keyed)
    rows = [(s if keyed else 0, p, rng.choice([0, 1, 2, 5, 9]) if p else 4) for s in range(40 if keyed else 1) for p in range(rng.randrange(1, 60))]
    want, before, gone = set(), {}, set()
    for s, p, n in sorted(rows):
        if s not in gone and before.get(s, 0) < 20 and n > 0:
            want.add((s, p, n))
        gone |= {s} if n <= 0 else set()
        before[s] = before.get(s, 0) + n
    df = spark.createDataFrame(rows, "s int, p int, n int").repartition(5)
    got = books.until_enough(df, "p", "n", 20, "s" if keyed else None)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["s", "p", "n"]
    assert books.until_enough(df.limit(0), "p", "n", 20, "s").count() == 0


# ---- pages of one URL ----


def test_requests_of_one_url_have_one_page_each_and_their_own_by_key(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<h1>one</h1>"), (2, "http://a/x", "<h1>two</h1>"), (3, "http://a/y", None)], "page_id long, url string, html string")
    asked = pages.select("page_id", "url")
    assert sorted(map(tuple, books.fetch(asked, pages).select("page_id", "body", "found").collect())) == [(1, "<h1>one</h1>", True), (2, "<h1>one</h1>", True), (3, None, False)]
    assert sorted(map(tuple, books.fetch(asked, pages, page_key="page_id").select("page_id", "body").collect())) == [(1, "<h1>one</h1>"), (2, "<h1>two</h1>"), (3, None)]
    got = books.book_info(asked, pages, {"name": "@css:h1@text"}, page_key="page_id")
    assert sorted(map(tuple, got.select("page_id", "name").collect())) == [(1, "one"), (2, "two"), (3, "")]


def test_attempts_of_one_url_are_told_apart_by_key(spark):
    rows = [(1, "http://a.example/x", 1, None, "i/o timeout", "a"), (1, "http://a.example/x", 2, 200, None, "b"), (2, "http://a.example/x", 1, 404, None, "c")]
    made = spark.createDataFrame(rows, "k long, url string, attempt int, status int, error string, said string").select("k", "url", "attempt", "status", "error", F.lit("text/html").alias("content_type"), F.lit("").alias("content_encoding"), F.encode("said", "UTF-8").alias("body"))
    got = fetching.fetched(made.select("k", "url").distinct(), made, key="k")
    assert sorted(map(tuple, got.select("k", "attempts", "status", "text").collect())) == [(1, 2, 200, "b"), (2, 1, 404, "c")]


# ---- alternates over alphabets of any size ----


@pytest.mark.parametrize("wide", [False, True])
def test_sets_of_letters_as_bits_and_as_arrays_find_the_same_pairs(spark, wide):
    rng = random.Random(5)
    titles = sorted({"".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 7))).strip() for _ in range(60)} - {""})
    more = ["".join(chr(0x4E00 + k) for k in range(90))] if wide else []
    df = spark.createDataFrame([(t,) for t in titles + more], "title string")
    got = {(r[0], r[1]): r[2] for r in alike.title_pairs(df, df.withColumnRenamed("title", "other"), 0.2).collect()}
    both = df.crossJoin(df.withColumnRenamed("title", "other")).withColumn("s", text.text_similarity(F.col("title"), F.col("other"))).where("s >= 0.2")
    want = {(r[0], r[1]): r[2] for r in both.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
