import io
import zipfile

from leafmill.operators import books, tables
from leafmill.sources import feeds, files
from leafmill.streaming import streams
from pyspark.sql import functions as F


def archive(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return b.getvalue()


EPUB = archive(
    {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        "OEBPS/c.opf": '<package xmlns="http://x"><metadata><title>Book</title><creator>Ann</creator></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="zz"/></spine></package>',
        "OEBPS/toc.ncx": '<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="b.xhtml#x"/></navPoint></navMap></ncx>',
        "OEBPS/a.xhtml": "<html><body><h1>A</h1><p>alpha</p></body></html>",
        "OEBPS/b.xhtml": "<html><body><p>beta</p></body></html>",
    }
)
CBZ = archive({"p10.jpg": b"", "p2.PNG": b"", "x/ComicInfo.xml": "<ComicInfo><Title>C</Title><Writer>W</Writer></ComicInfo>", "note.txt": ""})
PDF = b"%PDF-1.4 /Type /Page /Title (Doc) BT (Hel\\154o \\(x\\)) Tj <41 42> Tj ET"


def test_archives(spark, tmp_path):
    for name, data in {"a.epub": EPUB, "b.cbz": CBZ, "c.PDF": PDF, "d.doc": b"x", "e.epub": b"broken", "f.txt": "x".encode()}.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    assert read.count() == 5
    got = sorted(tuple(r) for r in files.chapters(read).select("format", "ch.idx", "ch.title", "ch.book", "ch.author", "ch.text").collect())
    assert got == [("cbz", 0, "p2.PNG", "C", "W", ""), ("cbz", 1, "p10.jpg", "C", "W", ""), ("epub", 0, "First", "Book", "Ann", "beta"), ("epub", 1, "a", "Book", "Ann", "A\nalpha"), ("pdf", 0, "1 pages", "Doc", "", "Hello (x) AB")]
    new = files.store(read, spark.createDataFrame([], "id string"))
    assert new.count() == 5 and files.store(read, new).count() == 0


def test_charsets(spark):
    cases = [("中文".encode("gb18030"), "中文"), (b"\xef\xbb\xbfab", "ab"), ("ab".encode("utf-16"), "ab"), ("hi there".encode("utf-16-be"), "hi there"), ("é".encode(), "é"), (b"", "")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c binary").select(files.decoded(F.col("c"))["text"].alias("t")).collect()
    assert [r["t"] for r in got] == [t for _, t in cases]


def test_feeds(spark):
    rss = "<rss><channel><title>c</title><item><title>A</title><link>http://x/1</link><description>d</description><content:encoded>full</content:encoded><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item><item><guid>g</guid><title>B</title></item></channel></rss>"
    got = sorted(feeds.rss_items(spark.createDataFrame([(1, rss), (2, "<p>"), (3, None)], "feed_id int, body string")).collect())
    assert [(r["guid"], r["title"], r["content"]) for r in got] == [("http://x/1", "A", "full"), ("g", "B", "")] and got[0]["published_at"].year == 2024
    page = "<html><div class=item><h2>Long title</h2><a href='/a'>x</a></div><div class=item><a href='b'>Another title</a><p>text</p></div></html>"
    got = feeds.page_items(spark.createDataFrame([(1, "http://s/l", page)], "page_id int, url string, html string")).collect()
    assert [(r["title"], r["link"], r["description"]) for r in got] == [("Long title", "http://s/a", ""), ("Another title", "http://s/l/b", "text")]
    pages = spark.createDataFrame([("http://s/p", "<html>"), ("http://s/p/rss", rss), ("http://t/p", '<html><link rel=alternate type="application/rss+xml" href="/f">'.replace("rel=", 'rel="').replace("alternate ", 'alternate" '))], "url string, html string")
    got = {r["url"]: r["feed_url"] for r in feeds.discover(pages.select("url"), pages).collect()}
    assert got == {"http://s/p": "http://s/p/rss", "http://s/p/rss": "http://s/p/rss", "http://t/p": "http://t/f"}


def test_collections(spark):
    rows = [(1, '[{"bookSourceName": "a"}, {"x": 1}]'), (2, '{"sources": [{"name": "b"}]}'), (3, '{"name": "c"}'), (4, "nonsense"), (5, None)]
    got = files.collection(spark.createDataFrame(rows, "k int, body string"), "body").select("k", "error").collect()
    assert sorted((r["k"], r["error"] or "") for r in got) == [(1, ""), (1, "no name"), (2, ""), (3, ""), (4, "no collection"), (5, "no collection")]


def test_chapters_of_text(spark):
    t = "intro line, with a comma and many more words than any title could have here\n第1章 Sea\nabc\n第2章 Sky\nde"
    docs = spark.createDataFrame([(1, t), (2, "")], "k int, body string")
    got = [tuple(r) for r in books.text_chapters(docs, "k", "body").orderBy("idx").select("idx", "title", "rule", "start_pos", "end_pos").collect() if r["rule"] == "chapter_standard"]
    assert [g[1] for g in got] == ["Sea", "Sky"] and got[-1][4] <= len(t.encode())
    parts = books.split_long(spark.createDataFrame([(1, "aaaa\nbbbb\ncc")], "k int, body string"), "k", "body", 6).orderBy("part").collect()
    assert [r["text"] for r in parts] == ["aaaa", "bbbb\ncc"]
    spine = books.spine_titles(spark.createDataFrame([("a/x.html",), ("b.html",)], "path string"), spark.createDataFrame([("b.html", "B", 1), ("b.html", "late", 2)], "path string, title string, pos int"))
    assert {r["path"]: r["title"] for r in spine.collect()} == {"a/x.html": "x", "b.html": "B"}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "n", 1), (2, "b", None, 1)], "k int, v string, note string, version int")
    new = spark.createDataFrame([(1, "A", 2), (3, "c", 1)], "k int, v string, version int")
    got = {r["k"]: (r["v"], r["note"]) for r in tables.upsert(old, new, ["k"], "version").collect()}
    assert got == {1: ("A", "n"), 2: ("b", None), 3: ("c", None)}
    assert tables.insert_new(old, new, ["k"]).select("k").collect()[0]["k"] == 3


def test_limits(spark):
    ev = spark.sql("select id as event_id, id % 2 as user_id, timestamp_seconds(id) as ts from range(20)")
    got = streams.sliding_limit(ev, "user_id", "ts", "event_id", 2, 6.0).where("accepted and user_id = 0").select("event_id").collect()
    assert sorted(r[0] for r in got) == [0, 2, 6, 8, 12, 14, 18]
    got = streams.token_bucket(ev, "user_id", "ts", "event_id", 0.25, 1.0).where("accepted and user_id = 1").select("event_id").collect()
    assert sorted(r[0] for r in got) == [1, 5, 9, 13, 17]


def test_streams(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 15).alias("k"), F.lit("u").alias("url"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = streams.read_parquet_stream(spark, f"{tmp_path}/in")
    out = streams.search_stream(stream, ["k"], 12, f"{tmp_path}/out", f"{tmp_path}/s1")
    assert out.count() == 12 == out.select("k").distinct().count()
    got = streams.run_to_table(streams.first_seen(stream, ["k"]), "seen", f"{tmp_path}/s2")
    assert sorted(r["k"] for r in got.collect()) == list(range(15))
