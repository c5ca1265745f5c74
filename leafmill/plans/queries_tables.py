"""Queries of the relational flows: sources, shelf, feeds, statistics, writes, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import extract, text
from leafmill.operators import books, tables
from leafmill.plans.registry import block, query, read
from leafmill.sources import feeds, files
from leafmill.sources.shared import shared_dir
from leafmill.streaming import streams


def _sources(spark, sf):
    """Suppliers as sources: a group, an order, a flag, a search rule that needs scripts for every fourth."""
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("g"), (F.col("s_nationkey") % 5).cast("string")).alias("group"), F.col("s_nationkey").cast("long").alias("order"), (F.col("s_acctbal") > 0).alias("enabled"), F.when(F.col("s_suppkey") % 4 == 0, "<js>x()</js>").otherwise("li a").alias("search_rule"))


_S = "SELECT s_suppkey AS id, s_name AS name, concat('g', s_nationkey % 5) AS grp, CAST(s_nationkey AS BIGINT) AS ord, s_acctbal > 0 AS enabled, s_suppkey % 4 = 0 AS js FROM supplier"


@query(f'SELECT id, name, CAST(row_number() OVER (ORDER BY ord DESC, id DESC) - 1 AS BIGINT) AS pos FROM ({_S}) QUALIFY pos < 50')
def source_list(spark, sf):
    return tables.ranked(_sources(spark, sf), 50, F.desc("order"), F.desc("id")).select("id", "name", "pos")


@query(f"SELECT id, name FROM ({_S}) WHERE enabled")
def source_enabled(spark, sf):
    return _sources(spark, sf).where("enabled").select("id", "name")


@query(f"SELECT id, NOT js AS enabled, js AS needs_script FROM ({_S})")
def source_policy(spark, sf):
    return tables.script_policy(_sources(spark, sf), ["search_rule"]).select("id", "enabled", "needs_script")


@query(f"SELECT count(*) AS total, count(*) FILTER (js) AS scripted, count(*) FILTER (NOT js) AS plain, count(*) FILTER (enabled) AS enabled FROM ({_S})")
def source_policy_counts(spark, sf):
    return tables.counts(_sources(spark, sf), scripted=F.col("search_rule").contains("<js>"), plain=~F.col("search_rule").contains("<js>"), enabled=F.col("enabled"))


@query(f"SELECT id, CASE WHEN js THEN false ELSE enabled END AS enabled FROM ({_S})")
def source_batch_enable(spark, sf):
    return tables.update(_sources(spark, sf), F.col("search_rule").contains("<js>"), enabled=F.lit(False)).select("id", "enabled")


@query(f"SELECT count(*) FILTER (js AND enabled) AS updated FROM ({_S})")
def source_batch_changes(spark, sf):
    return tables.changed(_sources(spark, sf), F.col("search_rule").contains("<js>"), "enabled", F.lit(False))


@query("SELECT coalesce(max(s_nationkey), 0) + 1 AS next_order FROM supplier")
def next_order(spark, sf):
    return tables.next_order(_sources(spark, sf))


@query("SELECT c_custkey AS id, c_name AS name, (SELECT max(s_nationkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS \"order\" FROM customer")
def import_orders(spark, sf):
    new = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.with_order(_sources(spark, sf), new, F.col("id")).select("id", "name", "order")


@query(f"SELECT id FROM ({_S}) WHERE (contains(lower(name), '00001') OR contains(grp, '00001')) AND grp = 'g1'")
def source_filter(spark, sf):
    return _sources(spark, sf).where(tables.search_text("00001", "name", "group") & (F.col("group") == "g1")).select("id")


@query(f"SELECT grp AS \"group\", count(*) AS n FROM ({_S}) GROUP BY grp")
def source_groups(spark, sf):
    return tables.grouped_counts(_sources(spark, sf), "group", "none")


@query("SELECT DISTINCT coalesce(nullif(trim(c_mktsegment), ''), 'none') AS c_mktsegment FROM customer")
def group_labels(spark, sf):
    return tables.groups(read(spark, sf, "customer"), "c_mktsegment", "none")


def _shelf(spark, sf):
    """Orders as a shelf: progress of 0, between, or 100."""
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("name"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("last_read_at"), F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 40).otherwise(0).alias("progress"))


_H = "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS name, o_totalprice AS price, o_orderdate AS last_read_at, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 40 ELSE 0 END AS progress FROM orders"


@query(f"SELECT id, last_read_at FROM ({_H}) ORDER BY last_read_at DESC, id DESC LIMIT 20 OFFSET 20")
def shelf_page(spark, sf):
    return tables.page(_shelf(spark, sf).select("id", "last_read_at"), 2, 0, F.desc("last_read_at"), F.desc("id"))


@query(f"SELECT count(*) AS total, count(*) > 40 AS has_more FROM ({_H})")
def shelf_page_info(spark, sf):
    return tables.page_info(_shelf(spark, sf), 2, 20)


@query(f"SELECT count(*) AS total, count(*) FILTER (progress = 0) AS unread, count(*) FILTER (progress > 0 AND progress < 100) AS reading, count(*) FILTER (progress >= 100) AS finished FROM ({_H})")
def shelf_stats(spark, sf):
    p = F.col("progress")
    return tables.counts(_shelf(spark, sf), unread=p == 0, reading=(p > 0) & (p < 100), finished=p >= 100)


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY last_read_at DESC, id) - 1 AS BIGINT) AS pos FROM ({_H}) WHERE progress > 0 QUALIFY pos < 8")
def continue_reading(spark, sf):
    return tables.ranked(_shelf(spark, sf).where("progress > 0"), 8, F.desc("last_read_at"), F.col("id")).select("id", "pos")


@query(f"SELECT id, CASE WHEN progress >= 100 THEN 'finished' WHEN progress > 0 THEN 'reading' ELSE 'unread' END AS grp FROM ({_H}) WHERE contains(name, '12')")
def shelf_filter(spark, sf):
    return _shelf(spark, sf).where(tables.search_text("12", "name")).select("id", tables.progress_group(F.col("progress")).alias("grp"))


_E = "SELECT event_id, ts, user_id, event_type, value FROM events"


@query("SELECT user_id, max_by(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def shelf_upsert(spark, sf):
    """Progress events applied to a shelf by user: the last one wins."""
    e = read(spark, sf, "events").select("user_id", "value", "ts", F.struct("ts", "event_id").alias("version"))
    old = e.where("value < 50").groupBy("user_id").agg(F.max_by("value", "version").alias("value"), F.max("ts").alias("ts"), F.max("version").alias("version"))
    new = e.groupBy("user_id").agg(F.max_by("value", "version").alias("value"), F.max("ts").alias("ts"), F.max("version").alias("version"))
    return tables.upsert(old, new, ["user_id"], "version").select("user_id", "value", "ts")


@query("SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_success, max(ts) FILTER (event_type = 'error') AS last_error, count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY user_id")
def counter_upsert(spark, sf):
    e = read(spark, sf, "events")
    ok = F.col("event_type") != "error"
    empty = tables.count_events(spark.createDataFrame([], "user_id long, last_success timestamp_ntz, last_error timestamp_ntz, success_count long, error_count long"), e.where("event_id % 2 = 0"), "user_id", ok, "ts")
    return tables.count_events(empty, e.where("event_id % 2 = 1"), "user_id", ok, "ts")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 50 <> 0 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 50 = 0)")
def feed_ingest(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("user_id").alias("feed_id"), F.col("event_type").alias("guid"))
    new = feeds.ingest(e.where("event_id % 50 <> 0"), e.where("event_id % 50 = 0"))
    return new.select(F.col("feed_id").alias("user_id"), F.col("guid").alias("event_type"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY (value < 5), ts DESC, event_id DESC) - 1 AS BIGINT) AS pos FROM events WHERE user_id = 8 QUALIFY pos < 20")
def feed_items_page(spark, sf):
    items = read(spark, sf, "events").where("user_id = 8").select("event_id", F.when(F.col("value") >= 5, F.col("ts")).alias("at"), "ts")
    return tables.ranked(items, 20, F.col("at").isNull().asc(), F.desc("ts"), F.desc("event_id")).select("event_id", "pos")


@query("SELECT event_type, max(ts) AS ts, CAST(row_number() OVER (ORDER BY max(ts) DESC, event_type) - 1 AS BIGINT) AS pos FROM events GROUP BY event_type QUALIFY pos < 20")
def search_history(spark, sf):
    return tables.history(read(spark, sf, "events"), "event_type", "ts")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark, sf):
    left = tables.cascade(read(spark, sf, "lineitem"), read(spark, sf, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def batch_delete(spark, sf):
    gone = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete(read(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS icon_url, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def migrate_columns(spark, sf):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("icon_url", T.StringType())])
    return tables.migrate(read(spark, sf, "customer"), schema)


@query("SELECT c_custkey, c_name FROM customer")
def export_import(spark, sf):
    out = tables.bundle(read(spark, sf, "customer"), "c_custkey")
    return tables.unbundle(out, "c_custkey long, c_name string")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def collection_import(spark, sf):
    """Wrapper objects of each nation, with its suppliers as sources, those of a block of ids in one."""
    doc = read(spark, sf, "supplier").groupBy("s_nationkey", block(F.col("s_suppkey"))).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("bookSourceName"))).alias("bookSources"))).alias("doc"))
    got = files.collection(doc, "doc").where("error is null")
    return got.select(F.get_json_object("json", "$.id").cast("long").alias("id"), F.get_json_object("json", "$.bookSourceName").alias("name"))


# ---- flows over pages ----

_NAV = "SELECT page_id, url, regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1) AS hrefs, [trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)] AS texts FROM pages"


@query("SELECT md5(text) AS text, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL ORDER BY min(doc_id) LIMIT 50")
def search_merge(spark, sf):
    """All documents as search results, merged by text and source; the first 50."""
    rows = read(spark, sf, "documents").select(F.md5("text").alias("text"), "source", "doc_id", F.lit("u").alias("url"))
    return books.merge_results(rows, F.col("doc_id"), keys=("text", "source")).select("text", "source", "doc_id")


@query(
    f"WITH r AS (SELECT n.page_id, i, texts[i] AS name, hrefs[i] AS href, n.url AS base FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM ({_NAV})) n WHERE texts[i] <> ''), m AS (SELECT name, min((-page_id, page_id, i)) AS k FROM r GROUP BY name ORDER BY k, name LIMIT 50) SELECT m.name, concat(regexp_extract(r.base, '^(https?://[^/]+)', 1), r.href) AS url FROM m JOIN r ON r.page_id = m.k[2] AND r.i = m.k[3]".replace(
        "m.k[2]", "struct_extract(m.k, 2)").replace("m.k[3]", "struct_extract(m.k, 3)")
)
def search_flow(spark, sf):
    """Every page as a source whose search page is itself: list items, their fields, merged by name and author."""
    pages = read(spark, sf, "pages")
    sources = pages.select(F.col("page_id").alias("id"), F.col("url").alias("base_url"), F.col("url").alias("search_url"), F.lit(True).alias("enabled"), F.col("page_id").alias("order"))
    got = books.search(sources, pages, {"list": "@css:nav li", "name": "tag.a@text", "author": "@css:none@text", "url": "tag.a@href"}, "q", page_key="page_id")
    return got.select("name", "url")


@query("SELECT page_id, url, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS name, concat('author ', page_id) AS author FROM pages")
def book_info_flow(spark, sf):
    pages = read(spark, sf, "pages")
    asked = pages.select("page_id", "url", F.lit("old").alias("name"), F.concat(F.lit("author "), F.col("page_id").cast("string")).alias("author"))
    return books.book_info(asked, pages, {"name": "@css:article h1@text", "author": "@css:.author@text"}, page_key="page_id").select("page_id", "url", "name", "author")


@query(f"SELECT page_id, CAST(len(texts) - i AS BIGINT) AS idx, texts[i] AS title, concat(regexp_extract(url, '^(https?://[^/]+)', 1), hrefs[i]) AS chapter_url FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM ({_NAV})) WHERE texts[i] <> ''")
def chapter_list_flow(spark, sf):
    pages = read(spark, sf, "pages")
    got = books.chapters(pages.select("page_id", "url"), pages, {"list": "tag.nav@tag.li", "title": "tag.a@text", "url": "tag.a@href"}, "page_id", newest_first=True, page_key="page_id")
    return got.withColumn("idx", F.col("idx").cast("long"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations WHERE turn < 50 GROUP BY conv_id")
def content_pages(spark, sf):
    return books.join_pages(read(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", most=50)


@query("SELECT p.page_id AS k, CAST(i AS INTEGER) AS page_no, concat('/p/', p.page_id + 3 * i) AS url FROM pages p, range(6) r(i) WHERE p.page_id % 24 < 3 AND p.page_id % 24 + 3 * i < 13 + p.page_id % 5 AND p.page_id + 3 * i IN (SELECT page_id FROM pages)")
def content_page_links(spark, sf):
    """Chapters of up to six pages: every 24 pages hold three, whose pages take turns; lengths differ."""
    n = read(spark, sf, "pages").select(F.col("page_id").alias("k"))
    url = lambda c: F.concat(F.lit("/p/"), c.cast("string"))
    first = F.col("k") - F.col("k") % 24 + F.col("k") % 3
    links = n.where((F.col("k") % 24 + 3) < 13 + first % 5).select(url(F.col("k")).alias("url"), (F.col("k") + 3).alias("to")).join(n.withColumnRenamed("k", "to"), "to", "left_semi").select("url", url(F.col("to")).alias("next_url"))
    return books.follow_pages(n.where("k % 24 < 3").select("k", url(F.col("k")).alias("url")), links, "k", most=6)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') AND contains(p_type, 'ECONOMY') ORDER BY p_partkey LIMIT 20 OFFSET 20")
def explore_page(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("author"), F.col("p_type").alias("category"))
    return books.explore(rows, "RING", "ECONOMY", 2, 20, F.col("id")).select("id", "name")


@query("SELECT l_linenumber, n FROM (SELECT l_linenumber, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem GROUP BY l_linenumber) WHERE b < 20000")
def explore_until_enough(spark, sf):
    per = read(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return books.until_enough(per, "l_linenumber", "n", 20000)


_JAC = "CASE WHEN p_name = 'small ring' THEN 1.0 WHEN contains(p_name, 'small ring') OR contains('small ring', p_name) THEN 0.9 WHEN contains(replace(p_name, ' ', ''), 'smallring') OR contains('smallring', replace(p_name, ' ', '')) THEN 0.88 ELSE jaccard(replace(p_name, ' ', ''), 'smallring') END"


@query(f"SELECT p_size AS source_id, p_partkey AS pos, name, score FROM (SELECT p_size, p_partkey, p_name AS name, {_JAC} AS score, row_number() OVER (PARTITION BY p_size ORDER BY {_JAC} DESC, p_partkey) AS k FROM part WHERE p_size <> 11) WHERE k = 1 AND score >= 0.45")
def alternates_best(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_size").alias("source_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit("").alias("author"))
    book = rows.where("pos = 0").select(F.lit("small ring").alias("name"), F.lit("").alias("author"), F.lit(11).alias("source_id"))
    return books.alternates(book, rows).select("source_id", "pos", "name", "score")


@query("SELECT p_brand, p_partkey AS idx, p_name AS title, s AS score FROM (SELECT *, CASE WHEN p_name = 'small ring' THEN 1.0 WHEN contains(replace(p_name, ' ', ''), 'smallring') OR contains('smallring', replace(p_name, ' ', '')) THEN 0.88 ELSE jaccard(replace(p_name, ' ', ''), 'smallring') END AS s FROM part) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) = 1")
def chapter_align(spark, sf):
    rows = read(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("idx"), F.col("p_name").alias("title"))
    return books.align_chapter(rows, "small ring", "p_brand")


# ---- feeds ----


@query("SELECT user_id AS feed_id, count(*) AS n, max(ts) AS newest, min(concat('t', event_id)) AS first_title FROM (SELECT *, date_trunc('second', ts) AS ts2 FROM events) GROUP BY user_id".replace("max(ts)", "max(ts2)"))
def rss_reader(spark, sf):
    """Feeds of each user: its events as items, those of a block of ids in one document."""
    item = F.concat(F.lit("<item><title>t"), F.col("event_id").cast("string"), F.lit("</title><link>http://x/"), F.col("event_id").cast("string"), F.lit("</link><description>d &amp; e</description><pubDate>"), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    docs = read(spark, sf, "events").select("user_id", block(F.col("event_id")).alias("b"), item.alias("i")).groupBy(F.col("user_id").alias("feed_id"), "b").agg(F.concat(F.lit("<rss><channel><title>c</title>"), F.array_join(F.collect_list("i"), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.rss_items(docs).where("guid = link and content = 'd & e'").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").cast("timestamp_ntz").alias("newest"), F.min("title").alias("first_title"))


@query("SELECT user_id AS feed_id, event_id, concat('http://x/', event_id) AS link, concat('s', event_id) AS content FROM events")
def atom_reader(spark, sf):
    e = F.col("event_id").cast("string")
    body = F.concat(F.lit('<feed><title>c</title><entry><title>t</title><link rel="self" href="no"/><link rel="alternate" href="http://x/'), e, F.lit('"/><summary>s'), e, F.lit("</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>"))
    rows = read(spark, sf, "events").select(F.col("user_id"), F.col("event_id").alias("feed_id"), body.alias("body"))
    got = feeds.atom_items(rows).where("published_at is not null")
    return got.join(rows.select("feed_id", "user_id"), "feed_id").select(F.col("user_id").alias("feed_id"), F.col("feed_id").alias("event_id"), "link", "content")


@query("SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_feed(spark, sf):
    return feeds.page_items(read(spark, sf, "pages")).select("page_id", "title")


@query("SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/my.xml') WHEN 1 THEN concat(regexp_extract(url, '^[^?#]*'), '/feed/') WHEN 2 THEN concat(regexp_extract(url, '^[^?#]*'), '/rss') END AS feed_url FROM (SELECT page_id, concat(regexp_extract(url, '^[^?#]*'), '/', page_id, '?q#f') AS url FROM pages)")
def feed_discovery(spark, sf):
    """Feeds that a page's head names, or that lie at a usual path below it; the fourth usual path is not tried."""
    at = F.concat(F.regexp_extract("url", r"^[^?#]*", 0), F.lit("/"), F.col("page_id").cast("string"))
    named = F.col("page_id") % 4 == 0
    pages = read(spark, sf, "pages").select("page_id", F.concat(at, F.lit("?q#f")).alias("url"), F.when(named, '<html><head><link rel="alternate" type="application/rss+xml" href="/my.xml"></head>').otherwise("<html>").alias("html"))
    below = F.element_at(F.array(*[F.lit(x) for x in ("/feed/", "/rss", "/rss.xml")]), (F.col("page_id") % 4).cast("int"))
    found = read(spark, sf, "pages").where(~named).select("page_id", F.concat(at, below).alias("url"), F.lit("<rss>").alias("html"))
    return feeds.discover(pages.select("page_id", "url"), pages.unionByName(found)).select("page_id", "url", "feed_url")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rss' ELSE 'atom' END AS title, concat('http://x/', event_id) AS link FROM events WHERE event_id % 3 < 2")
def feed_entry(spark, sf):
    """RSS, Atom and neither: one entry point sniffs a body's kind and reads it; previews hold the first item."""
    e = F.col("event_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><title>c</title><item><title>rss</title><link>http://x/"), e, F.lit("</link></item><item><title>more</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><title>c</title><entry><title>atom</title><link href="http://x/'), e, F.lit('"/></entry></feed>'))
    bodies = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, rss).when(F.col("event_id") % 3 == 1, atom).otherwise("<p>none</p>").alias("body"))
    return feeds.preview(bodies, 1, key="event_id").select("event_id", "title", "link")


# ---- streams ----


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """The events as a file stream, deduplicated with state, into files."""
    place = _scratch(spark)
    got = streams.first_seen(streams.read_parquet_stream(spark, f"{sf}/events.parquet*").select("user_id", "event_type"), ["user_id", "event_type"])
    return streams.run_to_parquet(got, f"{place}/out", f"{place}/state")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_window FROM events")
def rate_window(spark, sf):
    return streams.in_window(read(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "n_window")


_TURNS = "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"


@query(
    f"""WITH RECURSIVE e AS ({_TURNS}),
r AS (SELECT user_id, event_id, k, [us] AS held, true AS accepted FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END, len(h) < 3
      FROM (SELECT e.*, [t FOR t IN r.held IF t > e.us - 1800000000] AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, accepted FROM r"""
)
def sliding_limiter(spark, sf):
    return streams.sliding_limit(read(spark, sf, "events"), "user_id", "ts", "event_id", 3, 1800.0)


@query(
    f"""WITH RECURSIVE e AS ({_TURNS}),
r AS (SELECT user_id, event_id, k, us, CAST(2 AS DOUBLE) AS tokens, true AS accepted FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, us, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1
      FROM (SELECT e.*, least(CAST(3 AS DOUBLE), r.tokens + (1 / CAST(600 AS DOUBLE)) * (e.us - r.us) / CAST(1000000 AS DOUBLE)) AS t FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, accepted FROM r"""
)
def token_buckets(spark, sf):
    return streams.token_bucket(read(spark, sf, "events"), "user_id", "ts", "event_id", 1 / 600, 3.0)


@query("SELECT event_id, 'fetch' AS step, unnest(['start', CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END]) AS status FROM events")
def debug_stream(spark, sf):
    return streams.debug_events(read(spark, sf, "events"), "event_id", "fetch", F.col("event_type") != "error")


def _scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# ---- flagship ----


def nav_links(spark, sf):
    """Titles and navigation links of all pages, cleaned: one parse a page, resolved links, one row per page and link."""
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    got = extract.extract(pages, "html", {"title": "@css:article h1@text", "links": "@css:nav ul li a@href"}, as_list={"links"})
    rows = got.select("page_id", "url", text.apply_rules(F.col("title"), [{"id": 1, "pattern": "\\s+", "replacement": " ", "scope": "all", "order": 1}], "all").alias("title"), F.posexplode("links").alias("pos", "link"))
    from leafmill.functions import urls

    full = rows.withColumn("link", urls.absolutize(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.col("link")))
    return full.groupBy("page_id", "title", "link").agg(F.min("pos").cast("long").alias("pos"))


query(
    f"SELECT page_id, title, link, CAST(min(i) - 1 AS BIGINT) AS pos FROM (SELECT n.page_id, trim(regexp_replace(replace(regexp_extract(p.html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, concat(regexp_extract(n.url, '^(https?://[^/]+)', 1), hrefs[i]) AS link, i FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM ({_NAV})) n JOIN pages p USING (page_id)) GROUP BY ALL"
)(nav_links)
