"""Queries of flows over many sources: rules as data, alternates of a shelf, page chains, replace rules, fetching, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import blocks, extract, json_paths, lists, regexes, text, urls
from leafmill.operators import alike, books, by_source, replacing
from leafmill.plans import rules as rules_
from leafmill.plans.registry import query, read
from leafmill.sources import fetching, files, formats
from leafmill.sources.shared import shared_dir
from leafmill.streaming import searches, streams

#: Five ways in which sources list their books: a JSON text of rules, k:v rules, regexes, fall-backs with a template, and markup.
_RULES = [
    '{"bookList": "$.data.list", "name": "$.t", "author": "$.a", "bookUrl": "$.u"}',
    "bookList:$.items&&name:$.name&&author:$.by&&bookUrl:$.link",
    '{"bookList": ":<b>(.*?)</b>", "name": ":^[^|]+", "author": ":\\\\|(\\\\w+)\\\\|", "bookUrl": ":[^|]+$"}',
    '{"bookList": "$.none&&$.rows", "name": "N{{$.k}}", "author": "$.x&&$.s", "bookUrl": "/b/{{$.k}}"}',
    '{"bookList": "@css:ul.r li", "name": "tag.a@text", "author": "tag.i@text", "bookUrl": "tag.a@href"}',
]


#: Orders of a customer that one source lists come from one stretch of so many ids, so that no page grows with a customer.
_STRETCH = 14


def _shops(spark, sf):
    """Customers' stretches of orders as sources that list them in the way of their rules; some have no rules, some no page."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").withColumn("at", F.shiftright("o_orderkey", _STRETCH))
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    item = F.array(
        F.concat(F.lit('{"t": "N'), k, F.lit('", "a": "'), s, F.lit('", "u": "/b/'), k, F.lit('"}')),
        F.concat(F.lit('{"name": "N'), k, F.lit('", "by": "'), s, F.lit('", "link": "http://other.example/'), k, F.lit('"}')),
        F.concat(F.lit("<b>N"), k, F.lit("|"), s, F.lit("|/b/"), k, F.lit("</b>")),
        F.concat(F.lit('{"k": '), k, F.lit(', "s": "'), s, F.lit('"}')),
        F.concat(F.lit('<li><a href="/b/'), k, F.lit('">N'), k, F.lit("</a><i>"), s, F.lit("</i></li>")),
    )
    kind = (F.col("o_custkey") % 5).cast("int")
    lists = o.groupBy("o_custkey", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.get(item, kind).alias("i")))), lambda x: x["i"]).alias("rows"))
    around = [('{"data": {"list": [', "]}}"), ('{"items": [', "]}"), ("<p>", "</p>"), ('{"none": [], "rows": [', "]}"), ('<ul class="r">', "</ul>")]
    head, tail = (F.get(F.array(*[F.lit(x[i]) for x in around]), kind) for i in (0, 1))
    root = F.concat(F.lit("http://s"), F.col("o_custkey").cast("string"), F.lit(".example/"), F.col("at").cast("string"))
    pages = lists.where("o_custkey % 13 <> 5").select(F.concat(root, F.lit("/find?q=a+b&p=1")).alias("url"), F.concat(head, F.array_join("rows", ","), tail).alias("html"))
    template = F.when(F.col("c_custkey") % 2 == 0, "find?q={{key}}&p={{page}},{'method': 'post'}").otherwise("/find?q={keyword}&p=1")
    rule = F.when(F.col("c_custkey") % 11 != 3, F.get(F.array(*map(F.lit, _RULES)), (F.col("c_custkey") % 5).cast("int")))
    listing = o.select("o_custkey", "at").distinct().join(c, F.col("o_custkey") == F.col("c_custkey"))
    return listing.select((F.col("at") * 100_000_000 + F.col("c_custkey")).alias("id"), root.alias("base_url"), template.alias("search_url"), rule.alias("search_rule"), (F.col("c_acctbal") > 0).alias("enabled"), F.col("c_nationkey").alias("order")), pages


_FOUND = f"""SELECT (o_orderkey >> {_STRETCH}) * 100000000 + o_custkey AS source_id, c_nationkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey >> {_STRETCH} ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, concat('N', o_orderkey) AS name, o_orderstatus AS author,
       concat(CASE WHEN o_custkey % 5 = 1 THEN 'http://other.example/' ELSE concat('http://s', o_custkey, '.example/b/') END, o_orderkey) AS url
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_custkey % 11 <> 3 AND o_custkey % 13 <> 5"""


@query(f"SELECT * EXCLUDE (c_nationkey) FROM ({_FOUND})")
def search_by_rules(spark, sf):
    """Search in sources of five rule sets at once."""
    return by_source.search(*_shops(spark, sf), "a b").select("source_id", "pos", "name", "author", "url")


@query(f"SELECT name, author, url FROM ({_FOUND}) ORDER BY -c_nationkey, source_id, pos LIMIT 50")
def search_by_rules_merged(spark, sf):
    return by_source.search_merged(*_shops(spark, sf), "a b").select("name", "author", "url")


@query(
    f"""SELECT source_id, CASE WHEN c_custkey % 11 = 3 THEN 'no search rule' WHEN c_custkey % 13 = 5 THEN 'no page' ELSE 'ok' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, coalesce(n, 0) AS n_books
FROM (SELECT DISTINCT c_custkey, (o_orderkey >> {_STRETCH}) * 100000000 + c_custkey AS source_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0)
LEFT JOIN (SELECT source_id, count(*) AS n FROM ({_FOUND}) GROUP BY 1) f USING (source_id)"""
)
def search_by_rules_report(spark, sf):
    return by_source.search_report(*_shops(spark, sf), "a b")


# ---- alternates of a shelf ----


def _alike(a: str, b: str) -> str:
    """text_similarity() of titles without title prefixes."""
    x, y = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 WHEN {x} = {y} THEN 1.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.88 ELSE jaccard({x}, {y}) END"


_TITLED = "SELECT p_partkey, p_size, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', p_type) ELSE concat(p_brand, ' ', p_name) END) AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_type) END AS author FROM part"


def _titled(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    return read(spark, sf, "part").select(k.alias("book_id"), k.alias("pos"), F.col("p_size").alias("source_id"), name.alias("name"), F.when(k % 4 != 0, F.col("p_type")).alias("author"))


@query(
    f"""WITH t AS ({_TITLED}), d AS (SELECT DISTINCT name FROM t), s AS MATERIALIZED (SELECT a.name AS a, b.name AS b, {_alike("a.name", "b.name")} AS alike FROM d a, d b),
c AS (SELECT p_size, name, min(p_partkey) AS pos FROM t GROUP BY ALL),
r AS (SELECT s.a, c.p_size AS source_id, c.pos, s.b AS name, s.alike AS score FROM s JOIN c ON c.name = s.b WHERE s.alike >= 0.45 QUALIFY row_number() OVER (PARTITION BY s.a, c.p_size ORDER BY s.alike DESC, c.pos) = 1)
SELECT t.p_partkey AS book_id, r.source_id, r.pos, r.name, r.score FROM t JOIN r ON t.name = r.a WHERE r.source_id <> t.p_size"""
)
def alternates_shelf(spark, sf):
    """The best alternate of every part, by name, in every other source."""
    rows = _titled(spark, sf).withColumn("author", F.lit(""))
    return alike.shelf_alternates(rows, rows).select("book_id", "source_id", "pos", F.lower("name").alias("name"), "score")


@query(
    f"""WITH t AS ({_TITLED}), d AS (SELECT DISTINCT name FROM t), s AS MATERIALIZED (SELECT a.name AS a, b.name AS b, {_alike("a.name", "b.name")} AS alike FROM d a, d b),
w AS (SELECT DISTINCT author FROM t), v AS MATERIALIZED (SELECT a.author AS a, b.author AS b, CASE WHEN a.author = '' OR b.author = '' THEN 0.0 ELSE {_alike("a.author", "b.author")} END AS alike FROM w a, w b),
c AS (SELECT p_size, name, author, min(p_partkey) AS pos FROM t GROUP BY ALL), k AS (SELECT DISTINCT name, author FROM t),
r AS (SELECT k.name, k.author, c.p_size AS source_id, c.pos, CASE WHEN k.author = '' THEN s.alike ELSE s.alike * 0.65 + v.alike * 0.35 END AS score FROM k JOIN s ON s.a = k.name JOIN c ON c.name = s.b JOIN v ON v.a = k.author AND v.b = c.author WHERE s.alike > 0 AND score >= 0.45
      QUALIFY row_number() OVER (PARTITION BY k.name, k.author, c.p_size ORDER BY score DESC, c.pos) = 1)
SELECT t.p_partkey AS book_id, r.source_id, r.pos, round(r.score, 9) AS score FROM t JOIN r USING (name, author) WHERE r.source_id <> t.p_size"""
)
def alternates_shelf_authors(spark, sf):
    """The same with authors, of which some are null."""
    rows = _titled(spark, sf)
    return alike.shelf_alternates(rows, rows).select("book_id", "source_id", "pos", F.round("score", 9).alias("score"))


# ---- chains of pages ----


@query(
    """WITH RECURSIVE l AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 5 THEN first_value(event_id) OVER w ELSE lead(event_id) OVER w END AS onto FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT user_id AS k, 0 AS page_no, min(event_id) AS e FROM events GROUP BY user_id UNION ALL SELECT k, page_no + 1, onto FROM c JOIN l ON l.event_id = c.e WHERE page_no < 49 AND onto IS NOT NULL)
SELECT k, min(page_no) AS page_no, concat('/e/', e) AS url FROM c GROUP BY k, e"""
)
def page_chains(spark, sf):
    """Every user's events as the pages of one chapter, up to fifty; some pages lead back to the first one."""
    e = read(spark, sf, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = F.min("event_id").over(Window.partitionBy("user_id"))
    url = lambda c: F.concat(F.lit("/e/"), c.cast("string"))
    to = F.when(F.col("event_id") % 97 == 5, first).otherwise(F.lead("event_id").over(w))
    links = e.select(url(F.col("event_id")).alias("url"), url(to).alias("next_url"))
    start = e.groupBy(F.col("user_id").alias("k")).agg(url(F.min("event_id")).alias("url"))
    return books.follow_pages(start, links, "k")


# ---- replace rules ----

#: A rule a brand, with the number of its newest part: groups, patterns that cannot be compiled, none, capitals, plain ones.
_RULE_ROWS = """SELECT max(p_partkey) AS id, n, chr(CAST(96 + n AS INTEGER)) AS l, CASE WHEN n % 5 = 0 THEN 'all' ELSE concat('s', n % 4) END AS scope, n * 7 % 5 AS ord FROM (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part) WHERE n % 11 <> 0 AND n % 6 <> 2 GROUP BY n"""


def _brand_rules(spark, sf):
    n = F.col("n")
    letter, kind = F.char((96 + n).cast("int")), n % 6
    pattern = F.when(kind == 0, F.concat(F.lit("("), letter, F.lit(")([aeiou])"))).when(kind == 1, F.concat(F.lit("("), letter)).when(kind == 2, F.lit("")).when(kind == 3, F.concat(F.upper(letter), F.lit("{2}"))).otherwise(F.concat(letter, F.lit("\\s")))
    replacement = F.when(kind == 0, "$2$1").when(kind == 1, "$1\\").when(kind != 3, F.concat(F.lit("-"), n.cast("string"), F.lit(" ")))
    brands = read(spark, sf, "part").groupBy(F.substring("p_brand", 7, 9).cast("int").alias("n")).agg(F.max("p_partkey").alias("id"))
    return brands.select("id", pattern.alias("pattern"), replacement.alias("replacement"), F.when(n % 5 == 0, "all").otherwise(F.concat(F.lit("s"), (n % 4).cast("string"))).alias("scope"), (n * 7 % 5).alias("order"), (kind == 3).alias("case_insensitive"), (n % 11 != 0).alias("enabled"))


@query(
    f"""WITH RECURSIVE s AS (SELECT concat('s', i) AS s FROM range(6) r(i)), r AS (SELECT s, n, l, row_number() OVER (PARTITION BY s ORDER BY ord DESC, id DESC) AS k FROM s JOIN ({_RULE_ROWS}) ON scope IN ('all', s)),
t AS (SELECT doc_id, concat('s', doc_id % 6) AS s, 0 AS k, concat(text, ' (a (g (m (s (y Ccc iI oOo') AS text FROM documents
      UNION ALL SELECT doc_id, t.s, r.k, CASE n % 6 WHEN 0 THEN regexp_replace(text, concat('(', l, ')([aeiou])'), '\\2\\1', 'g') WHEN 1 THEN replace(text, concat('(', l), '$1\\') WHEN 3 THEN regexp_replace(text, concat('(?i)', l, '{{2}}'), '', 'g') ELSE regexp_replace(text, concat(l, '\\s'), concat('-', n, ' '), 'g') END
      FROM t JOIN r ON r.s = t.s AND r.k = t.k + 1)
SELECT doc_id, md5(arg_max(text, k)) AS h FROM t GROUP BY doc_id""".replace("\\\\", "\\")
)
def replace_rules_table(spark, sf):
    """Rules from a table on all documents, each by its scope; two scopes have none of their own."""
    docs = read(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" (a (g (m (s (y Ccc iI oOo")).alias("text"), F.concat(F.lit("s"), (F.col("doc_id") % 6).cast("string")).alias("scope"))
    return replacing.apply_rules(docs, _brand_rules(spark, sf), "text", "scope").select("doc_id", F.md5("text").alias("h"))


@query("SELECT p_partkey AS id, p_size AS \"order\" FROM part WHERE p_partkey % 11 <> 0")
def replace_rules_enabled(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("order"), (F.col("p_partkey") % 11 != 0).alias("enabled"))
    return replacing.listed(rows, enabled_only=True).select("id", "order")


# ---- streamed search ----

_STREAM_MOST, _STREAM_SECONDS = 12, 40 * 3600
_RESULTS = "SELECT CAST(user_id AS VARCHAR) AS request, ts, event_type AS source_id, event_id, event_id % 7 AS book FROM events"


@query(
    f"""WITH r AS ({_RESULTS}), u AS (SELECT *, min(ts) OVER (PARTITION BY request) + INTERVAL {_STREAM_SECONDS} SECONDS AS until FROM r),
b AS (SELECT request, source_id, book, min(ts) AS ts FROM u WHERE ts <= until AND book <> 3 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts, source_id, concat('/b/', book)) - 1 AS seq FROM b QUALIFY seq < {_STREAM_MOST}),
d AS (SELECT request, any_value(until) AS until, max(ts) AS last FROM u GROUP BY request)
SELECT request, 'result' AS event, seq, source_id, concat('B', book) AS name, concat('/b/', book) AS url, NULL AS total FROM n
UNION ALL SELECT request, 'done', coalesce(t, 0), NULL, NULL, NULL, coalesce(t, 0) FROM d LEFT JOIN (SELECT request, count(*) AS t FROM n GROUP BY request) USING (request) WHERE t >= {_STREAM_MOST} OR last > until OR until <= (SELECT max(ts) FROM events)"""
)
def search_streamed(spark, sf):
    """The events as a stream of search results: every user asks, event types are sources, twelve books or forty hours end a request."""
    place = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    # one batch over all files: their times overlap, and what a later batch brings behind the watermark would be late
    e = streams.read_parquet_stream(spark, f"{sf}/events.parquet*", files=(1 << 31) - 1)
    book = F.col("event_id") % 7
    url = F.when(book != 3, F.concat(F.lit("/b/"), book.cast("string")))
    rows = e.select(F.col("user_id").alias("request"), "ts", F.col("event_type").alias("source_id"), F.concat(F.lit("B"), book.cast("string")).alias("name"), F.lit("").alias("author"), url.alias("url"))
    return searches.run_search(spark, rows, f"{place}/out", f"{place}/state", most=_STREAM_MOST, seconds=_STREAM_SECONDS).drop("author")


# ---- formats ----


@query("SELECT p_partkey AS id, p_name AS name, p_size > 20 AS enabled, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def collection_format(spark, sf):
    """All parts written as a collection of lines and read back, three of the four fields that were written and one that was not always."""
    formats.register(spark)
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 20).alias("enabled"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"), F.col("p_type").alias("type"))
    rows.write.format("json_collection").mode("append").save(path)
    return spark.read.format("json_collection").schema("id long, name string, enabled boolean, price double").option("split", 1 << 16).load(path)


@query("SELECT p_brand AS \"group\", count(*) AS n, min(p_name) AS name FROM part GROUP BY p_brand")
def collection_stream(spark, sf):
    """The same as a stream of collection files, counted by brand when it is out."""
    formats.register(spark)
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    read(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("group")).write.format("json_collection").mode("append").save(f"{path}/in")
    found = streams.run_to_parquet(spark.readStream.format("json_collection").schema("name string, `group` string").load(f"{path}/in"), f"{path}/out", f"{path}/state")
    return found.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))


# ---- scripts ----

_SCRIPT = """
var title = name.trim();  // declared, used twice
var words = title.split(' ').map(function(w) { return w.substring(0, 1).toUpperCase() + w.substring(1); });
const price = (n, cut) => n > cut ? n - cut : 0;
var tail = '/' + price(size, 20);
tail += words.length > 1 ? '; many!' : '; one?';
words.join('-') + tail
"""


@query(
    """SELECT p_partkey, concat(array_to_string([concat(upper(w[1]), w[2:]) FOR w IN string_split(trim(p_name), ' ')], '-'), '/', greatest(p_size - 20, 0), CASE WHEN contains(trim(p_name), ' ') THEN '; many!' ELSE '; one?' END) AS said,
       concat(p_size * 2 + 1, CASE WHEN p_size % 2 = 0 THEN concat('-', p_brand) ELSE '' END, md5(p_type)) AS added FROM part"""
)
def script_blocks(spark, sf):
    """A script of declarations and functions, and blocks whose values are added up, on every part."""
    names = {"name": F.col("p_name"), "size": F.col("p_size"), "brand": F.col("p_brand"), "kind": F.col("p_type")}
    added = "text <js>function twice(n) { return n * 2; } twice(size) + one</js> and <js>var one = 1; size % 2 == 0 ? '-' + brand : ''</js><JS>md5Encode(kind)</JS>"
    return read(spark, sf, "part").select("p_partkey", blocks.as_text(blocks.run(_SCRIPT, names)).alias("said"), blocks.as_text(blocks.embedded(added, names)).alias("added"))


# ---- references ----

_REFS = ["g", "./g?y=1", "../h/./i", "/r/../s", "//o.example/x", "?q=2", "#f", "../../../up", "http://z.example/a/../b", "javascript:void(0)", "", "a//b/.."]


@query(
    f"""WITH p AS (SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/one/two/', page_id, '.html;v=1?k=', page_id, '#top') AS base, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN concat(root, '/one/two/g') WHEN 1 THEN concat(root, '/one/two/g?y=1') WHEN 2 THEN concat(root, '/one/h/i') WHEN 3 THEN concat(root, '/s') WHEN 4 THEN concat(scheme, '://o.example/x') WHEN 5 THEN concat(root, '/one/two/', page_id, '.html;v=1?q=2')
       WHEN 6 THEN concat(root, '/one/two/', page_id, '.html;v=1?k=', page_id, '#f') WHEN 7 THEN concat(root, '/up') WHEN 8 THEN 'http://z.example/a/../b' WHEN 9 THEN 'javascript:void(0)' WHEN 10 THEN base ELSE concat(root, '/one/two/a/') END AS resolved FROM p, range({len(_REFS)}) r(i)"""
)
def url_resolve_cases(spark, sf):
    """Twelve kinds of references against a base with path, parameters, query and fragment on every page's host."""
    k, root = F.col("page_id").cast("string"), F.regexp_extract("url", "^(https?://[^/]+)", 1)
    base = F.concat(root, F.lit("/one/two/"), k, F.lit(".html;v=1?k="), k, F.lit("#top"))
    rows = read(spark, sf, "pages").select("page_id", base.alias("base"), F.posexplode(F.array(*map(F.lit, _REFS))).alias("i", "ref"))
    return rows.select("page_id", "i", urls.resolve(F.col("base"), F.col("ref")).alias("resolved"))


# ---- fetching, charsets, listings ----


@query(
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'refused' WHEN page_id % 7 = 0 THEN 'no response' WHEN page_id % 5 IN (2, 4) THEN 'failed' ELSE 'ok' END AS outcome,
       CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 2 WHEN page_id % 5 = 2 THEN 3 ELSE 1 END AS attempts,
       CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 5 IN (2, 4) THEN NULL WHEN page_id % 5 = 3 THEN 404 ELSE 200 END AS status,
       CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 5 IN (2, 4) THEN NULL WHEN page_id % 2 = 0 THEN 'utf-8' ELSE 'utf-16-le' END AS charset,
       md5(CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 5 IN (2, 4) THEN '' ELSE html END) AS h FROM pages"""
)
def fetch_attempts(spark, sf):
    """Every page asked for: some answer at once, some at the second attempt, some time out three times, some fail for good, some may not be asked."""
    k = F.col("page_id")
    p = read(spark, sf, "pages").select("page_id", "html", F.when(k % 11 == 0, F.concat(F.lit("http://127.0.0.1/"), k.cast("string"))).otherwise(F.col("url")).alias("url"))
    error = lambda said: F.lit(said).alias("error")
    row = lambda n, status, err: F.struct(F.lit(n).alias("attempt"), F.lit(status).cast("int").alias("status"), error(err))
    tries = F.when(k % 5 == 1, F.array(row(1, None, "unexpected EOF"), row(2, 200, None))).when(k % 5 == 2, F.array(*[row(n, None, "i/o timeout") for n in (1, 2, 3)], row(4, 200, None))).when(k % 5 == 3, F.array(row(1, 404, None), row(2, 200, None))).when(k % 5 == 4, F.array(row(1, None, "no such host"), row(2, 200, None))).otherwise(F.array(row(1, 200, None)))
    body = F.when(k % 2 == 0, F.encode("html", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
    made = p.where(k % 7 != 0).select("page_id", "url", F.inline(tries), body.alias("body")).select("page_id", "url", "attempt", "status", "error", F.lit("text/html").alias("content_type"), F.lit("").alias("content_encoding"), "body")
    got = fetching.fetched(p.select("page_id", "url"), made, key="page_id")
    return got.select("page_id", "outcome", "attempts", "status", "charset", F.md5("text").alias("h"))


@query(
    """SELECT doc_id, ['utf-8', 'gbk', 'hz', 'utf-16-be', 'utf-8'][1 + doc_id % 5] AS charset, md5(CASE doc_id % 5 WHEN 4 THEN t ELSE concat(repeat('第一章中文', 1 + length(t) // 8), t) END) AS h
FROM (SELECT doc_id, replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '~', '') AS t FROM documents)"""
)
def charset_scored(spark, sf):
    """Chinese words before each document's ASCII letters in UTF-8, GBK, HZ and marked UTF-16, and these letters alone."""
    t = F.replace(F.regexp_replace("text", "[^\\x00-\\x7F]", ""), F.lit("~"), F.lit(""))
    n = (1 + F.floor(F.char_length(t) / 8)).cast("int")
    said = lambda code: F.concat(F.unhex(F.repeat(F.lit("第一章中文".encode(code).hex()), n)), F.encode(t, "UTF-8"))
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat(F.repeat(F.lit("第一章中文"), n), t), "UTF-16BE"))
    raw = F.get(F.array(said("utf-8"), said("gb18030"), said("hz"), wide, F.encode(t, "UTF-8")), (F.col("doc_id") % 5).cast("int"))
    return read(spark, sf, "documents").select("doc_id", files.scored(raw).alias("x")).select("doc_id", "x.charset", F.md5("x.text").alias("h"))


@query(
    """WITH n AS (SELECT l_suppkey AS source_id, l_partkey AS page, count(*) FILTER (l_partkey % 17 <> 3) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER w, 0) AS before, coalesce(max(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER w, 0) AS gone FROM n WINDOW w AS (PARTITION BY source_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source_id, page, n FROM b WHERE before < 30 AND gone = 0 AND n > 0"""
)
def explore_sources(spark, sf):
    """Every supplier's listing, page by page of its parts, up to an empty page or thirty items."""
    per = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("page")).agg(F.count_if(F.col("l_partkey") % 17 != 3).alias("n"))
    return books.until_enough(per, "page", "n", 30, "source_id")


# ---- smaller parts of rules and URLs ----


@query(
    "SELECT p_partkey, concat('http://b.example/toc/', p_partkey, '?q=', p_size) AS toc, concat('http://b.example/', replace(p_brand, '#', '%23'), '/', p_partkey, '/', greatest(1, p_partkey % 4)) AS filled, CASE WHEN p_partkey % 4 <= 1 THEN 'x' ELSE 'y' END AS listed FROM part"
)
def url_placeholders(spark, sf):
    """Contents' URLs told from book pages, some of them glued to another URL; generic places and values by page."""
    k = F.col("p_partkey").cast("string")
    page = F.concat(F.lit('<a id="toc" href="'), F.when(F.col("p_partkey") % 3 == 0, F.lit("http://x.example/go?u=http://b.example")).otherwise(""), F.lit("/toc/"), k, F.lit("?q="), F.col("p_size").cast("string"), F.lit('">'))
    rows = read(spark, sf, "part").withColumn("page", page)
    got = extract.extract(rows, "page", {"toc": ':id="toc" href="([^"]+)"'})
    number = F.col("p_partkey") % 4
    filled = urls.evaluate(urls.parse_template("http://b.example//{{brand}}/{id}/{page}"), {"brand": urls.encode(F.col("p_brand")), "id": k}, F.greatest(number, F.lit(1)))
    listed = urls.evaluate(urls.parse_template("<x,y>"), {}, number)
    return got.select("p_partkey", urls.undouble(urls.absolutize(F.lit("http://b.example/#top"), F.col("toc"))).alias("toc"), filled.alias("filled"), listed.alias("listed"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]+e\\.')) AS BIGINT) AS n, regexp_extract(text, '([A-Z])[a-z]', 1) AS first FROM documents")
def regex_delimiters(spark, sf):
    """Regex rules between slashes and behind a colon, one with doubled backslashes, one with a group."""
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.size(regexes.find_all(t, "/[a-z]+e\\./")).cast("long").alias("n"), lists.first(regexes.find_all(t, ":([A-Z])[a-z]")).alias("first"))


@query("SELECT event_id, concat(event_type, ',', user_id, ',', event_id, ',x') AS flat, 4 AS n FROM events")
def json_flat(spark, sf):
    """Nested arrays of an event's values, three deep, flattened."""
    doc = F.concat(F.lit('["'), F.col("event_type"), F.lit('", ["'), F.col("user_id").cast("string"), F.lit('", ["'), F.col("event_id").cast("string"), F.lit('"]], [["x"]]]'))
    got = json_paths.flat(F.from_json(doc, "array<string>"))
    return read(spark, sf, "events").select("event_id", F.array_join(got, ",").alias("flat"), F.size(got).alias("n"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE text END AS content, CASE WHEN doc_id % 2 = 0 THEN concat('T', doc_id) ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN concat('/p/', doc_id) WHEN 1 THEN concat('/q/', doc_id) ELSE '' END AS next_url,
       CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_images, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE strlen(replace(text, ' ', '')) END AS word_count, CASE WHEN doc_id % 5 <= 1 THEN 'comic' ELSE 'text' END AS mode FROM documents"""
)
def json_content_default(spark, sf):
    """Documents as JSON chapters under several names of their fields, with images or without."""
    k = F.col("doc_id")
    n = k.cast("string")
    some = lambda c, x: F.when(c, x)
    doc = F.to_json(
        F.struct(
            some(k % 4 == 0, F.col("text")).alias("content"),
            some(k % 4 == 1, F.col("text")).alias("body"),
            some(k % 4 == 2, F.col("text")).alias("text"),
            some(k % 2 == 0, F.concat(F.lit("T"), n)).alias("title"),
            some(k % 3 == 0, F.concat(F.lit("/p/"), n)).alias("nextUrl"),
            some(k % 3 < 2, F.concat(F.lit("/q/"), n)).alias("next"),
            F.array(F.lit(" "), F.lit("")).alias("images"),
            some(k % 5 == 0, F.array(F.lit("a.png"), F.lit(" "), F.lit("b.png"))).alias("imgs"),
            some(k % 5 == 1, F.array(F.lit("c.png"))).alias("pics"),
        )
    )
    got = json_paths.default_content(doc)
    return read(spark, sf, "documents").select("doc_id", got["content"].alias("content"), got["title"].alias("title"), got["next_url"].alias("next_url"), F.size(got["images"]).alias("n_images"), got["word_count"].alias("word_count"), got["mode"].alias("mode"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN (p_size % 10) / 2.0 WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 0 END AS rating, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size * 1000 END AS BIGINT) AS word_count,
       CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, '|', p_type) WHEN 1 THEN p_type WHEN 2 THEN concat(p_brand, '|x') ELSE '' END AS tags, ['image/jpeg', 'image/png', 'image/gif', 'image/svg+xml', 'image/webp'][1 + p_partkey % 5] AS kind FROM part"""
)
def json_detail_numbers(spark, sf):
    """Ratings, words and tags of details by the usual keys, and types of covers by their first bytes, else their names."""
    k = F.col("p_partkey")
    some = lambda c, x: F.when(c, x)
    doc = F.to_json(
        F.struct(
            (F.col("p_size") % 10 / 2.0).alias("rating"),
            some(k % 2 == 0, F.lit("1.5")).alias("score"),
            some(k % 3 == 1, F.col("p_size") * 1000).alias("wordCount"),
            some(k % 3 == 2, F.struct((F.col("p_size") * 1000).cast("string").alias("wordCount"))).alias("book"),
            some(k % 3 == 0, F.lit("many")).alias("size"),
            some(k % 4 == 1, F.array("p_type", F.lit(""))).alias("tag"),
        )
    )
    tagged = F.when(k % 4 == 0, F.concat(F.lit(',"tags":["'), F.col("p_brand"), F.lit('","'), F.col("p_type"), F.lit('"]}'))).when(k % 4 == 2, F.concat(F.lit(',"tags":" '), F.col("p_brand"), F.lit(', ,x"}'))).otherwise("}")
    got = json_paths.default_numbers(F.concat(F.regexp_replace(doc, r"\}$", ""), tagged))
    marks = ["FFD8FFE000", "89504E470D0A", "474946383961", "3C73766720786D6C", "52494646"]
    kind = text.image_type_of(F.unhex(F.get(F.array(*map(F.lit, marks)), (k % 5).cast("int"))), F.when(k % 5 == 4, "x.webp").otherwise("x.bin"))
    return read(spark, sf, "part").select("p_partkey", got["rating"].alias("rating"), got["word_count"].alias("word_count"), F.array_join(got["tags"], "|").alias("tags"), kind.alias("kind"))


@query(
    """SELECT p_partkey, ['css', 'json', 'chain', 'xpath', 'json', 'js', NULL][1 + p_partkey % 7] AS mode, CASE p_partkey % 7 WHEN 6 THEN NULL WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS n_parts, ['&&', '||,&&', '', '', '', '', NULL][1 + p_partkey % 7] AS ops,
       ['', '', '', '', 'name', '', NULL][1 + p_partkey % 7] AS puts, ['', '', '', '', concat('size', p_size), '', NULL][1 + p_partkey % 7] AS gets, [0, 0, 2, 0, 0, 0, NULL][1 + p_partkey % 7] AS n_replaces, [0, 0, 0, 0, 0, 1, NULL][1 + p_partkey % 7] AS n_expressions,
       p_partkey % 7 = 2 AS chain, p_partkey % 7 = 5 AS script FROM part"""
)
def rule_inspection(spark, sf):
    """What the rules of parts are made of: modes, parts and operators, bindings, replacements, expressions; every seventh is blank."""
    n = F.col("p_size").cast("string")
    rules = [F.concat(F.lit("@css:li.c"), n, F.lit(" a@href && .b[title='a||b']@text")), F.concat(F.lit("$.data.l"), n, F.lit("||$.items&&$.rows[?(@.a)]")), F.concat(F.lit("tag.li!0@tag.a@text##[0-9]+##x##y"), n), F.concat(F.lit('//div[@id="p'), n, F.lit('"]/text()')), F.concat(F.lit("@put:{name}$.title@get:{size"), n, F.lit("}")), F.concat(F.lit("@js:result + {{key"), n, F.lit("}}")), F.lit(" ")]
    rows = read(spark, sf, "part").select("p_partkey", F.get(F.array(*rules), (F.col("p_partkey") % 7).cast("int")).alias("rule"))
    got = rules_.inspected(rows, "rule")
    joined = lambda c: F.array_join(f"said.{c}", ",").alias(c)
    flag = lambda c: F.coalesce(f"said.{c}", F.lit(False)).alias(c)
    return got.select("p_partkey", "said.mode", F.col("said.parts").cast("int").alias("n_parts"), joined("ops"), joined("puts"), joined("gets"), F.col("said.replaces").cast("int").alias("n_replaces"), F.col("said.expressions").cast("int").alias("n_expressions"), flag("chain"), flag("script"))
