"""Further queries: JSON list pages, variables, headers, membership, page look-ups, local book lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import dom, extract, json_paths, text
from leafmill.operators import books, tables
from leafmill.plans.registry import block, query, read
from leafmill.sources import feeds, files


def _list_pages(spark, sf):
    """JSON list pages of each brand: its parts of a block of ids under data.list, with the usual names."""
    row = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.concat(F.lit("/b/"), F.col("p_partkey").cast("string")).alias("bookUrl")))
    docs = read(spark, sf, "part").select("p_brand", F.struct("p_partkey", row.alias("j")).alias("r")).groupBy("p_brand", block(F.col("r.p_partkey"))).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["j"]), ",").alias("rows"))
    return docs.select("p_brand", F.concat(F.lit('{"code": 0, "data": {"list": ['), F.col("rows"), F.lit("]}}")).alias("doc"))


_PART = "SELECT p_brand, p_name AS name, p_type AS author, concat('/b/', p_partkey) AS url FROM part"


@query(_PART)
def json_list_default(spark, sf):
    rows = _list_pages(spark, sf).select("p_brand", F.explode(json_paths.default_items(F.col("doc"))).alias("item"))
    book = json_paths.default_book(F.col("item"))
    return rows.select("p_brand", *[book[k].alias(k) for k in ("name", "author", "url")]).where("name <> ''")


@query(_PART)
def json_list_rules(spark, sf):
    return books.list_page(_list_pages(spark, sf).withColumn("base", F.lit("")), {"list": "$.data.list", "name": "$.title", "author": "$.author", "url": "$.bookUrl"}, "doc", "base").select("p_brand", "name", "author", "url")


_H1 = "trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_H1} AS name, {_H1} AS again, concat({_H1}, ' (', length({_H1}), ')') AS label FROM pages")
def rule_variables(spark, sf):
    rules = {"name": "@put:{title}@css:article h1@text", "again": "@get:{title}", "label": "{{name}} ({{name.length}})"}
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", rules).drop("html")


@query("SELECT page_id, regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1) AS link FROM pages")
def first_part_only(spark, sf):
    got = extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"link": "@xpath://nav//a/@href || //h1"}, first_only=True)
    return got.select("page_id", "link")


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('b', p_size) ELSE 'a' END AS agent, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS cookie, CASE WHEN p_partkey % 5 = 0 THEN 'last' ELSE '*' END AS accept, CASE WHEN p_partkey % 3 = 1 THEN 3 ELSE 2 END AS n_headers FROM part"
)
def merged_headers(spark, sf):
    """Headers of all requests, of a source (some malformed) and of one request, the last of which wins."""
    m = F.col("p_partkey") % 3
    said = F.when(m == 0, F.concat(F.lit('{"User-Agent": "b'), F.col("p_size").cast("string"), F.lit('"}'))).when(m == 1, F.concat(F.lit('{"Cookie": "'), F.col("p_brand"), F.lit('"}'))).otherwise("{broken")
    last = F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("Accept"), F.lit("last"))).otherwise(F.create_map().cast("map<string,string>"))
    got = text.merge_headers(F.create_map(F.lit("User-Agent"), F.lit("a"), F.lit("Accept"), F.lit("*")), text.headers(said), last)
    return read(spark, sf, "part").select("p_partkey", got["User-Agent"].alias("agent"), got["Cookie"].alias("cookie"), got["Accept"].alias("accept"), F.size(got).alias("n_headers"))


@query("SELECT p_partkey, p_partkey % 7 IN (0, 1, 2) AS ok FROM part")
def isbn_shapes(spark, sf):
    """Thirteen digits with dashes, ten without, ten with an X; one digit less, one more, a letter inside, none."""
    k = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    shapes = [F.concat(F.lit("978-0"), k), F.concat(k, F.lit("1")), F.concat(k, F.lit("-X")), k, F.concat(k, F.lit("12")), F.concat(F.lit("x"), k), F.lit("")]
    return read(spark, sf, "part").select("p_partkey", text.is_isbn(F.get(F.array(*shapes), (F.col("p_partkey") % 7).cast("int"))).alias("ok"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS on_shelf FROM customer")
def shelf_membership(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    on = c.join(o, "c_custkey", "left_semi").withColumn("on_shelf", F.lit(True))
    return on.unionByName(c.join(o, "c_custkey", "left_anti").withColumn("on_shelf", F.lit(False)))


@query("SELECT page_id, page_id % 3 <> 0 AS found FROM pages")
def page_lookup(spark, sf):
    pages = read(spark, sf, "pages")
    asked = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "http://nowhere.example/").otherwise(F.col("url")).alias("url"))
    return books.fetch(asked, pages).select("page_id", "found")


@query("SELECT source, count(*) AS n_books, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents GROUP BY source")
def local_book_list(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_books"), F.sum(F.octet_length("text")).alias("size"))


@query("SELECT coalesce(nullif(trim(source), ''), '-') AS source, count(*) FILTER (quality = 1) AS read_, count(*) FILTER (toxic = 1) AS starred FROM documents JOIN labels USING (doc_id) GROUP BY 1".replace("read_", "n_read"))
def feed_flags(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return j.groupBy(F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("-")).alias("source")).agg(F.count_if(F.col("quality") == 1).alias("n_read"), F.count_if(F.col("toxic") == 1).alias("starred"))


_ALLOWED = "|".join(sorted(dom.ALLOWED, key=lambda t: (-len(t), t)))
_ENDS = "article|aside|footer|section|header|nav|main|div|p|ul|ol|h[1-6]|table|form|blockquote|figure|pre|body"
#: The pages' unclosed bold paragraphs are closed, code and comments go, allowed tags lose their attributes, others go, texts are escaped anew.
_MARKED = f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br>(\\s*</?(?:{_ENDS}))', '<br></b></p>\\1', 'g'), '(?s)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<(/?)({_ALLOWED})(\\s[^>]*)?>', chr(2) || '\\1\\2' || chr(3), 'g'), '<[^>]*>', '', 'g') AS h FROM pages"""
_SAID = "replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160))"


@query(f"SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace({_SAID}, '&(lt|gt|amp);?', chr(4) || '\\1;', 'g'), '&', '&amp;', 'g'), chr(4), '&'), chr(2), '<'), chr(3), '>') AS html_clean FROM ({_MARKED})")
def whitelisted_html(spark, sf):
    return extract.whitelisted(read(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "html_clean")


@query("SELECT (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS enabled, (SELECT count(*) FROM orders) AS books, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished")
def dashboard(spark, sf):
    s = tables.counts(read(spark, sf, "supplier"), enabled=F.col("s_acctbal") > 0).withColumnRenamed("total", "sources")
    b = tables.counts(read(spark, sf, "orders"), finished=F.col("o_orderstatus") == "F").withColumnRenamed("total", "books")
    return s.join(b)


# ---- JSON details, contents and feeds; conversions ----

_DETAIL = "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS author, concat('/b/', p_partkey) AS url, p_brand AS category FROM part"


@query(_DETAIL)
def json_detail_default(spark, sf):
    """Book details by the usual keys, plain or inside a book."""
    p = read(spark, sf, "part")
    plain = F.to_json(F.struct(F.col("p_name").alias("bookName"), F.col("p_type").alias("authorName"), F.concat(F.lit("/b/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_brand").alias("genre")))
    inner = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.lit("").alias("author"), F.concat(F.lit("/b/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_brand").alias("category")).alias("book")))
    got = json_paths.default_detail(F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(inner))
    return p.select("p_partkey", *[got[k].alias(k) for k in ("name", "author", "url", "category")])


@query("SELECT p_partkey, p_name AS name, concat(p_brand, '/', p_partkey) AS url, CASE WHEN p_size > 20 THEN p_type ELSE p_brand END AS category FROM part")
def json_detail_rules(spark, sf):
    """Book details by rules: a path, a template, and fall-backs."""
    doc = F.to_json(F.struct(F.struct("p_name", "p_brand", "p_partkey", F.when(F.col("p_size") > 20, F.col("p_type")).alias("big")).alias("data")))
    got = json_paths.fields(doc, {"name": "$.data.p_name", "url": "{{$.data.p_brand}}/{{$.data.p_partkey}}", "category": "$.data.big&&$.data.p_brand"})
    return read(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in got.items()])


_TOC = "SELECT o_orderkey, CAST(i AS INTEGER) AS idx, concat('T', i, '-', o_custkey) AS title, concat('/c/', o_orderkey, '/', i) AS chapter_url FROM orders, range(4) r(i) WHERE i <> 2"


def _contents(spark, sf):
    k = F.col("o_orderkey").cast("string")
    row = lambda i: F.concat(F.lit('{"name": "' + ("" if i == 2 else f"T{i}-")), F.lit("") if i == 2 else F.col("o_custkey").cast("string"), F.lit('", "link": "/c/'), k, F.lit(f'/{i}"}}'))
    rows = F.concat(F.lit("["), F.concat_ws(",", *[row(i) for i in range(4)]), F.lit("]"))
    wrapped = F.when(F.col("o_orderkey") % 3 == 0, rows).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"toc": '), rows, F.lit("}"))).otherwise(F.concat(F.lit('{"volume": {"chapters": '), rows, F.lit("}}")))
    return read(spark, sf, "orders").select("o_orderkey", wrapped.alias("doc"), F.concat(F.lit('{"none": [], "a": {"b": '), rows, F.lit("}}")).alias("ruled"))


@query(_TOC)
def json_chapters_default(spark, sf):
    return books.json_chapters(_contents(spark, sf).drop("ruled"), "doc")


@query(_TOC)
def json_chapters_rules(spark, sf):
    return books.json_chapters(_contents(spark, sf).drop("doc"), "ruled", {"list": "$.none&&$.a.b", "title": "$.title&&$.name", "url": "$.link"})


@query("SELECT event_id, CAST(0 AS INTEGER) AS pos, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat('http://f.example/e/', event_id) END AS title, concat('http://f.example/e/', event_id) AS link, concat('u', user_id) AS author FROM events")
def json_feed(spark, sf):
    """JSON feeds of one article and one without title and link."""
    doc = F.concat(F.lit('{"posts": [{"t": "'), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""), F.lit('", "u": "/e/'), F.col("event_id").cast("string"), F.lit('", "by": "u'), F.col("user_id").cast("string"), F.lit('"}, {"t": "", "by": "x"}]}'))
    rows = read(spark, sf, "events").select("event_id", doc.alias("body"), F.lit("http://f.example/feed").alias("url"))
    return feeds.json_items(rows, {"list": "$.items&&$.posts", "title": "$.t", "link": "$.u", "author": "$.by"}).select("event_id", "pos", "title", "link", "author")


_RULED = ["@css:li", "//li", "$.data.list", ":<li>(.*?)</li>", "li a"]


@query(
    "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN concat('old ', s_name) ELSE concat('s', s_suppkey, '.example') END AS name, concat('https://www.s', s_suppkey, '.example/x') AS base_url, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey ELSE s_nationkey + 100 END AS \"order\", ['css', 'xpath', 'jsonpath', 'regex', 'default'][1 + s_suppkey % 5] AS search_mode, concat('author:.a', s_suppkey, '&&name:h1') AS info_rule, CASE WHEN s_suppkey % 2 = 0 THEN concat('<css>li@a@b', s_suppkey) ELSE concat('<xpath>//p', s_suppkey) END AS toc_rule FROM supplier".replace(
        "CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey ELSE s_nationkey + 100 END", "CASE WHEN s_suppkey % 4 = 0 AND s_nationkey > 0 THEN s_nationkey ELSE s_nationkey + 100 END"
    )
)
def source_conversion(spark, sf):
    """Suppliers as sources of an older kind: names, orders, modes and rules that must be told from what is there."""
    k, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    text_of = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.lit(1 << 20))
    doc = F.to_json(
        F.struct(
            F.when(m % 3 == 0, F.col("s_name")).otherwise("  ").alias("bookSourceName"),
            F.when(m % 3 == 1, F.concat(F.lit(" old "), F.col("s_name"))).alias("name"),
            F.concat(F.lit("https://www.s"), k, F.lit(".example/x")).alias("bookSourceUrl"),
            F.when(m % 4 == 0, F.col("s_nationkey")).otherwise(0).alias("weight"),
            (F.col("s_nationkey") + 100).alias("customOrder"),
            F.element_at(F.array(*map(F.lit, _RULED)), (m % 5 + 1).cast("int")).alias("ruleSearch"),
            F.struct(F.lit("h1").alias("name"), F.concat(F.lit(".a"), k).alias("author")).alias("ruleBookInfo"),
            F.when(m % 2 == 1, F.struct(F.lit("xpath").alias("type"), F.concat(F.lit("//p"), k).alias("rule"))).alias("ruleToc"),
        )
    )
    listed = F.concat(F.regexp_replace(doc, r"\}$", ""), F.lit(',"ruleToc":[{"type":"css","rule":"li"},"a","b'), k, F.lit('"]}'))
    got = files.converted(F.when(m % 2 == 0, listed).otherwise(doc))
    return read(spark, sf, "supplier").select("s_suppkey", *[got[c].alias(c) for c in ("name", "base_url", "order", "search_mode", "info_rule", "toc_rule")])


# ---- flows in one call, home pages, uploads, views ----

_LINKS = "SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1) AS hrefs, [trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)] AS texts FROM pages"


def _catalogue(spark, sf):
    """Every page as a source: its search page lists one book, whose details and contents are the page itself."""
    pages = read(spark, sf, "pages")
    k = F.col("page_id").cast("string")
    found = pages.select(F.concat(F.lit("http://s.example/q/"), k).alias("url"), F.concat(F.lit('<ul class="r"><li><a href="/d/'), k, F.lit('">T'), k, F.lit("</a></li></ul>")).alias("html"))
    detail = pages.select(F.concat(F.lit("http://s.example/d/"), k).alias("url"), "html")
    sources = pages.select(F.col("page_id").alias("id"), F.lit("http://s.example/").alias("base_url"), F.concat(F.lit("http://s.example/{{key}}/"), k).alias("search_url"), (F.col("page_id") % 7 != 0).alias("enabled"), F.col("page_id").alias("order"))
    return sources, found.unionByName(detail)


_SEARCH = {"list": "@css:ul.r li", "name": "tag.a@text", "author": "@css:none@text", "url": "tag.a@href"}


@query(f"SELECT {_H1.replace('html', 'p.html')} AS book, CAST(i - 1 AS BIGINT) AS idx, texts[i] AS title, concat('http://s.example', hrefs[i]) AS chapter_url FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM ({_LINKS})) n JOIN pages p USING (page_id) WHERE texts[i] <> '' AND page_id = (SELECT max(page_id) FROM pages WHERE page_id % 7 <> 0)")
def search_in_full(spark, sf):
    """Search, the first book's details and its contents in one call."""
    sources, pages = _catalogue(spark, sf)
    info, toc = books.first_in_full(sources, pages, _SEARCH, {"name": "@css:article h1@text"}, {"list": "tag.nav@tag.li", "title": "tag.a@text", "url": "tag.a@href"}, "q")
    return toc.select(F.col("name").alias("book"), F.col("idx").cast("long").alias("idx"), "title", "chapter_url")


@query("SELECT page_id AS source_id, concat('T', page_id) AS name, concat('http://s.example/d/', page_id) AS url FROM pages WHERE page_id = 8")
def search_single_source(spark, sf):
    sources, pages = _catalogue(spark, sf)
    return books.search_one(sources, pages, _SEARCH, "q", 8).select("source_id", "name", "url")


@query(f"SELECT page_id AS source_id, texts[i] AS name FROM (SELECT page_id, [x for x in texts if x <> ''] AS texts, unnest([3, 4]) AS i FROM ({_LINKS})) WHERE i <= len(texts)")
def explore_home(spark, sf):
    """The second two books of every source's home page."""
    pages = read(spark, sf, "pages")
    at = F.concat(F.lit("h.example/"), F.col("page_id").cast("string"))
    sources = pages.select(F.col("page_id").alias("id"), at.alias("base_url"))
    home = pages.select(F.concat(F.lit("https://"), at).alias("url"), "html")
    return books.explore_home(sources, home, {"list": "@css:nav li", "name": "tag.a@text"}, 2, 2).select("source_id", "name")


def _uploads(lines: str) -> str:
    def good(t: str) -> str:
        odd = " OR ".join(f"contains(lower({t}), '{w}')" for w in text.UPLOAD_SUSPICIOUS)
        return f"NOT ({odd}) AND strlen({t}) BETWEEN 2 AND 80"

    def case(pattern: str) -> str:
        title = f"coalesce(nullif(trim(regexp_extract(x, '{pattern}', 1)), ''), x)"
        return f"WHEN regexp_matches(x, '{pattern}') AND {good(title)} THEN {title}"

    titled = f"SELECT *, CASE WHEN strlen(x) BETWEEN 2 AND 100 THEN CASE {' '.join(case(p) for _, p, _ in text.UPLOAD_RULES)} END END AS title FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM ({lines}))"
    numbered = f"SELECT *, count(title) OVER (PARTITION BY conv_id ORDER BY line_no) AS n FROM ({titled})"
    return f"SELECT conv_id, n - 1 AS idx, max(title) AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (title IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS content FROM ({numbered}) WHERE n > 0 GROUP BY conv_id, n"


_BOOKS = "SELECT conv_id, string_agg(concat(CASE turn % 4 WHEN 0 THEN concat('  第', turn + 1, '章 ', role) WHEN 1 THEN concat('Chapter ', turn) WHEN 2 THEN concat(turn, '. contents') ELSE concat('(', turn, ') part ', turn) END, chr(10), text), chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id"


@query(_uploads(f"SELECT conv_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT conv_id, string_split(body, chr(10)) AS l FROM ({_BOOKS}))"))
def upload_chapters(spark, sf):
    """Conversations as uploaded texts whose turns have titles of several kinds, one of them suspicious."""
    t = F.col("turn").cast("string")
    head = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  第"), (F.col("turn") + 1).cast("string"), F.lit("章 "), "role")).when(F.col("turn") % 4 == 1, F.concat(F.lit("Chapter "), t)).when(F.col("turn") % 4 == 2, F.concat(t, F.lit(". contents"))).otherwise(F.concat(F.lit("("), t, F.lit(") part "), t))
    turns = read(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", "text", F.concat(head, F.lit("\n"), "text").alias("said")).alias("r"))
    made = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["said"]), "\n").alias("body"))
    return books.upload_chapters(made, "conv_id", "body")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS pos FROM orders QUALIFY pos < 6")
def recently_added(spark, sf):
    return tables.ranked(read(spark, sf, "orders"), 6, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "pos")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_type = 'ECONOMY'")
def rule_filter(spark, sf):
    """Replace rules by name or pattern, and scope."""
    rules = read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("pattern"), F.col("p_type").alias("scope"))
    return rules.where(tables.search_text("RING", "name", "pattern") & (F.col("scope") == "ECONOMY")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'web') OR contains(lower(lang), 'web') OR contains(CASE WHEN doc_id % 2 = 0 THEN 'epub' ELSE 'webtxt' END, 'web')")
def book_filter(spark, sf):
    """Local books by name, author or format."""
    rows = read(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.coalesce("lang", F.lit("")).alias("author"), F.when(F.col("doc_id") % 2 == 0, "epub").otherwise("webtxt").alias("format"))
    return rows.where(tables.search_text("Web", "name", "author", "format")).select("doc_id")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('k', p_partkey) WHEN 1 THEN concat(p_brand, '::/b/', p_partkey) ELSE concat('id', p_partkey) END AS book_id, p_name AS book_name, CASE WHEN p_size > 20 THEN p_type ELSE '未知作者' END AS author, CASE WHEN p_partkey % 3 = 1 THEN concat('/b/', p_partkey) WHEN p_partkey % 3 = 0 THEN concat('k', p_partkey) ELSE concat('id', p_partkey) END AS book_url, CASE WHEN p_partkey % 3 = 1 THEN '未知来源' ELSE p_brand END AS source_name FROM part")
def stream_results(spark, sf):
    """Results of a streaming search with the fall-backs of their names."""
    m, k = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    rows = read(spark, sf, "part").select("p_partkey", F.when(m == 0, F.concat(F.lit("k"), k)).alias("bookKey"), F.when(m == 1, F.col("p_brand")).alias("sourceId"), F.when(m == 1, F.concat(F.lit("/b/"), k)).alias("bookUrl"), F.concat(F.lit("id"), k).alias("bookId"), F.lit("").alias("bookName"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("author"), F.lit(None).cast("string").alias("sourceName"), F.when(m != 1, F.col("p_brand")).alias("source"))
    return tables.stream_results(rows).select("p_partkey", "book_id", "book_name", "author", "book_url", "source_name")
