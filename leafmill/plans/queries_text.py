"""Queries of the text, URL and expression functions, and of local texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import expressions, regexes, text, urls
from leafmill.operators import books
from leafmill.plans.registry import query, read
from leafmill.sources import files

_RULES = [
    {"id": 1, "pattern": "[0-9]+", "replacement": "#", "scope": "all", "order": 1},
    {"id": 2, "pattern": "the", "replacement": "THE", "scope": "content", "order": 3, "case_insensitive": True},
    {"id": 3, "pattern": "([a-z])ing", "replacement": "$1ed", "scope": "content", "order": 2},
    {"id": 4, "pattern": "a", "replacement": "b", "scope": "title", "order": 9},
    {"id": 5, "pattern": "e", "replacement": "f", "scope": "all", "order": 8, "enabled": False},
]


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the', 'THE', 'g'), '([a-z])ing', '\\1ed', 'g'), '[0-9]+', '#', 'g')) AS h FROM documents")
def replace_rules_scoped(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.apply_rules(F.col("text"), _RULES, "content")).alias("h"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def collapse_blanks(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("h"))


_BLANK = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _cleaned(t: str) -> str:
    lines = f"array_to_string([regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g') for x in string_split({t}, chr(10))], chr(10))"
    return f"regexp_replace(regexp_replace({lines}, '\\n{{4,}}', repeat(chr(10), 3), 'g'), '^\\n+|\\n+$', '', 'g')"


_ROUND = "concat('  ', repeat(chr(10), 4), text, ' ', chr(10), ' ', chr(10))"


@query(f"SELECT doc_id, {_cleaned(_ROUND)} AS lines, {_cleaned(f"""regexp_replace(regexp_replace({_ROUND}, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{3000}}]+', ' ', 'g')""")} AS plain FROM documents")
def clean_lines(spark, sf):
    t = F.concat(F.lit("  \n\n\n\n"), F.col("text"), F.lit(" \n \n"))
    return read(spark, sf, "documents").select("doc_id", text.clean_lines(t).alias("lines"), text.clean_plain(t).alias("plain"))


@query("SELECT doc_id, base64(CAST(encode(text) AS BLOB)) AS b64, md5(text) AS h, true AS same FROM documents")
def base64_md5(spark, sf):
    b = text.base64(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", b.alias("b64"), F.md5(F.encode("text", "UTF-8")).alias("h"), (text.base64_decode(b) == F.col("text")).alias("same"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^a-zA-Z0-9.,!?;:]', '', 'g')) AS BIGINT) AS n_chars_counted, CAST(strlen(replace(text, ' ', '')) AS BIGINT) AS n_bytes FROM documents")
def char_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.count_chars(F.col("text")).cast("long").alias("n_chars_counted"), text.count_bytes(F.col("text")).cast("long").alias("n_bytes"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS id, concat(source, '::/d/', doc_id) AS book_key, source AS source_id, concat('/d/', doc_id) AS url FROM documents")
def content_ids(spark, sf):
    key = text.book_key(F.col("source"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    return read(spark, sf, "documents").select("doc_id", text.content_id(F.encode("text", "UTF-8")).alias("id"), key.alias("book_key"), F.get(text.split_key(key), F.lit(0)).alias("source_id"), F.get(text.split_key(key), F.lit(1)).alias("url"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS t1, CAST(epoch(o_orderdate) AS BIGINT) AS t2, CAST(epoch(o_orderdate) AS BIGINT) AS t3, CAST(NULL AS BIGINT) AS t4 FROM orders")
def parse_times(spark, sf):
    d = F.col("o_orderdate")
    said = {"t1": F.date_format(d, "yyyy-MM-dd"), "t2": F.concat(F.lit("Mon, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), "t3": F.date_format(d, "yyyy年M月d日"), "t4": F.lit("soon")}
    return read(spark, sf, "orders").select("o_orderkey", *[F.unix_timestamp(text.parse_time(v)).alias(k) for k, v in said.items()])


@query(
    "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS day_first, CAST(epoch(CASE WHEN day(o_orderdate) > 12 THEN o_orderdate ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END) AS BIGINT) AS month_first, CAST(epoch(o_orderdate) AS BIGINT) AS named, CAST(epoch(o_orderdate) AS BIGINT) AS mailed, CAST(NULL AS BIGINT) AS none FROM orders"
)
def parse_page_times(spark, sf):
    """Dates of list pages: a day stands before its month where both readings are possible."""
    d = F.col("o_orderdate")
    said = {"day_first": F.date_format(d, "dd/MM/yyyy"), "month_first": F.date_format(d, "MM/dd/yyyy"), "named": F.date_format(d, "MMMM dd, yyyy"), "mailed": F.concat(F.lit("Tue, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), "none": F.date_format(d, "yyyy.MM.dd")}
    return read(spark, sf, "orders").select("o_orderkey", *[F.unix_timestamp(text.parse_time(v, text.PAGE_TIME_FORMATS)).alias(k) for k, v in said.items()])


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) * 10000 AS in_units, p_retailprice AS plain FROM part")
def parse_numbers(spark, sf):
    said = F.col("p_retailprice").cast("string")
    return read(spark, sf, "part").select("p_partkey", text.number(F.concat(said, F.lit("万字"))).alias("in_units"), text.number(F.concat(F.lit("about "), said)).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 1.0 WHEN contains(replace(p_name, ' ', ''), 'smallring') OR contains('smallring', replace(p_name, ' ', '')) THEN 0.88 ELSE jaccard(replace(p_name, ' ', ''), 'smallring') END AS score FROM part")
def title_scores(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.title_similarity(F.col("p_name"), F.lit("Small  Ring")).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round((l + 1) / 8.0 * 100) ELSE 0 END AS pct FROM (SELECT *, o_orderkey % 8 AS l FROM orders)")
def progress_percent(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.percent(F.col("o_orderkey") % 8, F.lit(8)).alias("pct"))


@query("SELECT page_id, concat('cover_', page_id, CASE WHEN page_id % 2 = 0 THEN '.JPG' ELSE '.txt' END) AS name, page_id % 2 = 0 AS is_image, CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS kind, concat('cover_', page_id, CASE WHEN page_id % 2 = 0 THEN '.JPG' ELSE '' END) AS book FROM pages")
def file_names(spark, sf):
    name = F.concat(F.lit("cover_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".JPG").otherwise(".txt"))
    return read(spark, sf, "pages").select("page_id", name.alias("name"), text.is_image(name).alias("is_image"), text.image_type(name).alias("kind"), text.book_name(F.concat(F.lit("/a/"), name)).alias("book"))


_NAMES = ["免费", "小说", "TXT ", "全本小说", "完整版", "【完结】", "book "]


@query(
    f"SELECT page_id, trim(regexp_replace(concat({_NAMES}[1 + page_id % 7], 'Sea', page_id), '^(小说|txt|全本小说|完整版|免费)', '', 'i')) AS book, trim(replace(concat({_NAMES}[1 + page_id % 7], 'Sea', page_id, CASE WHEN page_id % 2 = 0 THEN '(完结)' ELSE '【精校】' END), '【完结】', '').replace('(完结)', '').replace('【精校】', '')) AS upload, concat('a', page_id, '.epub') AS other FROM pages"
)
def book_names(spark, sf):
    """Names of texts and of uploads from their paths."""
    begun = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 7 + 1).cast("int")), F.lit("Sea"), F.col("page_id").cast("string"))
    tagged = F.concat(F.lit("/up/"), begun, F.when(F.col("page_id") % 2 == 0, "(完结)").otherwise("【精校】"), F.lit(".txt"))
    other = F.concat(F.lit("C:\\b\\a"), F.col("page_id").cast("string"), F.lit(".epub"))
    return read(spark, sf, "pages").select("page_id", text.book_name(F.concat(F.lit("/x/"), begun, F.lit(".TXT"))).alias("book"), text.upload_name(tagged).alias("upload"), text.book_name(other).alias("other"))


@query("SELECT p, CAST(row_number() OVER (ORDER BY length(CAST(p AS VARCHAR)), p) AS BIGINT) AS pos FROM (SELECT DISTINCT page_id AS p FROM pages)")
def natural_order(spark, sf):
    from leafmill.operators import tables

    names = read(spark, sf, "pages").select(F.col("page_id").alias("p")).distinct().withColumn("name", F.concat(F.lit("img"), F.col("p").cast("string"), F.lit(".png")))
    return tables.numbered(names, text.natural_key(F.col("name"))).select("p", (F.col("pos") + 1).alias("pos"))


# ---- URLs ----


@query("SELECT page_id, concat('https://x.example/s/', replace(url_encode(title), '%20', '+'), '?p=', ['a', 'b', 'c'][least(greatest(page_id % 5, 1), 3)]) AS url FROM (SELECT page_id, regexp_extract(url, '[^/]+$') AS title FROM pages)")
def url_templates(spark, sf):
    t = urls.parse_template("https://x.example//s/{{key}}?p=<a,b,c>,{'method': 'post', body: 'q={{key}}'}")
    last = F.regexp_extract("url", "[^/]+$", 0)
    return read(spark, sf, "pages").select("page_id", urls.evaluate(t, {"key": urls.encode(last)}, (F.col("page_id") % 5).cast("int")).alias("url"))


@query("SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/next') AS abs, concat(rtrim(split_part(url, '#', 1), '/'), '/next') AS rel, url AS same FROM pages")
def url_absolute(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", urls.join_loose(u, F.lit("/next")).alias("abs"), urls.absolutize(u, F.lit("next")).alias("rel"), urls.absolutize(F.lit("http://x"), u).alias("same"))


@query("SELECT page_id, concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/a/b') AS resolved FROM pages")
def url_resolve(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.resolve(F.col("url"), F.lit("/a/x/../b")).alias("resolved"))


@query("SELECT page_id, url AS undoubled, true AS is_http, true AS allowed, false AS local_allowed, url AS first FROM pages")
def url_checks(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", urls.undouble(F.concat(F.lit("http://dup.example/"), u)).alias("undoubled"), urls.is_http(u).alias("is_http"), urls.is_allowed(u).alias("allowed"), urls.is_allowed(F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"))).alias("local_allowed"), urls.first_http(F.lit("ftp://x"), F.lit(None), u).alias("first"))


@query("SELECT c_custkey, concat('/r/', c_nationkey % 5) AS url, concat('R', c_nationkey % 5) AS tab FROM customer")
def explore_tabs(spark, sf):
    tabs = F.concat_ws("\n", F.array(*[F.lit(f"R{k}::/r/{k}") for k in range(5)]), F.lit("none::"))
    got = urls.choose_tab(urls.explore_tabs(tabs), F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")))
    return read(spark, sf, "customer").select("c_custkey", got["url"].alias("url"), got["title"].alias("tab"))


_MARKS = ["React", "vue", "angular", "next.js", "nuxt", "window.__INITIAL_STATE__", "window.__data", "window.__app", "#app", "#root", "[data-reactroot]", "<noscript>", "<noscript class=a>", '<div id="app">', "__NEXT_DATA__", "webview"]


@query(
    rf"SELECT page_id, octet_length(encode(body)) < 5000 AND len(regexp_extract_all(lower(body), '<script')) > 5 OR regexp_matches(lower(body), 'react|vue|angular|next\.js|nuxt|window\.__(initial|data|app)|#app|#root|\[data-reactroot\]|<noscript>') AS needs, true AS asked FROM (SELECT page_id, concat(html, CASE WHEN page_id % 3 = 0 THEN list_value({', '.join(repr(m) for m in _MARKS)})[1 + page_id % 16] ELSE '' END) AS body FROM pages)"
)
def browser_needed(spark, sf):
    marks = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("page_id") % 16 + 1).cast("int"))
    body = F.concat(F.col("html"), F.when(F.col("page_id") % 3 == 0, marks).otherwise(""))
    return read(spark, sf, "pages").select("page_id", urls.needs_browser(F.col("url"), body).alias("needs"), urls.needs_browser(F.concat("url", F.lit("#webView")), F.lit("")).alias("asked"))


@query(
    "SELECT p_partkey, concat('https://x.example/s/', replace(url_encode(p_name), '%20', '+'), '/', least(greatest(p_size, 1), 9)) AS found, concat('https://x.example/toc/', p_partkey, '/1') AS toc, concat('https://x.example/base/b', p_partkey) AS plain, CASE WHEN p_size % 4 BETWEEN 1 AND 3 THEN ['first', 'second', 'third'][p_size % 4] ELSE 'first' END AS tab, concat('http://a/b/c', p_partkey, '/') AS slashes FROM part"
)
def source_urls(spark, sf):
    """URLs of searches, contents and tabs from a source's templates."""
    base = F.lit("https://x.example/base/#about")
    k, page = F.col("p_partkey").cast("string"), F.least(F.greatest(F.col("p_size"), F.lit(1)), F.lit(9)).cast("int")
    tabs = urls.parse_template("<first, second, third>")
    return read(spark, sf, "part").select(
        "p_partkey",
        urls.search_url("https://x.example//s/{{key}}/{page},{'method': 'post', body: 'q={{key}}'}", base, F.col("p_name"), page).alias("found"),
        urls.source_url("https://x.example/toc/{{bookUrl}}/{page}", base, k).alias("toc"),
        urls.source_url("", base, F.concat(F.lit("b"), k)).alias("plain"),
        urls.evaluate(tabs, {}, (F.col("p_size") % 4).cast("int"), beyond="first").alias("tab"),
        urls.single_slashes(F.concat(F.lit("http://a//b///c"), k, F.lit("//"))).alias("slashes"),
    )


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'thecustomer' ELSE concat('part', o_custkey) END AS normal, CAST(o_custkey // 3 AS INTEGER) AS words, CAST(o_custkey // 2 AS INTEGER) AS words2 FROM orders")
def chapter_titles(spark, sf):
    """Titles without their numbers and blanks, and words from byte spans."""
    said = F.when(F.col("o_orderkey") % 3 == 0, "  第十二章： The Customer ").otherwise(F.concat(F.lit("第"), F.col("o_orderkey").cast("string"), F.lit("章 Part　"), F.col("o_custkey").cast("string")))
    start = F.col("o_orderkey").cast("long")
    return read(spark, sf, "orders").select("o_orderkey", text.normal_title(said).alias("normal"), text.span_words(start, start + F.col("o_custkey")).alias("words"), text.span_words(start, start + F.col("o_custkey"), 2).alias("words2"))


# ---- expressions ----


@query("SELECT p_partkey, concat(p_name, '/', CAST(p_size * 2 + 1 AS VARCHAR), '/', length(p_brand), '/', md5(p_name), '/', CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END) AS filled FROM part")
def expression_templates(spark, sf):
    names = {"name": F.col("p_name"), "size": F.col("p_size"), "brand": F.col("p_brand")}
    return read(spark, sf, "part").select("p_partkey", expressions.fill("{{name}}/{{size2}}/{{brand.length}}/<js>java.md5Encode(name)</js>/{{size > 20 ? 'big' : 'small'}}".replace("size2", "String(twice)"), {**names, "twice": F.col("p_size") * 2 + 1}).alias("filled"))


# ---- local texts ----


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line, CAST(strlen(l[i]) AS BIGINT) AS n_bytes FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def text_lines(spark, sf):
    got = books.lines(read(spark, sf, "documents"), "doc_id", "text")
    return got.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", (F.col("stop") - F.col("start")).alias("n_bytes"))


_CHAPTERS = "SELECT doc_id, l, i, (SELECT coalesce(sum(strlen(x) + 1), 0) FROM (SELECT unnest(l[1:i - 1]) AS x)) AS start_pos, strlen(text) AS size FROM (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))"


@query(
    f"SELECT doc_id, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, CAST(start_pos AS BIGINT) AS start_pos, CAST(coalesce(lead(start_pos) OVER w, size) AS BIGINT) AS end_pos FROM ({_CHAPTERS}) WHERE strlen(l[i]) BETWEEN 1 AND 60 WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos)"
)
def chapter_spans(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    short = books.lines(docs, "doc_id", "text").where(F.octet_length("line").between(1, 60)).select("doc_id", "start", F.col("line").alias("title"), F.lit("short").alias("rule"))
    return books.text_chapters(docs, "doc_id", "text", titles=short).select("doc_id", F.col("idx").cast("long").alias("idx"), "start_pos", "end_pos")


def _ruled() -> str:
    """Lines of the documents with the first rule that gives an unsuspicious title."""

    def case(name: str, pattern: str, priority: int) -> str:
        group = lambda k: f"trim(regexp_extract(line, '{pattern}', {k}))"
        title = group(1) if regexes.n_groups(pattern) < 2 else f"coalesce(nullif({group(2)}, ''), {group(1)})"
        odd = " OR ".join(f"contains(lower({title}), '{w}')" for w in ("http", "www.", ".com"))
        return f"WHEN regexp_matches(line, '{pattern}') AND NOT ({odd}) AND strlen({title}) BETWEEN 2 AND 50 AND NOT regexp_matches({title}, '^[+-]?[0-9]+$') THEN ('{name}', {priority})"

    found = "CASE " + " ".join(case(*r) for r in text.TITLE_RULES) + " END"
    lines = "SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents"
    return f"SELECT doc_id, struct_extract(r, 1) AS rule, count(*) AS hits, max(struct_extract(r, 2)) AS priority FROM (SELECT doc_id, {found} AS r FROM ({lines}) WHERE strlen(line) BETWEEN 2 AND 100) WHERE r IS NOT NULL GROUP BY ALL"


@query(_ruled())
def title_rule_hits(spark, sf):
    return books.rule_hits(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"SELECT doc_id, max_by(rule, (hits, priority)) AS rule, max(hits) AS hits FROM ({_ruled()}) GROUP BY doc_id")
def best_title_rule(spark, sf):
    return books.best_rule(books.rule_hits(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, l, 1 AS i, 0 AS part, length(l[1]) AS n FROM d
      UNION ALL SELECT doc_id, l, i + 1, CASE WHEN n + length(l[i + 1]) > 4000 THEN part + 1 ELSE part END, CASE WHEN n + length(l[i + 1]) > 4000 THEN 0 ELSE n END + length(l[i + 1]) FROM r WHERE i < len(l))
SELECT doc_id, part, string_agg(l[i], chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, part"""
)
def long_text_parts(spark, sf):
    return books.split_long(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 4000)


@query("SELECT doc_id, 'utf-8' AS charset, text FROM documents")
def charsets(spark, sf):
    got = files.decoded(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    return read(spark, sf, "documents").select("doc_id", got["charset"].alias("charset"), got["text"].alias("text"))


@query("SELECT substr(sha256(text), 1, 16) AS id, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY text HAVING NOT bool_or(text IN (SELECT text FROM documents WHERE doc_id % 3 = 0))".replace("count(*) AS n", "1 AS n"))
def stored_books(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    had = docs.where("doc_id % 3 = 0").select(text.content_id(F.col("content")).alias("id"))
    return files.store(docs.where("doc_id % 3 <> 0"), had).select("id", F.lit(1).alias("n"))
