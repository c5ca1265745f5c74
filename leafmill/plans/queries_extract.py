"""Queries of the extraction rules: selectors, JSON paths, regexes, list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import dom, extract, json_paths, lists, regexes, text
from leafmill.plans import rules
from leafmill.plans.registry import query, read

_CLEAN = "trim(regexp_replace(replace({0}, '&amp;', '&'), '\\s+', ' ', 'g'))"
_H1 = _CLEAN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
_TEXTS = "[t for t in [" + _CLEAN.format("x") + " for x in regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)] if t <> '']"
_HREFS = "[replace(x, '&amp;', '&') for x in regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)]"
_NAV = f"SELECT page_id, url, {_H1} AS title, {_TEXTS} AS texts, {_HREFS} AS hrefs FROM pages"


def _rows(lists_sql: str, value: str = "value") -> str:
    """SQL for one row per item of a list, with its place."""
    return f"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS {value} FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({lists_sql}))"


def _listed(spark, sf, rule):
    got = extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"l": rule}, as_list=True)
    return got.select("page_id", F.posexplode("l").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, title FROM ({_NAV})")
def css_title(spark, sf):
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"title": "@css:article h1@text"}).select("page_id", "title")


@query(_rows(f"SELECT page_id, hrefs AS l FROM ({_NAV})"))
def css_nav_links(spark, sf):
    return _listed(spark, sf, "@css:nav ul li a@href")


@query(_rows(f"SELECT page_id, [texts[2]] AS l FROM ({_NAV}) WHERE len(texts) >= 2"))
def css_index_single(spark, sf):
    return _listed(spark, sf, "@css:nav li:1@text")


@query(_rows(f"SELECT page_id, texts[1:3] AS l FROM ({_NAV})"))
def css_index_range(spark, sf):
    return _listed(spark, sf, "@css:nav li[0:3]@text")


@query(_rows(f"SELECT page_id, texts[3:] AS l FROM ({_NAV})"))
def css_index_exclude(spark, sf):
    return _listed(spark, sf, "@css:nav li!0:2@text")


@query(_rows(f"SELECT page_id, list_filter([texts[1], CASE WHEN len(texts) >= 3 THEN texts[3] END, texts[len(texts)]], lambda x: x IS NOT NULL) AS l FROM ({_NAV})"))
def css_index_list(spark, sf):
    return _listed(spark, sf, "@css:nav li[0,2,-1]@text")


@query(_rows(f"SELECT page_id, CASE WHEN len(hrefs) = len(texts) THEN flatten([[hrefs[i], texts[i]] for i in range(1, len(hrefs) + 1)]) ELSE list_concat(hrefs, texts) END AS l FROM ({_NAV})"))
def css_interleave(spark, sf):
    return _listed(spark, sf, "@css:nav li a@href && nav li a@text")


@query(_rows(f"SELECT page_id, list_concat([title], texts) AS l FROM ({_NAV})"))
def css_concat(spark, sf):
    return _listed(spark, sf, "@css:article h1@text || nav li@text")


@query(f"SELECT page_id, t AS value FROM (SELECT DISTINCT page_id, unnest(texts) AS t FROM ({_NAV})) WHERE t <> ''")
def xpath_and(spark, sf):
    return _listed(spark, sf, "@xpath://nav//li && //nav//a").select("page_id", "value")


@query(f"SELECT page_id, t AS value FROM (SELECT DISTINCT page_id, unnest(list_concat([title], texts)) AS t FROM ({_NAV})) WHERE t <> ''")
def xpath_or(spark, sf):
    got = extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"l": "@xpath://h1 || //nav//a/text()"}, as_list=True)
    return got.select("page_id", F.explode("l").alias("value"))


@query(f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(texts) AS t FROM ({_NAV})) WHERE contains(t, 'e') GROUP BY page_id")
def xpath_containing(spark, sf):
    return _listed(spark, sf, "@xpath://nav//a %% e").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, hrefs[1] AS value FROM ({_NAV}) WHERE len(hrefs) > 0")
def xpath_condition(spark, sf):
    return _listed(spark, sf, "@xpath://nav/ul/li[1]/a[@href]/@href").select("page_id", "value")


@query(f"SELECT page_id, title AS value FROM ({_NAV})")
def chain_alternatives(spark, sf):
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"value": "class.none@text||tag.h1@text"}).select("page_id", "value")


@query(_rows(f"SELECT page_id, texts[2:] AS l FROM ({_NAV})"))
def chain_exclude(spark, sf):
    return _listed(spark, sf, "tag.nav@tag.li!0@tag.a@text")


@query(f"SELECT page_id, regexp_replace(title, '[aeiou]+([a-z])', '<\\1>', 'g') AS value, regexp_replace(title, '[A-Z]', '', 'g') AS small FROM ({_NAV})")
def chain_replace(spark, sf):
    """Replacements behind a chain: with a group, and to nothing."""
    rules = {"value": "tag.article@tag.h1@text##[aeiou]+([a-z])##<$1>", "small": "tag.article@tag.h1@text##[A-Z]"}
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", rules).select("page_id", "value", "small")


@query(f"SELECT page_id, regexp_replace(title, '[aeiou]+', '_', 'g') AS value FROM ({_NAV})")
def css_replace(spark, sf):
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"value": "@css:article h1@text##[aeiou]+##_"}).select("page_id", "value")


@query(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, texts[i] AS name, hrefs[i] AS link FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM ({_NAV}) WHERE len(texts) = len(hrefs))")
def list_rule_items(spark, sf):
    rows = extract.items(read(spark, sf, "pages").select("page_id", "html"), "html", "tag.nav@tag.li")
    return extract.extract(rows, "item", {"name": "tag.a@text", "link": "tag.a@href"}).select("page_id", F.col("pos").cast("long").alias("pos"), "name", "link")


_INLINE = "|".join(sorted(dom.INLINE - {"br", "li"}))
#: The article's text by blocks: code and comments go, inline tags join, every other tag ends a block.
_BLOCKS = f"""SELECT page_id, array_to_string([y FOR y IN [trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN string_split(t, chr(1))] IF y <> ''], repeat(chr(10), 2)) AS content FROM (
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?({_INLINE})(\\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;?', '&', 'g') AS t
FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages))"""


@query(f"SELECT page_id, content, CAST([] AS VARCHAR[]) AS images, CAST(strlen(replace(content, ' ', '')) AS INTEGER) AS word_count FROM ({_BLOCKS})")
def content_text(spark, sf):
    return extract.content(read(spark, sf, "pages").select("page_id", "html"), "html", "article").select("page_id", "content", "images", text.count_bytes(F.col("content")).alias("word_count"))


@query(
    "WITH t AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1) AS a FROM pages) SELECT page_id, CAST(len(regexp_extract_all(a, '<p>')) AS BIGINT) AS n_paragraphs, contains(a, '<b>') AS has_bold FROM t"
)
def article_shape(spark, sf):
    got = extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"p": "@css:article p@html", "b": "@css:article b@html"}, as_list=True)
    return got.select("page_id", F.size("p").cast("long").alias("n_paragraphs"), (F.size("b") > 0).alias("has_bold"))


# ---- JSON ----


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf):
    return read(spark, sf, "events").select("event_id", json_paths.value(F.col("props"), "$.k").alias("k"))


_SHELF = "SELECT o_orderkey // 8 AS g, list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey) AS l FROM orders GROUP BY o_orderkey // 8"


def _books(spark, sf):
    """A JSON document per eight orders: {"books": [{id, status}, ...], "meta": {"total": n}}."""
    return (
        read(spark, sf, "orders")
        .groupBy(F.floor(F.col("o_orderkey") / 8).alias("g"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("books"))
        .select("g", F.to_json(F.struct("books", F.struct(F.size("books").alias("total")).alias("meta"))).alias("doc"))
    )


@query(f"SELECT g, CAST(i - 1 AS BIGINT) AS pos, CAST(l[i].id AS VARCHAR) AS value FROM (SELECT g, l, unnest(range(1, len(l) + 1)) AS i FROM ({_SHELF}))")
def json_wildcard(spark, sf):
    return _books(spark, sf).select("g", F.posexplode(json_paths.query(F.col("doc"), "$.books[*].id")).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT g, CAST(i - 2 AS BIGINT) AS pos, l[i].status AS value FROM (SELECT g, l, unnest(range(2, least(4, len(l)) + 1)) AS i FROM ({_SHELF}))")
def json_slice(spark, sf):
    return _books(spark, sf).select("g", F.posexplode(json_paths.query(F.col("doc"), "$.books[1:4].status")).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT g, CAST(len(l) AS VARCHAR) AS total, CAST(l[1].id AS VARCHAR) AS first_id, concat('n', len(l), '/', l[1].status) AS label FROM ({_SHELF})")
def json_fallback(spark, sf):
    d = F.col("doc")
    return _books(spark, sf).select("g", json_paths.first_of(d, "$.nothing && $.meta.total").alias("total"), json_paths.value(d, "books[0].id").alias("first_id"), json_paths.first_of(d, "n{{$.meta.total}}/{{$.books[0].status}}").alias("label"))


@query(f"SELECT g, list_distinct([b.status for b in l]) AS s, len(list_distinct([b.status for b in l])) AS n, list_aggregate(list_sort(list_distinct([b.status for b in l])), 'string_agg', ',') AS held FROM ({_SHELF})".replace("list_distinct([b.status for b in l]) AS s, ", ""))
def json_or(spark, sf):
    d = F.col("doc")
    both = lists.combine([json_paths.query(d, "$.nothing[*].x"), json_paths.query(d, "$.books[*].status")], ["||"], "json")
    return _books(spark, sf).select("g", F.size(both).cast("long").alias("n"), F.array_join(F.array_sort(both), ",").alias("held"))


@query(f"SELECT g, CAST(b.id AS VARCHAR) AS id, b.status AS status FROM (SELECT g, unnest(l) AS b FROM ({_SHELF}))")
def json_items(spark, sf):
    rows = _books(spark, sf).select("g", F.explode(json_paths.items(F.col("doc"), "$.books")).alias("item"))
    return rows.select("g", json_paths.aliases(F.col("item"), ["bookId", "id"]).alias("id"), json_paths.aliases(F.col("item"), ["status", "state"]).alias("status"))


@query("SELECT event_id, json_valid(props) AS ok FROM events")
def json_validity(spark, sf):
    return read(spark, sf, "events").select("event_id", json_paths.is_json(F.col("props")).alias("ok"))


# ---- regexes ----


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n, coalesce(regexp_extract_all(text, '[A-Z][a-z]+')[1], '') AS first FROM documents")
def regex_all(spark, sf):
    got = regexes.find_all(F.col("text"), "[A-Z][a-z]+")
    return read(spark, sf, "documents").select("doc_id", F.size(got).cast("long").alias("n"), lists.first(got).alias("first"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '([a-z]+)\\.', 1)) AS BIGINT) AS n, coalesce(regexp_extract_all(text, '([a-z]+)\\.', 1)[1], '') AS first FROM documents")
def regex_group(spark, sf):
    got = regexes.find_all(F.col("text"), r"([a-z]+)\.")
    return read(spark, sf, "documents").select("doc_id", F.size(got).cast("long").alias("n"), lists.first(got).alias("first"))


@query("SELECT doc_id, regexp_extract(regexp_extract(text, '[A-Z][a-z]+ [a-z]+', 0), '[a-z]+$', 0) AS value FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ [a-z]+')")
def regex_chain(spark, sf):
    got = regexes.chain(F.col("text"), ["[A-Z][a-z]+ [a-z]+", "[a-z]+$"])
    return read(spark, sf, "documents").select("doc_id", F.get(got, F.lit(0)).alias("value")).where("value is not null")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Za-z]+) ([a-z]+)') THEN concat(regexp_extract(text, '([A-Za-z]+) ([a-z]+)', 2), '-', regexp_extract(text, '([A-Za-z]+) ([a-z]+)', 1)) ELSE '' END AS value FROM documents")
def regex_template(spark, sf):
    return read(spark, sf, "documents").select("doc_id", regexes.template(F.col("text"), "([A-Za-z]+) ([a-z]+)", "$2-$1").alias("value"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '([a-z]+)ing\\b', '\\1ed', 'g')) AS h FROM documents")
def regex_replace_chain(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(regexes.replace_chain(F.col("text"), [("[0-9]+", "#"), (r"([a-z]+)ing\b", "$1ed"), ("(", "x")])).alias("h"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)THE')) AS BIGINT) AS n FROM documents")
def regex_flags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(regexes.find_all(F.col("text"), regexes.flags("THE", ignore_case=True))).cast("long").alias("n"))


_DOUBLED = "|".join(2 * chr(c) for c in range(97, 123))


@query(f"SELECT doc_id, CAST((length(text) - length(replace(text, 'ther', ''))) / 4 AS INTEGER) AS n_look, CAST(len(regexp_extract_all(text, '(?:{_DOUBLED})+')) AS INTEGER) AS n_doubled FROM documents")
def regex_lookaround(spark, sf):
    """Lookbehind, lookahead and a back reference, which the other engine's regexes lack."""
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.size(regexes.find_all(t, r"(?<=th)e(?=r)")).alias("n_look"), F.size(regexes.find_all(t, r"(?:([a-z])\1)+")).alias("n_doubled"))


@query(
    "SELECT doc_id, regexp_extract(text, '([A-Z])([a-z]+)', 0) AS whole, regexp_extract(text, '([A-Z])([a-z]+)', 1) AS g1, regexp_extract(text, '([A-Z])([a-z]+)', 2) AS g2, CAST(len(regexp_extract_all(text, '([A-Z])([a-z]+)', 0)) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '([A-Z])([a-z]+)')"
)
def regex_groups(spark, sf):
    p = "([A-Z])([a-z]+)"
    g = regexes.groups(F.col("text"), p)
    return read(spark, sf, "documents").where(F.col("text").rlike(p)).select("doc_id", F.get(g, F.lit(0)).alias("whole"), F.get(g, F.lit(1)).alias("g1"), F.get(g, F.lit(2)).alias("g2"), F.size(regexes.all_groups(F.col("text"), p)).cast("long").alias("n"))


@query(f"SELECT page_id, len(list_distinct(texts)) AS n_union, len(list_distinct(list_intersect(texts, texts[2:]))) AS n_common FROM ({_NAV})")
def list_operators(spark, sf):
    got = extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", {"a": "@css:nav li@text", "b": "@css:nav li!0@text"}, as_list=True)
    return got.select("page_id", F.size(lists.union(F.col("a"), F.col("b"))).cast("long").alias("n_union"), F.size(lists.intersection(F.col("a"), F.col("b"))).cast("long").alias("n_common"))


@query("SELECT p_name, p_type, CASE WHEN contains(p_type, 'ECONOMY') THEN 'xpath' ELSE 'css' END AS mode, count(*) AS n FROM part GROUP BY ALL")
def rule_modes(spark, sf):
    """Modes of a table's rules, told by expressions."""
    rule = F.when(F.col("p_type").contains("ECONOMY"), "//div/a/@href").otherwise(".book a")
    return read(spark, sf, "part").groupBy("p_name", "p_type", rules.mode_of(rule).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


_INLINE_RULES = ["@XPath://a", "@Json:$.a", "@CSS:a", "@css:a", "$.a", "/a/b", ":a(b)", "a.b", "class.x@text"]


@query(f"SELECT p_partkey, ['xpath', 'json', 'css', 'default', 'json', 'xpath', 'regex', 'default', 'default'][1 + p_partkey % 9] AS inline, ['xpath', 'json', 'css', 'css', 'json', 'css', 'regex', 'css', 'chain'][1 + p_partkey % 9] AS analyzed, {_INLINE_RULES}[1 + p_partkey % 9] AS rule FROM part".replace("'json', 'css', 'regex'", "'json', 'xpath', 'regex'"))
def inline_modes(spark, sf):
    """Both ways of telling a rule's mode, side by side."""
    rule = F.element_at(F.array(*map(F.lit, _INLINE_RULES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", rules.inline_mode(rule).alias("inline"), rules.mode_of(rule).alias("analyzed"), rule.alias("rule"))


@query("SELECT p_partkey, [CAST(p_partkey AS VARCHAR), p_name] AS of_object, [p_name, p_brand] AS of_array, [CAST(p_size AS VARCHAR)] AS number FROM part")
def json_roots(spark, sf):
    """Values of a root object, elements of a root array, and a whole number without its fraction."""
    part = read(spark, sf, "part")
    obj, arr = F.to_json(F.struct("p_partkey", "p_name")), F.to_json(F.array("p_name", "p_brand"))
    number = F.concat(F.lit('{"n": '), F.col("p_size").cast("string"), F.lit(".0}"))
    return part.select("p_partkey", json_paths.query(obj, "$").alias("of_object"), json_paths.query(arr, "$.").alias("of_array"), json_paths.query(number, "@json:$.n").alias("number"))


@query(f"SELECT page_id, title, texts[1] AS first_link FROM ({_NAV})")
def field_rule_maps(spark, sf):
    """Field rules written in two ways, looked up whatever their case and name."""
    quoted = rules.field_rules("{'bookName': '@css:article h1@text'}")
    plain = rules.field_rules("Title::@css:nav li@text@author::none")
    wanted = {"title": rules.field_rule(quoted, "name"), "first_link": rules.field_rule(plain, "missing", "title")}
    return extract.extract(read(spark, sf, "pages").select("page_id", "html"), "html", wanted).drop("html")
