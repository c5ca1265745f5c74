"""Search in which every source row carries its own URL template and its own rules.

Requests of all sources meet the pages in one join.  The distinct rule texts are compiled once each: JSON and regex rule sets
become columns, and those of one plan are told apart by the row's rule number, so that the pages are scanned once whatever
the number of sources.  Rule sets beyond one plan's share, and those over markup, read the fetched rows back from the shared folder, each
its own part of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import json_paths, lists, regexes, urls
from leafmill.operators import books
from leafmill.plans import rules as R
from leafmill.sources.shared import settled

#: Rule sets that are compiled into one plan.
FUSED = 24
FIELDS = ("name", "author", "url", "cover", "intro")
#: What rule sets call their fields, fixed values.
_KEYS = {"name": ("name", "title"), "author": ("author",), "url": ("bookUrl", "bookURL"), "cover": ("coverUrl", "cover"), "intro": ("intro",)}
_BOOKS = "array<struct<name: string, author: string, url: string, cover: string, intro: string>>"


def request_url(template: Column, base: Column, key: str) -> tuple[Column, Column, Column]:
    """(url, method, body) of a search: the template's place holders filled in, relative ones on the source's base.

    A suffix ,{...} gives method and body; a template that is blank, or a script, gives a null url.
    """
    said = F.trim(template)
    cut = F.instr(said, ",{")
    # what the suffix says, in single or double quotes; a suffix that cannot be read is dropped all the same
    meta = F.from_json(F.when(cut > 1, F.replace(F.substr(said, cut + 1), F.lit("'"), F.lit('"'))), "struct<method: string, body: string>", {"mode": "PERMISSIVE"})
    path = F.when(cut > 1, F.substr(said, F.lit(1), cut - 1)).otherwise(said)
    root = F.regexp_replace(base, "/+$", "")
    whole = F.when(path.rlike("^https?://"), path).otherwise(F.concat(root, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
    encoded = F.url_encode(F.lit(key))

    def fill(text: Column, value: Column) -> Column:
        places = (("{{key}}", value), ("{{page}}", F.lit("1")), ("{key}", value), ("{q}", value), ("{keyword}", value))
        return reduce(lambda t, p: F.replace(t, F.lit(p[0]), p[1]), places, text)

    url = F.when((said != "") & ~said.startswith("@js:"), fill(whole, encoded))
    return url, F.coalesce(F.upper(F.nullif(meta["method"], F.lit(""))), F.lit("GET")), fill(F.coalesce(meta["body"], F.lit("")), F.lit(key))


def _regex_value(item: Column, rule: str) -> Column:
    parsed = R.parse(rule)
    return lists.first(F.coalesce(regexes.chain(item, list(parsed.parts)), lists.EMPTY()))


def book_column(body: Column, rule_text: str) -> Column | None:
    """The books of a list page as an array of FIELDS; None if the rules ask for markup.  Rules without a list or name find nothing."""
    rules = R.field_rules(rule_text)
    where = R.field_rule(rules, "bookList", "list")
    if not where or not any(R.field_rule(rules, k) for k in _KEYS["name"]):
        return F.array().cast(_BOOKS)
    mode = R.detect(where.split("&&")[0])
    wanted = {k: next((r for n in names if (r := {x.lower(): v for x, v in rules.items()}.get(n.lower(), ""))), "") for k, names in _KEYS.items()}
    if mode == "json":
        rows, value = json_paths.listed(body, where), json_paths.first_of
    elif mode == "regex":
        rows, value = regexes.find_all(body, where), _regex_value
    else:
        return None
    found = F.transform(rows, lambda x: F.struct(*[(value(x, rule) if rule else F.lit("")).alias(k) for k, rule in wanted.items()]))
    return F.coalesce(found.cast(_BOOKS), F.array().cast(_BOOKS))


def rule_texts(sources: DataFrame, rule: str) -> list[str]:
    """The distinct rule texts, which are few beside the sources, in order."""
    return [r[0] for r in sources.where(F.trim(rule) != "").select(F.trim(rule).alias(rule)).distinct().orderBy(rule).collect()]


def list_pages(fetched: DataFrame, texts: list[str], rule: str, body: str, base: str, fused: int = FUSED) -> DataFrame:
    """fetched, without rule and body, with a row per book of its list page: pos and FIELDS; nameless books go.

    url and cover are resolved against the base.  texts: the rule texts that occur; rows of another rule find nothing.
    """
    rest = [c for c in fetched.columns if c not in (rule, body)]
    said = F.trim(rule)
    native = [(t, c) for t in texts if (c := book_column(F.col(body), t)) is not None]
    markup = [t for t in texts if t not in {t for t, _ in native}]
    if len(native) > fused or markup:
        fetched = settled(fetched)
    full = lambda x: F.when(F.trim(x) != "", urls.resolve(F.col(base), x)).otherwise("")
    parts = []
    for at in range(0, max(1, len(native)), fused):
        some = native[at : at + fused]
        found = reduce(lambda c, x: c.when(said == x[0], x[1]), some, F) if some else F.array().cast(_BOOKS)
        # resolved before they are told apart: a filter on the rows' URLs would resolve them once more
        found = F.transform(found, lambda b: F.struct(*[(full(b[k]) if k in ("url", "cover") else b[k]).alias(k) for k in FIELDS]))
        rows = fetched.where(said.isin([t for t, _ in some])) if some else fetched.where("false")
        parts.append(rows.select(*rest, F.posexplode(found).alias("pos", "b")).select(*rest, "pos", "b.*"))
    for t in markup:
        rules = R.field_rules(t)
        wanted = {k: r for k, names in _KEYS.items() for r in [next((rules[n] for n in names if rules.get(n)), "")] if r}
        got = books.list_page(fetched.where(said == t).drop(rule), {"list": R.field_rule(rules, "bookList", "list"), **{k: v for k, v in wanted.items() if k != "url"}, **({"link": wanted["url"]} if "url" in wanted else {})}, body, base)
        parts.append(got.select(*rest, "pos", *[(F.col("link" if k == "url" else k) if k in wanted else F.lit("")).alias(k) for k in FIELDS]).withColumns({k: full(F.col(k)) for k in ("url", "cover")}))
    return reduce(DataFrame.unionByName, parts).where(F.trim("name") != "")


def fetched_results(sources: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(source_id, source_order, rule, url, method, request_body, html, status) per enabled source: 'ok', or why there is no page.

    sources: id, base_url, search_url, search_rule, enabled, order; pages: url, html.
    """
    url, method, body = request_url(F.col("search_url"), F.col("base_url"), key)
    asked = sources.where("enabled").select(F.col("id").alias("source_id"), F.col("order").alias("source_order"), F.coalesce("search_rule", F.lit("")).alias("rule"), url.alias("url"), method.alias("method"), body.alias("request_body"))
    held = pages.select(F.col("url").alias("at"), "html")
    joined = asked.join(held, F.col("url") == F.col("at"), "left").drop("at")
    why = F.when(F.col("url").isNull(), "no search URL").when(F.trim("rule") == "", "no search rule").when(F.col("html").isNull(), "no page").otherwise("ok")
    return joined.withColumn("status", why)


def search(sources: DataFrame, pages: DataFrame, key: str, fused: int = FUSED) -> DataFrame:
    """(source_id, source_order, pos, FIELDS): all books that the enabled sources find, each by its own rules."""
    ready = fetched_results(sources, pages, key).where("status = 'ok'").select("source_id", "source_order", "rule", F.col("url").alias("page_url"), "html")
    return list_pages(ready, rule_texts(sources.where("enabled"), "search_rule"), "rule", "html", "page_url", fused).drop("page_url")


def search_merged(sources: DataFrame, pages: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` books of search(): sources of high order first, one row a name and author, those with a URL."""
    return books.merge_results(search(sources, pages, key), -F.col("source_order"), F.col("source_id"), F.col("pos"), limit=limit)


def search_report(sources: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(source_id, status, method, n_books) per enabled source."""
    counts = search(sources, pages, key).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_books"))
    said = fetched_results(sources, pages, key).select("source_id", "status", "method")
    return said.join(counts, "source_id", "left").withColumn("n_books", F.coalesce("n_books", F.lit(0)))
