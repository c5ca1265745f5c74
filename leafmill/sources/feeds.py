"""Feeds as rows: kind, RSS and Atom items, discovery, list pages as feeds, incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import dom, json_paths, lists, text, urls
from leafmill.functions.batches import pieces

_ITEM = "struct<title: string, link: string, description: string, guid: string, pubDate: string, author: string, `content:encoded`: string>"
_RSS = f"channel struct<title: string, link: string, description: string, item: array<{_ITEM}>>"
_LINK = "struct<_href: string, _rel: string>"
_ATOM = f"title string, link array<{_LINK}>, entry array<struct<title: string, id: string, link: array<{_LINK}>, summary: string, content: string, published: string, updated: string, author: struct<name: string>>>"


def kind(body: Column) -> Column:
    """1 RSS, 2 Atom, 3 a page of list items, 0 nothing."""
    return F.when(body.contains("<rss"), 1).when(body.contains("<feed"), 2).when(body.rlike("(?i)<html"), 3).otherwise(0)


def _or(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def _alternate(links: Column) -> Column:
    first = F.get(F.filter(links, lambda x: x["_rel"].isNull() | x["_rel"].isin("", "alternate")), F.lit(0))
    return F.coalesce(first["_href"], F.get(links, F.lit(0))["_href"])


def rss_items(feeds: DataFrame, body: str = "body", key: str = "feed_id") -> DataFrame:
    """(key, pos, guid, title, link, description, content, author, published_at); guid falls back to link, content to description."""
    one = feeds.where(kind(F.col(body)) == 1).select(key, F.posexplode(F.from_xml(body, _RSS)["channel"]["item"]).alias("pos", "i"))
    return one.select(key, "pos", _or(F.col("i.guid"), F.col("i.link")).alias("guid"), _or(F.col("i.title")).alias("title"), _or(F.col("i.link")).alias("link"), _or(F.col("i.description")).alias("description"), _or(F.col("i")["content:encoded"], F.col("i.description")).alias("content"), _or(F.col("i.author")).alias("author"), text.parse_time(F.col("i.pubDate")).alias("published_at"))


def atom_items(feeds: DataFrame, body: str = "body", key: str = "feed_id") -> DataFrame:
    one = feeds.where(kind(F.col(body)) == 2).select(key, F.posexplode(F.from_xml(body, _ATOM)["entry"]).alias("pos", "i"))
    link = _alternate(F.col("i.link"))
    return one.select(key, "pos", _or(F.col("i.id"), link).alias("guid"), _or(F.col("i.title")).alias("title"), _or(link).alias("link"), _or(F.col("i.summary")).alias("description"), _or(F.col("i.content"), F.col("i.summary")).alias("content"), _or(F.col("i.author.name")).alias("author"), text.parse_time(_or(F.col("i.published"), F.col("i.updated"))).alias("published_at"))


def feed_items(feeds: DataFrame, body: str = "body", key: str = "feed_id") -> DataFrame:
    """Items of RSS and Atom feeds alike: each body goes to the reader that its kind names; others give nothing."""
    return rss_items(feeds, body, key).unionByName(atom_items(feeds, body, key))


def preview(feeds: DataFrame, n: int, body: str = "body", key: str = "feed_id") -> DataFrame:
    """The first n items of each feed; nothing is written."""
    return feed_items(feeds, body, key).where(F.col("pos") < n)


def json_items(docs: DataFrame, rules: dict[str, str], body: str = "body", base: str = "url") -> DataFrame:
    """docs with a row per article of JSON feeds by rules (list, title, link, author, image, date, description).

    A title falls back to its link; rows with neither go.
    """
    names = ("title", "link", "author", "image", "date", "description")

    def read(item: Column) -> Column:
        got = json_paths.fields(item, {k: rules.get(k, "") for k in names})
        for k in ("link", "image"):
            if rules.get(k):
                got[k] = lists.bound(got[k], lambda x: F.when(x != "", urls.resolve(F.col(base), x)).otherwise(""))
        return F.struct(*[got[k].alias(k) for k in names])

    # read before they are told apart: a filter over the rows would work titles and links out once more
    rows = docs.select("*", F.posexplode(F.transform(json_paths.listed(F.col(body), rules["list"]), read)).alias("pos", "_item"))
    item = {k: F.col(f"_item.{k}") for k in names}
    named = rows.withColumns({**item, "title": F.coalesce(F.nullif(item["title"], F.lit("")), item["link"]), "date": text.parse_time(item["date"])})
    return named.drop(body, "_item").where("title <> ''")


#: Selectors of list items and of their titles, fixed values, tried in this order.
ITEM_SELECTORS = ("article", ".article", ".post", ".entry", ".item", ".news-item", ".list-item", ".card", "[itemprop='articleBody']", ".content-item", "main article", ".main-content article", "#content article", "tr.athing", ".athing", "[data-testid='post-container']", ".Post", ".story", ".news", "li.item", "div.item")
TITLE_SELECTORS = ("h1", "h2", "h3", "h4", ".title", ".post-title", ".entry-title", "[itemprop='headline']", "a.title", ".titleline a", ".titleline", "a.storylink", "a[href]")


def _page_items(page: str) -> list[dict]:
    root = dom.parse(page)
    best: list[dom.Node] = []
    for s in ITEM_SELECTORS:
        found = dom.select(root, s)
        if len(found) > len(best):
            best = found
    if not best:
        boxes = [(d, sum("href" in a.attrs for a in d.walk() if a.tag == "a")) for d in dom.select(root, "div")]
        boxes = [b for b in boxes if b[1] >= 3]
        if boxes:
            box = max(boxes, key=lambda b: b[1])[0]
            best = box.elements() if len(box.elements()) >= 3 else [box]
    out = []
    for n in best:
        title, link = "", ""
        for s in TITLE_SELECTORS:
            hit = next(iter(dom.select(n, s)), None)
            if hit is not None and len(hit.text().strip().encode()) > 3:
                title, link = " ".join(hit.text().split()), hit.attrs.get("href", "")
                break
        if not link:
            link = next((a.attrs["href"] for a in n.walk() if a.tag == "a" and a.attrs.get("href")), "")
        if title:
            text_ = next((p.text().strip() for p in n.walk() if p.tag == "p" and p.text().strip()), "")
            out.append({"title": title, "link": link, "description": " ".join(text_.split())})
    return out


def page_items(pages: DataFrame, body: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """List pages as feeds: the selector with the most matches (the first on ties), else the box with most links."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind_ = pa.list_(pa.struct([("title", pa.string()), ("link", pa.string()), ("description", pa.string())]))
        for b in pieces(batches):
            yield pa.array([_page_items(p.as_py() or "") for p in b], kind_)

    got = pages.select(key, url, F.posexplode(F.arrow_udf(run, "array<struct<title: string, link: string, description: string>>")(F.col(body))).alias("pos", "i"))
    link = F.when(F.col("i.link") == "", F.col(url)).otherwise(urls.join_loose(F.col(url), F.col("i.link")))
    return got.select(key, "pos", link.alias("guid"), F.col("i.title").alias("title"), link.alias("link"), F.col("i.description").alias("description"))


_REL = r"(?is)<link\b(?=[^>]*\brel=[\"']?alternate)(?=[^>]*application/(?:rss|atom)\+xml)[^>]*\bhref=[\"']([^\"']+)"


def discovered(body: Column) -> Column:
    """The feed URL that a page's head names, as written; ''."""
    return F.regexp_extract(body, _REL, 1)


#: Where feeds usually are below a page's path, fixed values.
COMMON_PATHS = ("feed/", "feed", "rss", "rss.xml", "atom.xml", "index.xml")


def candidates(page_url: Column, n: int = 3) -> Column:
    """The first n usual feed URLs below a page's own path; its query and fragment go."""
    page = F.regexp_extract(page_url, r"^(https?://[^/?#]+[^?#]*)", 1)
    below = F.when(page.endswith("/"), page).otherwise(F.concat(page, F.lit("/")))
    return F.when(page != "", F.transform(F.array(*map(F.lit, COMMON_PATHS[:n])), lambda p: F.concat(below, p))).otherwise(F.array().cast("array<string>"))


def discover(asked: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """asked with feed_url: the page itself if it is a feed, else the feed its head names, else the first candidate that is one."""
    body = pages.select(F.col("url").alias("_u"), "html")
    here = asked.join(body, F.col(url) == F.col("_u"), "left")
    named = here.select(*asked.columns, F.when(kind(F.col("html")).isin(1, 2), F.col(url)).when(discovered(F.col("html")) != "", urls.resolve(F.col(url), discovered(F.col("html")))).alias("named"))
    tried = asked.select(url, F.posexplode(candidates(F.col(url))).alias("k", "_u")).join(body, "_u").where(kind(F.col("html")).isin(1, 2)).groupBy(url).agg(F.min_by("_u", "k").alias("tried"))
    return named.join(tried, url, "left").withColumn("feed_url", F.coalesce("named", "tried")).drop("named", "tried")


def ingest(items: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("feed_id", "guid")) -> DataFrame:
    """Items that are new, one a key."""
    return items.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def item_order(at: Column, id_: Column) -> list[Column]:
    """Undated items last, newest first, then the highest id."""
    return [at.isNull().asc(), at.desc(), id_.desc()]
