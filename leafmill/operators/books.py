"""Book flows: search, details, contents, chapter text, explore pages, alternates, chapters of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import extract, json_paths, text, urls
from leafmill.functions.batches import pieces
from leafmill.sources.shared import settled


def fetch(requests: DataFrame, pages: DataFrame, url: str = "url", page_key: str | None = None) -> DataFrame:
    """Requested URLs with their page, by a join, one row a request; found says whether there is one.

    Where pages are kept by request, page_key is the column of both that tells whose page it is; of several pages of one URL (and key) the
    smallest text counts.
    """
    by = [url] if page_key is None else [url, page_key]
    held = pages.select(F.col("url").alias(url), *by[1:], "html").groupBy(*by).agg(F.min("html").alias("body"))
    return requests.join(held, by, "left").select(*requests.columns, "body").withColumn("found", F.col("body").isNotNull())


def allowed(requests: DataFrame, url: str = "url") -> DataFrame:
    return requests.where(urls.is_allowed(F.col(url)))


def merge_results(results: DataFrame, *order: Column, limit: int = 50, keys: tuple[str, ...] = ("name", "author"), url: str = "url") -> DataFrame:
    """Search results of all sources: rows without a URL go, the first a key stays, the first ``limit`` come out.

    min_by over a struct keeps one row a key and task, so that a hot key never meets in one task.
    """
    rows = results.where(F.coalesce(F.trim(url), F.lit("")) != "")
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*order)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r"), F.min(rank).alias("_rank")).select(*keys, "r.*", "_rank")
    return best.orderBy("_rank", *keys).limit(limit).drop("_rank")


def search(sources: DataFrame, pages: DataFrame, rules: dict[str, str], key: str, limit: int = 50, page_key: str | None = None) -> DataFrame:
    """Search every enabled source: its URL, its page, the list rule's items, their fields, merged.

    sources: id, base_url, search_url, order; the search_url column already holds the URL of the query.  page_key is the pages' column that
    names the source that a page is kept for, if they are kept so.
    """
    asked = sources.where("enabled").select(F.col("id").alias("source_id"), F.col("order").alias("source_order"), F.replace("search_url", F.lit("{{key}}"), F.lit(key)).alias("url"), "base_url")
    own = pages if page_key is None else pages.withColumnRenamed(page_key, "source_id")
    rows = list_page(fetch(allowed(asked), own, page_key=page_key and "source_id").where("found"), rules, "body", "base_url")
    return merge_results(rows, -F.col("source_order"), F.col("source_id"), F.col("pos"), limit=limit)


def list_page(pages: DataFrame, rules: dict[str, str], body: str, base: str) -> DataFrame:
    """Books of list pages: the list rule's items and each item's fields; items without a name go."""
    got = extract.extract_items(pages, body, rules["list"], {k: v for k, v in rules.items() if k != "list"})
    if "url" in rules:
        got = got.withColumn("url", urls.resolve(F.col(base), F.col("url")))
    return got.where(F.trim("name") != "")


def book_info(books: DataFrame, pages: DataFrame, rules: dict[str, str], page_key: str | None = None) -> DataFrame:
    """Details of books: their page's fields, filled up from the search row where the page has none."""
    got = extract.extract(fetch(books, pages, page_key=page_key), "body", {f"new_{k}": v for k, v in rules.items()})
    fill = {k: F.coalesce(F.nullif(F.col(f"new_{k}"), F.lit("")), F.col(k) if k in books.columns else F.lit("")) for k in rules}
    return got.withColumns(fill).drop("body", *[f"new_{k}" for k in rules])


def chapters(books: DataFrame, pages: DataFrame, rules: dict[str, str], key: str, url: str = "url", newest_first: bool = False, page_key: str | None = None) -> DataFrame:
    """Contents: (key, idx, title, chapter_url); blank titles go, numbers are dense, reversed lists renumbered."""
    asked = books.select(*dict.fromkeys([key, url, page_key or key]))
    found = fetch(asked, pages, url, page_key).where("found")
    got = extract.extract_items(found, "body", rules["list"], {"title": rules["title"], "link": rules["url"]}).where(F.trim("title") != "")
    order = F.col("pos").desc() if newest_first else F.col("pos").asc()
    return got.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("idx"), "title", urls.resolve(F.col(url), F.col("link")).alias("chapter_url"))


def join_pages(parts: DataFrame, key: str, order: str, value: str, sep: str = "\n", most: int | None = None) -> DataFrame:
    """Texts of one chapter's pages joined in order."""
    got = parts if most is None else parts.where(F.col(order) < most)
    return got.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep).alias(value), F.count(F.lit(1)).alias("n_pages"))


def follow_pages(start: DataFrame, links: DataFrame, key: str, url: str = "url", most: int = 50) -> DataFrame:
    """(key, page_no, url) along next-page links: links(url, next_url); at most ``most`` pages, none twice.

    By doubling: in round k every page that is known is joined with the page 2^k links on, so that fifty pages take six
    rounds.  A page has one next page (the smallest of several); a chain ends at a page that has none, or that it has been at before: from
    there on it would repeat itself, so a page's first number is its only one.  Pages that are lost are listed, as they are asked for.
    """
    jump = links.where(F.col("next_url").isNotNull()).groupBy("url").agg(F.min("next_url").alias("to"))
    known = start.select(key, F.lit(0).alias("page_no"), F.col(url).alias("url"))
    step = 1
    while step < most:
        jump = settled(jump)
        further = known.join(jump, "url").select(key, (F.col("page_no") + step).alias("page_no"), F.col("to").alias("url")).where(F.col("page_no") < most)
        known = settled(known.unionByName(further).groupBy(key, "url").agg(F.min("page_no").alias("page_no")))
        step *= 2
        if step < most:
            then = jump.select(F.col("url").alias("to"), F.col("to").alias("further"))
            jump = jump.join(then, "to").select("url", F.col("further").alias("to"))
    return known.select(key, "page_no", "url")


def explore(rows: DataFrame, search: str, category: str, page_no: int, size: int, *order: Column) -> DataFrame:
    """Explore results: name or author holds the text (any case), the category holds the category, one page of them."""
    found = rows
    if search:
        found = found.where(F.lower("name").contains(search.lower()) | F.lower("author").contains(search.lower()))
    if category:
        found = found.where(F.col("category").contains(category))
    size = min(max(size, 1), 1000)
    return found.orderBy(*order).offset((max(1, page_no) - 1) * size).limit(size)


def until_enough(pages: DataFrame, order: str, n_items: str, size: int, key: str | None = None) -> DataFrame:
    """Pages of a listing, of each listing by key, up to the first empty one or the one that fills the page size.

    Items before a page are summed in two steps, inside ranges of (key, order) and over them, so that no task holds a listing.
    """
    by = [key] if key else []
    empty = (F.col(n_items) <= 0).cast("long")
    rows = settled(pages.repartitionByRange(*by, order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    here = rows.withColumns({"_n": zero(F.sum(n_items).over(inside)), "_e": zero(F.sum(empty).over(inside))})
    sums = rows.groupBy(*by, "_p").agg(F.sum(n_items).alias("_sn"), F.sum(empty).alias("_se"))
    over = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*by, "_p", zero(F.sum("_sn").over(over)).alias("_bn"), zero(F.sum("_se").over(over)).alias("_be"))
    got = here.join(shift, [*by, "_p"])
    return got.where((F.col("_n") + F.col("_bn") < size) & (F.col("_e") + F.col("_be") == 0) & (F.col(n_items) > 0)).select(*pages.columns)


def alternates(book: DataFrame, candidates: DataFrame, least: float = 0.45) -> DataFrame:
    """The best candidate of each other source for a book (one row: name, author, source_id), by score, then place.

    The target is one row, so the join is a broadcast of it to the candidates.
    """
    one = book.limit(1).select(F.col("name").alias("t_name"), F.col("author").alias("t_author"), F.col("source_id").alias("t_source"))
    scored = candidates.join(F.broadcast(one), F.col("source_id") != F.col("t_source")).withColumn("score", text.book_score(F.col("t_name"), F.col("t_author"), F.col("name"), F.col("author"))).where(F.col("score") >= least)
    rest = [c for c in candidates.columns if c != "source_id"] + ["score"]
    return scored.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("pos"))).alias("r")).select("source_id", "r.*")


def align_chapter(titles: DataFrame, current: str, key: str) -> DataFrame:
    """Per key the title most like the current one, the first on ties; none if nothing is alike."""
    scored = titles.withColumn("score", text.title_similarity(F.lit(current), F.col("title"))).where("score > 0")
    return scored.groupBy(key).agg(F.max_by(F.struct("idx", "title", "score"), F.struct("score", -F.col("idx"))).alias("r")).select(key, "r.*")


# ---- local texts ----


@F.arrow_udf(T.ArrayType(T.LongType()))
def _line_starts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Byte offsets of the lines: one pass over the bytes (a sum carried through built-in array functions is quadratic)."""
    for b in texts:
        raw = (np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else None for t in b.cast(pa.binary()))
        yield pa.array([None if r is None else np.r_[0, np.flatnonzero(r == 10) + 1] for r in raw], pa.list_(pa.int64()))


def lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, line, start, stop) with byte offsets into the text."""
    split = docs.select(key, F.split(body, "\n").alias("l"), _line_starts(F.col(body)).alias("at"))
    return split.select(key, F.posexplode(F.arrays_zip(F.col("l").alias("line"), F.col("at").alias("start"))).alias("line_no", "x")).select(key, "line_no", F.col("x.line").alias("line"), F.col("x.start").alias("start"), (F.col("x.start") + F.octet_length("x.line")).alias("stop"))


def text_chapters(docs: DataFrame, key: str, body: str, rules: list[tuple] = text.TITLE_RULES, titles: DataFrame | None = None) -> DataFrame:
    """(key, idx, title, rule, start_pos, end_pos, word_count): title lines and the byte span up to the next title."""
    found = titles if titles is not None else lines(docs, key, body).withColumn("t", text.title_rule(F.trim("line"), rules)).where("t is not null").select(key, "start", F.col("t.title").alias("title"), F.col("t.rule").alias("rule"))
    sizes = docs.select(key, F.octet_length(body).cast("long").alias("size"))
    by = Window.partitionBy(key).orderBy("start")
    spans = found.join(sizes, key).withColumns({"idx": F.row_number().over(by) - 1, "end_pos": F.coalesce(F.lead("start").over(by), F.col("size"))})
    return spans.select(key, "idx", "title", "rule", F.col("start").alias("start_pos"), "end_pos", text.span_words(F.col("start"), F.col("end_pos")).alias("word_count"))


def upload_chapters(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, idx, title, content) of uploaded texts: lines up to the next title; what stands before the first one goes.

    The running number of titles over a text's lines names the chapter that a line belongs to.
    """
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines(docs, key, body).withColumn("title", text.upload_title(trimmed)).withColumn("n", F.count("title").over(by)).where("n > 0")
    held = rows.groupBy(key, "n").agg(F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("content"))
    return held.select(key, (F.col("n") - 1).alias("idx"), "title", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


def json_chapters(docs: DataFrame, body: str, rules: dict[str, str] | None = None) -> DataFrame:
    """docs with a row per chapter (idx, title, chapter_url) of JSON contents, by rules or by the usual keys; blank titles go."""
    rows = json_paths.listed(F.col(body), rules["list"]) if rules else json_paths.default_chapters(F.col(body))

    def named(item: Column) -> Column:
        got = json_paths.fields(item, {"title": rules["title"], "url": rules["url"]}) if rules else {k: json_paths.aliases(item, v) for k, v in json_paths.CHAPTER_KEYS.items()}
        return F.struct(got["title"].alias("title"), got["url"].alias("url"))

    # named before they are told apart: a filter over the rows would work the titles out once more
    got = docs.select("*", F.posexplode(F.transform(rows, named)).alias("idx", "_item"))
    return got.withColumns({"title": F.col("_item.title"), "chapter_url": F.col("_item.url")}).where(F.trim("title") != "").drop(body, "_item")


def search_one(sources: DataFrame, pages: DataFrame, rules: dict[str, str], key: str, source_id: int) -> DataFrame:
    """search() in one enabled source, all its results."""
    asked = sources.where((F.col("id") == source_id) & F.col("enabled")).select(F.col("id").alias("source_id"), F.replace("search_url", F.lit("{{key}}"), F.lit(key)).alias("url"), "base_url")
    return list_page(fetch(allowed(asked), pages).where("found"), rules, "body", "base_url")


def first_in_full(sources: DataFrame, pages: DataFrame, search_rules: dict[str, str], info_rules: dict[str, str], chapter_rules: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """In one call: the first search result's details, and its contents."""
    info = book_info(search(sources, pages, search_rules, key, limit=1), pages, info_rules)
    return info, chapters(info.select("name", "url"), pages, chapter_rules, "name")


def explore_home(sources: DataFrame, pages: DataFrame, rules: dict[str, str], page_no: int, size: int) -> DataFrame:
    """Explore without an explore URL: each source's home page read by its search rule, one page of its books."""
    home = F.when(F.col("base_url").startswith("http"), F.col("base_url")).otherwise(F.concat(F.lit("https://"), F.col("base_url")))
    asked = sources.where(F.trim("base_url") != "").select(F.col("id").alias("source_id"), home.alias("url"), home.alias("home"))
    rows = list_page(fetch(asked, pages).where("found"), rules, "body", "home")
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("pos")) - 1
    return rows.withColumn("at", at).where((F.col("at") >= (page_no - 1) * size) & (F.col("at") < page_no * size)).drop("at", "home")


def rule_hits(docs: DataFrame, key: str, body: str, rules: list[tuple] = text.TITLE_RULES) -> DataFrame:
    """(key, rule, hits, priority) over the lines of each text."""
    return lines(docs, key, body).withColumn("t", text.title_rule(F.trim("line"), rules)).where("t is not null").groupBy(key, F.col("t.rule").alias("rule")).agg(F.count(F.lit(1)).alias("hits"), F.max("t.priority").alias("priority"))


def best_rule(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.max_by("rule", F.struct("hits", "priority")).alias("rule"), F.max("hits").alias("hits"))


def split_long(docs: DataFrame, key: str, body: str, most: int) -> DataFrame:
    """(key, part, text): a text is cut at a paragraph when the running length passes the limit."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches):
            out = []
            for t in b.to_pylist():
                parts, now, n = [], [], 0
                for p in (t or "").split("\n"):
                    if now and n + len(p) > most:
                        parts.append("\n".join(now))
                        now, n = [], 0
                    now.append(p)
                    n += len(p)
                out.append([*parts, "\n".join(now)])
            yield pa.array(out, pa.list_(pa.string()))

    return docs.select(key, F.posexplode(F.arrow_udf(run, "array<string>")(F.col(body))).alias("part", "text"))


def spine_titles(spine: DataFrame, toc: DataFrame, path: str = "path") -> DataFrame:
    """Spine documents with their title from the contents, else from the file name."""
    titles = toc.groupBy(path).agg(F.min_by("title", "pos").alias("title"))
    return spine.join(titles, path, "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), text.upload_name(F.col(path))))
