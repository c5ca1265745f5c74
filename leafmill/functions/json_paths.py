"""JSON path rules on get_json_object and from_json: scalars, wildcards, slices, roots, fall-backs and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import lists

_SLICE = re.compile(r"^(.*?)\[(-?\d*):(-?\d*)\](.*)$")


def to_path(rule: str) -> str:
    """A rule as a path that starts at the root; a trailing [*] is the list itself."""
    rule = re.sub(r"^@?json:", "", rule.strip(), flags=re.I).strip()
    rule = rule[:-3] if rule.endswith("[*]") else rule
    if rule in ("", "$", "$."):
        return "$"
    return rule if rule.startswith("$") else "$" + (rule if rule.startswith("[") else f".{rule}")


def _number(text: Column) -> Column:
    """Numbers without a fraction of zeros."""
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def items(doc: Column, rule: str) -> Column:
    """The JSON texts of the array at a path; a scalar or object is a list of itself; nothing there is an empty list."""
    path = to_path(rule)
    if path == "$":
        return F.coalesce(F.when(F.ltrim(doc).startswith("["), F.from_json(doc, "array<string>")).otherwise(F.map_values(F.from_json(doc, "map<string,string>"))), F.array().cast("array<string>"))
    listed = lists.bound(F.get_json_object(doc, path), lambda got: F.when(got.startswith("["), F.from_json(got, "array<string>")).when(got.isNotNull(), F.array(got)))
    return F.coalesce(listed, F.array().cast("array<string>"))


def query(doc: Column, rule: str) -> Column:
    """Values at a path as texts.  Slices [s:e] take half-open ranges; a negative start is 0, a negative end all."""
    if m := _SLICE.match(rule):
        base, start, stop, rest = m[1], max(0, int(m[2] or 0)), int(m[3]) if m[3] else -1, m[4].lstrip(".")
        rows = items(doc, base or "$")
        rows = F.slice(rows, start + 1, F.greatest((F.size(rows) if stop < 0 else F.least(F.lit(stop), F.size(rows))) - start, F.lit(0)))
        rows = F.transform(rows, lambda x: F.get_json_object(x, to_path(rest))) if rest else rows
        return F.transform(F.filter(rows, lambda x: x.isNotNull()), _number)
    return F.transform(F.filter(items(doc, rule), lambda x: x.isNotNull()), _number)


def value(doc: Column, rule: str) -> Column:
    """The first value at a path, or ''."""
    if _SLICE.match(rule) or to_path(rule) == "$":
        return F.coalesce(F.get(query(doc, rule), F.lit(0)), F.lit(""))
    first = lambda got: F.get(F.filter(F.from_json(got, "array<string>"), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(lists.bound(F.get_json_object(doc, to_path(rule)), lambda got: _number(F.when(got.startswith("["), first(got)).otherwise(got))), F.lit(""))


def first_of(doc: Column, rule: str) -> Column:
    """The first non-empty of p1&&p2&&..., each a path or a template with {{path}}."""
    each = []
    for part in (p.strip() for p in rule.split("&&")):
        if "{{" in part:
            pieces = re.split(r"\{\{([^}]+)\}\}", part)
            each.append(F.concat(*[F.coalesce(F.get_json_object(doc, to_path(x)), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(pieces)]))
        elif part:
            each.append(value(doc, part))
    return lists.first_that(each[:-1], lambda x: x != "", each[-1]) if each else F.lit("")


def aliases(doc: Column, names: list[str]) -> Column:
    """The first non-empty of several keys."""
    return lists.first_that([F.get_json_object(doc, f"$.{n}") for n in names], lambda x: x != "", F.lit(""))


def is_json(doc: Column) -> Column:
    return F.try_parse_json(doc).isNotNull()


def flat(rows: Column) -> Column:
    """Nested JSON arrays flattened, however deep: as many steps as brackets can be inside one another, while any is left."""
    nested = lambda x: F.ltrim(x).startswith("[") & F.from_json(x, "array<string>").isNotNull()
    step = lambda xs: F.flatten(F.transform(xs, lambda x: F.when(nested(x), F.from_json(x, "array<string>")).otherwise(F.array(x))))
    most = F.coalesce(F.array_max(F.transform(rows, lambda x: F.coalesce(F.regexp_count(x, F.lit(r"\[")), F.lit(0)))), F.lit(0))
    return F.when(most == 0, rows).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), rows.cast("array<string>"), lambda xs, _: F.when(F.exists(xs, nested), step(xs)).otherwise(xs)))


#: Where list pages keep their rows and what they call a book's fields, fixed values.
LIST_KEYS = ("list", "data", "books", "result", "items", "data.list")
BOOK_KEYS = {"name": ["name", "title", "bookName"], "author": ["author", "bookAuthor"], "url": ["url", "bookUrl", "link"], "intro": ["intro", "description", "summary"]}


#: What detail pages and contents call their fields, and where contents keep their rows, fixed values, tried in this order.
DETAIL_KEYS = {
    "name": ["name", "title", "bookName", "book.name"],
    "author": ["author", "authorName", "book.author"],
    "url": ["bookUrl", "url", "book.url"],
    "cover": ["coverUrl", "cover", "book.cover"],
    "intro": ["intro", "description", "introduction", "book.description"],
    "category": ["category", "tag", "genre", "book.category"],
    "last_chapter": ["lastChapter", "latestChapter", "lastChapterName"],
    "last_chapter_url": ["lastChapterUrl", "latestChapterUrl", "lastChapter.url"],
    "update_time": ["updateTime", "lastUpdateTime"],
    "status": ["status", "bookStatus", "book.status"],
    "publisher": ["publisher", "publishInfo"],
    "isbn": ["isbn", "ISBN"],
}
CHAPTER_KEYS = {"title": ["title", "name", "chapterTitle"], "url": ["url", "chapterUrl", "link"]}
CHAPTER_LISTS = ("list", "data", "chapters", "toc", "volume.chapters")


#: Details that are numbers or lists, and what content pages call their fields, fixed values, tried in this order.
DETAIL_NUMBERS = {"rating": ["rating", "score", "book.rating"], "word_count": ["wordCount", "size", "book.wordCount"]}
TAG_LISTS, TAG_TEXT = ("tags", "tag"), "tags"
CONTENT_KEYS = {"content": ["content", "body", "text"], "title": ["title"], "prev_url": ["prevUrl", "prev"], "next_url": ["nextUrl", "next"]}
IMAGE_LISTS = ("images", "imgs", "imageList", "pics")


def _number_of(doc: Column, names: list[str], kind: str) -> Column:
    """The first of several keys whose number is not zero, or 0."""
    each = [F.nullif(F.get_json_object(doc, f"$.{n}").try_cast("double"), F.lit(0.0)) for n in names]
    return F.coalesce(*each, F.lit(0.0)).cast(kind)


def _array_at(doc: Column, key: str) -> Column:
    """The texts of the array at a key that are not blank; null if there is no array."""
    got = F.get_json_object(doc, f"$.{key}")
    return F.when(got.startswith("["), F.filter(F.transform(F.from_json(got, "array<string>"), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))


def default_numbers(doc: Column) -> dict[str, Column]:
    """A book's rating, words and tags by the usual keys; tags are the first list there is, else a text's parts between commas."""
    said = F.coalesce(F.get_json_object(doc, f"$.{TAG_TEXT}"), F.lit(""))
    parts = F.filter(F.transform(F.split(said, ","), lambda x: F.trim(x)), lambda x: x != "")
    return {"rating": _number_of(doc, DETAIL_NUMBERS["rating"], "double"), "word_count": _number_of(doc, DETAIL_NUMBERS["word_count"], "long"), "tags": F.coalesce(*[_array_at(doc, k) for k in TAG_LISTS], parts)}


def default_content(doc: Column) -> dict[str, Column]:
    """A chapter's content by the usual keys: texts and links, the first list with images, words (bytes without blanks), and the mode of reading."""
    found = {k: aliases(doc, names) for k, names in CONTENT_KEYS.items()}
    lists = [_array_at(doc, k) for k in IMAGE_LISTS]
    images = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
    words = F.octet_length(F.replace(found["content"], F.lit(" "), F.lit("")))
    return {**found, "images": images, "word_count": words.cast("long"), "mode": F.when(F.size(images) > 0, "comic").otherwise("text")}


def default_detail(doc: Column) -> dict[str, Column]:
    """A book's fields by the usual keys."""
    return {k: aliases(doc, names) for k, names in DETAIL_KEYS.items()}


def fields(doc: Column, rules: dict[str, str]) -> dict[str, Column]:
    """Fields of a document by rules, each with fall-backs; a missing rule gives ''."""
    return {k: first_of(doc, rule) for k, rule in rules.items()}


def _first_array(doc: Column, paths: list[str], empty: bool = False) -> Column:
    """The JSON text of the first array at the paths, be it empty or not; null if there is none."""
    is_array = lambda x: x.startswith("[") if empty else x.startswith("[") & (x != "[]")
    return lists.first_that([F.get_json_object(doc, p) for p in paths], is_array, F.lit(None).cast("string"))


def _rows_of(array: Column) -> Column:
    return F.coalesce(F.from_json(array, "array<string>"), F.array().cast("array<string>"))


def listed(doc: Column, rule: str) -> Column:
    """The rows at the first path of p1&&p2&&... that holds a non-empty array."""
    return _rows_of(_first_array(doc, [to_path(p.strip()) for p in rule.split("&&") if p.strip()]))


def default_chapters(doc: Column) -> Column:
    """The rows of contents without a rule: the root array, or the first usual key with an array, be it empty."""
    held = _first_array(doc, [f"$.{k}" for k in CHAPTER_LISTS], empty=True)
    return _rows_of(F.when(F.ltrim(doc).startswith("["), doc).otherwise(held))


def default_items(doc: Column) -> Column:
    """The rows of a list page without a rule: the root array, or the first usual key with a non-empty array."""
    return _rows_of(F.when(F.ltrim(doc).startswith("["), doc).otherwise(_first_array(doc, [f"$.{k}" for k in LIST_KEYS])))


def default_book(item: Column) -> dict[str, Column]:
    return {k: aliases(item, names) for k, names in BOOK_KEYS.items()}
