"""Text functions as column expressions: cleaning, replace rules, counts, ids, dates, similarity, title rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import java_replacement, valid

_BLANK = r"[\s\h\x{0085}]"


def apply_rule(text: Column, pattern: str, replacement: str, ignore_case: bool = False, enabled: bool = True) -> Column:
    """One replace rule; a disabled or empty one changes nothing; an invalid pattern is replaced literally."""
    if not enabled or not pattern:
        return text
    if not valid(pattern):
        return F.replace(text, F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(text, F.lit(f"(?i){pattern}" if ignore_case else pattern), F.lit(java_replacement(pattern, replacement)))


def apply_rules(text: Column, rules: list[dict], scope: str) -> Column:
    """All enabled rules of a scope ('all' or the scope itself), highest order first, then highest id."""
    for r in sorted(rules, key=lambda r: (-r["order"], -r["id"])):
        if r["scope"] in ("all", scope):
            text = apply_rule(text, r["pattern"], r["replacement"], r.get("case_insensitive", False), r.get("enabled", True))
    return text


def clean_lines(text: Column) -> Column:
    """Trim each line, at most two blank lines in a row, none at the ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{_BLANK}+|{_BLANK}+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n"), r"^\n+|\n+$", "")


def clean_plain(text: Column) -> Column:
    """clean_lines with line ends unified and inner blanks collapsed."""
    return clean_lines(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\x{3000}]+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_non_blank(*values: Column) -> Column:
    """The first value that is not blank, as it is; else ''."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values], F.lit(""))


def base64(text: Column) -> Column:
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def base64_decode(text: Column) -> Column:
    """'' for what is no base64."""
    return F.coalesce(F.try_to_binary(text, F.lit("base64")).cast("string"), F.lit(""))


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def count_chars(text: Column) -> Column:
    """Ideographs, their punctuation, full-width forms, ASCII letters and digits and six marks."""
    return F.char_length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}a-zA-Z0-9.,!?;:]", ""))


def count_bytes(text: Column) -> Column:
    """Bytes without spaces."""
    return F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def span_words(start: Column, stop: Column, bytes_per_word: int = 3) -> Column:
    return F.floor((stop - start) / bytes_per_word).cast("int")


def number(text: Column) -> Column:
    """A number with the units of ten thousand and a hundred million; null if there is none."""
    unit = F.when(text.contains("亿"), 1e8).when(text.contains("万"), 1e4).otherwise(1.0)
    return F.nullif(F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double") * unit


#: Date formats of feeds and pages, fixed values, tried in this order after the weekday is gone.
TIME_FORMATS = [
    "dd MMM yyyy HH:mm:ss Z",
    "dd MMM yyyy HH:mm:ss z",
    "dd MMM yy HH:mm Z",
    "dd MMM yy HH:mm z",
    "dd MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MMM d, yyyy",
    "MMMM dd, yyyy",
    "yyyy年MM月dd日",
    "yyyy年M月d日",
]


#: Date formats of list pages that are read as feeds, fixed values, tried in this order after the weekday is gone.
PAGE_TIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "dd MMM yyyy HH:mm:ss Z",
    "dd MMM yyyy HH:mm:ss z",
    "dd MMM yy HH:mm Z",
    "dd MMM yy HH:mm z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "MMM dd, yyyy",
    "MMMM dd, yyyy",
    "yyyy年MM月dd日",
    "yyyy年M月d日",
]


def parse_time(text: Column, formats: list[str] = TIME_FORMATS) -> Column:
    """Lenient timestamp; null if no format fits."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]+, ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


# ---- titles ----

#: What goes from the front of a chapter's title, a fixed value.
_PREFIX = r"^(第[\d一二三四五六七八九十百千万]+章[：:\s\-—]*)"


def normal_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"^\s+|\s+$", ""), _PREFIX, ""), r"[\s\x{3000}]", ""))


def _jaccard(a: Column, b: Column) -> Column:
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _alike(a: Column, b: Column, within: float, otherwise: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), within).otherwise(otherwise)


def title_similarity(a: Column, b: Column) -> Column:
    """1 if equal after normalisation, 0.88 if one holds the other, else the Jaccard of their characters."""
    x, y = normal_title(a), normal_title(b)
    return _alike(x, y, 0.88, _jaccard(x, y))


def text_similarity(a: Column, b: Column) -> Column:
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return text_similarity_of(x, normal_title(x), y, normal_title(y))


def text_similarity_of(x: Column, normal_x: Column, y: Column, normal_y: Column, jaccard: Column | None = None) -> Column:
    """text_similarity() of trimmed texts in small letters whose normalised forms, and their letters' Jaccard similarity, are there already."""
    return _alike(x, y, 0.9, _alike(normal_x, normal_y, 0.88, _jaccard(normal_x, normal_y) if jaccard is None else jaccard))


def book_score(name: Column, author: Column, other_name: Column, other_author: Column) -> Column:
    names = text_similarity(name, other_name)
    return F.when(F.trim(author) == "", names).otherwise(names * 0.65 + text_similarity(author, other_author) * 0.35)


#: Title rules for whole books: name, pattern, priority; fixed values, tried in this order.
TITLE_RULES = [
    ("chapter_standard", r"^(?:第\s*(\d+)\s*[章节卷篇部]\s*)(.+)$", 100),
    ("section_standard", r"^(?:第\s*(\d+)\s*[节篇])\s*(.+)$", 95),
    ("number_dot", r"^(\d+)\s*[.、．]\s*(.+)$", 90),
    ("number_space", r"^(\d+)\s+(.+)$", 85),
    ("roman_numeral", r"^([IVX]+)\s*[.、．]\s*(.+)$", 80),
    ("chinese_number", r"^(第[一二三四五六七八九十百千万]+[章节卷篇部])\s*(.+)$", 75),
    ("bracket_number", r"^[\(（](\d+)[\)）]\s*(.+)$", 70),
    ("square_bracket", r"^\[(\d+)\]\s*(.+)$", 65),
    ("dash_chapter", r"^(?:—|-|·)\s*(?:第\s*\d+\s*[章节])?\s*(.+)$", 60),
    ("pure_title", r"^([^0-9\n。，！？…]{4,30})$", 50),
    ("volume", r"^(?:第\s*([一二三四五六七八九十\d]+)\s*[卷篇])\s*(.+)$", 98),
    ("special_chapter", r"^(?:番外|外传|特别篇|特别章|尾声|后记|序言|序章|引子)\s*[：:：]?\s*(.+)$", 88),
    ("chapter_cn_num", r"^(第[一二三四五六七八九十\d]+章)\s*(.+)$", 92),
    ("english_chapter", r"^(?:Chapter|Section|Part|Book)\s+(\d+)\s*(.+)$", 78),
    ("decorated_title", r"^(?:[-—]{3,}\s*)(.+?)(?:\s*[-—]{3,})$", 45),
    ("short_title", r"^([^0-9\n。，！？…]{2,20})$", 40),
    ("chapter_colon", r"^(第[一二三四五六七八九十\d]+[章节卷篇部])\s*[：:]\s*(.+)$", 93),
    ("filtered_title", r"^([^0-9\n。，！？…]{4,50})$", 30),
]

#: Title rules for uploads: name, pattern, priority; fixed values, tried in this order.
UPLOAD_RULES = [
    ("chapter_cn", r"^[\s]*第[一二三四五六七八九十百千万零\d]+[章节卷篇部集][\s]*[：:．.\s]*[\s]*(.*)$", 100),
    ("chapter_hui", r"^[\s]*第[一二三四五六七八九十百千万零\d]+[回][\s]*[：:．.\s]*[\s]*(.*)$", 95),
    ("chapter_en", r"^[\s]*Chapter[\s]+\d+[\s]*[：:．.\s]*[\s]*(.*)$", 90),
    ("chapter_en_upper", r"^[\s]*CHAPTER[\s]+\d+[\s]*[：:．.\s]*[\s]*(.*)$", 90),
    ("number_dot", r"^[\s]*\d+[\s]*[.．、][\s]*(.*)$", 70),
    ("bracket_number", r"^[\s]*[（(]\d+[)）][\s]*[：:．.\s]*[\s]*(.*)$", 65),
    ("square_bracket", r"^[\s]*[\[【]\d+[\]】][\s]*[：:．.\s]*[\s]*(.*)$", 60),
    ("special", r"^[\s]*[序序章引言前言后记尾声附录][\s]*[：:．.\s]*[\s]*(.*)$", 50),
    ("volume", r"^[\s]*[卷篇部集][\s]*[一二三四五六七八九十百千万零\d]+[\s]*[：:．.\s]*[\s]*(.*)$", 85),
]


#: What the title of an upload's chapter does not hold, fixed values.
UPLOAD_SUSPICIOUS = ("目录", "contents", "content", "index", "版权声明", "版权所有", "copyright", "简介", "介绍", "summary", "作者", "author", "editor", "出版", "publisher", "推荐", "recommend")


def upload_title(line: Column) -> Column:
    """The title of a chapter that begins with this trimmed line, by the first rule that gives an unsuspicious one, else null."""

    def one(pattern: str) -> Column:
        title = F.coalesce(F.nullif(F.trim(F.regexp_extract(line, pattern, 1)), F.lit("")), line)
        return F.when(line.rlike(pattern), title)

    def good(t: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in UPLOAD_SUSPICIOUS])
        return t.isNotNull() & ~odd & F.octet_length(t).between(2, 80)

    return F.when(F.octet_length(line).between(2, 100), F.get(F.filter(F.array(*[one(p) for _, p, _ in UPLOAD_RULES]), good), F.lit(0)))


def with_rule(rules: list[tuple], name: str, pattern: str, priority: int) -> list[tuple]:
    """The rules and one more, by priority."""
    return sorted([*rules, (name, pattern, priority)], key=lambda r: -r[2])


def title_rule(line: Column, rules: list[tuple] = TITLE_RULES, suspicious: tuple[str, ...] = ("http", "www.", ".com"), shortest: int = 2, longest: int = 100) -> Column:
    """struct(title, rule, priority) by the first rule that gives an unsuspicious title, else null; lengths are in bytes."""
    from .regexes import n_groups

    def one(name: str, pattern: str, priority: int) -> Column:
        last = F.trim(F.regexp_extract(line, pattern, min(2, n_groups(pattern))))
        title = last if n_groups(pattern) < 2 else F.coalesce(F.nullif(last, F.lit("")), F.trim(F.regexp_extract(line, pattern, 1)))
        return F.when(line.rlike(pattern), F.struct(title.alias("title"), F.lit(name).alias("rule"), F.lit(priority).alias("priority")))

    def good(c: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.lower(c["title"]).contains(w) for w in suspicious])
        return c.isNotNull() & ~odd & F.octet_length(c["title"]).between(2, 50) & ~c["title"].rlike(r"^[+-]?\d+$")

    found = F.get(F.filter(F.array(*[one(*r) for r in rules]), good), F.lit(0))
    return F.when(F.octet_length(line).between(shortest, longest), found)


#: What a text's name may begin with, fixed values: the first of them in this order goes, whatever its case.
NAME_PREFIXES = ("小说", "txt", "全本小说", "完整版", "免费")
#: What goes from an upload's name, fixed values.
NAME_TAGS = ("【全本】", "【完结】", "(完结)", "（完结）", "【精校】")


def book_name(path: Column) -> Column:
    """A text's name from its path: without folders, the ending .txt and one known prefix."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)\.txt$", "")
    return F.trim(F.regexp_replace(base, "^(?i:" + "|".join(NAME_PREFIXES) + ")", ""))


def upload_name(path: Column) -> Column:
    """An upload's name from its file name: without its ending and the known tags."""
    base = F.trim(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", ""))
    return F.trim(reduce(lambda x, tag: F.replace(x, F.lit(tag), F.lit("")), NAME_TAGS, base))


def natural_key(name: Column) -> Column:
    """Sort key of file names: runs of digits by their length, then by value."""
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D"), F.lit(0)), lambda x: F.struct(F.when(x.rlike(r"^\d"), F.length(x)).otherwise(0).alias("digits"), x.alias("text")))


def is_image(name: Column) -> Column:
    return name.rlike(r"(?i)\.(jpe?g|gif|png|bmp|webp|svg)$")


def image_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "svg", "image/svg+xml").when(ext.isin("gif", "png", "bmp", "webp"), F.concat(F.lit("image/"), ext)).otherwise("application/octet-stream")


#: First bytes of images, in hexadecimal digits, and their types; fixed values.
IMAGE_MARKS = (("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("474946", "image/gif"), ("3C737667", "image/svg+xml"))


def image_type_of(content: Column, name: Column | None = None) -> Column:
    """An image's type by its first bytes, else by its name if there is one."""
    head = F.hex(F.substring(content, 1, 4))
    out = F
    for mark, kind in IMAGE_MARKS:
        out = out.when(head.startswith(mark), kind)
    return out.otherwise("application/octet-stream" if name is None else image_type(name))


def is_isbn(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit("")).rlike(r"^(\d{13}|[\dX]{10})$")


def headers(text: Column) -> Column:
    """A header object as a map; malformed text gives an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def book_key(source_id: Column, url: Column) -> Column:
    return F.concat(source_id.cast("string"), F.lit("::"), url)


def split_key(key: Column) -> Column:
    return F.split(key, "::", 2)


def percent(index: Column, total: Column) -> Column:
    """Reading progress, 0 for an empty book."""
    return F.when(total > 0, F.round((index + 1) / total * 100)).otherwise(0.0)


def merge_headers(*maps: Column) -> Column:
    """Header maps put together; a later one wins."""
    keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.coalesce(*[F.element_at(m, k) for m in reversed(maps)]))))
