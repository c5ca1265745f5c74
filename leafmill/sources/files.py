"""Local books: registry of formats, storing by content, charsets, and readers of TXT, EPUB, CBZ and PDF bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import dom, text
from leafmill.functions.batches import pieces

MAX_BYTES = 50 << 20
FORMATS = {".txt": "txt", ".epub": "epub", ".cbz": "cbz", ".pdf": "pdf"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format) of a folder of books."""
    return spark.read.format("binaryFile").load(path).select("path", "content").withColumn("format", format_of(F.col("path"))).where("format is not null")


def format_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.[^./\\]*$", 0))
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[ext]


def store(files: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """New files with their content id: none over the size limit, none stored already, one a content."""
    rows = files.where(F.octet_length(content) <= MAX_BYTES).withColumn("id", text.content_id(F.col(content)))
    return rows.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


# ---- charsets ----

_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def charset(data: bytes, hint: str = "") -> tuple[str, int]:
    """(encoding, bytes of the mark): by mark, then the hint, UTF-8, GB18030, UTF-16 by its zeros."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name, len(mark)
    zeros = data[:4096]
    if len(zeros) > 3 and zeros[1::2].count(0) > 0.4 * len(zeros[1::2]):
        return "utf-16-le", 0
    if len(zeros) > 3 and zeros[0::2].count(0) > 0.4 * len(zeros[0::2]):
        return "utf-16-be", 0
    m = re.search(r"charset=[\"']?([\w-]+)", hint, re.I)
    for name in [*([m[1].lower().replace("gb2312", "gb18030").replace("gbk", "gb18030")] if m else []), "utf-8", "gb18030"]:
        try:
            data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        return name, 0
    return "utf-8", 0


#: What an encoding's score is made of, fixed values: that the bytes can be decoded, how few control bytes there are (share, score), how
#: many CJK characters a byte (share, score), and that UTF-8 sequences are whole.
DECODES, CONTROLS, CJK, WHOLE = 0.3, ((0.01, 0.3), (0.05, 0.15)), ((0.1, 0.4), (0.05, 0.2), (0.01, 0.1)), 0.3
_CONTROL = np.isin(np.arange(256), [b for b in range(32) if b not in (9, 10, 13)])
_CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))


def charset_scores(data: bytes) -> dict[str, float]:
    """How well UTF-8, GBK and HZ fit bytes without a mark; an encoding that cannot read them scores 0."""
    if not data:
        return dict.fromkeys(("utf-8", "gbk", "hz"), 0.0)
    controls = np.bincount(np.frombuffer(data, np.uint8), minlength=256)[_CONTROL].sum() / len(data)
    clean = next((s for most, s in CONTROLS if controls < most), 0.0)
    out = {}
    for name, codec in (("utf-8", "utf-8"), ("gbk", "gb18030"), ("hz", "hz")):
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            out[name] = 0.0
            continue
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        n = sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in _CJK)
        extra = WHOLE if name == "utf-8" else next((s for least, s in CJK if n > least * len(text.encode("utf-8", "replace"))), 0.0)
        out[name] = DECODES + clean + extra
    return out


def scored_charset(data: bytes) -> str:
    """The encoding by its mark, else by its zeros, else of the highest score.

    Bytes above 127 that are whole UTF-8 are UTF-8, whatever GBK would make of them; with none of those, HZ needs its shifts.
    """
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    if (name := charset(data)[0]).startswith("utf-16"):
        return name
    scores = charset_scores(data)
    if scores["utf-8"] and max(data, default=0) > 127:
        return "utf-8"
    if b"~{" not in data:
        scores["hz"] = 0.0
    best = max(scores, key=lambda k: (scores[k], k == "utf-8"))
    return best if scores[best] else "utf-8"


def scored(content: Column) -> Column:
    """struct(charset, text) of bytes, the charset by scores."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for data in pieces(batches):
            out = []
            for d in data.to_pylist():
                d = bytes(d or b"")
                name = scored_charset(d)
                skip = next((len(m) for m, n in _BOMS if n == name and d.startswith(m)), 0)
                out.append({"charset": name, "text": d[skip:].decode({"gbk": "gb18030"}.get(name, name), "replace")})
            yield pa.array(out, pa.struct([("charset", pa.string()), ("text", pa.string())]))

    return F.arrow_udf(run, "struct<charset: string, text: string>")(content)


def decode(data: bytes, hint: str = "") -> str:
    name, skip = charset(data, hint)
    return data[skip:].decode(name, "replace")


def decoded(content: Column, hint: Column | None = None) -> Column:
    """struct(text, charset, bom) of bytes."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, hints in pieces(batches):
            out = []
            for d, h in zip(data.to_pylist(), hints.to_pylist(), strict=True):
                d, h = bytes(d or b""), h or ""
                name, skip = charset(d, h)
                out.append({"text": d[skip:].decode(name, "replace"), "charset": name, "bom": skip})
            yield pa.array(out, pa.struct([("text", pa.string()), ("charset", pa.string()), ("bom", pa.int32())]))

    return F.arrow_udf(run, "struct<text: string, charset: string, bom: int>")(content, hint if hint is not None else F.lit(""))


# ---- readers of one archive: small helpers that a task runs per row ----


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(raw: bytes) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def _find(e, name: str):
    return [x for x in e.iter() if _name(x.tag) == name] if e is not None else []


def _said(e, name: str) -> str:
    return next((" ".join("".join(x.itertext()).split()) for x in _find(e, name)), "")


def epub(data: bytes) -> list[dict]:
    """Chapters in spine order with titles of the NCX or nav contents; a broken archive gives none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
        opf_path = next((x.get("full-path", "") for x in _find(_xml(z.read("META-INF/container.xml")), "rootfile")), "")
        opf = _xml(z.read(opf_path))
    except (zipfile.BadZipFile, KeyError, ValueError):
        return []
    base = posixpath.dirname(opf_path)
    place = lambda href: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
    items = {x.get("id"): x for x in _find(opf, "item")}
    titles: dict[str, str] = {}
    for x in items.values():
        path = place(x.get("href", ""))
        if path not in names:
            continue
        inside = posixpath.dirname(path)
        if x.get("media-type") == "application/x-dtbncx+xml":
            for p in _find(_xml(z.read(path)), "navPoint"):
                src = next((c.get("src", "") for c in _find(p, "content")), "")
                titles.setdefault(posixpath.normpath(posixpath.join(inside, unquote(src.split("#")[0]))), _said(p, "text"))
        elif "nav" in (x.get("properties") or "").split():
            for a in dom.select(dom.parse(z.read(path).decode("utf-8", "replace")), "nav a[href]"):
                titles.setdefault(posixpath.normpath(posixpath.join(inside, unquote(a.attrs["href"].split("#")[0]))), " ".join(a.text().split()))
    out, book, author = [], _said(opf, "title"), _said(opf, "creator")
    for ref in _find(opf, "itemref"):
        item = items.get(ref.get("idref"))
        path = place(item.get("href", "")) if item is not None else ""
        if path in names:
            root = dom.parse(z.read(path).decode("utf-8", "replace"))
            body = next(iter(dom.select(root, "body")), root)
            out.append({"book": book, "author": author, "idx": len(out), "title": titles.get(path) or posixpath.splitext(posixpath.basename(path))[0], "path": path, "text": dom.block_text(body)})
    return out


def _natural(name: str):
    return [(len(x), x) if x.isdigit() else (0, x) for x in re.findall(r"\d+|\D", name.lower())]


def cbz(data: bytes) -> list[dict]:
    """Images in natural order as chapters, with the ComicInfo title and writer."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return []
    info = next((_xml(z.read(n)) for n in z.namelist() if posixpath.basename(n).lower() == "comicinfo.xml"), None)
    pics = sorted((n for n in z.namelist() if re.search(r"(?i)\.(jpe?g|gif|png|bmp|webp|svg)$", n)), key=_natural)
    return [{"book": _said(info, "Title"), "author": _said(info, "Writer"), "idx": i, "title": posixpath.basename(n), "path": n, "text": ""} for i, n in enumerate(pics)]


def pdf(data: bytes) -> list[dict]:
    """One chapter of the text between BT and ET of plain and deflated streams; idx 0."""
    streams = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            streams.append(zlib.decompressobj().decompress(m[1]))
        except zlib.error:
            continue
    said = []
    for s in streams:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", s, re.S):
            for m in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>", block):
                if m[2] is not None:
                    h = re.sub(rb"\s", b"", m[2])
                    said.append(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()).decode("latin-1"))
                else:
                    plain = re.sub(rb"\\([0-7]{1,3})", lambda o: bytes([int(o[1], 8) & 255]), m[1])
                    said.append(re.sub(rb"\\(.)", lambda o: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(o[1], o[1]), plain, flags=re.S).decode("latin-1"))
    title = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", data)
    return [{"book": title[1].decode("latin-1") if title else "", "author": "", "idx": 0, "title": f"{len(re.findall(rb'/Type\s*/Page\b', data))} pages", "path": "", "text": " ".join(said)}] if data.startswith(b"%PDF") else []


_CHAPTER = pa.struct([("book", pa.string()), ("author", pa.string()), ("idx", pa.int32()), ("title", pa.string()), ("path", pa.string()), ("text", pa.string())])


def chapters(files: DataFrame, content: str = "content", kind: str = "format") -> DataFrame:
    """files with one row per chapter of their EPUB, CBZ or PDF content (column ch); files with none give no row."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, kinds in pieces(batches):
            yield pa.array([{"epub": epub, "cbz": cbz, "pdf": pdf}.get(k, lambda _: [])(bytes(d or b"")) for d, k in zip(data.to_pylist(), kinds.to_pylist(), strict=True)], pa.list_(_CHAPTER))

    schema = "array<struct<book: string, author: string, idx: int, title: string, path: string, text: string>>"
    return files.select(*[c for c in files.columns if c != content], F.explode(F.arrow_udf(run, schema)(F.col(content), F.col(kind))).alias("ch"))


# ---- JSON collections ----


def collection(df: DataFrame, body: str, wrappers: tuple[str, ...] = ("sources", "bookSources", "rssSources")) -> DataFrame:
    """(pos, json, error): entries of an array, of a wrapper's list, or a single object; what is none of them is an error row."""
    raw = F.ltrim(body)
    inner = F.coalesce(*[F.get_json_object(body, f"$.{w}") for w in wrappers])
    listed = F.when(F.try_parse_json(body).isNull(), F.lit(None)).when(raw.startswith("["), F.from_json(body, "array<string>")).when(inner.startswith("["), F.from_json(inner, "array<string>")).when(raw.startswith("{"), F.array(body))
    rest = [c for c in df.columns if c != body]
    got = df.select(*rest, F.posexplode_outer(listed).alias("pos", "json"))
    return got.withColumn("error", F.when(F.col("json").isNull(), "no collection").when(F.coalesce(F.get_json_object("json", "$.bookSourceName"), F.get_json_object("json", "$.sourceName"), F.get_json_object("json", "$.name"), F.lit("")) == "", "no name"))


def converted(json: Column) -> dict[str, Column]:
    """A source of an older kind as today's columns: names, order and mode fall back as they can be told from the rest."""
    said = lambda k: F.coalesce(F.trim(F.get_json_object(json, f"$.{k}")), F.lit(""))
    either = lambda *v: F.coalesce(*[F.nullif(x, F.lit("")) for x in v], F.lit(""))
    base = either(said("bookSourceUrl"), said("baseUrl"))
    host = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("HOST")), F.lit("")), r"^www\.", "")
    derived = F.when(host != "", host).when(F.octet_length(base) > 48, F.concat(F.substring(base, 1, 48), F.lit("..."))).otherwise(base)
    number = lambda k: F.coalesce(F.get_json_object(json, f"$.{k}").try_cast("int"), F.lit(0))
    rule = flat_rule(json, "ruleSearch")
    low = F.lower(F.trim(rule))
    bare = F.trim(rule)
    mode = (
        F.when(bare == "", "")
        .when(bare.startswith("$") | bare.contains("$.") | low.startswith("@json:"), "jsonpath")
        .when(bare.startswith("//") | low.startswith("@xpath:"), "xpath")
        .when(low.startswith("@css:"), "css")
        .when(bare.startswith(":") | low.startswith("@regex:"), "regex")
        .otherwise("default")
    )
    info = [F.when(said(f"ruleBookInfo.{k}") != "", F.concat(F.lit(f"{k}:"), F.get_json_object(json, f"$.ruleBookInfo.{k}"))) for k in ("author", "coverUrl", "intro", "name", "kind", "lastChapter", "wordCount", "status")]
    return {
        "name": either(said("bookSourceName"), said("name"), derived),
        "base_url": base,
        "search_url": said("searchUrl"),
        "enabled": F.coalesce(F.get_json_object(json, "$.enabled") == "true", F.lit(False)),
        "group": said("bookSourceGroup"),
        "order": F.when(number("weight") != 0, number("weight")).otherwise(number("customOrder")),
        "search_rule": rule,
        "search_mode": mode,
        "info_rule": F.concat_ws("&&", *info),
        "toc_rule": flat_rule(json, "ruleToc"),
        "content_rule": flat_rule(json, "ruleContent"),
    }


def flat_rule(json: Column, key: str) -> Column:
    """A rule as one text: a text as it is, {type, rule} as <type>rule, a list joined by @, any other object as JSON."""
    got = F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(""))

    def one(x: Column) -> Column:
        kind, rule = F.get_json_object(x, "$.type"), F.get_json_object(x, "$.rule")
        return F.when(kind.isNotNull() & rule.isNotNull(), F.concat(F.lit("<"), kind, F.lit(">"), rule))

    parts = F.transform(F.from_json(got, "array<string>"), lambda x: F.when(x.startswith("{"), F.coalesce(one(x), F.lit(""))).otherwise(x))
    return F.when(got.startswith("[") & parts.isNotNull(), F.array_join(parts, "@")).when(got.startswith("{"), F.coalesce(one(got), got)).otherwise(got)
