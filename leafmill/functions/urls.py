"""URL templates, resolution and checks as column expressions; templates are parsed once, when the plan is built."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import lists


@dataclass(frozen=True)
class Template:
    url: str
    pages: tuple[str, ...] = ()
    method: str = "GET"
    headers: dict = field(default_factory=dict)
    body: str = ""
    charset: str = ""
    retry: int = 0
    has_script: bool = False

    @property
    def required(self) -> list[str]:
        return [m.strip() for m in re.findall(r"\{\{([^}]+)\}\}", self.url)]


def loose_json(text: str) -> dict:
    """A JSON object, or one with single quotes and bare keys; {} if it is neither."""
    for t in (text, re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', re.sub(r"'([^']*)'", r'"\1"', text))):
        try:
            got = json.loads(t)
            return got if isinstance(got, dict) else {}
        except ValueError:
            continue
    return {}


def parse_template(text: str) -> Template:
    """url,{options}; <js> parts are noted and left out; <a,b,c> lists values by page."""
    bare = re.sub(r"<js>.*?</js>", "", text, flags=re.S)
    url, _, rest = bare.partition(",{") if re.search(r",\s*\{", bare) else (bare, "", "")
    options = loose_json("{" + rest) if rest else {}
    pages = re.search(r"<([^<>]*,[^<>]*)>", url)
    body = options.get("body", "")
    return Template(
        url=url.strip(),
        pages=tuple(x.strip() for x in pages[1].split(",")) if pages else (),
        method=str(options.get("method", "GET")).upper(),
        headers=dict(options.get("headers") or {}),
        body=body if isinstance(body, str) else json.dumps(body),
        charset=str(options.get("charset", "")),
        retry=int(options.get("retry", 0) or 0),
        has_script=bare != text,
    )


def page_value(pages: tuple[str, ...], page: Column, beyond: str = "last") -> Column:
    """The list's value for a page; a page beyond it takes the last value (or the first), an empty list the page itself."""
    if not pages:
        return page.cast("string")
    at = F.greatest(page, F.lit(1))
    at = F.least(at, F.lit(len(pages))) if beyond == "last" else F.when(at > len(pages), 1).otherwise(at)
    return F.element_at(F.array(*map(F.lit, pages)), at.cast("int"))


def single_slashes(url: Column) -> Column:
    """Runs of slashes after the scheme become one."""
    head = F.regexp_extract(url, "^(.*?://)", 1)
    return F.concat(head, F.regexp_replace(F.substr(url, F.char_length(head) + 1), "/{2,}", "/"))


def evaluate(template: Template, params: dict[str, Column], page: Column, beyond: str = "last") -> Column:
    """The template's URL with its values; double braces before single ones, page as a number."""
    url = F.lit(template.url)
    if template.pages:
        url = F.replace(url, F.lit(re.search(r"<[^<>]*,[^<>]*>", template.url)[0]), page_value(template.pages, page, beyond))
    for k, v in {**params, "page": page.cast("string")}.items():
        url = F.replace(F.replace(url, F.lit("{{" + k + "}}"), v), F.lit("{" + k + "}"), v)
    return single_slashes(url)


def encode(text: Column) -> Column:
    """Form encoding: a space is a plus."""
    return F.url_encode(text)


def search_url(template: str, base: Column, key: Column, page: Column) -> Column:
    """A source's search URL: the key encoded, relative to the source's base."""
    return absolutize(base, evaluate(parse_template(template), {"key": encode(key), "searchKey": encode(key)}, page))


def source_url(template: str, base: Column, value: Column, **more: Column) -> Column:
    """A source's info, contents or text URL."""
    if not template:
        return absolutize(base, value)
    names = ("bookUrl", "tocUrl", "chapterUrl", "url", "id")
    return absolutize(base, evaluate(parse_template(template), {**dict.fromkeys(names, value), **more}, F.lit(1)))


def absolutize(base: Column, raw: Column) -> Column:
    """raw if it is absolute, else the base (up to # and without a last slash) and raw with a first slash."""
    root = F.regexp_replace(F.split_part(base, F.lit("#"), F.lit(1)), "/+$", "")
    return F.when(is_http(raw), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(root, raw)).otherwise(F.concat(root, F.lit("/"), raw))


def join_loose(base: Column, href: Column) -> Column:
    """How pages' feed readers join: // is https, /x is on the host, anything else follows the base."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(href == "", "").when(is_http(href), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), href))


def undouble(url: Column) -> Column:
    """The second URL of two that were glued together."""
    return F.when(url.rlike(r"^.+https?://"), F.regexp_extract(url, r"^.+(https?://.*)$", 1)).otherwise(url)


def is_http(url: Column) -> Column:
    return url.rlike(r"^\s*https?://")


def first_http(*urls: Column) -> Column:
    """The first http(s) URL, or ''."""
    return F.coalesce(F.get(F.filter(F.array(*urls), lambda u: u.isNotNull() & is_http(u)), F.lit(0)), F.lit(""))


#: Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B).
_PIECES = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(segments: Column) -> Column:
    """Segments with . and .. worked off; one of them at the end leaves a slash."""
    none = F.array().cast("array<string>")
    step = lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    left = F.aggregate(segments, none, step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)


def _merged_path(base: Column, path: Column, authority: Column) -> Column:
    """The reference's path, after the base's up to its last slash if it is relative; without dots, and joined ones without empty segments."""
    above = F.regexp_replace(base, "[^/]*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(above, path))
    parts = F.split(whole, "/", -1)
    n = F.size(parts)
    filled = F.filter(parts, lambda x, i: (x != "") | (i == 0) | (i == n - 1) | path.startswith("/"))
    joined = F.array_join(_without_dots(filled), "/")
    out = F.when(joined == "", "/").otherwise(joined)
    return F.when((authority != "") & ~out.startswith("/"), F.concat(F.lit("/"), out)).otherwise(out)


def resolve(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of a reference, blanks at its ends and line ends inside it left out; null stays null.

    An absolute reference stays as it is, one without a base too; a fold over the path's segments keeps those that no .. takes back.
    """
    return lists.bound(ref, lambda r: lists.bound(F.translate(F.trim(r), "\t\r\n", ""), lambda said: _resolved(base, r, said)))


def _resolved(base: Column, ref: Column, said: Column) -> Column:
    """resolve() of a reference that is cleaned already: said."""
    mark = {2: "//", 4: "?", 5: "#"}  # alone, it says nothing

    def of(text: Column, k: int) -> Column:
        piece = F.coalesce(F.regexp_extract(text, _PIECES, k), F.lit(""))
        return F.when(piece == mark[k], "").otherwise(piece) if k in mark else piece

    from_ = F.coalesce(F.trim(base), F.lit(""))
    host = F.regexp_extract(from_, r"^(https?://[^/?#]+)", 1)
    whole = said.rlike(r"^https?://")
    rooted = (host != "") & said.rlike(r"^/(?:[^/.\s;?#][^.\s;?#]*)?$") & ~said.contains("//")
    scheme, same = of(said, 1), F.lower(of(said, 1)) == F.lower(of(from_, 1))
    authority, path, query, fragment = (of(said, k) for k in (2, 3, 4, 5))
    front = F.when(of(from_, 1) != "", F.concat(F.lower(of(from_, 1)), F.lit(":"))).otherwise("")
    foreign = (scheme != "") & (~same | (authority != ""))
    same_path = F.concat(front, of(from_, 2), of(from_, 3), F.when(query != "", query).otherwise(of(from_, 4)), fragment)
    merged = F.concat(front, of(from_, 2), _merged_path(of(from_, 3), path, of(from_, 2)), query, fragment)
    return (
        F.when(said.isNull(), None)
        .when(from_ == "", F.trim(ref))
        .when(whole, said)
        .when(said == "", from_)
        .when(rooted, F.concat(host, said))
        .when(foreign & same, F.concat(front, F.substr(said, F.length(scheme) + 2)))
        .when(foreign, said)
        .when(authority != "", F.concat(front, said))
        .when(path == "", same_path)
        .otherwise(merged)
    )


@F.arrow_udf(T.BooleanType())
def _public(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for hosts in parts:
        out = []
        for h in hosts.to_pylist():
            try:
                ip = ipaddress.ip_address((h or "").strip("[]"))
                out.append(ip.is_global and not ip.is_multicast)
            except ValueError:
                out.append(bool(h))
        yield pa.array(out, pa.bool_())


def is_allowed(url: Column) -> Column:
    """http(s) with a host that is neither local nor a private, loopback, link-local or shared address; names are not looked up."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    plain = F.coalesce(scheme.isin("http", "https") & (host != "") & ~host.rlike(r"(^|\.)localhost$") & ~host.rlike(r"\.(local|internal)$"), F.lit(False))
    return plain & _public(F.coalesce(host, F.lit("")))


def explore_tabs(text: Column) -> Column:
    """ARRAY<STRUCT<title, url>> of a JSON list of tabs or of title::url lines; entries without a URL go."""
    tab = "array<struct<title: string, url: string>>"
    listed = F.from_json(text, tab, {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
    lines = F.transform(F.filter(F.split(text, r"\n|&&"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.when(x.contains("::"), F.trim(F.split_part(x, F.lit("::"), F.lit(1)))).otherwise("").alias("title"), F.trim(F.when(x.contains("::"), F.split_part(x, F.lit("::"), F.lit(2))).otherwise(x)).alias("url")))
    return F.filter(F.when(F.ltrim(text).startswith("["), listed).otherwise(lines), lambda t: F.coalesce(t["url"], F.lit("")) != "")


def choose_tab(tabs: Column, wanted: Column) -> Column:
    """The tab with this title, else the first whose title holds it, else the first."""
    exact = F.get(F.filter(tabs, lambda t: t["title"] == wanted), F.lit(0))
    near = F.get(F.filter(tabs, lambda t: (wanted != "") & t["title"].contains(wanted)), F.lit(0))
    return F.coalesce(exact, near, F.get(tabs, F.lit(0)))


#: Marks of pages that scripts build, fixed values, looked for in lower case.
SCRIPT_MARKS = ("react", "vue", "angular", "next.js", "nuxt", "window.__initial", "window.__data", "window.__app", "#app", "#root", "[data-reactroot]")


def needs_browser(url: Column, body: Column) -> Column:
    """Whether a page looks as if it were built by scripts."""
    low = F.lower(body)
    many = (F.regexp_count(low, F.lit("<script")) > 5) & (F.octet_length(body) < 5000)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in SCRIPT_MARKS], url.contains("webView") | low.contains("<noscript>") | many)
