"""The rule language: a rule string becomes a few parts with operators, mode, replacements and bindings, once, when a plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.lists import IndexSpec
from leafmill.functions.urls import loose_json

MODES = ("css", "xpath", "json", "regex", "js", "chain", "default")
_PREFIX = {"@css:": "css", "$css:": "css", "@xpath:": "xpath", "$xpath:": "xpath", "@json:": "json", "$json:": "json", "@regex:": "regex", "$regex:": "regex", "@js:": "js", "$js:": "js"}


def split(rule: str) -> tuple[list[str], list[str]]:
    """Parts and the operators between them; operators inside brackets, braces, double quotes or after a backslash do not count.

    A rule that begins or ends with an operator is an error.
    """
    parts, ops, depth, quoted, last, i = [], [], 0, False, 0, 0
    while i < len(rule):
        c = rule[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted:
            if c in "[({":
                depth += 1
            elif c in "])}":
                depth = max(0, depth - 1)
            elif depth == 0 and rule[i : i + 2] in ("&&", "||", "%%"):
                parts.append(rule[last:i])
                ops.append(rule[i : i + 2])
                last = i = i + 2
                continue
        i += 1
    if (depth or quoted) and not ops:  # an unclosed delimiter protects nothing
        pieces = re.split(r"(&&|\|\|)", rule)
        parts, ops = pieces[:-1:2], pieces[1::2]
        last = len(rule) - len(pieces[-1])
    parts.append(rule[last:])
    parts = [p.strip() for p in parts]
    if ops and not (parts[0] and parts[-1]):
        raise ValueError(f"operator without a side in {rule!r}")
    kept = [(p, (["", *ops])[k]) for k, p in enumerate(parts) if p]
    return [p for p, _ in kept], [op for _, op in kept[1:]]


def strip_prefix(rule: str) -> tuple[str, str]:
    low = rule.lower()
    for p, mode in _PREFIX.items():
        if low.startswith(p):
            return mode, rule[len(p) :].strip()
    return "", rule


def detect(rule: str) -> str:
    """Mode of a bare rule."""
    mode, rest = strip_prefix(rule.strip())
    if mode:
        return mode
    rest = rest.strip()
    if rest.startswith("$.") or rest.startswith("$["):
        return "json"
    if rest.startswith("//") or re.match(r"^\(?//?[\w*]+(\[|/|$)", rest) and not rest.endswith("/"):
        return "xpath"
    if (len(rest) > 2 and rest[0] == rest[-1] == "/") or rest.startswith(":"):
        return "regex"
    if rest.startswith("<js>") or re.search(r"\bfunction\b|=>|\bvar\s", rest):
        return "js"
    if re.search(r"(^|@)(class|tag|id|text|children)\.|@(text|html|href|src|textNodes|ownText|all|content)\b", rest) or re.search(r"@\w[\w.]*(@|$)", rest):
        return "chain"
    if re.match(r"^[#.\w\[*]", rest):
        return "css"
    return "default"


def mode_of(rule: Column) -> Column:
    """detect() for a column of rules."""
    bare, low = F.trim(rule), F.lower(F.trim(rule))
    out = F
    for p, mode in _PREFIX.items():
        out = out.when(low.startswith(p), mode)
    return (
        out.when(bare.rlike(r"^\$[.\[]"), "json")
        .when(bare.startswith("//") | (bare.rlike(r"^\(?//?[\w*]+(\[|/|$)") & ~bare.endswith("/")), "xpath")
        .when(bare.rlike(r"^/.+/$") | bare.startswith(":"), "regex")
        .when(bare.rlike(r"^<js>|\bfunction\b|=>|\bvar\s"), "js")
        .when(bare.rlike(r"(^|@)(class|tag|id|text|children)\.|@(text|html|href|src|textNodes|ownText|all|content)\b|@\w[\w.]*(@|$)"), "chain")
        .when(bare.rlike(r"^[#.\w\[*]"), "css")
        .otherwise("default")
    )


#: Prefixes of inline segments, fixed values, in this case only.
INLINE_PREFIXES = {"@XPath:": "xpath", "@Json:": "json", "@CSS:": "css"}


def inline_mode(rule: Column) -> Column:
    """Mode of an inline segment: its prefix, or its first letter."""
    out = F
    for p, mode in INLINE_PREFIXES.items():
        out = out.when(rule.startswith(p), mode)
    return out.when(rule.startswith("$"), "json").when(rule.startswith("/"), "xpath").when(rule.startswith(":"), "regex").otherwise("default")


@dataclass(frozen=True)
class Rule:
    raw: str
    mode: str
    parts: tuple[str, ...]
    ops: tuple[str, ...] = ()
    replaces: tuple[tuple[str, str], ...] = ()
    puts: tuple[str, ...] = ()
    gets: tuple[str, ...] = ()
    expressions: tuple[str, ...] = ()
    groups: tuple[int, ...] = ()

    @property
    def composite(self) -> bool:
        return bool(self.ops)


@lru_cache(maxsize=4096)
def parse(rule: str, mode: str = "") -> Rule:
    """A rule's parts, operators, mode, ##find##repl pairs, @put/@get bindings, {{expressions}} and $n references."""
    puts = tuple(re.findall(r"@put:\{?([\w.]+)", rule))
    gets = tuple(re.findall(r"@get:\{?([\w.]+)\}?", rule))
    expressions = tuple(x.strip() for x in re.findall(r"\{\{(.+?)\}\}", rule, re.S))
    bare = re.sub(r"@put:\{[^}]*\}|@put:\w+(\{[^}]*\})?|@get:(\{[^}]*\}|\w+)", "", rule).strip()
    body, *rest = bare.split("##")
    pairs = tuple((rest[k], rest[k + 1].removesuffix("###") if k + 1 < len(rest) else "") for k in range(0, len(rest), 2) if rest[k])
    prefix, body = strip_prefix(body.strip())
    mode = mode or prefix or detect(body)
    parts, ops = split(body) if body else ([""], [])
    return Rule(rule, mode, tuple(parts), tuple(ops), pairs, puts, gets, expressions, tuple(int(x) for x in re.findall(r"(?<!\$)\$(\d)", body)))


def field_rules(text: str) -> dict[str, str]:
    """Field rules as a JSON object (also with single quotes), as k:v&&k:v, as k::v@k::v, or one list rule."""
    text = (text or "").strip()
    if text.startswith("{"):
        return {k: str(v) for k, v in loose_json(text).items()}
    if "::" in text:
        return dict(p.split("::", 1) for p in re.split(r"@(?=\w+::)", text) if "::" in p)
    if re.match(r"^\w+:(?!/)", text) and "&&" in text:
        return {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in text.split("&&")) if k.strip()}
    return {"bookList": text} if text else {}


#: Other names of fields, fixed values.
ALIASES = {"name": ("name", "bookName", "title"), "url": ("bookUrl", "url", "link"), "author": ("author", "bookAuthor"), "list": ("bookList", "chapterList", "list", "items")}


def field_rule(rules: dict[str, str], *keys: str) -> str:
    """The first of these fields that has a rule, whatever its case."""
    low = {k.lower(): v for k, v in rules.items()}
    for k in keys:
        for name in ALIASES.get(k, (k,)):
            if low.get(name.lower()):
                return low[name.lower()]
    return ""


def index_spec(selector: str) -> tuple[IndexSpec, str]:
    """Index syntax of a selector (:n, [i,j], [s:e], !s:e, !i) and the selector without it."""
    if m := re.search(r"\[(-?\d+(?:\s*,\s*-?\d+)*)\]", selector):
        spec = IndexSpec("indices", tuple(int(x) for x in m[1].split(",")))
    elif m := re.search(r"\[(\d*):(\d*)\]", selector):
        spec = IndexSpec("range", (), int(m[1] or 0), int(m[2]) if m[2] else None)
    elif m := re.search(r"!(\d+):(\d+)", selector):
        spec = IndexSpec("exclude", (), int(m[1]), int(m[2]))
    elif m := re.search(r"!(\d+(?:,\d+)*)", selector):
        spec = IndexSpec("exclude", tuple(int(x) for x in m[1].split(",")))
    elif m := re.search(r":(-?\d+)(?![\w(])", selector):
        spec = IndexSpec("indices", (int(m[1]),))
    else:
        return IndexSpec(), selector
    return spec, (selector[: m.start()] + selector[m.end() :]).strip()


def is_chain(rule: str) -> bool:
    return detect(rule) == "chain"


def uses_script(rule: str | None) -> bool:
    return bool(rule) and bool(re.search(r"<js>|@js:|\{\{|\bfunction\b|java\.|eval\(", rule))


def uses_browser(url: str | None) -> bool:
    return bool(url) and "webview" in url.lower()


def summary(rule: str) -> dict:
    """What a rule is made of, for inspection."""
    r = parse(rule)
    return {"mode": r.mode, "parts": len(r.parts), "ops": list(r.ops), "puts": list(r.puts), "gets": list(r.gets), "replaces": len(r.replaces), "expressions": len(r.expressions)}


#: The fields of a summary.
_SUMMARY = [("mode", T.StringType()), ("parts", T.LongType()), ("ops", T.ArrayType(T.StringType())), ("puts", T.ArrayType(T.StringType())), ("gets", T.ArrayType(T.StringType())), ("replaces", T.LongType()), ("expressions", T.LongType()), ("chain", T.BooleanType()), ("script", T.BooleanType())]


@F.arrow_udf(T.StructType([T.StructField(k, t) for k, t in _SUMMARY]))
def _summaries(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.ArrayType: pa.list_(pa.string())}
    for rules in parts:
        rows = [{**summary(r or ""), "chain": is_chain(r or ""), "script": uses_script(r)} if (r or "").strip() else None for r in rules.to_pylist()]
        yield pa.array(rows, pa.struct([(k, kinds[type(t)]) for k, t in _SUMMARY]))


def inspected(df: DataFrame, rule: str, out: str = "said") -> DataFrame:
    """df with what each row's rule is made of, as summary() says it, and whether it is a chain or needs a script; null for a blank rule.

    Every distinct rule is parsed once.
    """
    distinct = df.select(rule).where(F.col(rule).isNotNull()).distinct()
    found = distinct.select(F.col(rule).alias("_rule"), _summaries(F.col(rule)).alias(out))
    return df.join(found, F.col(rule) == F.col("_rule"), "left").drop("_rule")


@dataclass
class Source:
    """Rules of one source by phase."""

    id: int
    name: str
    base: str
    search_url: str = ""
    search: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    toc: dict = field(default_factory=dict)
    content: dict = field(default_factory=dict)
    enabled: bool = True

    def mode(self, phase: str) -> str:
        rules = getattr(self, phase, {})
        return parse(field_rule(rules, "list") or next(iter(rules.values()), "")).mode if rules else "default"
