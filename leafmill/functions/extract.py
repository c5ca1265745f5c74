"""DOM rules as one fused Arrow UDF: a page is parsed once for all of a query's rules; lists come back as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import dom, expressions, json_paths, lists, regexes
from leafmill.functions.batches import pieces
from leafmill.plans import rules as R


def _replaced(rule: R.Rule, x: Column) -> Column:
    return regexes.replace_chain(x, list(rule.replaces))


def _one(root: dom.Node, mode: str, part: str) -> list[str]:
    if mode == "xpath":
        return dom.xpath(root, part)
    if mode == "chain":
        return dom.chain(root, part)
    return dom.css(root, part)


def dom_lists(body: Column, parts: list[tuple[str, str]]) -> Column:
    """STRUCT<p0: ARRAY<STRING>, ...> of the (mode, selector) parts."""
    names = [f"p{i}" for i in range(len(parts))]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches):
            cols: list[list[list[str]]] = [[] for _ in parts]
            for page in b:
                root = dom.parse(page.as_py() or "")
                for col, (mode, part) in zip(cols, parts, strict=True):
                    col.append(_one(root, mode, part))
            yield pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in cols], names=names)

    return F.arrow_udf(run, "struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">")(body)


_DOM = ("css", "xpath", "chain", "default")


def _places(parsed: dict[str, R.Rule]) -> dict[tuple[str, str], int]:
    """The (mode, selector) parts of the DOM rules, each with its number."""
    where: dict[tuple[str, str], int] = {}
    for r in parsed.values():
        if r.mode in _DOM:
            for p in r.parts:
                where.setdefault((r.mode, p), len(where))
    return where


def _late(everything: dict[str, R.Rule]) -> dict[str, R.Rule]:
    """The rules that are filled in from what the others have found."""
    return {k: r for k, r in everything.items() if r.expressions or (r.gets and not any(r.parts))}


def extract(df: DataFrame, body: str, wanted: dict[str, str], as_list: bool | set[str] = False, first_only: bool = False, ready: bool = False) -> DataFrame:
    """df with a column per rule: its first value, or all of them (as_list: for every rule, or for those named).

    DOM parts of all rules share one UDF call; JSON, regex and list operators stay built-in expressions.  A null body gives
    empty results.  Columns of the wanted names are replaced.  A rule @get:{a} takes the value that rule a (or @put:{a} in
    front of a rule) has found, and a rule with {{expressions}} is filled in from the values found; first_only takes the first
    part of a composite rule alone.  With ready, df has the DOM parts' lists in column _dom and no body.
    """
    listed = set(wanted) if as_list is True else as_list or set()
    everything = {k: R.parse(r) for k, r in wanted.items()}
    late = _late(everything)
    parsed = {k: r for k, r in everything.items() if k not in late}
    if first_only:
        parsed = {k: replace(r, parts=r.parts[:1], ops=()) for k, r in parsed.items()}
    where = _places(parsed)
    if where and not ready:
        df = df.withColumn("_dom", dom_lists(F.col(body), list(where)))
    out = {}
    for k, r in parsed.items():
        if r.mode == "json":
            cols = [json_paths.query(F.col(body), p) for p in r.parts]
        elif r.mode == "regex":
            cols = [regexes.chain(F.coalesce(F.col(body), F.lit("")), list(r.parts))]
        elif r.mode == "js":
            raise ValueError(f"{k}: scripts are not run; see functions.expressions")
        else:
            cols = [F.col(f"_dom.p{where[r.mode, p]}") for p in r.parts]
        if r.mode == "chain" and "||" in r.ops and k not in listed:
            got = F.coalesce(*[F.when(F.size(c) > 0, c) for c in cols], lists.EMPTY())
        else:
            got = lists.combine(cols, list(r.ops) if r.mode != "regex" else [], "css" if r.mode == "default" else r.mode, list(r.parts))
        got = F.coalesce(got, lists.EMPTY())
        if r.replaces:
            got = F.filter(F.transform(got, partial(_replaced, r)), lambda x: x != "")
        out[k] = got if k in listed else lists.first(got)
    df = df.withColumns(out).drop("_dom")
    if late:
        value = {k: lists.first(F.col(k)) if k in listed else F.col(k) for k in parsed}
        value |= {p: value[k] for k, r in parsed.items() for p in r.puts}
        filled = {k: expressions.fill(r.raw, value) if r.expressions else F.concat(*[value[g] for g in r.gets]) for k, r in late.items()}
        df = df.withColumns({k: F.array(c) if k in listed else c for k, c in filled.items()})
    return df


def items(df: DataFrame, body: str, rule: str, out: str = "item", pos: str = "pos") -> DataFrame:
    """One row per element of a list rule: its outer HTML (or JSON text) and place."""
    parsed = R.parse(rule)
    if parsed.mode == "json":
        return df.select("*", F.posexplode(json_paths.items(F.col(body), parsed.parts[0])).alias(pos, out))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches):
            got = []
            for page in b:
                root = dom.parse(page.as_py() or "")
                got.append([n.outer() for n in _elements(root, parsed)])
            yield pa.array(got, pa.list_(pa.string()))

    return df.select("*", F.posexplode(F.arrow_udf(run, "array<string>")(F.col(body))).alias(pos, out))


def _elements(root: dom.Node, rule: R.Rule) -> list[dom.Node]:
    """The elements of a list rule."""
    if rule.mode == "chain":
        return dom.chain_list(root, rule.raw)
    spec, selector = R.index_spec(rule.parts[0])
    return dom.taken(dom.select(root, selector), spec)


def extract_items(df: DataFrame, body: str, rule: str, wanted: dict[str, str], pos: str = "pos") -> DataFrame:
    """df without its body, with one row per element of a list rule: its place and a column per rule, told from the element alone.

    Where all rules are DOM rules, a page is parsed once and its elements are looked at in place; else each element's
    HTML (or JSON) goes through extract().
    """
    parsed = R.parse(rule)
    everything = {k: R.parse(r) for k, r in wanted.items()}
    late = _late(everything)
    where = _places({k: r for k, r in everything.items() if k not in late})
    if parsed.mode == "json" or not where or any(r.mode not in _DOM for k, r in everything.items() if k not in late):
        return extract(items(df, body, rule, pos=pos), "item", wanted).drop(body, "item")
    names = [f"p{i}" for i in range(len(where))]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(n, pa.list_(pa.string())) for n in names]))
        for b in pieces(batches):
            out = []
            for page in b:
                rows = []
                for n in _elements(dom.parse(page.as_py() or ""), parsed):
                    alone, up = dom.Node("#root"), n.parent
                    alone.children, n.parent = [n], alone
                    rows.append(dict(zip(names, (_one(alone, mode, part) for mode, part in where), strict=True)))
                    n.parent = up
                out.append(rows)
            yield pa.array(out, kind)

    found = F.arrow_udf(run, "array<struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">>")(F.col(body))
    rest = [c for c in df.columns if c != body]
    return extract(df.select(*rest, F.posexplode(found).alias(pos, "_dom")), body, wanted, ready=True)


def content(df: DataFrame, body: str, selector: str, base: str | None = None) -> DataFrame:
    """df with content (text by blocks) and images of the first element that matches, or of the page; base is the column of its URL."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, at in pieces(batches):
            texts, pics = [], []
            for page, url in zip(b, at, strict=True):
                root = dom.parse(page.as_py() or "")
                node = next(iter(dom.select(root, selector)), root)
                texts.append(dom.content_text(node))
                pics.append(dom.images(node, url.as_py() or ""))
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(pics, pa.list_(pa.string()))], names=["content", "images"])

    return df.withColumn("_c", F.arrow_udf(run, "struct<content: string, images: array<string>>")(F.col(body), F.col(base) if base else F.lit(""))).select("*", "_c.*").drop("_c")


def whitelisted(df: DataFrame, body: str, out: str = "html_clean", allowed: frozenset[str] = dom.ALLOWED) -> DataFrame:
    """df with the body's markup reduced to the allowed tags; scripts and styles go, other tags leave their content."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pieces(batches):
            yield pa.array([dom.whitelisted(dom.parse(p.as_py() or ""), allowed) for p in b], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(body)))
