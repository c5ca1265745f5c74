"""Ordered lists of strings as ARRAY<STRING> columns: set operators, index specifications, combination of rule parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = lambda: F.array().cast("array<string>")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_that(each: list[Column], fits: Callable[[Column], Column], other: Column) -> Column:
    """The first value that fits, each worked out once and only if none before it fits; else the other."""
    if not each:
        return other
    return bound(each[0], lambda x: F.when(fits(x), x).otherwise(first_that(each[1:], fits, other)))


def intersection(left: Column, right: Column) -> Column:
    """Distinct non-empty items of left that right has, in left's order."""
    return F.array_remove(F.array_intersect(left, right), "")


def union(left: Column, right: Column) -> Column:
    """Distinct non-empty items of both, left first."""
    return F.array_remove(F.array_union(left, right), "")


def containing(left: Column, literal: str) -> Column:
    """Items of left that contain the literal."""
    return F.filter(left, lambda x: x.contains(literal))


def first_list(left: Column, right: Column) -> Column:
    """left if it has items, else right; distinct."""
    return F.array_distinct(F.when(F.size(left) > 0, left).otherwise(right))


def interleave(parts: list[Column]) -> Column:
    """Item by item if all parts have one positive length, else one after the other."""
    if len(parts) == 1:
        return parts[0]
    same = reduce(lambda a, b: a & b, [F.size(p) == F.size(parts[0]) for p in parts[1:]]) & (F.size(parts[0]) > 0)
    names = [f"p{i}" for i in range(len(parts))]
    turns = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names, strict=True)]), lambda x: F.array(*[x[n] for n in names]))
    return F.when(same, F.flatten(turns)).otherwise(F.concat(*parts))


@dataclass(frozen=True)
class IndexSpec:
    """Which items to take: indices in order (negative from the end), a half-open range, or all but some."""

    kind: str = "all"  # all, indices, range, exclude
    values: tuple[int, ...] = ()
    start: int | None = None
    stop: int | None = None


def take(items: Column, spec: IndexSpec) -> Column:
    """Apply an index specification; what is out of range is left out."""
    n = F.size(items)
    if spec.kind == "indices":
        return F.array_compact(F.array(*[F.get(items, F.lit(i) if i >= 0 else n + i) for i in spec.values]))
    if spec.kind == "range":
        stop = n if spec.stop is None else F.least(F.lit(spec.stop), n)
        start = F.lit(spec.start or 0)
        return F.when(stop > start, F.slice(items, start + 1, F.greatest(stop - start, F.lit(0)))).otherwise(EMPTY())
    if spec.kind == "exclude":
        gone = lambda i: (i >= (spec.start or 0)) & (i < spec.stop) if spec.stop is not None else i.isin(*spec.values)
        return F.filter(items, lambda _, i: ~gone(i))
    return items


def first(items: Column) -> Column:
    """The first item, or ''."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def combine(parts: list[Column], ops: list[str], engine: str, literals: list[str | None] | None = None) -> Column:
    """Fold lists from left to right; what an operator means depends on the engine.

    css: && interleaves, || concatenates.  xpath: && intersects, || unites, %% keeps items that contain the right side's
    literal text.  json: && intersects, || takes the first list with items, %% takes the right side.  chain: || concatenates.
    """
    out = parts[0]
    for k, op in enumerate(ops):
        right = parts[k + 1]
        if engine == "xpath":
            out = {"&&": intersection, "||": union}[op](out, right) if op != "%%" else containing(out, (literals or [None] * len(parts))[k + 1] or "")
        elif engine == "json":
            out = {"&&": intersection, "||": first_list, "%%": lambda _, r: r}[op](out, right)
        elif engine == "css" and op == "&&":
            out = interleave([out, right])
        else:
            out = F.concat(out, right)
    return out
