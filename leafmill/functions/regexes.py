"""Regex rules: all matches, chains, group templates and ordered replacements, on Spark's own regex functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def preprocess(pattern: str) -> str:
    """Two doubled backslashes become one escaped backslash; the delimiters of /re/ and the colon of :re go."""
    if len(pattern) > 2 and pattern[0] == pattern[-1] == "/":
        pattern = pattern[1:-1]
    elif pattern.startswith(":"):
        pattern = pattern[1:]
    return pattern.replace("\\\\\\\\", "\\\\")


def flags(pattern: str, ignore_case: bool = False, multiline: bool = False, dot_all: bool = False) -> str:
    on = "".join(f for f, is_on in (("i", ignore_case), ("m", multiline), ("s", dot_all)) if is_on)
    return f"(?{on}){pattern}" if on else pattern


def n_groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def find_all(text: Column, pattern: str) -> Column:
    """All matches; with exactly one capturing group that group, else the whole match."""
    pattern = preprocess(pattern)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if n_groups(pattern) == 1 else 0))


def chain(text: Column, patterns: list[str]) -> Column:
    """Each step matches in the last one's first match; null if a step before the last has none, [] if the last has none."""
    if len(patterns) == 1:
        return find_all(text, patterns[0])
    for p in patterns[:-1]:
        p = preprocess(p)
        text = F.when(text.rlike(p), F.regexp_extract(text, p, 0))
    last = preprocess(patterns[-1])
    return F.when(text.isNotNull(), F.when(text.rlike(last), F.array(F.regexp_extract(text, last, 0))).otherwise(F.array().cast("array<string>")))


def template(text: Column, pattern: str, groups: str) -> Column:
    """The first match's groups put into a template such as $1-$2; groups that the pattern lacks are empty; '' without a match."""
    pattern, n = preprocess(pattern), n_groups(pattern)
    parts = [F.regexp_extract(text, pattern, int(p[1:])) if p[0] == "$" and int(p[1:]) <= n else F.lit("" if p[0] == "$" else p) for p in re.split(r"(\$\d)", groups) if p]
    return F.when(text.rlike(pattern), F.concat(*parts)).otherwise("")


def java_replacement(pattern: str, replacement: str) -> str:
    """A $1 or ${name} replacement for Java: groups that the pattern lacks are blank, lone dollars and backslashes literal."""
    n = n_groups(pattern)

    def one(m: re.Match) -> str:
        if m[1]:
            name = m[1].strip("{}")
            return (f"${{{name}}}" if not name.isdigit() else f"${name}") if not name.isdigit() or int(name) <= n else ""
        return "\\" + m[0]

    return re.sub(r"\$(\d+|\{\w+\})|[$\\]", one, replacement)


def valid(pattern: str) -> bool:
    """Whether the pattern can be compiled (checked on the driver; Java takes all that is in common use)."""
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except re.error:
        return False
    return True


def replace_chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after the other; invalid patterns are skipped."""
    for find, to in pairs:
        if find and valid(find):
            text = F.regexp_replace(text, F.lit(find), F.lit(java_replacement(find, to)))
    return text


def groups(text: Column, pattern: str) -> Column:
    """Groups 0 to n of the first match, or null."""
    pattern = preprocess(pattern)
    return F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, g) for g in range(n_groups(pattern) + 1)]))


def all_groups(text: Column, pattern: str) -> Column:
    """Groups 0 to n of every match."""
    pattern = preprocess(pattern)
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(n_groups(pattern) + 1)]
    names = [f"g{g}" for g in range(len(each))]
    # zipped first: what a lambda names from outside is worked out anew for every match
    return F.transform(F.arrays_zip(*[e.alias(n) for e, n in zip(each, names, strict=True)]), lambda m: F.array(*[m[n] for n in names]))
