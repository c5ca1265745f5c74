"""Replace rules kept in a table: joined with texts by scope, applied in order by a fold over each scope's rules.

Rules are looked at once each, as rows: whether their pattern can be compiled, and what their replacement says in Spark's
notation.  Each scope then has one ordered array of them, with those of scope 'all' in their places, and every text is folded over the array of
its scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.regexes import java_replacement, valid

ALL = "all"
_RULE = "array<struct<rank: bigint, id: bigint, pattern: string, replacement: string, literal: boolean>>"


def listed(rules: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Rules as they are applied: the highest order first, then the highest id."""
    return (rules.where("enabled") if enabled_only else rules).orderBy(F.desc("order"), F.desc("id"))


@F.arrow_udf(T.StructType([T.StructField("literal", T.BooleanType()), T.StructField("replacement", T.StringType())]))
def _prepared(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for patterns, replacements in parts:
        rows = []
        for p, r in zip(patterns.to_pylist(), replacements.to_pylist(), strict=True):
            ok = valid(p)
            rows.append({"literal": not ok, "replacement": java_replacement(p, r) if ok else r})
        yield pa.array(rows, pa.struct([("literal", pa.bool_()), ("replacement", pa.string())]))


def by_scope(rules: DataFrame) -> DataFrame:
    """(scope, rules): the enabled rules of each scope that occurs, those of all scopes among them, in order; scope null: those of all scopes alone.

    rules: id, pattern, replacement, scope, order, case_insensitive, enabled.  Rules without a pattern do nothing; a null
    replacement is empty, a null scope 'all', a null order 0.
    """
    used = rules.where(F.coalesce("enabled", F.lit(False)) & (F.coalesce("pattern", F.lit("")) != ""))
    made = used.select(F.coalesce("scope", F.lit(ALL)).alias("scope"), (-F.coalesce("order", F.lit(0))).cast("long").alias("rank"), (-F.col("id")).cast("long").alias("id"), F.col("pattern"), F.coalesce("case_insensitive", F.lit(False)).alias("any_case"), _prepared(F.col("pattern"), F.coalesce("replacement", F.lit(""))).alias("p"))
    pattern = F.when(F.col("any_case") & ~F.col("p.literal"), F.concat(F.lit("(?i)"), F.col("pattern"))).otherwise(F.col("pattern"))
    rows = made.select("scope", F.struct("rank", "id", pattern.alias("pattern"), F.col("p.replacement").alias("replacement"), F.col("p.literal").alias("literal")).alias("rule"))
    scopes = rows.where(F.col("scope") != ALL).select("scope").distinct()
    own = rows.where(F.col("scope") != ALL).groupBy("scope").agg(F.collect_list("rule").alias("own"))
    common = rows.where(F.col("scope") == ALL).agg(F.collect_list("rule").alias("common"))  # one row, also without rules
    every = scopes.unionByName(common.select(F.lit(None).cast("string").alias("scope"))).join(own, "scope", "left").join(F.broadcast(common))
    return every.select("scope", F.array_sort(F.concat(F.coalesce("own", F.array().cast(_RULE)), "common")).alias("rules"))


def replaced(text: Column, rules: Column) -> Column:
    """The text after all rules of an array as by_scope() makes them."""
    return F.aggregate(rules, text, lambda t, r: F.when(r["literal"], F.replace(t, r["pattern"], r["replacement"])).otherwise(F.regexp_replace(t, r["pattern"], r["replacement"])))


def apply_rules(texts: DataFrame, rules: DataFrame, text: str, scope: str) -> DataFrame:
    """texts with the rules of their scope applied to column text; a null text stays null, a scope without rules has those of all scopes."""
    found = by_scope(rules)
    own = found.where("scope is not null").select(F.col("scope").alias("_scope"), F.col("rules").alias("_own"))
    common = found.where("scope is null").select(F.col("rules").alias("_common"))
    # rules are few beside texts, which stay where they are: by scope, a task would have all texts of one
    joined = texts.join(F.broadcast(own), F.col(scope) == F.col("_scope"), "left").join(F.broadcast(common))
    return joined.withColumn(text, replaced(F.col(text), F.coalesce("_own", "_common"))).select(*texts.columns)
