"""Relational flows over the small tables: listing, paging, counters, batch updates, upserts, cascades, migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.shared import settled


def listed(df: DataFrame, *order: Column, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).orderBy(*order)


def ranked(df: DataFrame, n: int, *order: Column, name: str = "pos") -> DataFrame:
    """The first n rows in this order with their place from 0 (a top-k: each task keeps n rows)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def page(df: DataFrame, number: int, size: int, *order: Column, default: int = 20, most: int = 100) -> DataFrame:
    """One page of rows; sizes out of range take the default, or the most."""
    size = default if size <= 0 else min(size, most)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total and has_more of a paged table."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > max(1, number) * size)


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """total and one conditional count a name, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that match get the values; types stay."""
    where = F.coalesce(where, F.lit(False))
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in values.items()})


def changed(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """How many rows an update would change."""
    return df.agg(F.count_if(where & ~F.col(column).eqNullSafe(value)).alias("updated"))


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is left."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last writer wins by key: the highest version, new before old on ties; null fields of the new row keep the old value.

    One partial-aggregated shuffle by key: max_by keeps a single row a key and task.
    """
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.col(version), F.col("_new"))
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new with keys that old lacks, one a key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def next_order(df: DataFrame, column: str = "order") -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_order"))


def numbered(df: DataFrame, *by: Column, name: str = "pos") -> DataFrame:
    """All rows numbered from 0 in this order: a range sort, numbers inside each partition, and the counts of those before.

    No task holds more than its partition; only the partitions' counts are broadcast.  The sorted rows are held in the shared
    folder, since a second sort could cut the ranges elsewhere.
    """
    rows = settled(df.orderBy(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    inner = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1)
    sizes = inner.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    shift = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return inner.join(F.broadcast(shift), "_p").withColumn(name, F.col("_s") + F.col("_n")).drop("_p", "_i", "_n", "_s")


def with_order(old: DataFrame, new: DataFrame, *by: Column, name: str = "name", column: str = "order") -> DataFrame:
    """New rows with consecutive orders after the old ones; rows with a blank name are skipped."""
    rows = numbered(new.where(F.trim(name) != ""), *by, name="_at")
    return rows.join(F.broadcast(next_order(old, column))).withColumn(column, F.col("next_order") + F.col("_at")).drop("_at", "next_order")


def count_events(old: DataFrame, events: DataFrame, key: str, ok: Column, ts: str) -> DataFrame:
    """Counter upsert: success and error counts and last times per key, added to the old table."""
    new = events.groupBy(key).agg(F.count_if(ok).alias("s"), F.count_if(~ok).alias("e"), F.max(F.when(ok, F.col(ts))).alias("ls"), F.max(F.when(~ok, F.col(ts))).alias("le"))
    both = old.join(new, key, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(key, F.greatest("last_success", "ls").alias("last_success"), F.greatest("last_error", "le").alias("last_error"), (zero("success_count") + zero("s")).alias("success_count"), (zero("error_count") + zero("e")).alias("error_count"))


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that the schema has and df lacks are added as nulls, in the schema's order; others stay behind them."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in schema.names])


def search_text(needle: str, *columns: str) -> Column:
    """Whether any column holds the text, whatever its case."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(needle.lower()) for c in columns])


def groups(df: DataFrame, column: str, default: str) -> DataFrame:
    """Distinct groups in order, blank ones under the default label."""
    return df.select(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default)).alias(column)).distinct().orderBy(column)


def grouped_counts(df: DataFrame, column: str, default: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def history(events: DataFrame, keyword: str, ts: str, n: int = 20) -> DataFrame:
    """Search history: each keyword at its last use, the n latest."""
    last = events.groupBy(keyword).agg(F.max(ts).alias(ts))
    return ranked(last, n, F.desc(ts), F.col(keyword))


def progress_group(percent: Column) -> Column:
    return F.when(percent >= 100, "finished").when(percent > 0, "reading").otherwise("unread")


def script_policy(df: DataFrame, rules: list[str], only_plain: bool = True) -> DataFrame:
    """needs_script per source, and enabled as the policy sets it."""
    text = F.concat_ws("\n", *rules)
    needs = text.rlike(r"<js>|@js:|\bfunction\b|java\.|eval\(")
    return df.withColumn("needs_script", needs).withColumn("enabled", F.when(F.lit(only_plain), ~needs).otherwise(F.lit(True)))


def bundle(df: DataFrame, key: str) -> DataFrame:
    """Export: one JSON text a row."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def unbundle(df: DataFrame, schema: str) -> DataFrame:
    """Import of exported rows; what is no JSON object goes."""
    return df.select(F.from_json("json", schema).alias("r")).where("r is not null").select("r.*")


def stream_results(rows: DataFrame) -> DataFrame:
    """rows with book_id, book_name, author, book_url and source_name: results of a streaming search, blanks filled from what else they say."""
    either = lambda *v: F.coalesce(*[F.nullif(x, F.lit("")) for x in v])
    named = either(F.col("bookKey"), F.when((F.col("sourceId") != "") & (F.col("bookUrl") != ""), F.concat("sourceId", F.lit("::"), "bookUrl")), F.col("bookId"), F.lit(""))
    key = F.coalesce(named, F.lit(""))
    return rows.withColumns({"book_id": key, "book_name": F.coalesce(either(F.col("bookName"), F.col("name")), F.lit("")), "author": either(F.col("author"), F.lit("未知作者")), "book_url": either(F.col("bookUrl"), key), "source_name": either(F.col("sourceName"), F.col("source"), F.lit("未知来源"))})
