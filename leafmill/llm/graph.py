"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove

#: Tasks that the rows of one hub are dealt to.
SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with its key's single row of one; a key's rows are dealt by a hash of column ``by``, and one is repeated for that."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return dealt.join(repeated.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")  # its size before it is repeated is no bound for a broadcast


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v; a hub's edges are dealt to many tasks."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = salted_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = salted_join(large, low, "u", "v")
    small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge that is not its own root; root is the component's smallest node.

    Self loops, repeated edges and both directions are accepted; rows with a null end are ignored.  Each round is a few
    aggregations and joins whose result is written to the shared folder, so that no lineage grows; only two numbers
    per round reach the driver.  An empty edge table gives an empty result.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and u > v")
        .select("u", "v")
        .distinct()
    )
    spark, schema, path = edges.sparkSession, e.schema, None

    def put(e: DataFrame) -> DataFrame:
        """Write a round's edges and remove those before."""
        nonlocal path
        was, path = path, new_path(spark, "edges")
        e.write.option("compression", "zstd").parquet(path)
        if was:
            remove(spark, was)
        return spark.read.schema(schema).parquet(path)

    e = put(e)
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        e = put(_round(e))
        was, mark = mark, _mark(e)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
