"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Targets: sources in code-point order weigh 3, 1, 2, repeating, and share ``share`` of all words; a target stops at
   ``most`` times its source's words and the excess is shared again by weight, round after round, until none is above.
2. Blocks: a hash deals every source's documents to blocks of about BLOCK_WORDS words.  All blocks are drawn
   floor(target / words) times; blocks in a permuted order are drawn once more until the words that are left are used up, and the
   documents of the block in which that happens are drawn singly, to the nearest document: of equal ones as many as are needed.
3. Splitting tree: the exact numbers of draws are halved again and again among the output shards, each half by a
   multivariate hypergeometric draw, so that every shard's share of each source is that of drawing without replacement.
   Only these counts, one a stratum and node, are computed on the driver.  A stratum is a source; of more than STRATA
   sources several share one, inside which the permutation of step 4 splits them by the same law.
4. A stratum's draws are permuted, and a shard takes the stretch of them that its quota says: the shards' draws are disjoint.
   Inside a shard (inside each part of a large one) a seeded hash orders the documents.  The words taken are those of the
   documents that the shards hold.

Rows that agree in id, source and text are one unit with a multiplicity, so that repeated rows meet in no task.  A unit's copies are drawn as
spans of at most COPIES, which are dealt to shards' parts each for itself; the rows of a unit of several spans are numbered in two steps, inside
the input's partitions and over them.  So are running sums over a source's blocks, inside 1,024 stretches and over them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import read, write_out

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1 << 16
#: Blocks of a source at least.
LEAST_BLOCKS = 64
STRATA = 1024
#: Words of an output shard; shards are a power of two between these, and larger ones are dealt to several partitions.
SHARD_WORDS = 4_000_000
SHARDS = (16, 1024)
#: Copies of a unit that are dealt together.
COPIES = 1024
#: Units of several spans up to which they are broadcast; more of them are shuffled.
FEW = 100_000
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"
UNIT = ["id", "source", "digest", "size"]


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, digest, size, m): rows that agree in id, source and text, and their number; size is the words of each, 0 for null."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("digest"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, nth, source_size, target) per source of units; null is a source of its own, the last.

    One row of sums a round reaches the driver; the sources themselves stay distributed.
    """
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    rows = numbered(totals, F.col("source").asc_nulls_last(), name="nth").withColumn("w", weight).withColumn("cap", cap)
    level, above = 0.0, -1
    while True:
        full = F.col("w") * F.lit(level) > F.col("cap")
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if r["n"] == above or not r["w"]:
            break
        level, above = (share * r["all"] - r["held"]) / r["w"], r["n"]
    return rows.select("source", "nth", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def split_quotas(draws: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """draws[s] draws of source s, split exactly among the shards: an array (shards, sources)."""
    if shards == 1:
        return np.array([draws])
    left = shards // 2
    total = sum(draws)
    near = total * left // shards
    half = rng.multivariate_hypergeometric(draws, near) if total else np.zeros(len(draws), int)
    rest = (np.array(draws) - half).tolist()
    return np.vstack([split_quotas(half.tolist(), left, rng), split_quotas(rest, shards - left, rng)])


def _shards(words: float | None) -> int:
    return min(SHARDS[1], max(SHARDS[0], 1 << max(0, int((words or 0) / SHARD_WORDS)).bit_length()))


def _hash(*parts: Column | str | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int | None = None, strata: int = STRATA, seed: int = SEED) -> tuple[DataFrame, int, int]:
    """(units' columns, copies, first, m, source_size, target, shards) per span of units' copies: m of them from number ``first`` on, of
    ``copies`` in all; shards lists the output shard of each time that every one of them is taken.

    Also the number of shards, and of the parts of each.  Null and wordless texts have size 0; they are taken with their block
    and add no words.  The same rows give the same plan, however they are dealt to partitions.
    """
    spark = sized.sparkSession
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    goal = write_out(
        targets(sized, weights, share, most)
        .withColumn("base", whole_times)
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block_words)))
        .withColumn("stratum", F.pmod("nth", F.lit(strata))),
        "targets",
    )
    words = goal.agg(F.sum("target").alias("n")).first()["n"] or 0
    shards = shards or _shards(words)
    each = 1 + int(words // (SHARD_WORDS * shards))
    rows = sized.alias("u").join(goal.alias("g"), _same("u", "g", "source")).select("u.*", *[f"g.{c}" for c in ("stratum", "source_size", "target", "base", "rest")], F.pmod(_hash(seed, "id", "digest"), "blocks").alias("block"))
    per_source = ["source", "stratum", "base", "rest"]
    order = _hash(seed + 1, "source", "block")
    summed = rows.groupBy(*per_source, "block").agg(F.sum(F.col("size") * F.col("m")).alias("words")).withColumn("u", order).withColumn("stretch", F.shiftrightunsigned("u", 54))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = summed.groupBy("source", "stretch").agg(F.sum("words").alias("n")).select("source", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("upto"))
    inside = Window.partitionBy("source", "stretch").orderBy("u", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = write_out(
        summed.alias("b")
        .join(stretches.alias("s"), _same("b", "s", "source", "stretch"))
        .select("b.*", "s.upto")
        .withColumn("before", F.col("upto") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .withColumn("whole", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0))
        .withColumn("cut", ~F.col("whole") & (F.col("before") < F.col("rest")) & (F.col("rest") > 0))
        .withColumn("copies", F.col("base") + (F.col("whole") | F.col("cut")).cast("int")),
        "blocks",
    )
    drawn = placed.where("copies > 0").select("source", "stratum", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    counted = drawn.groupBy("stratum").count().orderBy("stratum").collect()
    draws = [r["count"] for r in counted]
    ends = split_quotas(draws, shards, np.random.default_rng(seed)).cumsum(axis=0) if counted else np.zeros((shards, 0), int)
    first = np.cumsum(draws) - np.array(draws) if counted else []
    cuts = spark.createDataFrame([(r["stratum"], int(first[i]), ends[:, i].tolist()) for i, r in enumerate(counted)], "stratum long, first long, ends array<long>")
    permuted = numbered(drawn, F.col("stratum"), _hash(seed + 2, "source", "block", "copy"), F.col("source"), F.col("block"), F.col("copy"), name="draw")
    dealt = permuted.join(cuts, "stratum").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("draw") - F.col("first"))))
    lists = dealt.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    per_block = placed.alias("b").join(lists.alias("l"), _same("b", "l", "source", "block"), "left").select("b.source", "b.block", "before", "cut", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    found = rows.alias("u").join(per_block.alias("b"), _same("u", "b", "source", "block")).select("u.*", "before", "cut", "shards")
    singly = Window.partitionBy("source", "block").orderBy(_hash(seed + 3, "id", "digest"), *UNIT).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(F.col("size") * F.col("m")).over(singly) - F.col("size") * F.col("m")
    left = F.col("rest") - F.col("start")
    # of a unit's copies, the nearest number to what is left; m is 1 but for repeated rows
    more = F.when(F.col("size") > 0, F.least(F.greatest(F.round(left / F.col("size")), F.lit(0)), F.col("m"))).otherwise(F.when(left >= 0, F.col("m")).otherwise(0))
    none = F.lit(0).cast("long")
    by_unit = found.where("cut").withColumn("start", start).withColumn("k", more.cast("long"))
    split = F.array(F.struct(none.alias("a"), F.col("k").alias("b"), F.col("shards")), F.struct(F.col("k").alias("a"), F.col("m").alias("b"), F.slice("shards", F.lit(1), F.size("shards") - 1).alias("shards")))
    whole = found.where("not cut").select(*UNIT, "m", "source_size", "target", none.alias("a"), F.col("m").alias("b"), "shards")
    ranges = whole.unionByName(by_unit.select(*UNIT, "m", "source_size", "target", F.inline(split))).where("a < b")
    chunk = F.explode(F.sequence(F.floor(F.col("a") / COPIES), F.floor((F.col("b") - 1) / COPIES))).alias("c")
    spans = ranges.select("*", chunk).withColumns({"first": F.greatest("a", F.col("c") * COPIES), "stop": F.least("b", (F.col("c") + 1) * COPIES)})
    return write_out(spans.select(*UNIT, F.col("m").alias("copies"), "first", (F.col("stop") - F.col("first")).alias("m"), "source_size", "target", "shards"), "plan"), shards, each


def deal(planned: DataFrame, each: int, seed: int = SEED) -> DataFrame:
    """(spans' columns, copy, shard, part, place) per drawn span: where the output shards hold it.

    A shard has ``each`` parts; place is the number of rows before it in its part's shuffled order.
    """
    drawn = planned.select(*planned.columns, F.posexplode("shards").alias("copy", "shard")).drop("shards").withColumn("part", F.pmod(_hash(seed + 5, "id", "digest", "copy", "first"), F.lit(each)))
    before = Window.partitionBy("shard", "part").orderBy(_hash(seed + 4, "id", "digest", "copy", "first"), *UNIT, "first", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("place", F.coalesce(F.sum("m").over(before), F.lit(0)))


def _rows(docs: DataFrame, planned: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, digest, n): docs' rows, those of a unit of several spans numbered from 0 on; n is null for the others."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    several = planned.where((F.col("first") > 0) | (F.col("m") < F.col("copies"))).select("id", "source", "digest").distinct()
    unit, n = ["id", "source", "digest"], several.count()
    several = F.broadcast(several) if n <= FEW else several
    plain = keyed.alias("k").join(several.alias("s"), _same("k", "s", *unit), "left_anti").select("k.*", F.lit(None).cast("long").alias("n"))
    if not n:
        return keyed.withColumn("n", F.lit(None).cast("long"))
    parts = keyed.withColumn("p", F.spark_partition_id()).alias("k").join(several.alias("s"), _same("k", "s", *unit), "left_semi").select("k.*")
    held = write_out(parts.withColumn("i", F.row_number().over(Window.partitionBy(*unit, "p").orderBy("p"))), "repeated")
    upto = Window.partitionBy(*unit).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.groupBy(*unit, "p").agg(F.count(F.lit(1)).alias("c")).select(*unit, "p", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("s"))
    numbered_ = held.alias("k").join(shift.alias("s"), _same("k", "s", *unit, "p")).select("k.row", *[f"k.{c}" for c in unit], (F.col("s.s") + F.col("k.i") - 1).alias("n"))
    return plain.unionByName(numbered_)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """docs' rows as often as the shards hold them, with mix_shard; other columns stay as they are, whatever their names.

    A partition holds one part of a shard or several, each in its shuffled order.  Which of the rows that agree in id, source and text are
    taken, if not all are, is not said.  No rows give no rows.
    """
    planned, shards, each = plan(write_out(units(docs, id_col, text_col, source_col), "units"), seed=seed, **options)
    rows, drawn = _rows(docs, planned, id_col, text_col, source_col), deal(planned, each, seed)
    inside = F.col("r.n").isNull() | (F.col("r.n") >= F.col("d.first")) & (F.col("r.n") < F.col("d.first") + F.col("d.m"))
    # a unit's rows meet the spans of their own stretch of COPIES numbers
    rows, drawn = rows.withColumn("c", F.coalesce(F.floor(F.col("n") / COPIES), F.lit(0))), drawn.withColumn("c", F.floor(F.col("first") / COPIES))
    joined = rows.alias("r").join(drawn.alias("d"), _same("r", "d", "id", "source", "digest", "c") & inside).select("r.row", "d.shard", "d.part", "d.place")
    dealt = joined.repartition(shards * each, "shard", "part").sortWithinPartitions("shard", "part", "place")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix_shard"], F.col("shard").alias("mix_shard"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    planned, _, each = plan(write_out(units(docs, "doc_id", "text", "source"), "units"))
    span = [*UNIT, "first", "m", "source_size", "target"]
    held = deal(planned, each).withColumn("held", F.struct("shard", "part", "place"))
    none = planned.where(F.size("shards") == 0).withColumn("held", F.lit(None).cast(held.schema["held"].dataType))
    rows = held.select(*span, "held").unionByName(none.select(*span, "held")).groupBy(*span).agg(F.sum(F.when(F.col("held").isNotNull(), F.col("size")).otherwise(0)).alias("taken"), F.array_sort(F.collect_list("held")).alias("held"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "held", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth")).drop("nth")
