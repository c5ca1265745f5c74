"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Fingerprint: 64 bits; bit i is set if it is set in more than half of the XXH64 hashes (seed 42) of the text's word
shingles, repeats included.  Two fingerprints link if they differ in at most ``radius`` bits.

Search: a covering family of 2^(radius+1)-1 bit masks.  Bit i gets a vector m(i) of radius+1 bits; the mask of a
non-zero vector v keeps the bits with <v, m(i)> = 1.  For any set of at most ``radius`` differing bits some v is
orthogonal to all their vectors, so the pair agrees on that mask: no pair within the radius is missed.

Distinct fingerprints only are compared.  A bucket of a mask is compared inside one task while it holds at most
``bucket_rows`` fingerprints (breadth-first, so that a dense bucket costs little and gives a spanning forest, never all
pairs).  The fingerprints of larger buckets are linked exactly another way: two of them are within the radius if and
only if they share a point at half the radius from both, so each is dealt to all points of its ball and each point
links what it got to its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_out
from .graph import connected_components, salted_join

RADIUS = 4
SHINGLE = 4
BUCKET_ROWS = 32768


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 for null or no words."""
    from xxhash import xxh64_intdigest as h

    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    norm = b" ".join(words)
    if n <= shingle:
        return h(norm, 42)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([h(norm[i:j], 42) for i, j in spans], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row of docs, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering family's masks, as unsigned numbers; the vectors are dealt evenly, so every mask keeps half the bits."""
    top = 2 ** (radius + 1)
    vector = [1 + (7 * i) % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (v & vector[i]).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges (first, member) that join the linked ones of these distinct fingerprints."""
    left = fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            for x in left[near]:
                queue.append(x)
                yield root, x
            left = left[~near]


def _compare(radius: int, most: int):
    """Over rows sorted by (t, key): edges (a, b, false), and (fp, fp, true) for each fingerprint of a larger bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)  # the last bucket, which may go on
        hot = None  # (t, key) of a bucket over the limit

        def close(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Edges of whole buckets."""
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            start, stop = np.r_[0, cut], np.r_[cut, len(rows)]
            size = stop - start
            two = start[size == 2]
            x, y = rows[two, 2].view(np.uint64), rows[two + 1, 2].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= radius
            a, b = [x[near]], [y[near]]
            for i, j in zip(start[size > 2].tolist(), stop[size > 2].tolist(), strict=True):
                pairs = list(_forest(np.ascontiguousarray(rows[i:j, 2]).view(np.uint64), radius))
                if pairs:
                    p = np.array(pairs, dtype=np.uint64)
                    a.append(p[:, 0])
                    b.append(p[:, 1])
            return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)

        def out(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]).astype(np.int64, copy=False)
            if hot is not None:
                same = (rows[:, 0] == hot[0]) & (rows[:, 1] == hot[1])
                if same.any():
                    yield out(rows[same, 2], rows[same, 2], True)
                rows = rows[~same]
                if len(rows):
                    hot = None
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = int(np.argmax((rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])))
            held, done = rows[last:], rows[:last]
            if len(held) > most:
                hot = tuple(held[0, :2])
                yield out(held[:, 2], held[:, 2], True)
                held = held[:0]
            if len(done):
                yield out(*close(done), False)
        if len(held):
            yield out(*close(held), False)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) edges that join all fingerprints (column fp, each once) within the radius, directly or through others."""
    if radius % 2:
        raise ValueError("the exact way for large buckets halves the radius; give an even one")
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])
    dealt = distinct.select("fp", F.posexplode(keys).alias("t", "key")).select(F.col("t").cast("long").alias("t"), "key", "fp")
    sorted_ = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = write_out(sorted_.mapInArrow(_compare(radius, bucket_rows), "a long, b long, large boolean").distinct(), "links")
    edges = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("fp"))
    if not large.isEmpty():
        edges = edges.unionByName(_by_centres(large, radius // 2))
    return edges


def _by_centres(large: DataFrame, half: int) -> DataFrame:
    """Edges of the fingerprints of large buckets: those that share a point within half the radius."""
    points = large.select("fp", F.col("fp").alias("c"))
    for _ in range(half):
        step = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        points = points.select("fp", F.explode(step).alias("s"), "c").select("fp", F.col("c").bitwiseXOR(F.col("s")).alias("c")).distinct()
    first = points.groupBy("c").agg(F.min("fp").alias("a"))
    return points.join(first, "c").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest id that can be reached over links, its own included.  Null or wordless texts have
    fingerprint zero and link like any other.  Rows that repeat an id keep their own fingerprints, all of which carry
    that id.  A null id is never the smallest unless its class has no other.  Further columns of docs, whatever their
    names, are not read.  No rows give no rows.
    """
    marks = write_out(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), radius, bucket_rows))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "root")
    members = joined.where("root is not null")
    below = members.groupBy("root").agg(F.min("least").alias("below"))
    heads = joined.where("root is null").join(below.withColumnRenamed("root", "of"), F.col("fp") == F.col("of"), "left").select("fp", F.least("least", "below").alias("component_id"), F.col("of").isNotNull().alias("head"))
    inside = salted_join(members.select("fp", "root"), heads.where("head").select(F.col("fp").alias("root"), "component_id"), "root", "fp")
    classes = heads.select("fp", "component_id").unionByName(inside.select("fp", "component_id"))
    return marks.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
