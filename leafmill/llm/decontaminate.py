"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark items' windows of 13 words (a shorter item is one window).  Patterns of one length m form a
searcher: the shift table maps every block of B consecutive pattern words to its distance from the window's end; a block
that no pattern has lets the search jump m - B + 1 words.  A block with shift 0 leads to the bucket of the patterns that
end with it; of those, the ones whose hash agrees are compared word by word, so that a bucket of many
patterns costs no more than one of few.

Tables are flat arrays, sorted by the hash of the block: some forty bytes a word of the items with the words themselves, built once on the
driver and sent as they are.  An item of any length is cut into parts that overlap by a window less a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, read, remove
from .substring_dedup import hash_words, window_hashes

WINDOW = 13
#: Words of benchmark items that are broadcast at once; more items are searched in further passes of blocks of this size.
BLOCK_WORDS = 2_000_000
#: Bytes of an item that are cut into words at once, at least.
PART_BYTES = 1 << 16
#: Upper case to lower; what separates words, to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_FOLD).split()


class Words:
    """The words of a folded text, cut apart when they are asked for."""

    def __init__(self, text: bytes):
        self.text, self.words = text, None

    def __getitem__(self, some: slice) -> list[bytes]:
        if self.words is None:
            self.words = self.text.split()
        return self.words[some]


class Searcher:
    """Wu-Manber tables for windows of m words of texts, whose words stand one space apart; owners has an item per text."""

    def __init__(self, texts: list[bytes], owners: list, m: int):
        self.m, self.block, self.owners = m, min(3, m), owners
        self.jump = m - self.block + 1
        self.raw = b"\n".join(texts)
        a, b, start = hash_words(self.raw)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.r_[0, np.searchsorted(start, ends)]  # the number of each text's first word
        size = np.diff(self.first)
        place = np.arange(len(a)) - np.repeat(self.first[:-1], size)
        at = np.flatnonzero(place + self.block <= np.repeat(size, size))  # where blocks begin
        keys = window_hashes((a, b), self.block, 64)[0][at]
        shift = np.maximum(m - self.block - place[at], 0).astype(np.uint8) if m < 256 else np.maximum(m - self.block - place[at], 0)
        word = at + self.block - m  # the first word of the window that ends with the block
        whole = window_hashes((a, b), m, 64)[0]
        hashes = np.where(shift == 0, whole[np.clip(word, 0, len(whole) - 1)], np.uint64(0))
        order = np.lexsort((word, hashes, shift, keys))
        keys, shift, hashes, word = keys[order], shift[order], hashes[order], word[order]
        # a window that a text repeats is kept once; of a block's longer shifts, the least
        text = np.searchsorted(self.first, word, "right")
        same = np.r_[False, (keys[1:] == keys[:-1]) & ((shift[1:] > 0) | (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))] if len(keys) else np.empty(0, bool)
        keep = ~same
        self.keys, self.shifts, self.hashes = keys[keep], shift[keep], hashes[keep]
        self.word = word[keep].astype(np.int32 if len(a) < 1 << 31 else np.int64)
        self.start = np.append(start, len(self.raw) + 1).astype(np.uint32 if len(self.raw) < (1 << 32) - 1 else np.int64)

    def find(self, hashed: tuple[np.ndarray, np.ndarray], words: Words | list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence in a text of these words and their hashes."""
        m, n = self.m, len(hashed[0])
        if n < m or not len(self.keys):
            return
        keys = window_hashes(hashed, self.block, 64)[0]
        at_key = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        shift = np.where(self.keys[at_key] == keys, self.shifts[at_key], self.jump)
        if shift[m - self.block :].all():
            return
        shift, whole, at = shift.tolist(), window_hashes(hashed, m, 64)[0], m
        while at <= n:
            s = shift[at - self.block]
            if s:
                at += s
                continue
            start = at - m
            if found := self._owners(int(at_key[at - self.block]), keys[at - self.block], whole[start], words, start):
                yield start, found
            at += 1

    def _owners(self, lo: int, key: np.uint64, hash_: np.uint64, words: Words | list[bytes], start: int) -> list:
        hi = int(np.searchsorted(self.keys, key, "right"))
        hi = lo + int(np.searchsorted(self.shifts[lo:hi], 1))  # the bucket: windows that end with the block
        a, b = (lo + int(np.searchsorted(self.hashes[lo:hi], hash_, side)) for side in ("left", "right"))
        said = b" ".join(words[start : start + self.m]) if a < b else b""
        out = []
        for w in self.word[a:b].tolist():
            if self.raw[int(self.start[w]) : int(self.start[w + self.m]) - 1] == said:
                out.append(self.owners[int(np.searchsorted(self.first, w, "right")) - 1])
        return out


def searchers(rows: list[tuple[object, bytes | None]], window: int = WINDOW) -> list[Searcher]:
    """A searcher for each length of window of items' texts, raw or already parts of items."""
    by_length: dict[int, tuple[list[bytes], list]] = defaultdict(lambda: ([], []))
    for item, raw in rows:
        words = words_of(raw)
        if words:
            texts, owners = by_length[min(window, len(words))]
            texts.append(b" ".join(words))
            owners.append(item)
    return [Searcher(*by_length[m], m) for m in sorted(by_length)]


def item_parts(raw: bytes | None, most: int, window: int = WINDOW) -> Iterator[tuple[bytes, int]]:
    """An item's text, folded, in parts of about ``most`` words, and their words: every window of the item is in one part at least."""
    raw, at, held, none = raw or b"", 0, [], True
    step = max(PART_BYTES, 6 * most)
    while at < len(raw) or none:
        end = at + step
        while end < len(raw) and raw[end : end + 1].translate(_FOLD) != b" ":
            end += 1
        words = held + words_of(raw[at:end])
        at = end
        if len(words) >= window or at >= len(raw) and none:
            yield b" ".join(words), len(words)
            none, held = False, words[len(words) - window + 1 :] if window > 1 else []
        else:
            held = words


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, window: int = WINDOW) -> Iterator[list]:
    rows, n = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        for part, count in item_parts(None if r["t"] is None else bytes(r["t"]), block_words, window):
            rows.append((r["i"], part))
            n += count
            if n >= block_words:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, text, n_words, hits, items): hits is a binary of one byte a word, 1 inside an occurrence; items the sorted ids found.

    Benchmark items are read in blocks of about block_words words (long items in parts); each block is broadcast and
    searched in one pass over docs without a shuffle, and the passes add up.  The driver holds one block at a time (and
    the next while a pass is written); every pass but the last is written to the shared folder, after which its
    broadcast is freed and the pass before it removed.  Null or wordless texts have no words and
    no hits; a null or wordless item has no window; an item without an id marks its words but is not listed.  Repeated
    rows are judged one by one; an empty benchmark finds nothing.  Further columns are not read.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(k, t) for k, t in (("text", T.BinaryType()), ("n_words", T.LongType()), ("hits", T.BinaryType()), ("items", T.ArrayType(T.StringType())))]])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))

    def one_pass(tables):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                count, hits, items = [], [], []
                for t, was, had in zip(b.column(1), b.column(3), b.column(4), strict=True):
                    text = (t.as_py() or b"").translate(_FOLD)
                    *hashed, starts = hash_words(text)
                    mask, found, words = bytearray(was.as_py() or bytes(len(starts))), set(had.as_py() or ()), Words(text)
                    for s in tables.value:
                        one = b"\x01" * s.m
                        for start, items_ in s.find(tuple(hashed), words):
                            mask[start : start + s.m] = one
                            found.update(str(i) for i in items_ if i is not None)
                    count.append(len(starts))
                    hits.append(bytes(mask))
                    items.append(sorted(found))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "n_words", "hits", "items"])

        return run

    blocks, before = _blocks(benchmark, item_col, item_text_col, block_words, window), None
    rows = next(blocks, [])
    while True:
        tables = spark.sparkContext.broadcast(searchers(rows, window))
        out = out.mapInArrow(one_pass(tables), schema)
        rows = next(blocks, None)
        if rows is None:
            return out
        path = new_path(spark, "hits")
        out.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(schema).parquet(path)
        tables.destroy()
        if before:
            remove(spark, before)
        before = path


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least one word in twenty inside an occurrence."""
    n_hit = F.length(F.regexp_replace(F.hex("hits"), "00", "")) / 2
    return found.withColumn("n_hit", n_hit.cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows; takes contamination()'s options.  Each text goes through once, beside its other columns."""
    text = options.pop("text_col", "text")
    others = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text])
    left = judged(contamination(docs.select(others.alias("row"), F.col(text).alias("text")), benchmark, id_col="row", **options)).where("not contaminated")
    return left.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"id.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged(found).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = {
    "op3_benchmark_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
o AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.s = p.s AND dw.m = p.m),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
