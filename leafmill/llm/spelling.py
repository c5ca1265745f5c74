"""Grouping of spelling variants by dynamic programming over sorted word lists.

Counting.  Runs of letters are found in the bytes of a whole batch of texts, their CRC-32 worked out for all runs at once, and a
task's words are summed up before they are shuffled.

Keys.  Two words at one edit differ in their first or in their second half, so they share the other half: a word meets words of its own length
and those longer by one under the first half, and under the second half, of the shorter length.  The two lists of a key hold its words
without what they share (``middle``).  A key of more than ``most`` words is halved again, as often as needed; at the end a middle is one
letter, of which there are 90.  Every pair of near words is found under one key alone: where it differs in the first part only.

Scan.  A key's middles are sorted.  Going down the list by its adjacent longest common prefixes, words that share a prefix are one
range, and the row of the edit matrix after that prefix is worked out once for the range.  Of a row three cells are kept,
those within one edit of the diagonal, each 0, 1 or 2 (more than one edit): 27 rows, so a step is a look-up by row and by which
of three letters of the asking word are the range's next one.  A range whose cells all exceed one edit is skipped with all its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, remove, write_out

LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
#: Every word whose CRC-32 with its document's id this divides loses a letter.
TYPO = 97
#: Words of a key at most; larger keys are halved again.
MOST = 20_000
#: Words that ask at once, bytes of text looked at at once, and distinct words that a task holds before they are sent on.
ASKING, CHUNK, HELD = 4096, 4 << 20, 1 << 20


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a byte of a run, where runs start and stop) of UTF-8 bytes: ASCII letters and the pairs C3 80 to C3 BF."""
    low = raw | 0x20
    letter = (low >= 97) & (low <= 122) & (raw < 128)
    lead = np.flatnonzero(raw == 0xC3)
    letter[lead] = True
    letter[lead + 1] = True
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False]))
    return letter, edge.reshape(-1, 2)


def _words(ids: list, texts: pa.Array) -> pa.Array:
    """The words of texts, with the letters that are to go gone; no text has a null or is empty."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    # a blank after each text keeps the runs of neighbours apart
    raw = np.insert(np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at[1:] - at[0], 32)
    ends = at[1:] - at[0] + np.arange(1, len(at))
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    letter, runs = _runs(raw)
    if not len(runs):
        return pa.array([], pa.string())
    size = runs[:, 1] - runs[:, 0]
    start = np.r_[0, np.cumsum(size)]
    packed = raw[letter]
    seed = np.array([zlib.crc32(b"" if i is None else b"%d:" % i if isinstance(i, int) else f"{i}:".encode()) for i in ids], np.uint32)
    crc = ~seed[np.searchsorted(ends, runs[:, 0], "right")]
    order = np.argsort(-size, kind="stable")  # the long ones first, so that those with a byte at a place are a beginning
    begin, many = start[:-1][order], np.searchsorted(-size[order], np.arange(-1, -int(size.max()) - 1, -1), "right")
    crc = crc[order]
    for place, n in enumerate(many.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ packed[begin[:n] + place]) & 0xFF] ^ (crc[:n] >> 8)
    odd = ~crc % TYPO == 0
    whole = pa.StringArray.from_buffers(len(size), pa.py_buffer(start.astype(np.int32)), pa.py_buffer(packed))
    if not odd.any():
        return whole
    at = np.sort(order[odd])
    h = np.empty(len(size), np.uint32)
    h[order] = ~crc
    cut = [w[: (k := x % len(w))] + w[k + 1 :] for w, x in zip(whole.take(pa.array(at)).to_pylist(), h[at].tolist(), strict=True)]
    keep = np.ones(len(size), bool)
    keep[at] = False
    return pa.concat_arrays([whole.filter(pa.array(keep)), pa.array(cut, pa.string())])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least ``letters`` letters that occur at least ``least`` times.

    A word is a maximal run of A-Z, a-z, U+00C0 to U+00FF with A-Z lower-cased, without one letter where TYPO divides the
    CRC-32 of "<id>:<run>".  A null text has no words; a null id and its colon are left out; repeated rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        rows = 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(sizes > 0))
            sizes = sizes[sizes > 0].astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // CHUNK
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                words = _words(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo))
                got = pc.value_counts(words.filter(pc.greater_equal(pc.utf8_length(words), letters)))
                held.append(pa.table({"word": got.field(0), "n": got.field(1)}))
                rows += len(got)
                if rows > 2 * HELD:
                    held[:] = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=1 << 16)
                        rows = 0
        if held:
            yield from summed().combine_chunks().to_batches(max_chunksize=1 << 16)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- keys ----


def _halved(rows: DataFrame) -> DataFrame:
    """Keys (m, a, s) halved: what is shared are the first a and the last s letters of words of m, or m + 1, letters."""
    first = F.floor((F.col("m") - F.col("a") - F.col("s")) / 2).cast("int")
    to = F.array(F.struct((F.col("a") + first).alias("a"), F.col("s").alias("s"), F.col("back").alias("back")), F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - first).alias("s"), F.lit(True).alias("back")))
    return rows.withColumn("to", F.explode(to)).select("word", "n", "m", "to.a", "to.s", "to.back")


def _keyed(rows: DataFrame) -> DataFrame:
    shared: Column = F.concat_ws("|", F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(F.length("word") - F.col("s") + 1, F.col("s")))
    return rows.withColumn("key", shared)


KEY = ["m", "a", "s", "back", "key"]


def keyed(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, m, a, s, back, key): every word under the keys where its near words may be; no key has more than ``most`` words, or
    what is left of it cannot be halved.  back: the pair differs in a first part, so it is another key's if the shorter middle begins the longer one."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    rows = _keyed(_halved(both.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(False).alias("back"))))
    out = None
    while True:
        big = rows.groupBy(*KEY).count().where((F.col("count") > most) & (F.col("m") - F.col("a") - F.col("s") > 1)).select(*KEY)
        big = write_out(big, "keys")
        if big.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(big, KEY, "left_anti")
        out = small if out is None else out.unionByName(small)
        rows = _keyed(_halved(rows.join(big, KEY, "left_semi").select("word", "n", "m", "a", "s", "back")))


# ---- the scan ----


def _row_steps() -> np.ndarray:
    """[row, equal letters] -> row.  A row's cells are the edits from a range's first d letters to the word's first d - 1, d, d + 1
    letters; bit k of equal letters says that the range's next letter is the word's letter d - 1 + k."""
    out = np.empty((27, 8), np.uint8)
    for row in range(27):
        a, b, c = row // 9, row // 3 % 3, row % 3
        for same in range(8):
            e = [1 - (same >> k & 1) for k in range(3)]
            x = min(2, a + e[0], b + 1)
            y = min(2, b + e[1], c + 1, x + 1)
            z = min(2, c + e[2], y + 1)
            out[row, same] = 9 * x + 3 * y + z
    return out


_STEPS = _row_steps()
_CELL = np.array([[r // 9, r // 3 % 3, r % 3] for r in range(27)], np.uint8)
#: All cells over one edit.
_DEAD = 26


def _adjacent(buf: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Letters that each middle shares with the one before it; -1 where a key begins."""
    out = np.where(new, -1, 0)
    live = np.flatnonzero(~new)
    for d in range(int(size.max(initial=0))):
        live = live[(size[live] > d) & (size[live - 1] > d)]
        live = live[buf[at[live] + d] == buf[at[live - 1] + d]]
        if not len(live):
            break
        out[live] = d + 1
    return out


def near_pairs(buf: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking, found): pairs at one edit inside keys.

    Middle i is buf[at[i]:at[i] + size[i]], sorted inside its key, keys one after another; new marks where a key begins and asks who
    asks: the middles of the shorter length.  Two that both ask are found once.  buf has three bytes more than middles.
    """
    lcp = _adjacent(buf, at, size, new)
    by_lcp = np.argsort(lcp, kind="stable")
    first = np.searchsorted(lcp[by_lcp], np.arange(-1, int(size.max(initial=0)) + 2))
    starts = np.r_[np.flatnonzero(new), len(new)]
    key = np.cumsum(new) - 1
    all_q, all_w = [], []
    for some in range(0, len(asks), ASKING):
        q = asks[some : some + ASKING]
        lo, hi, row = starts[key[q]], starts[key[q] + 1], np.full(len(q), 2 * 9 + 0 * 3 + 1, np.uint8)
        d = 0
        while len(q):
            # a word of d letters ends here
            ends = np.flatnonzero(size[lo] == d)
            w, by = lo[ends], q[ends]
            gap = size[by] - d + 1
            hit = (gap >= 0) & (gap <= 2) & (w != by) & ((size[by] < size[w]) | (size[by] == size[w]) & (by < w))
            hit[hit] = _CELL[row[ends[hit]], gap[hit]] == 1
            all_q.append(by[hit])
            all_w.append(w[hit])
            lo = lo + (size[lo] == d)
            keep = (lo < hi) & ~((hi - lo == 1) & (lo == q))
            q, lo, hi, row = q[keep], lo[keep], hi[keep], row[keep]
            if not len(q):
                break
            # ranges divide where neighbours share d letters and no more
            at_d = by_lcp[first[d + 1] : first[d + 2]]
            a, b = np.searchsorted(at_d, lo, "right"), np.searchsorted(at_d, hi)
            n = b - a + 1
            of = np.repeat(np.arange(len(q)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            cut = np.r_[at_d, 0]
            left = np.where(nth == 0, lo[of], cut[a[of] + nth - 1])
            right = np.where(nth == n[of] - 1, hi[of], cut[np.minimum(a[of] + nth, len(at_d))])
            by = q[of]
            # the asking word's letters d - 1, d, d + 1 against the range's letter d
            letter, begin, length = buf[at[left] + d], at[by], size[by]
            same = np.zeros(len(of), np.uint8)
            for k in range(3):
                j = d - 1 + k
                if j >= 0:
                    same |= ((buf[begin + np.minimum(j, length)] == letter) & (j < length)).astype(np.uint8) << k
            row = _STEPS[row[of], same]
            keep = row != _DEAD
            q, lo, hi, row = by[keep], left[keep], right[keep], row[keep]
            d += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *all_q]), np.concatenate([none, *all_w])


def _best(words: pa.Array, n: np.ndarray, q: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, best) of both ends of pairs: how many and the most frequent, the smallest on ties."""
    me, other = np.r_[q, w], np.r_[w, q]
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], me))
    me, other = me[order], other[order]
    head = np.flatnonzero(np.r_[True, me[1:] != me[:-1]]) if len(me) else np.empty(0, np.int64)
    best = other[head]
    pair = pa.StructArray.from_arrays([pa.array(-n[best]), words.take(pa.array(best))], ["minus", "word"])
    return pa.record_batch([words.take(pa.array(me[head])), pa.array(np.diff(np.r_[head, len(me)])), pair], names=["word", "n_near", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, whole, in groups of about MOST words: their near pairs."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch:
        words = rows["word"].combine_chunks().cast(pa.string())
        m, a, s, back, nth = (rows[c].to_numpy() for c in ("m", "a", "s", "back", "nth"))
        text = "".join(words.to_pylist()).encode("latin-1")
        length = pc.utf8_length(words).to_numpy()
        buf = np.frombuffer(text + b"\0\0\0", np.uint8)
        at, size = np.cumsum(length) - length + a, length - a - s
        q, w = near_pairs(buf, at, size, np.r_[True, nth[1:] != nth[:-1]], np.flatnonzero(length == m))
        # under a key of the last letters, a pair whose shorter middle begins the longer one shares the first letters too
        far = np.flatnonzero(back[q] & (size[w] > size[q]))
        begins = far.copy()
        for d in range(int(size[q[far]].max(initial=0))):
            begins = begins[(size[q[begins]] <= d) | (buf[at[q[begins]] + np.minimum(d, size[q[begins]])] == buf[at[w[begins]] + d])]
        once = np.ones(len(q), bool)
        once[begins] = False
        return _best(words, rows["n"].to_numpy(), q[once], w[once])

    left, rows, nth, last = None, 0, 0, None
    for b in batches:
        for at in range(0, b.num_rows, MOST):
            some = b.slice(at, MOST)
            keys = [some.column(c) for c in KEY]
            now = list(zip(*(k.to_pylist() for k in keys), strict=True))
            ids = np.empty(len(now), np.int64)
            for i, k in enumerate(now):
                if k != last:
                    nth, last = nth + 1, k
                ids[i] = nth
            t = pa.Table.from_batches([some]).append_column("nth", pa.array(ids))
            left = t if left is None else pa.concat_tables([left, t])
            if left.num_rows > MOST and left["nth"][0].as_py() != nth:
                cut = int(np.searchsorted(left["nth"].to_numpy(), nth))
                yield out(left.slice(0, cut))
                left = left.slice(cut)
    if left is not None and left.num_rows:
        yield out(left)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best): words of (word, n) with near words; best holds minus the largest n and the smallest word that has it.

    words holds each word once, of letters up to U+00FF.
    """
    middle = F.col("word").substr(F.col("a") + 1, F.length("word") - F.col("a") - F.col("s"))
    rows = keyed(words, most).select("word", "n", *KEY, middle.alias("middle"))
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "middle").drop("middle")
    found = dealt.mapInArrow(_scan, "word string, n_near long, best struct<minus: long, word: string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms of a word lead, by doubling of pointers; forms lead to no circle."""
    spark = forms.sparkSession
    now = forms.where("form is not null").select("word", F.col("form").alias("root"))
    paths = []
    while True:
        path = new_path(spark, "roots")
        now.write.option("compression", "zstd").parquet(path)
        paths.append(path)
        now = spark.read.schema("word string, root string").parquet(path)
        step = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        if step.where("y.root is not null").isEmpty():
            break
        now = step.select("x.word", F.coalesce("y.root", "x.root").alias("root"))
        if len(paths) > 1:
            remove(spark, paths.pop(0))
    return now


def variants(words: DataFrame, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), one row a word.

    n_near counts the words at exactly one inserted, deleted or replaced letter; form is the most frequent of them, the smallest by code
    points on ties, if its n is at least ``factor`` times the word's (above 1, so that forms lead to no circle); root is where forms lead in
    the end, the word itself if it has none.  Words without near words have null form and form_n and n_near 0; no rows give no rows.
    """
    found = words.join(near_words(words, most), "word", "left")
    enough = F.col("best").isNotNull() & (-F.col("best.minus") >= factor * F.col("n"))
    rows = write_out(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(write_out(word_counts(read(spark, sf_dir, "documents")), "words"))
