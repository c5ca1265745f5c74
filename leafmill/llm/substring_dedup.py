"""Removal of repeated passages with a log-structured fingerprint index of window hashes.

A window is 13 consecutive words of one document; it is repeated where it also starts in a document of an earlier batch, or
in a document with a smaller id of its own batch.

Fingerprint.  A word has two 64-bit hashes, made eight bytes at a time by two chains of multiplying and mixing (words of over
256 bytes: the halves of their XXH3).  A window's fingerprint h and its digest v are sums of its words' first and second
hashes, every place weighed by an odd number of its own, and mixed: 64 bits each, 128 in all.

Index.  Every batch becomes an immutable run: the sorted (h, v) of the windows that history lacks, dealt to hash ranges
(``bucket``) of bounded size and laid down as a table bucketed by them.  Runs of like size are merged (compacted), bucket by
bucket.

A batch.  Its documents are written with the part that each is in; each part sorts its windows, keeps each once with its least id, and deals them to
the hash ranges.  There they are merge-joined with the runs, which do not move: equal h are candidates, and v
verifies them, so no window is called repeated on its fingerprint alone.  A range answers each part with the part's own windows that
are repeated, and the part removes their words.  Nothing but a batch's own texts is read; history is its (h, v) alone.

Hot passages.  A part sends a window once however often it holds it, so a passage of a third of all documents gives its
range one entry a part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_path, read, remove

WINDOW = 13
#: Batches of a whole table, in order of id: runs of eight, four and two of them remain, so no merge rewrites everything.
BATCHES = 14
#: Bytes of text after which a part of a batch ends, and that are hashed and sorted at once.
PART_BYTES = 8 << 20
STEP = 2 << 20
#: Windows of the whole index that a hash range should hold.
BUCKET_WINDOWS = 1 << 20
_ALL = (1 << 64) - 1
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FIRST = np.array([_ALL >> (64 - 8 * n) if n else 0 for n in range(9)], np.uint64)
_LONG = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every word of a text, and where the words start."""
    from xxhash import xxh3_128_intdigest

    padded = text + bytes(8)
    start, end = _words(np.frombuffer(padded, np.uint8)[: len(text)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    x = eight[start] & _FIRST[np.minimum(size, 8)]
    length = size.astype(np.uint64)
    a = _mix(x ^ (length * np.uint64(0xC2B2AE3D27D4EB4F)))
    b = _mix((x + length) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x165667B19E3779F9))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(more):
        x = eight[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
        a[more] = _mix(a[more] * np.uint64(0xD6E8FEB86659FD93) ^ x)
        b[more] = _mix((b[more] ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) + x)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        d = xxh3_128_intdigest(text[start[i] : end[i]])
        a[i], b[i] = d >> 64, d & _ALL
    return a, b, start


def window_hashes(words: tuple[np.ndarray, np.ndarray], window: int, bits: int) -> list[np.ndarray]:
    """Fingerprint h (its upper ``bits``) and digest v of every window of words with these hashes."""
    n = len(words[0]) - window + 1
    out = []
    for k, half in enumerate(words):
        weight = _weights(window, k)
        total = half[:n] * weight[0]
        for i in range(1, window):
            total += half[i : i + n] * weight[i]
        out.append(_mix(total))
    if bits < 64:
        out[0] &= np.uint64(_ALL << (64 - bits) & _ALL)
    return out


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of some millions of bytes, cut where words end; at least one."""
    at = 0
    while len(raw) - at > STEP:
        end = at + STEP
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def windows(texts: list[bytes], window: int, bits: int, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, h, v) of all whole windows, about STEP bytes at a time; adds the texts' words to count."""
    group: list[int] = []
    size = 0
    for k in range(len(texts) + 1):
        if group and (k == len(texts) or size + len(texts[k]) > STEP):
            owner = np.array(group)
            a, b, start = hash_words(b"\n".join([texts[i] for i in group]))
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            sizes = np.diff(np.r_[0, np.searchsorted(start, ends)])
            count[owner] += sizes
            offset = np.cumsum(sizes) - sizes
            place = np.arange(len(a)) - np.repeat(offset, sizes)
            whole = np.flatnonzero(place + window <= np.repeat(sizes, sizes))
            if len(whole):
                h, v = window_hashes((a, b), window, bits)
                yield np.repeat(owner, sizes)[whole], place[whole], h[whole], v[whole]
            group, size = [], 0
        if k == len(texts):
            return
        if len(texts[k]) <= STEP:
            group.append(k)
            size += len(texts[k]) + 1
            continue
        a = b = np.empty(0, np.uint64)
        for piece in pieces(texts[k]):
            x, y, _ = hash_words(piece)
            at = count[k] - len(a)
            count[k] += len(x)
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) >= window:
                h, v = window_hashes((a, b), window, bits)
                yield np.full(len(h), k), at + np.arange(len(h)), h, v
                a, b = a[len(h) :], b[len(h) :]


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, as the upper bytes, which hardly change, compress well then."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in raw.to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _plain(raw: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.uint64)


def _packed(ids: np.ndarray, kind: pa.DataType) -> bytes:
    """Ids of one type as bytes: integers byte by byte, others as an Arrow batch."""
    if pa.types.is_integer(kind):
        return _planes(ids.astype(np.int64))
    return pa.record_batch([pa.array(ids, kind)], names=["x"]).serialize().to_pybytes()


def _unpacked(raw: pa.ChunkedArray, kind: pa.DataType) -> np.ndarray:
    if pa.types.is_integer(kind):
        return _unplaned(raw).view(np.int64)
    schema = pa.schema([("x", kind)])
    parts = [pa.ipc.read_record_batch(pa.py_buffer(x), schema).column(0).to_numpy(zero_copy_only=False) for x in raw.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, object)


def _sorted(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (h, v), and where a new pair starts in it."""
    order = np.argsort(h, kind="stable")
    for again in (False, True):
        hs, vs = h[order], v[order]
        same = hs[1:] == hs[:-1]
        equal = same & (vs[1:] == vs[:-1])
        if again or (same == equal).all():
            break
        order = np.lexsort((v, h))
    return order, np.flatnonzero(np.r_[True, ~equal]) if len(h) else order


def find(h: np.ndarray, v: np.ndarray, known_h: np.ndarray, known_v: np.ndarray) -> np.ndarray:
    """Place of each (h, v) among known ones that are sorted by (h, v), or -1: a candidate by h, verified by v."""
    out = np.full(len(h), -1, np.int64)
    if not len(known_h):
        return out
    shift = np.uint64(64 - min(24, (8 * len(known_h)).bit_length()))
    seen = np.zeros(1 << (64 - int(shift)), bool)
    seen[known_h >> shift] = True
    left = np.flatnonzero(seen[h >> shift])
    at = np.searchsorted(known_h, h[left])
    while len(left):
        inside = at < len(known_h)
        left, at = left[inside], at[inside]
        same = known_h[at] == h[left]
        left, at = left[same], at[same]
        right = known_v[at] == v[left]
        out[left[right]] = at[right]
        left, at = left[~right], at[~right] + 1
    return out


class WindowIndex:
    """Sorted immutable runs under a folder of their own; leaving it as a context drops them.

    ``expected`` is about how many windows the index will hold in all; it sets the number of hash ranges.  ``bits`` are those
    of the fingerprint that are used; fewer only make more candidates for the digests to tell apart.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, expected: int = 1 << 24, bits: int = 64, part_bytes: int = PART_BYTES):
        self.spark, self.window, self.bits, self.part_bytes = spark, window, bits, part_bytes
        self.path = path or new_path(spark, "windows")
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.ranges = max(4 * self.tasks, expected // BUCKET_WINDOWS).bit_length()
        self.table = f"leafmill_windows_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, int]] = []  # number and its windows
        self.made = 0

    def __enter__(self) -> WindowIndex:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def _lay(self, rows: DataFrame) -> None:
        """Add rows to the table, which is bucketed by hash range and has a folder for each run."""
        rows.write.mode("append").format("parquet").option("compression", "zstd").option("path", self.path).partitionBy("run").bucketBy(self.tasks, "bucket").saveAsTable(self.table)

    def _keep(self, run: int) -> None:
        n = self.spark.table(self.table).where(F.col("run") == run).agg(F.sum("n")).first()[0]
        self.runs.append((run, n or 0))

    def _forget(self, *runs: int) -> None:
        for run in runs:
            remove(self.spark, f"{self.path}/run={run}")
        self.spark.catalog.refreshTable(self.table)

    def rows(self, runs: list | None = None) -> DataFrame:
        """(bucket, h, v) of these runs, by default of all; the scan is dealt by bucket already."""
        named = [run for run, _ in (runs if runs is not None else self.runs)]
        if not named:
            return self.spark.createDataFrame([], "bucket long, h binary, v binary")
        return self.spark.table(self.table).where(F.col("run").isin(named)).select("bucket", "h", "v")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)
        self.runs = []

    def compact(self, last: int | None = None) -> None:
        """Merge the last runs (all, if none is named) into one; hash ranges stay where they are."""
        old = self.runs[-last:] if last else list(self.runs)
        if len(old) < 2:
            return
        self.made = run = self.made + 1
        kind = self.spark.table(self.table).schema

        def merge(rows: pa.Table) -> pa.Table:
            h, v = _unplaned(rows["h"]), _plain(rows["v"])
            order, first = _sorted(h, v)
            order = order[first]
            made = {"bucket": [rows["bucket"][0].as_py()], "n": [len(order)], "h": [_planes(h[order])], "v": [v[order].tobytes()], "run": [run]}
            return pa.table([pa.array(made[k], t) if k in made else pa.nulls(1, t) for k, t in zip(names, types, strict=True)], names=names)

        names, types = [f.name for f in kind], [to_arrow_type(f.dataType) for f in kind]
        self._lay(self.rows(old).groupBy("bucket").applyInArrow(merge, kind))
        self.runs = self.runs[: -len(old)]
        self._keep(run)
        self._forget(*[r for r, _ in old])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
        """Remove what a batch repeats, then index it: (id, n_words, n_removed, kept) per row of docs.

        kept is the text left over (words joined by single spaces), or with text=False its SHA-256.  A window is repeated if
        an earlier batch has it, or a document of this one with a smaller id; the windows are those of the input, not of
        what is left.  Rows that repeat an id do not repeat each other.  A null text has no words; of fewer words than a
        window, or without an id, nothing is removed, and nothing is indexed.  An empty batch gives no rows; other columns are
        not read.
        """
        kind = docs.schema[id_col].dataType.simpleString()
        id_type = to_arrow_type(docs.schema[id_col].dataType)
        window, bits, part_bytes, ranges = self.window, self.bits, self.part_bytes, self.ranges

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents with their parts."""
            first, size = TaskContext.get().partitionId() << 32, 0
            for b in batches:
                length = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = size + np.cumsum(length)
                yield pa.record_batch([pa.array(first + (end - length) // part_bytes), b.column(0), b.column(1)], names=["part", "id", "raw"])
                size = int(end[-1]) if len(end) else size

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every part's windows by hash range."""
            number, texts, ids, held = None, [], [], 0
            names = ["bucket", "part", "n", "h", "v", "first", "again"]

            def sent() -> Iterator[pa.RecordBatch]:
                """The windows of the documents held, each once with its least id, and whether two of these have it."""
                who = pa.array(ids, type_).to_numpy(zero_copy_only=False)
                for owner, _, h, v in windows(texts, window, bits, np.zeros(len(texts), np.int64)):
                    order, first = _sorted(h, v)
                    h, v, mine = h[order[first]], v[order[first]], who[owner[order]]
                    least, most = np.minimum.reduceat(mine, first), np.maximum.reduceat(mine, first)
                    bucket = (h >> np.uint64(64 - ranges)).astype(np.int64)
                    edge = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
                    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                    flags = [np.packbits(least[a:b] < most[a:b]).tobytes() for a, b in spans]
                    some = [bucket[edge[:-1]], np.full(len(spans), number), np.diff(edge), [_planes(h[a:b]) for a, b in spans], [v[a:b].tobytes() for a, b in spans], [_packed(least[a:b], type_) for a, b in spans], flags]
                    yield pa.record_batch([pa.array(x, pa.int64() if k < 3 else pa.binary()) for k, x in enumerate(some)], names=names)

            for b in batches:
                type_ = b.schema.field(1).type
                for part, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if texts and (part != number or held >= STEP):
                        yield from sent()
                        texts, ids, held = [], [], 0
                    number = part
                    if i is not None and t.is_valid:
                        texts.append(t.as_py())
                        ids.append(i)
                        held += len(texts[-1])
            if texts:
                yield from sent()

        def merge(new: pa.Table, old: pa.Table) -> pa.Table:
            """The range's part of the new run, and answers to the parts (as a run of the opposite number)."""
            names = ["bucket", "part", "n", "h", "v", "first", "old", "run"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            if not new.num_rows:
                return pa.table([pa.nulls(0, t) for t in types], names=names)
            h, v = _unplaned(new["h"]), _plain(new["v"])
            sizes, least = new["n"].to_numpy(), _unpacked(new["first"], id_type)
            part = np.repeat(new["part"].to_numpy(), sizes)
            again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(new["again"].to_pylist(), sizes.tolist(), strict=True)]).astype(bool)
            order, start = _sorted(h, v)
            h, v, least, part, again = h[order], v[order], least[order], part[order], again[order]
            group = np.zeros(len(h), np.int64)
            group[start[1:]] = 1
            group = np.cumsum(group)
            first = np.minimum.reduceat(least, start)
            known_h, known_v = _unplaned(old["h"]), _plain(old["v"])
            known, _ = _sorted(known_h, known_v)
            held = find(h[start], v[start], known_h[known], known_v[known]) >= 0
            hit = np.flatnonzero(held[group] | again | (first[group] < least))
            hit = hit[np.argsort(part[hit], kind="stable")]
            edge = np.r_[0, np.flatnonzero(part[hit][1:] != part[hit][:-1]) + 1, len(hit)] if len(hit) else np.zeros(1, np.int64)
            bucket = new["bucket"][0].as_py()
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = hit[a:b]
                rows.append((bucket, int(part[x[0]]), len(x), _planes(h[x]), v[x].tobytes(), _packed(first[group[x]], id_type), np.packbits(held[group[x]]).tobytes(), -run))
            fresh = start[~held]
            rows.append((bucket, None, len(fresh), _planes(h[fresh]), v[fresh].tobytes(), None, None, run))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def judge(mine: pa.Table, told: pa.Table) -> pa.Table:
            """A part's documents without the words that its repeated windows cover."""
            known_h, known_v = _unplaned(told["h"]), _plain(told["v"])
            order, once = _sorted(known_h, known_v)  # a part's chunks may each have been told
            order = order[once]
            known_h, known_v = known_h[order], known_v[order]
            if told.num_rows:
                first = _unpacked(told["first"], id_type)[order]
                old = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(told["old"].to_pylist(), told["n"].to_pylist(), strict=True)]).astype(bool)[order]
            ids, raws = mine["id"].to_pylist(), [x.as_py() or b"" for x in mine["raw"]]
            named = [k for k, i in enumerate(ids) if i is not None] if told.num_rows else []
            who = pa.array([ids[k] for k in named], mine.schema.field("id").type).to_numpy(zero_copy_only=False)
            count, hits = np.zeros(len(named), np.int64), []
            for owner, at, h, v in windows([raws[k] for k in named], window, bits, count):
                place = find(h, v, known_h, known_v)
                hit = np.flatnonzero(place >= 0)
                place = place[hit]
                hit = hit[old[place] | (first[place] < who[owner[hit]])]
                hits.append((owner[hit], at[hit]))
            offset = np.cumsum(count) - count
            edges = np.zeros(int(count.sum()) + 1, np.int32)
            for owner, at in hits:
                np.add.at(edges, offset[owner] + at, 1)
                np.add.at(edges, offset[owner] + at + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            gone = {named[k]: covered[offset[k] : offset[k] + count[k]] for k in np.unique(np.concatenate([x for x, _ in hits])).tolist()} if hits else {}
            out = []
            for k, raw in enumerate(raws):
                kept, n, at, removed = [], 0, 0, 0
                for piece in pieces(raw):
                    w = piece.split()
                    n += len(w)
                    if k in gone:
                        mask = gone[k][at : at + len(w)]
                        at += len(w)
                        removed += int(mask.sum())
                        w = [x for x, g in zip(w, mask.tolist(), strict=True) if not g]
                    if w:
                        kept.append(b" ".join(w))
                joined = b" ".join(kept)
                out.append((ids[k], n, removed, joined.decode("utf-8", "replace") if text else hashlib.sha256(joined).hexdigest()))
            types = [mine.schema.field("id").type, pa.int64(), pa.int64(), pa.string()]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, types, strict=True)], names=["id", "n_words", "n_removed", "kept"])

        spark, at, done = self.spark, new_path(self.spark, "batch"), new_path(self.spark, "judged")
        self.made = run = self.made + 1
        schema = f"part long, id {kind}, raw binary"
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(deal, schema).write.option("compression", "zstd").parquet(at)
        mine = spark.read.schema(schema).parquet(at)
        sent = mine.mapInArrow(cut, "bucket long, part long, n long, h binary, v binary, first binary, again binary").repartition(self.tasks, "bucket")
        self._lay(sent.groupBy("bucket").cogroup(self.rows().groupBy("bucket")).applyInArrow(merge, "bucket long, part long, n long, h binary, v binary, first binary, old binary, run int"))
        told = spark.table(self.table).where(F.col("run") == -run).select("part", "n", "h", "v", "first", "old")
        judged = mine.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(judge, f"id {kind}, n_words long, n_removed long, kept string")
        judged.write.option("compression", "zstd").parquet(done)
        remove(spark, at)
        self._keep(run)
        self._forget(-run)
        while len(self.runs) > 1 and self.runs[-2][1] < 2 * self.runs[-1][1] and self.runs[-1][1] < 2 * self.runs[-2][1]:
            self.compact(2)
        return spark.read.schema(judged.schema).parquet(done)


def _range_ends(docs: DataFrame, id_col: str, batches: int) -> list:
    """The largest id of each of the first ranges of ids, of ids that have an order but no percentiles: a value a batch."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").repartitionByRange(batches, "id")
    ends = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("id")).orderBy("p").collect()
    return [r["id"] for r in ends[:-1]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = True, batches: int = BATCHES, **options) -> DataFrame:
    """WindowIndex.add()'s rows for a whole table, taken in batches of like size in order of id.

    As every batch's ids are above those before it, a window is repeated exactly where a document with a smaller id has it.
    Rows of one id share a batch; rows without an id go with the first.
    """
    shares = [k / batches for k in range(1, batches)]
    plain = isinstance(docs.schema[id_col].dataType, T.NumericType)
    cuts = F.percentile_approx(id_col, shares, 10_000) if plain else F.lit(None)
    facts = docs.agg(cuts.alias("cuts"), F.sum(F.octet_length(text_col)).alias("bytes")).first() if shares else None
    inner = _range_ends(docs, id_col, batches) if shares and not plain else facts["cuts"] or [] if facts else []
    edges = [None, *sorted(set(inner)), None]
    found = None
    with WindowIndex(docs.sparkSession, expected=int((facts and facts["bytes"]) or 1) // 6, **options) as index:
        for lo, hi in zip(edges, edges[1:], strict=False):
            held = F.lit(True) if lo is None and hi is None else F.col(id_col) > F.lit(lo) if hi is None else F.col(id_col) <= F.lit(hi)
            if lo is not None and hi is not None:
                held = held & (F.col(id_col) > F.lit(lo))
            part = index.add(docs.where(held if lo is not None else held | F.col(id_col).isNull()), id_col, text_col, text)
            found = part if found is None else found.unionByName(part)
    return found


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read(spark, sf_dir, "documents"), text=False)
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = {
    "op10_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS x FROM g JOIN f USING (s) WHERE f.first < g.doc_id) GROUP BY doc_id),
k AS (SELECT d.doc_id, x.i AS i, d.w[x.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) x),
o AS (SELECT DISTINCT g.doc_id, y.i FROM g JOIN f USING (s), LATERAL (SELECT unnest(range(g.i, g.i + 13)) AS i) y WHERE f.first < g.doc_id),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept FROM k ANTI JOIN o ON k.doc_id = o.doc_id AND k.i = o.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
