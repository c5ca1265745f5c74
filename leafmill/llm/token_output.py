"""Token-id files with Elias-Fano document boundaries.

Documents are dealt to ranges of doc_id, sorted, encoded and laid down as blocks of about ``block_tokens`` ids.  A block is

    "LMEF" | u8 version | u8 bytes per id | u8 low bits l | u8 0 | u32 documents n | u32 ids N | u32 bytes of the high part
    | low parts (n times l bits) | high part (bits) | select samples (u32 each) | ids

where the documents' end offsets e_0 <= e_1 <= ... are Elias-Fano coded: the low l bits of each are packed, and the high
part has a one at bit (e_i >> l) + i.  A sample keeps the place of every 64th one, so that an offset is found by looking
at one stretch of the high part; no table of 64-bit offsets is kept.  Blocks are the payload rows of a Parquet folder, which any store
that Spark reaches can hold.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read

END_ID = 2
BLOCK_TOKENS = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
SAMPLE = 64
#: Bytes of chunks and their ids that a worker remembers, and about how much a chunk takes besides its letters.
CACHE_BYTES = 256 << 20
_ENTRY = 200
_HEAD = struct.Struct("<4sBBBBIII")


def _bits(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    each = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def pack(docs: list[np.ndarray], width: int) -> bytes:
    """A block of these documents' ids."""
    ends = np.cumsum([len(d) for d in docs], dtype=np.uint64)
    n, total = len(docs), int(ends[-1])
    low = max(0, (total // n).bit_length() - 1) if n else 0
    places = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    high_bytes = np.packbits(high, bitorder="little").tobytes()
    ids = np.concatenate(docs).astype("<u2" if width == 2 else "<u4").tobytes()
    head = _HEAD.pack(b"LMEF", 1, width, low, 0, n, total, len(high_bytes))
    return head + _bits(ends, low) + high_bytes + places[::SAMPLE].astype("<u4").tobytes() + ids


class Block:
    """Reads one block; ``offset(i)`` is where document i starts in it, by select."""

    def __init__(self, raw: bytes):
        magic, version, self.width, self.low, _, self.n, self.total, high = _HEAD.unpack_from(raw)
        if magic != b"LMEF" or version != 1:
            raise ValueError("not a block of this format")
        at = _HEAD.size
        low_bytes = (self.n * self.low + 7) // 8
        self._low = np.frombuffer(raw, np.uint8, low_bytes, at)
        self._high = np.frombuffer(raw, np.uint8, high, at + low_bytes)
        at += low_bytes + high
        samples = -(-self.n // SAMPLE)
        self._sample = np.frombuffer(raw, "<u4", samples, at)
        self._ids = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", self.total, at + 4 * samples)
        self._held = (-1, None)

    def select(self, i: int) -> int:
        """Place of the i-th one of the high part."""
        group = i // SAMPLE
        if self._held[0] != group:
            first = int(self._sample[group])
            last = int(self._sample[group + 1]) if group + 1 < len(self._sample) else 8 * len(self._high)
            bits = np.unpackbits(self._high[first // 8 : last // 8 + 1], bitorder="little")
            self._held = (group, np.flatnonzero(bits[first % 8 :]) + first)
        return int(self._held[1][i % SAMPLE])

    def end(self, i: int) -> int:
        value = (self.select(i) - i) << self.low
        if self.low:
            bit = i * self.low
            stretch = int.from_bytes(self._low[bit // 8 : (bit + self.low + 7) // 8].tobytes(), "little")
            value |= (stretch >> (bit % 8)) & ((1 << self.low) - 1)
        return value

    def offset(self, i: int) -> int:
        return self.end(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self._ids[self.offset(i) : self.end(i)]


class Encoder:
    """Encodes texts with a tokenizers file.

    Byte-level files split at every single space between two other characters that are not white space, and never merge
    across it, so a text's ids are its chunks' ids in a row; the chunks' ids are remembered, up to cache_bytes of them (CACHE_BYTES), after
    which the memory starts anew.  New chunks are encoded as one text, which is cut again where an id begins with a space.
    Texts with a special token's string, and files of another kind, are encoded whole.
    """

    def __init__(self, path: str, cache_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.most = cache_bytes
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer") and (made.get("post_processor") or {}).get("type") in (None, "ByteLevel")
        self.special = [t["content"] for t in made.get("added_tokens", ())]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.safe = re.compile(r"(?<=\S) (?=\S)")
        vocabulary = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level files write a space

    def _raw(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _follow(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of these clean chunks where it follows a space."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 512):
            some = chunks[at : at + 512]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.spaced[ids]) * self.width
            if len(cuts) != len(some):
                out += self._raw([" " + c for c in some])
                continue
            raw = ids.tobytes()
            out += map(raw.__getitem__, map(slice, cuts.tolist(), [*cuts[1:].tolist(), len(raw)]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes | None] = [None] * len(texts)
        whole, parts, found = [], {}, {}
        new: dict[str, bytes] = {}  # clean chunks: not empty, no white space at their ends
        rough: dict[str, bytes] = {}  # pieces of texts in which spaces stand beside other white space
        get = self.known.get
        for i, t in enumerate(texts):
            if not self.chunked or any(s in t for s in self.special):
                whole.append(i)
                continue
            p = t.split(" ")
            f = list(map(get, p))
            if None in f:
                fresh = [c for c, x in zip(p, f, strict=True) if x is None]
                if "" not in fresh and all(map(str.__eq__, map(str.strip, fresh), fresh)):
                    new.update(dict.fromkeys(fresh))
                else:
                    p = self.safe.split(t)
                    f = [None] * len(p)
                    rough.update(dict.fromkeys(p))
            parts[i], found[i] = p, f
        new = dict(zip(new, self._follow(list(new)), strict=True))
        rough = dict(zip(rough, self._raw([" " + c for c in rough]), strict=True))
        for i, got in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = got
        for (i, p), first in zip(parts.items(), self._raw([p[0] for p in parts.values()]), strict=True):
            f = found[i]
            if None in f:
                f = [(new[c] if c in new else rough[c]) if x is None else x for c, x in zip(p, f, strict=True)]
            f[0] = first
            out[i] = b"".join(f)
        self.held += sum(map(len, new)) + _ENTRY * len(new)
        if self.held > (CACHE_BYTES if self.most is None else self.most):
            self.known, self.held = {}, 0
        self.known.update(new)
        return [np.frombuffer(x, self.kind) for x in out]


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, cache_bytes: int | None = None) -> Encoder:
    """One per worker process, file and bound."""
    if (path, cache_bytes) not in _ENCODERS:
        _ENCODERS[path, cache_bytes] = Encoder(path, cache_bytes)
    return _ENCODERS[path, cache_bytes]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int | None = None) -> None:
    """Write docs' ids to path in ascending id order, end_id after each document.

    Null texts are empty and give the end id only; null ids come first; rows that repeat an id follow each other, in the
    order of their texts, and may be dealt to several tasks where their texts' beginnings differ.  A document longer than a block gets a block of its own.  An empty table gives an empty folder.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(tokenizer, cache_bytes), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def block():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([size], pa.int64()), pa.array([pack(held, enc.width)], pa.binary())], names=["part", "block", "ids", "n_tokens", "payload"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                for i, got in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    if held and size + len(got) + 1 > block_tokens:
                        yield block()
                        ids, held, size, number = [], [], 0, number + 1
                    ids.append(i)
                    held.append(np.append(got, np.array([end_id], enc.kind)))
                    size += len(got) + 1
        if held:
            yield block()

    (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, "id", F.substring("text", 1, 16))
        .sortWithinPartitions("id", "text")
        .mapInArrow(run, f"part int, block int, ids array<{kind.simpleString()}>, n_tokens long, payload binary")
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents by block (part, block, offset, id, n_tokens, tokens: little-endian unsigned 32-bit ids), and the blocks' starts."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, ids, raw in zip(*(b.column(i) for i in range(4)), strict=True):
                block, ids = Block(raw.as_py()), ids.values
                for at in range(0, block.n, 256):
                    some = range(at, min(at + 256, block.n))
                    got = [block.ids(i).astype("<u4").tobytes() for i in some]
                    yield pa.record_batch(
                        [pa.array([part.as_py()] * len(some), pa.int32()), pa.array([number.as_py()] * len(some), pa.int32()), pa.array([block.offset(i) for i in some], pa.int64()), ids.slice(at, len(some)), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary())],
                        names=["part", "block", "offset", "id", "n_tokens", "tokens"],
                    )

    found = blocks.select("part", "block", "ids", "payload").mapInArrow(run, f"part int, block int, offset long, id {kind}, n_tokens long, tokens binary")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("block")), F.lit(0)).alias("inner"))
    at = starts.join(F.broadcast(parts), "part").select("part", "block", (F.col("base") + F.col("inner")).alias("base"))
    return found, at


def documents_of(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """(id, start, n_tokens) per document read back, with ids_crc32 (digest) or tokens (binary, four bytes an id)."""
    found, at = read_blocks(spark, path)
    last = "ids_crc32" if digest else "tokens"
    small = found.select("part", "block", "offset", "id", "n_tokens", (F.crc32("tokens") if digest else F.col("tokens")).alias(last))
    return small.join(at, ["part", "block"]).select("id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", last)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path)
    return documents_of(spark, path).withColumnRenamed("id", "doc_id")
