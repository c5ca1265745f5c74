"""The trie of conversations' turns, from vertical bitmaps.

Places.  Turns are dealt by ranges of (conversation, turn, digest), so a conversation of any length has several tasks; each counts its own,
and what the ranges before it counted is added.  From there on a turn is its place and a digest; texts are not moved.

Shards.  Conversations in order of their ids are cut into shards of bounded numbers of conversations and turns (a long conversation goes on in
the next one).  A shard indexes (position, turn) to the bitset of the conversations that have that turn there, and (position, end) to
those that end there.  From the root down, depth first, the bitset of a node meets the posting of the next turn of its first
conversation that no child holds yet: what they share is a child, its number of bits the child's conversations, and what it
shares with the ends is the list of those that stop there.  So a child costs one intersection, whatever else stands at its position.

Nodes.  A node's fingerprint is the exclusive or of 128 bits per (position, turn) on its way.  A shard sends a node once, with its count and
its end list; nodes of equal fingerprint are merged in order of their shards, so that a digest of a hot node's ends
streams through lists of bounded length.  Sums over subtrees go up by doubling: in round k each node hands the sums of the 2^k
levels below it to its ancestor 2^k levels above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, write_out

#: A shard's conversations and turns at most.
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 16
#: Turns of a conversation that stay together; longer ones are dealt to several tasks.
PIECE = 1 << 14
#: What op12 takes over from the first conversation of each hundred: fewer turns than this.
SHARED = 6
_MASK = (1 << 64) - 1


def placed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, said, chars): turns in order, from 0; said is a digest of role and text, chars the text's code points.

    Null turns come first; turns of one number are in order of said; a null role or text is empty, and repeated rows are turns of their
    own.  Rows without a conv_id, an integer, belong to no conversation and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), said.alias("said"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if b.num_rows:
                conv, i = b.column(0).to_numpy(), np.arange(b.num_rows)
                head = np.maximum.accumulate(np.where(np.r_[conv[0] != last, conv[1:] != conv[:-1]], i, -1))
                pos = np.where(head >= 0, i - head, i + n)
                last, n = conv[-1], int(pos[-1]) + 1
                yield pa.record_batch([b.column(0), pa.array(np.full(len(i), part)), pa.array(pos), b.column(1), b.column(2)], names=["conv", "part", "pos", "said", "chars"])

    # equal rows can stand in any order, so the salt keeps them from one task
    dealt = rows.repartitionByRange("conv", "turn", "said", "salt").sortWithinPartitions("conv", "turn", "said", "salt")
    counted = write_out(dealt.select("conv", "said", "chars").mapInArrow(run, "conv long, part long, pos long, said binary, chars long"), "turns")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("conv", "part").count().select("conv", "part", F.sum("count").over(earlier).alias("start")).where("start > 0")
    return counted.join(starts, ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("start", F.lit(0))).alias("pos"), "said", "chars")


def lengths(rows: DataFrame) -> DataFrame:
    """(conv, n): the number of turns of each conversation of (conv, pos, ...)."""
    return rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


# ---- shards ----


class Shard:
    """Postings of some conversations, in order of their ids, each from some position on."""

    def __init__(self):
        self.convs: list[int] = []
        self.first: list[int] = []  # the position that a conversation enters at
        self.turns: list[list[tuple[int, int]]] = []  # (fingerprint, chars)
        self.postings: dict[tuple[int, int], int] = {}
        self.ends: dict[int, int] = {}
        self.entries: dict[tuple[int, int], int] = {}
        self.size = 0

    def enter(self, conv: int, pos: int, node: int) -> None:
        """A conversation whose first pos turns, node, earlier shards hold."""
        self.entries[pos, node] = self.entries.get((pos, node), 0) | 1 << len(self.convs)
        self.convs.append(conv)
        self.first.append(pos)
        self.turns.append([])

    def add(self, pos: int, turn: int | None, chars: int) -> None:
        """The last conversation's turn at pos, or its end there."""
        bit = 1 << (len(self.convs) - 1)
        self.size += 1
        if turn is None:
            self.ends[pos] = self.ends.get(pos, 0) | bit
        else:
            self.postings[pos, turn] = self.postings.get((pos, turn), 0) | bit
            self.turns[-1].append((turn, chars))

    def nodes(self) -> Iterator[tuple[int, int | None, int, int, int, int, list[int]]]:
        """(node, parent, depth, conversations, the first of them, chars of the last turn, those that end here).

        A node that cut conversations enter at has no parent here, and none are counted.
        """
        for (depth, node), bits in self.entries.items():
            stack: list[tuple[int, int, int, int | None, int]] = [(bits, depth, node, None, 0)]
            while stack:
                bits, depth, node, up, chars = stack.pop()
                ended = bits & self.ends.get(depth, 0)
                inside = up is not None or depth == 0
                if inside or ended:  # the node that cut conversations enter at was counted before, but not that they end there
                    yield node, up, depth, bits.bit_count() if inside else 0, self.convs[(bits & -bits).bit_length() - 1], chars, self._ids(ended)
                left = bits ^ ended
                while left:
                    j = (left & -left).bit_length() - 1
                    at = depth - self.first[j]
                    if at >= len(self.turns[j]):  # it goes on in a later shard
                        left &= left - 1
                        continue
                    turn, size = self.turns[j][at]
                    child = left & self.postings[depth, turn]
                    left ^= child
                    stack.append((child, depth + 1, node ^ turn, node, size))

    def _ids(self, bits: int) -> list[int]:
        out = []
        while bits:
            out.append(self.convs[(bits & -bits).bit_length() - 1])
            bits &= bits - 1
        return out


_PARTIAL = "node binary, up binary, depth long, n long, conv long, chars long, ends array<long>"
_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    data = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.record_batch(data, names=["node", "up", "depth", "n", "conv", "chars", "ends"])


def _partial(convs: int, turns: int):
    key = lambda x: None if x is None else x.to_bytes(16, "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, node = Shard(), None, 0

        def out():
            rows, held = [], 0
            for x in shard.nodes():
                rows.append((key(x[0]), key(x[1]), *x[2:]))
                held += 4 + len(x[6])
                if held > 1 << 15:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

        for b in batches:
            for conv, pos, z1, z2, chars, c1, c2 in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if shard.size >= turns or len(shard.convs) >= convs and conv != now:
                    yield from out()
                    shard = Shard()
                    if conv == now:
                        shard.enter(conv, pos, node)
                if conv != now:
                    now, node = conv, (c1 & _MASK) << 64 | c2 & _MASK
                    shard.enter(conv, pos, node)
                turn = None if z1 is None else (z1 & _MASK) << 64 | z2 & _MASK
                shard.add(pos, turn, chars)
                node ^= turn or 0
        yield from out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from what the shards know of them, sorted by node and conversation."""
    now: list | None = None
    rows: list[tuple] = []
    names = ["node", "up", "depth", "n", "conv", "chars", "ends"]
    types = [*_TYPES[:6], pa.string()]

    def batch():
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for node, up, depth, n, conv, chars, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now[0] != node:
                if now is not None:
                    rows.append((*now[:6], now[6].hexdigest()))
                    if len(rows) >= 10_000:
                        yield batch()
                        rows = []
                now = [node, up, depth, 0, conv, chars, hashlib.sha256(), False]
            now[1], now[3], now[5] = now[1] or up, now[3] + n, max(now[5], chars)
            if ends:
                now[6].update((("," if now[7] else "") + ",".join(map(str, ends))).encode())
                now[7] = True
    if now is not None:
        rows.append((*now[:6], now[6].hexdigest()))
        yield batch()


def nodes_of(rows: DataFrame, sizes: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS, piece: int = PIECE) -> DataFrame:
    """(node, up, depth, n, conv, chars, ends) per node of (conv, pos, said, chars) and (conv, n); ends is a digest of those that end there."""
    z = rows.select("conv", "pos", F.xxhash64("pos", "said").alias("z1"), F.xxhash64("said", "pos").alias("z2"), "chars")
    none = F.lit(None).cast("long")
    marked = z.unionByName(sizes.select("conv", F.col("n").alias("pos"), none.alias("z1"), none.alias("z2"), F.lit(0).cast("long").alias("chars")))
    marked = write_out(marked.withColumn("piece", F.floor(F.col("pos") / piece)), "turns")
    long = marked.where("piece > 0").select("conv").distinct()
    if long.isEmpty():
        held = marked.withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")})
    else:
        before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        each = marked.join(long, "conv", "left_semi").groupBy("conv", "piece").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
        way = each.select("conv", "piece", *[F.bit_xor(c).over(before).alias(c) for c in ("c1", "c2")])
        held = marked.join(way, ["conv", "piece"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("c1", "c2")})
    dealt = held.repartitionByRange("conv", "piece").sortWithinPartitions("conv", "pos").select("conv", "pos", "z1", "z2", "chars", "c1", "c2")
    partial = dealt.mapInArrow(_partial(shard_convs, shard_turns), _PARTIAL)
    return partial.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_merged, _PARTIAL.replace("array<long>", "string"))


# ---- subtrees ----


def below(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over the subtree of each node of (node, up, depth, leaves, saved)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    now = nodes.where("depth >= 1").select("node", F.col("up").alias("to"), "depth", "leaves", "saved")
    for k in range(deepest.bit_length()):
        sums = write_out(now.groupBy("to").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "sums")
        own = own.unionByName(sums.select(F.col("to").alias("node"), F.col("more_leaves").alias("n_leaves"), F.col("more_saved").alias("saved_tokens")))
        deep = now.where(F.col("depth") >= 2 << k)
        up = now.select(F.col("node").alias("to"), F.col("to").alias("further"))
        grown = deep.join(sums.withColumnRenamed("to", "node"), "node", "left").join(up, "to")
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = write_out(grown.select("node", F.col("further").alias("to"), "depth", more("leaves"), more("saved")), "climbed")
    return own.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def trie(rows: DataFrame, sizes: DataFrame, **options: int) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node; conversations
    of no turns stand in sizes alone.  No conversation gives no node.  Two ways are told apart by 128 bits of hash."""
    nodes = write_out(nodes_of(rows, sizes, **options), "nodes")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = write_out(nodes.join(kids, "node", "left").select("node", "up", "depth", "n", "conv", "ends", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")), "nodes")
    parents = own.select(F.col("node").alias("up"), F.col("conv").alias("parent_conv_id"))
    found = own.join(below(own), "node").join(parents, "up", "left")
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """trie() of conversations as they are; columns as in placed()."""
    rows = write_out(placed(turns, **columns), "placed")
    return trie(rows, lengths(rows))


def rebuilt(rows: DataFrame, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, said, chars), (conv, n): each conversation c begins with the first h turns of conversation c - c % 100, in place of
    its own first h; h is the CRC-32 of c in digits, modulo ``shared``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    sizes = write_out(lengths(rows).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base")), "lengths")
    had = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = sizes.join(had, "base", "left").select("conv", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"))
    own = rows.join(taken.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "said", "chars")
    first = rows.where((F.col("conv") % 100 == 0) & (F.col("pos") < shared - 1)).withColumnRenamed("conv", "base")
    lent = taken.where("k > 0").select("conv", "base", "k").join(first, "base").where("pos < k").select("conv", "pos", "said", "chars")
    return own.unionByName(lent), taken.select("conv", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("k")).alias("n"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_out(placed(read(spark, sf_dir, "conversations")), "placed")
    return trie(*rebuilt(rows))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
ORACLE = {
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, CAST(length(coalesce(text, '')) AS BIGINT) AS chars,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, n, h, least(h, coalesce((SELECT count(*) FROM t WHERE t.c = q.c - q.c % 100), 0)) AS k
      FROM (SELECT c, count(*) AS n, {_CRC} % 6 AS h FROM t GROUP BY c) q),
r AS (SELECT c, p - h + k AS p, said, chars FROM t JOIN s USING (c) WHERE p >= h
      UNION ALL SELECT s.c, p, said, chars FROM s JOIN t ON t.c = s.c - s.c % 100 WHERE p < k),
w AS (SELECT c, p + 1 AS d, md5(string_agg(said, '') OVER (PARTITION BY c ORDER BY p)) AS k, chars FROM r UNION ALL SELECT c, 0, '', 0 FROM s),
e AS (SELECT c, max(d) AS d FROM w GROUP BY c),
v AS (SELECT w.k, any_value(w.d) AS d, min(c) AS c, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE e.d = w.d), '') AS ends
      FROM w JOIN e USING (c) GROUP BY w.k),
u AS (SELECT v.*, pv.c AS up, pv.k AS upk FROM v LEFT JOIN w ON w.c = v.c AND w.d = v.d - 1 LEFT JOIN v pv ON pv.k = w.k),
kids AS (SELECT upk AS k, count(*) AS n_children FROM u WHERE upk IS NOT NULL GROUP BY upk),
sub AS (SELECT w.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.chars) AS saved
        FROM u LEFT JOIN kids USING (k) JOIN w ON w.c = u.c AND w.d <= u.d GROUP BY w.k)
SELECT u.c AS conv_id, CAST(u.d AS BIGINT) AS depth, up AS parent_conv_id, u.n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM u LEFT JOIN kids USING (k) JOIN sub USING (k)
"""
}
