import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from leafmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, node long, part long, n long, up long, salt long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, 8, 7, 6, 5, 4, 3) for r in rows], SCHEMA)


def said(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ways(rows):
    """conv -> its turns in order."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    return {c: [(x[3], x[4]) for x in sorted(xs)] for c, xs in by.items()}


def rebuild(by):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
    return {c: by.get(c - c % 100, [])[: h[c]] + by[c][h[c] :] for c in by}


def brute(by):
    members = defaultdict(list)
    for c in sorted(by):
        for d in range(len(by[c]) + 1):
            members[tuple(by[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for way in members:
        if way:
            kids[way[:-1]] += 1
    for way, cs in members.items():
        for d in range(len(way) + 1):
            leaves[way[:d]] += way not in kids
            saved[way[:d]] += (len(cs) - 1) * len(way[-1][1]) if way else 0
    ends = {way: ",".join(str(c) for c in cs if len(by[c]) == len(way)) for way, cs in members.items()}
    return {(cs[0], len(w), members[w[:-1]][0] if w else None, len(cs), kids[w], leaves[w], saved[w], hashlib.sha256(ends[w].encode()).hexdigest()) for w, cs in members.items()}


def as_set(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = as_set(prefix_trie.op12_prefix_trie(spark, sf))
    assert got == brute(rebuild(ways(rows)))
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    assert got == set(duckdb.sql(f"select {', '.join(COLUMNS)} from ({prefix_trie.ORACLE['op12_prefix_trie']})").fetchall())


ODD = [(1, None, "user", "a"), (1, None, None, "a"), (1, 2, "user", None), (1, 2, "user", None), (2, 0, "", ""), (2, 5, "u", "ser"), (3, 0, "us", "er"), (None, 1, "user", "x"), (-5, 1, "user", "é" * 70_000), (7, 1, "user", "a")]


def test_odd_rows(spark):
    assert as_set(prefix_trie.prefix_trie(table(spark, ODD))) == brute(ways(ODD))
    assert prefix_trie.prefix_trie(table(spark, ODD).limit(0)).count() == 0
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed(table(spark, ODD).limit(0)))).count() == 0


@pytest.mark.parametrize("options", [{}, {"shard_convs": 3, "shard_turns": 7, "piece": 4}, {"shard_convs": 1, "shard_turns": 1, "piece": 1}, {"shard_convs": 5, "shard_turns": 2, "piece": 3}])
def test_long_and_hot_conversations_cut_into_shards_and_pieces(spark, options):
    rng = random.Random(5)
    rows = [(c, k, rng.choice("ua"), rng.choice("xyz")) for c in range(60) for k in range(rng.randrange(1, 6))]
    rows += [(200, k, "u", "same" * (k % 3)) for k in range(45)] + [(c, k, "u", "same" * (k % 3)) for c in (150, 300) for k in range(40)]
    rows += [(c, k, "u", f"hello {k}") for c in range(400, 440) for k in range(3)]
    rng.shuffle(rows)
    placed = prefix_trie.placed(table(spark, rows).repartition(6))
    assert as_set(prefix_trie.trie(placed, prefix_trie.lengths(placed), **options)) == brute(ways(rows))


def test_rebuilt_conversations_without_a_first_one_or_without_turns(spark):
    rows = [(c, k, "user", f"{c % 3} {k}") for c in [*range(100, 130), *range(205, 240)] for k in range(1 + c % 4)]
    want = rebuild(ways(rows))
    assert any(not x for x in want.values())
    placed = prefix_trie.placed(table(spark, rows))
    assert as_set(prefix_trie.trie(*prefix_trie.rebuilt(placed))) == brute(want)


def test_one_conversation_with_most_turns_and_equal_rows_is_dealt_to_tasks(spark):
    rows = [(1, None, "user", "again")] * 3000 + [(2, 1, "user", "again")]
    placed = prefix_trie.placed(table(spark, rows).repartition(5))
    assert sorted(r["pos"] for r in placed.where("conv = 1").collect()) == list(range(3000))
    nodes = prefix_trie.trie(placed, prefix_trie.lengths(placed), piece=256, shard_turns=100)
    assert nodes.agg({"depth": "max"}).first()[0] == 3000 and nodes.count() == 3001
