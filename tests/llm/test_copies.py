import hashlib
import random
import re
from collections import defaultdict

import xxhash
import pytest
from leafmill.llm import decontaminate, graph, simhash_dedup

from .cases import ODD, documents

random.seed(5)
VOCAB = [f"v{i}" for i in range(400)]


def text(n):
    return " ".join(random.choices(VOCAB, k=n))


def slow_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps, radius=4):
    """Smallest id that each row reaches."""
    n, seen, out = len(fps), set(), {}
    for i in range(n):
        if i in seen:
            continue
        group, queue = {i}, [i]
        while queue:
            a = queue.pop()
            for j in range(n):
                if j not in group and (fps[a][1] ^ fps[j][1]).bit_count() <= radius:
                    group.add(j)
                    queue.append(j)
        seen |= group
        ids = [fps[j][0] for j in group if fps[j][0] is not None]
        for j in group:
            out[j] = min(ids) if ids else None
    return out


def near_rows():
    rows = list(ODD)
    for g in range(6):
        words = text(400).split()
        for k in range(8):
            w = list(words)
            for _ in range(k):
                w[random.randrange(len(w))] = random.choice(VOCAB)
            rows.append((100 + 10 * g + k, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted((repr(fps[j][0]), fps[j][1], c) for j, c in slow_classes(fps).items())
    for bucket_rows in (32768, 2):  # the second sends every bucket of three or more to the way for large ones
        got = simhash_dedup.near_duplicates(documents(spark, rows), bucket_rows=bucket_rows).collect()
        assert sorted((repr(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want


def test_masks_cover_every_small_difference():
    found = simhash_dedup.masks()
    for _ in range(3000):
        bits = random.sample(range(64), 4)
        assert any(all(not m >> b & 1 for b in bits) for m in found)


def test_near_duplicates_of_nothing(spark):
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def slow_contamination(docs, items, window=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = fold(t)
        m = min(window, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            owners[tuple(w[a : a + m])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for p, who in owners.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found |= who
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((repr(d), len(w), len(hit), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    items = [(1, text(30)), (2, text(13)), (3, "a b"), (4, None), (5, ""), (10, "One"), (None, "v1 v2 v3"), (6, "v1 " * 20)]
    docs = [(i, t) for i, t in ODD if not t or len(t) < 1000] + [(20 + k, text(20) + " " + items[k % 2][1] + " " + text(10 * k)) for k in range(8)] + [(40, "V1, " * 50), (41, items[0][1][:60])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 1):
        found = decontaminate.judged(decontaminate.contamination(documents(spark, docs), bench, block_words=block)).collect()
        got = sorted((repr(r["id"]), r["n_words"], r["n_hit"], hashlib.sha256(",".join(r["items"] or []).encode()).hexdigest(), r["contaminated"]) for r in found)
        assert got == slow_contamination(docs, items)


def test_contamination_without_items(spark):
    found = decontaminate.judged(decontaminate.contamination(documents(spark, ODD), spark.createDataFrame([], "item_id long, text string")))
    assert found.where("contaminated or n_hit > 0").count() == 0 and found.count() == len(ODD)


def test_rows_that_stay_keep_their_columns(spark):
    items = [(1, text(20))]
    docs = documents(spark, [*ODD[:4], (50, items[0][1]), (None, text(30)), (51, text(400) + " " + items[0][1])])
    left = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] != 50)


def test_a_bucket_of_many_patterns_costs_one_comparison():
    """Patterns that share their first word and last three, against a text of that kind."""
    start, end, mid = b"a", (b"x", b"y", b"z"), [text(9).encode().split() for _ in range(3000)]
    patterns = [(start, *m, *end) for m in mid]
    (s,) = decontaminate.searchers([(k, b" ".join(p)) for k, p in enumerate(patterns)])
    asked = []

    class Said(list):
        def __getitem__(self, some):
            asked.append(some)
            return list.__getitem__(self, some)

    words = Said(w for p in patterns[:50] for w in p)
    *hashed, _ = decontaminate.hash_words(b" ".join(words))
    assert [x for _, x in s.find(tuple(hashed), words)] == [[k] for k in range(50)]
    assert len(asked) == 50 and (s.shifts == 0).sum() == 3000


def test_tables_of_a_block_stay_small():
    """Bytes of two hundred thousand words' tables, of which a block may have ten times as many, as they are sent and as they are held."""
    import pickle
    import tracemalloc

    words = [f"w{k * 7919 % 100_003}".encode() for k in range(200_000)]
    rows = [(k, b" ".join(words[k : k + 400])) for k in range(0, len(words), 400)]
    sent = pickle.dumps(decontaminate.searchers(rows))
    tracemalloc.start()
    held = pickle.loads(sent)
    used, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(sent) * 10 < 100e6 and used * 10 < 100e6 and most * 10 < 200e6 and len(held) == 1


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_parts_of_an_item_hold_all_its_windows(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1)
    for n in (0, 1, 12, 13, 14, 200):
        raw = ("  ,".join(f"V{k}" for k in range(n)) + " . ").encode()
        parts = [p.split() for p, _ in decontaminate.item_parts(raw, most)]
        words = decontaminate.words_of(raw)
        m = min(13, n)
        want = {tuple(words[i : i + m]) for i in range(n - m + 1)} if n else set()
        assert {tuple(p[i : i + m]) for p in parts for i in range(len(p) - m + 1) if p} == want
        assert all(len(p) == n if n < 13 else len(p) >= 13 for p in parts) and (n < 200 or most > 100 or max(map(len, parts)) < 60)


def test_blocks_are_taken_one_by_one(spark, monkeypatch):
    took, made, ahead = [], [], []
    blocks, searchers = decontaminate._blocks, decontaminate.searchers
    monkeypatch.setattr(decontaminate, "_blocks", lambda *a: (took.append(1) or b for b in blocks(*a)))
    monkeypatch.setattr(decontaminate, "searchers", lambda *a: ahead.append(len(took) - len(made)) or made.append(1) or searchers(*a))
    items = [(i, text(20)) for i in range(5)]
    docs = [(i, items[i][1] + " " + text(5)) for i in range(5)]
    found = decontaminate.contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=1)
    assert len(made) == 5 and max(ahead) == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["id"], r["items"]) for r in found.collect()) == [(i, [str(i)]) for i in range(5)]
