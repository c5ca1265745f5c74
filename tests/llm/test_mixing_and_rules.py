import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from leafmill.llm import mixing, quality_rules
from pyspark.sql import functions as F

from .cases import ODD, documents


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def slow_measure(t):
    w, t = words(t), t or ""
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000 + (i or 0), t) for i, t in ODD] + [(2000, "a b c a b c a b c"), (2001, "x x x x"), (2002, "a b c d a b c")]
    got = {(r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.measure(documents(spark, rows)).collect()}
    assert got == {(i, *slow_measure(t)) for i, t in rows}


def test_rules_agree_with_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = quality_rules.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    judged = [r for r in got if not r["base_failed"]]
    good, bad = ([r["kept"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


def judged_votes(spark, patterns, names):
    """Which of these vote patterns are kept; patterns: (votes, number of documents)."""
    rows = [(*v, n) for v, n in patterns]
    voted = spark.createDataFrame(rows, ", ".join(f"vote_{k} int" for k in names) + ", many int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("many"))))
    accuracy, prior = quality_rules.fit(voted, names)
    got = voted.dropDuplicates([f"vote_{k}" for k in names]).withColumn("p", quality_rules._posterior(names, accuracy, prior)).collect()
    return {tuple(r[f"vote_{k}"] for k in names): r["p"] >= quality_rules.KEEP for r in got}, accuracy


def test_a_stray_bad_vote_does_not_drop_a_document(spark):
    names = list("abcdef")
    good, stray, bad = (1,) * 6, (1, 1, -1, 1, 1, 1), (-1, -1, 1, -1, 0, 1)
    kept, accuracy = judged_votes(spark, [(good, 900), (stray, 40), (bad, 80), ((-1, 1, 0, -1, -1, 1), 40)], names)
    assert kept == {good: True, stray: True, bad: False, (-1, 1, 0, -1, -1, 1): False}
    assert accuracy["c"][0] > 1.5 * accuracy["a"][0]  # the rule that errs often is found out


def test_withheld_votes_outweigh_an_all_pass(spark):
    names = list("abcdef")
    good, silent, bad = (1,) * 6, (0, 0, 0, 0, 0, 1), (-1, 0, 0, -1, 0, 1)
    kept, _ = judged_votes(spark, [(good, 900), (silent, 10), (bad, 90), ((0, -1, -1, 0, 0, 1), 40)], names)
    assert kept[good] and not kept[silent] and not kept[bad]  # no rule votes bad on the second


def test_stray_votes_on_texts(spark):
    """Prose with a few lines of symbols' share just too high stays; lines of symbols go."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(3, 8)))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    junk = lambda n: " ".join("###" if k % 3 else "12" for k in range(n))
    rows = [(i, prose(120)) for i in range(300)] + [(1000 + i, junk(120)) for i in range(40)] + [(2000 + i, "\n".join([prose(60)] + ["end of page"] * 4 + [prose(60)])) for i in range(8)]
    got = quality_rules.score(documents(spark, rows)).collect()
    strayed = [r for r in got if r["id"] >= 2000]
    assert all(r["kept"] for r in got if r["id"] < 1000) and not any(r["kept"] for r in got if 1000 <= r["id"] < 2000)
    assert all(r["vote_lines"] == -1 and r["kept"] for r in strayed)


def test_rules_of_nothing(spark):
    assert quality_rules.score(documents(spark, [])).count() == 0
    assert quality_rules.score(documents(spark, ODD)).count() == len(ODD)


def slow_targets(size, share=1.5):
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, free, total = {}, set(size), share * sum(size.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2 * size[s] for s in over}
        free -= over
    return target


def planned(docs, **options):
    return mixing.plan(mixing.units(docs, "doc_id", "text", "source"), **options)


def test_mix_meets_its_targets(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.op5_source_mixing(spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    size, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] == r["size"] * len(r["held"]) and len(r["held"]) <= 2
    want = slow_targets(size)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == size[s]
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    # the shards hold what was taken, every place once, in the order of their places
    places = defaultdict(list)
    for r in got:
        for h in r["held"]:
            places[h["shard"], h["part"]].append(h["place"])
    assert len({k for k, _ in places}) == mixing.SHARDS[0] and all(sorted(v) == list(range(len(v))) for v in places.values())
    again = mixing.plan(mixing.units(docs.repartition(7), "doc_id", "text", "source"))[0].collect()
    assert sorted(map(str, planned(docs)[0].collect())) == sorted(map(str, again))
    mixed = Counter((r["doc_id"], r["mix_shard"]) for r in mixing.mix(docs).collect())
    assert mixed == Counter((r["doc_id"], h["shard"]) for r in got for h in r["held"])


@pytest.mark.parametrize("strata", [1024, 2])
def test_shards_hold_the_trees_quotas(spark, sf, strata):
    """Blocks, draws and quotas by hand: a draw lies in one shard, and every shard has each stratum's quota."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    plan, shards, _ = planned(docs, strata=strata)
    block = F.pmod(mixing._hash(mixing.SEED, "id", "digest"), F.lit(mixing.LEAST_BLOCKS))
    rows = plan.withColumn("block", block).withColumn("u", mixing._hash(mixing.SEED + 1, "source", "block")).collect()
    shard_of, words, target = defaultdict(set), Counter(), {}
    for r in rows:
        for k, shard in enumerate(r["shards"]):
            shard_of[r["source"], r["block"], k].add(shard)
        words[r["source"], (r["u"] % 2**64 >> 54, r["u"], r["block"])] += r["size"] * r["m"]
        target[r["source"]] = r["source_size"], r["target"]
    assert all(len(v) == 1 for v in shard_of.values())
    stratum = {s: i % strata for i, s in enumerate(sorted(target, key=lambda s: (s is None, s)))}
    counts, held, unseen = Counter(), Counter(), 0
    for s, (size, goal) in target.items():
        base, before = int(goal // size), 0
        for (_, (_, _, b)), n in sorted((k, n) for k, n in words.items() if k[0] == s):
            copies = base + (before < goal - base * size)
            before += n
            counts[stratum[s]] += copies
            for k in range(copies):
                if (s, b, k) in shard_of:
                    held[min(shard_of[s, b, k]), stratum[s]] += 1
                else:
                    unseen += 1  # the last draw of a block that is cut before its first document
    quotas = mixing.split_quotas([counts[i] for i in sorted(counts)], shards, np.random.default_rng(mixing.SEED))
    left = quotas - [[held[k, i] for i in sorted(counts)] for k in range(shards)]
    assert left.min() >= 0 and left.sum() == unseen <= len(target)


def test_mix_of_odd_rows(spark):
    rows = [(*r, "en", None if i % 3 else "b") for i, r in enumerate(ODD)]
    docs = documents(spark, rows)
    got = planned(docs)[0].collect()
    assert sum(r["m"] for r in got) == len(rows)
    assert mixing.mix(docs).count() == sum(len(r["shards"]) * r["m"] for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0
    same = documents(spark, [(None, "a b c", "en", None)] * 30 + [(None, "d e", "en", None)] * 5 + [(1, None, "en", "x")])
    got = planned(same)[0].collect()
    spans = [r for r in got if r["size"] == 3]
    assert sum(r["m"] for r in spans) == 30 and {(r["copies"], r["source_size"]) for r in spans} == {(30, 100)} and [r["target"] for r in got if r["id"] == 1] == [0]
    assert mixing.mix(same).where("text = 'a b c'").count() == sum(r["m"] * len(r["shards"]) for r in spans)


@pytest.mark.parametrize(("rows", "target"), [([("q w e r t y u i o p", 1000)], 15_000), ([("q w e r t y u i o p", 700), ("a s d", 500)], 12_750), ([("q w e r t y u i o p", 3000)], 45_000), ([("", 50), ("one", 7)], 10.5)])
def test_repeated_rows_meet_the_target(spark, rows, target):
    """Sources of one and of two distinct texts, alone: a copy more or less, as the cut falls inside equal rows."""
    docs = spark.createDataFrame([(7, t, "s", k) for t, n in rows for k in range(n)], "doc_id long, text string, source string, __text int").repartition(5)
    got = planned(docs)[0].collect()
    words = sum(r["size"] * r["m"] * len(r["shards"]) for r in got)
    longest = max(r["size"] for r in got)
    assert {r["target"] for r in got} == {float(target)} and abs(words - target) <= longest / 2 + 1e-9
    assert sum(r["m"] for r in got) == sum(n for _, n in rows) and all(r["m"] <= mixing.COPIES for r in got)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_shard"]
    held = Counter((r["text"], r["__text"]) for r in out.collect())
    assert sum(len(t.split()) * n for (t, _), n in held.items()) == words and max(held.values()) <= 2
    assert {x for _, x in held} <= set(range(3000))


def test_many_sources_reach_their_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"host{i % 400:03d}") for i in range(2000)]
    got = planned(documents(spark, rows), strata=16)[0].collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    want = slow_targets(size)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_quotas_are_exact():
    q = mixing.split_quotas([100, 7, 0, 33], 16, np.random.default_rng(1))
    assert q.sum(axis=0).tolist() == [100, 7, 0, 33] and q.shape == (16, 4) and np.ptp(q.sum(axis=1)) <= 2
