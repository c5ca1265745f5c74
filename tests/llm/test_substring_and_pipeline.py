import hashlib
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from leafmill.llm import substring_dedup as S
from pyspark.sql import functions as F

from .cases import LONG, ODD, documents

random.seed(9)
VOCAB = [f"u{i}" for i in range(300)]


def text(n):
    return " ".join(random.choices(VOCAB, k=n))


def slow(rows):
    owner = defaultdict(list)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - 12):
            if i is not None:
                owner[tuple(w[a : a + 13])].append(i)
    first = {k: min(v) for k, v in owner.items()}
    out = []
    for i, w in words:
        gone = {x for a in range(len(w) - 12) if i is not None and first[tuple(w[a : a + 13])] < i for x in range(a, a + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((repr(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    passages = [text(n) for n in (12, 13, 14, 20, 60, 200)]
    rows = list(ODD)
    for k in range(60):
        rows.append((20 + k, " ".join([text(random.randrange(40)), random.choice(passages), text(random.randrange(30)), random.choice(passages)])))
    rows += [(90, "same " * 40), (91, "same " * 30), (92, passages[5]), (92, passages[5]), (93, "  ".join(passages[4].split()) + "\n"), (94, LONG + " tail"), (95, "a b " * 30), (96, "b a " * 9)]
    random.shuffle(rows)
    return rows


def found(df):
    return sorted((repr(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def test_repeats_equal_brute_force(spark):
    rows = cases()
    docs = documents(spark, rows)
    assert found(S.remove_repeats(docs, text=False)) == slow(rows)
    texts = S.remove_repeats(docs, batches=2, part_bytes=1000).collect()
    assert sorted((repr(r["id"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in texts) == sorted((a, d) for a, _, _, d in slow(rows))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("leafmill_windows")]


@pytest.mark.parametrize("bits", [64, 7])
def test_batches_meet_history_by_their_own_texts(spark, bits):
    """Each batch brings its own texts only; with 7 bits most windows share their fingerprint with others."""
    rows = [r for r in cases() if r[0] is not None]
    rows.sort(key=lambda r: r[0])
    with S.WindowIndex(spark, bits=bits) as index:
        got = []
        for lo, hi in ((0, 20), (20, 40), (40, 60), (60, 92), (92, 1000)):
            batch = [r for r in rows if lo < r[0] <= hi]
            got += found(index.add(documents(spark, batch), text=False))
            assert all(a[1] >= 2 * b[1] or b[1] >= 2 * a[1] for a, b in zip(index.runs, index.runs[1:], strict=False))
        assert sorted(got) == slow(rows)
        windows = {tuple(w[a : a + 13]) for w in ((t or "").split() for _, t in rows) for a in range(len(w) - 12)}
        assert sum(n for _, n in index.runs) == len(windows)
        index.compact()
        assert len(index.runs) == 1 and index.runs[0][1] == len(windows)
        index.add(documents(spark, rows[:30]), text=False)
        joined = spark.range(9).selectExpr("id AS bucket").repartition(index.tasks, "bucket").groupBy("bucket").cogroup(index.rows().groupBy("bucket")).applyInArrow(lambda a, b: a, "bucket long")
        assert len(index.runs) == 2 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the runs do not move


def test_ids_of_other_kinds_and_earlier_batches_win(spark):
    shared = text(30)
    with S.WindowIndex(spark, part_bytes=50) as index:
        docs = spark.createDataFrame([("b", shared), ("a", shared + " x"), ("c", text(40)), (None, shared)], "key string, body string")
        got = {r["id"]: r["n_removed"] for r in index.add(docs, "key", "body").collect()}
        assert got == {"b": 30, "a": 0, "c": 0, None: 0}
        late = spark.createDataFrame([("0", shared), ("1", text(20))], "key string, body string")
        assert {r["id"]: r["n_removed"] for r in index.add(late, "key", "body").collect()} == {"0": 30, "1": 0}


def test_words_that_polynomial_hashes_confuse_stay(spark):
    """Two windows whose last words are a Thue-Morse string and its complement are different."""
    start = text(12)
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, f"{start} {a}"), (2, f"{start} {a.translate(str.maketrans('ab', 'ba'))}")]
    assert [n for _, _, n, _ in found(S.remove_repeats(documents(spark, rows), text=False))] == [0, 0]


def test_windows_of_long_and_short_texts(monkeypatch):
    random.seed(4)
    parts = ["a", "ab", "ab" * 4, "ab" * 8, "c" * 17, "d" * 300, "é", "\x1c", "x y", "\x0b", "\n", "  ", "\t\r"]
    texts = [" ".join(random.choices(parts, k=random.choice([0, 1, 12, 13, 14, 60, 900]))).encode() for _ in range(40)]
    monkeypatch.setattr(S, "STEP", 500)
    count, got = np.zeros(len(texts), np.int64), {}
    for owner, place, h, v in S.windows(texts, 13, 64, count):
        got |= {(k, i): (a, b) for k, i, a, b in zip(owner.tolist(), place.tolist(), h.tolist(), v.tolist(), strict=True)}
    words = [t.split() for t in texts]
    assert count.tolist() == [len(w) for w in words] and [b"".join(S.pieces(t)) for t in texts] == texts
    assert sorted(got) == [(k, i) for k, w in enumerate(words) for i in range(len(w) - 12)]
    of = defaultdict(set)
    for (k, i), pair in got.items():
        of[tuple(words[k][i : i + 13])].add(pair)
    assert all(len(x) == 1 for x in of.values()) and len({p for x in of.values() for p in x}) == len(of)
    assert len({p[0] for x in of.values() for p in x}) == len({p[1] for x in of.values() for p in x}) == len(of)


def test_repeats_of_nothing(spark):
    assert S.remove_repeats(documents(spark, [])).count() == 0
    assert S.remove_repeats(documents(spark, [(1, None), (None, text(20))])).count() == 2


@pytest.fixture(scope="module")
def stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        path = corpus_pipeline.common.new_path(spark, name)
        docs.write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_pipeline_stages(spark, stages):
    docs = stages["documents"]
    ids = {k: [r[0] for r in v.select("doc_id").collect()] for k, v in stages.items()}
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert all(stages[k].columns == docs.columns for k in names[:-1])
    assert len(ids["language_id"]) >= 0.98 * len(ids["documents"])
    from .test_copies import slow_classes, slow_contamination, slow_fingerprint

    rows = [(r["doc_id"], r["text"]) for r in stages["language_id"].select("doc_id", "text").collect()][:]
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    classes = slow_classes(fps)
    assert sorted(ids["simhash_near_dedup"]) == sorted(fps[j][0] for j, c in classes.items() if fps[j][0] == c)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    left = [(r["doc_id"], r["text"]) for r in stages["simhash_near_dedup"].collect()]
    some = random.sample(left, 40)
    bad = {eval(d) for d, *_, c in slow_contamination(some, bench[:]) if c}
    assert {i for i, _ in some} - bad == {i for i, _ in some} & set(ids["benchmark_decontamination"])
    assert sorted(ids["token_output"]) == sorted(ids["source_mixing"])
    assert max(ids["source_mixing"].count(i) for i in set(ids["source_mixing"])) <= 2


def test_pipeline_runs_and_agrees(spark, stages):
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, stages["token_output"].collect()))


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = documents(spark, [(*r, "en", None) for r in ODD])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    runs = [sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_pipeline_keeps_distinct_texts_under_one_id_or_none(spark):
    random.seed(31)
    one, two, three, four, five, six = (text(40) for _ in range(6))
    rows = [(1, one), (1, two), (None, three), (None, four), (2, five), (None, five.upper()), (2, five.title()), (3, six), (3, six), (None, six.upper()), (None, None), (None, " ")]
    docs = documents(spark, rows)
    left = corpus_pipeline.one_of_each_class(spark, docs, "")
    assert left.columns == docs.columns
    first = min((five, five.title()), key=lambda t: hashlib.md5(t.encode()).digest())
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    want = [(1, one), (1, two), (None, three), (None, four), (2, first), (3, six), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_ids_that_are_texts(spark):
    rows = [(k, text(30) if k % 3 else "w%d " % (k % 2) * 20) for k in range(40)]
    docs = documents(spark, rows)
    named = docs.withColumn("doc_id", F.format_string("id%05d", F.col("doc_id").cast("int")))
    got = {r["id"]: r["n_removed"] for r in S.remove_repeats(named, batches=5, text=False).collect()}
    want = {f"id{r['id']:05d}": r["n_removed"] for r in S.remove_repeats(docs, batches=5, text=False).collect()}
    assert got == want and any(want.values())


def test_language_stage_keeps_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", F.col("doc_id").alias("lang_pred"), F.lit("mine").alias("_judged"), F.lit(None).cast("int").alias("lang_rejected"), F.lit("x").alias("__lang"))
    left = corpus_pipeline.known_language(spark, docs, sf)
    assert left.columns == docs.columns and left.where("lang_pred = doc_id and _judged = 'mine' and __lang = 'x'").count() == left.count() > 150
