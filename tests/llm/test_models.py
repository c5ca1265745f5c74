import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from leafmill.llm import language_id, lm_scoring
from pyspark.sql import functions as F

from .cases import ODD, documents


def tiny(states=3, classes=5, seed=2):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return lm_scoring.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def all_paths(h, seq):
    total = 0.0
    for path in itertools.product(range(len(h.start)), repeat=len(seq)):
        p = h.start[path[0]]
        for a, b in itertools.pairwise(path):
            p *= h.step[a, b]
        for s, x in zip(path, seq, strict=True):
            p *= h.emit[x, s]
        total += p
    return total


def test_forward_sums_all_paths():
    h = tiny()
    seqs = [np.array(s) for s in ([0], [1, 4, 2], [3, 3, 0, 1, 2, 4], [2, 2])]
    assert np.allclose(h.likelihoods(seqs), [math.log10(all_paths(h, s)) for s in seqs])
    every = [np.array(s) for s in itertools.product(range(5), repeat=3)]
    assert math.isclose(sum(10 ** h.likelihoods(every)), 1)


def test_expected_counts_and_ascent():
    h, rng = tiny(), np.random.default_rng(4)
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 9, 9, 40)]
    last = -math.inf
    for _ in range(6):
        start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        now = h.expect(seqs, start, step, emit)
        assert math.isclose(emit.sum(), 61, rel_tol=1e-4) and math.isclose(step.sum(), 56, rel_tol=1e-4) and math.isclose(start.sum(), 5, rel_tol=1e-4)
        assert np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=5), rtol=1e-4)
        assert now >= last - 1e-3
        for stretch in (1, 3, 11):
            parts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
            assert math.isclose(h.expect(seqs, *parts, stretch=stretch), now, rel_tol=1e-5)
            assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(parts, (start, step, emit), strict=True))
        last, h = now, lm_scoring.Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_counts_of_a_long_text_are_exact():
    """One sequence, cut into stretches, against sums over all paths."""
    h, seq = tiny(), np.array([3, 0, 4, 1, 1, 2, 0])
    want, total = np.zeros((3, 3)), all_paths(h, seq)
    for path in itertools.product(range(3), repeat=len(seq)):
        p = h.start[path[0]] * h.emit[seq[0], path[0]]
        for (a, b), x in zip(itertools.pairwise(path), seq[1:], strict=True):
            p *= h.step[a, b] * h.emit[x, b]
        for a, b in itertools.pairwise(path):
            want[a, b] += p / total
    for stretch in (1, 2, 100):
        start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        assert math.isclose(h.expect([seq], start, step, emit, stretch=stretch), math.log(total), rel_tol=1e-5)
        assert np.allclose(step, want, rtol=1e-4) and math.isclose(start.sum(), 1, rel_tol=1e-4)


def check_scores(spark, rows, **options):
    docs = documents(spark, rows)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    got = lm_scoring.score_corpus(docs, ~held, **options).collect()
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    c = Counter()
    for (i, _), w in zip(rows, toks, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for (i, _), w in zip(rows, toks, strict=True))
    assert sorted((repr(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_scores_equal_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check_scores(spark, rows + ODD, known=300, emitted=100, rounds=3)
    assert sum(r["score"] - r["base_score"] for r in got) > 0
    check_scores(spark, ODD, rounds=1)


def test_scores_are_those_of_the_forward_recursion(spark, sf):
    """Scores, rare tokens and all, against the model's definition word by word."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ODD + [(900, "z" * 70 + " " + "z" * 70)]
    docs = documents(spark, rows).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"), F.lit(True).alias("learn"))
    counts = lm_scoring.count_tokens(docs)
    voc = lm_scoring.vocabulary(counts, 200, 80)
    encoded = lm_scoring.encode(docs, voc)
    h = lm_scoring.train_model(encoded, voc, rounds=2)
    got = sorted((repr(r["id"]), r["score"]) for r in lm_scoring.score(encoded, counts, voc, h).collect())
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    own = voc.words[: voc.emitted]
    inside = Counter()
    for w, n in c.items():
        if w not in own:
            inside[lm_scoring.ending(w), "n"] += n
            inside[lm_scoring.ending(w), "v"] += 1
    want = []
    for i, t in rows:
        alpha, total = None, 0.0
        for w in lm_scoring.tokens((t or "").encode()):
            e = lm_scoring.ending(w)
            x = own.index(w) if w in own else voc.emitted + e
            alpha = h.emit[x] * (h.start if alpha is None else alpha @ h.step)
            total += math.log10(alpha.sum()) + (0 if w in own else math.log10((c[w] + 0.5) / (inside[e, "n"] + 0.5 * (inside[e, "v"] + 1))))
            alpha = alpha / alpha.sum()
        want.append((repr(i), total))
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and math.isclose(x, y, rel_tol=1e-9)
    assert len(voc.words) <= 200 and max(map(len, voc.words)) <= lm_scoring.LONGEST


def test_every_round_reads_all_training_documents_and_climbs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("raw"), F.lit(True).alias("learn"))
    voc = lm_scoring.vocabulary(lm_scoring.count_tokens(docs), 5000, 2000)
    encoded, h, seen = lm_scoring.encode(docs, voc), lm_scoring.Hmm.first(voc.class_prior(), 4), []
    for _ in range(4):
        h, now = lm_scoring.baum_welch(encoded, voc, h)
        seen.append(now)
    assert seen == sorted(seen) and math.isclose(seen[0], lm_scoring.baum_welch(encoded.repartition(3), voc, lm_scoring.Hmm.first(voc.class_prior(), 4))[1], rel_tol=1e-5)


def test_scores_of_nothing_and_without_training(spark):
    assert lm_scoring.score_corpus(documents(spark, []), F.lit(True)).count() == 0
    got = lm_scoring.score_corpus(documents(spark, ODD), F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_vocabulary_is_a_distribution():
    """One step of the model over every known token and one unseen token a class sums to one."""
    words = [b"", b"alpha", b"beta", b"gamma"]
    rest = Counter({b"delta": 3, b"zeta": 2, b"eta": 1})
    n, v = np.zeros(lm_scoring.ENDINGS), np.zeros(lm_scoring.ENDINGS)
    for w, c in rest.items():
        n[lm_scoring.ending(w)] += c
        v[lm_scoring.ending(w)] += 1
    voc = lm_scoring.Vocabulary(words, np.array([9.0, 4, 3, 3]), 4, 25, 7, n, v)
    h = lm_scoring.Hmm.first(voc.class_prior(), 2)
    of = lambda w, c: float(h.likelihoods([voc.encode([w], voc.ranks([w]))])[0]) + (0 if w in words else math.log10(c + 0.5) - voc.log_rest[lm_scoring.ending(w)])
    total = sum(10 ** of(w, c) for w, c in [*((w, 0) for w in words), *rest.items()])
    p = h.emit[4:] @ h.start
    total += sum(p[e] * 0.5 / (n[e] + 0.5 * (v[e] + 1)) for e in range(lm_scoring.ENDINGS))
    assert math.isclose(total, 1)


def test_languages_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = language_id.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_languages_of_odd_rows(spark):
    rows = [*ODD, (50, "12 34 !"), (51, None), *((100 + k, "the of and to in that was it " * 3, "en") for k in range(20)), *((200 + k, "der die und das ist nicht ein zu " * 3, "de") for k in range(20)), (300, "und das ist", None)]
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_rejected"] and got[i]["lang_score"] == 0 for i in (1, 2, 3, 50, 51))
    assert got[300]["lang_pred"] == "de" and got[5]["lang_pred"] in model.langs
    nothing = language_id.fit(documents(spark, []))
    assert nothing.langs == [] and language_id.identify(documents(spark, [(1, "word")]), nothing).first()["lang_pred"] == "und"


def test_texts_of_no_learned_language_are_rejected(spark, sf):
    """Clean texts and short cuts of them stay; letters of other languages go, the shortest least surely."""
    rows = [r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("lang is not null and text is not null").select("doc_id", "lang", "text").collect()]
    mine = [(r["lang"], r["text"].encode()) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    held = [r["text"].encode() for r in rows if not zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = language_id.train(mine)
    cuts = [b" ".join(t.split()[:12]) for t in held if len(t.split()) >= 12]
    share = lambda texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    assert share(held) <= 0.01 and share(cuts) <= 0.02
    rng = np.random.default_rng(5)

    def other(parts, n):
        return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n)).encode()

    letters = lambda a, b: [chr(c) for c in range(a, b)]
    for parts in (letters(0x3B1, 0x3CA), letters(0x430, 0x450), letters(0x4E00, 0x4F00), letters(0x5D0, 0x5EB), letters(0xE01, 0xE2F)):
        assert share([other(parts, 200) for _ in range(60)]) >= 0.95
        assert share([other(parts, 50) for _ in range(60)]) >= 0.8


def test_every_language_is_learned():
    rng = np.random.default_rng(3)
    made = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for k in range(600)}
    model = language_id.train([(k, " ".join(rng.choice(w, 20)).encode()) for k, w in made.items() for _ in range(6)])
    assert len(model.langs) == 600 and sum(model.predict(" ".join(w * 3).encode())[0] == k for k, w in made.items()) > 500


def test_pieces_cut_neither_words_nor_letters():
    raw = ("  Der die  das, nicht! é 日本 \n" * 60 + "x").encode()
    whole = np.sort(language_id.grams(raw))
    for piece in (1, 2, 3, 5, 7, 64, 1000):
        assert np.array_equal(np.sort(np.concatenate([x for x, _ in language_id.pieces(raw, piece)])), whole)
    assert len(whole) == len(language_id.grams(b" ".join(raw.translate(None, b"\n").split()).replace(b",", b"").replace(b"!", b"")))


def test_sample_is_bounded_where_one_id_repeats(spark):
    rows = [(7, f"the of and to in that was it {k % 3}", "en") for k in range(900)] + [(k, "der die und das ist nicht ein zu", "de") for k in range(900)] + [(None, "x " * 200_000, "de")]
    docs = documents(spark, rows)
    seen = language_id.fit(docs, per_lang=50, longest=1000)
    assert seen.langs == ["de", "en"]


def test_long_texts_are_read_whole():
    model = language_id.train([("en", b"the of and to in that was it " * 5), ("de", b"der die und das ist nicht ein zu " * 5)] * 20)
    start = b"the of and to " * 1000
    assert model.predict(start + b"und der die das nicht " * 200_000)[0] == "de"
