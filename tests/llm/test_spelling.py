import random
import re
import zlib
from collections import Counter

import pytest
from leafmill.llm import spelling

from .cases import ODD, documents

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else f'{i}:'}{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def at_one_edit(w):
    """All words of the alphabet at exactly one edit."""
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in LETTERS} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
    return out - {w}


def brute_variants(n):
    near = {w: [x for x in at_one_edit(w) if x in n] for w in n}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def as_set(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = {w: k for w, k in brute_words(rows).items() if k >= 3 and len(w) >= 5}
    assert len(n) > 1000
    assert as_set(spelling.op13_spelling_variants(spark, sf)) == brute_variants(n)


def test_words_of_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), "".join(rng.choice("aAbÉé×÷ ĀñÃ\x80Â.zƀ\U0001f600") for _ in range(rng.randrange(200)))) for _ in range(300)]
    rows += [(r[0], r[1]) for r in ODD] + [(7, "aaaaa"), (None, "Bcdefg bcdefg"), (8, "x" * 200_000 + " " + "xyzzy " * 5)] * 3
    want = {w: k for w, k in brute_words(rows).items() if k >= 3 and len(w) >= 5}
    got = [tuple(r) for r in spelling.word_counts(documents(spark, rows)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert spelling.word_counts(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("most", [20_000, 40, 1])
def test_crowded_keys_are_halved_until_they_fit(spark, most):
    """Words over three letters crowd every key; all are at few edits, and runs of one letter can be aligned in many ways."""
    rng = random.Random(most)
    n = {"".join(rng.choice("aaé") for _ in range(rng.randrange(1, 11))): rng.randrange(3, 60) for _ in range(700)}
    n |= {"long" * 50 + x: 5 for x in ("", "a", "b", "ba")} | {"a": 3, "": 4}
    n.pop("")
    got = as_set(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most))
    assert got == brute_variants(n)


def test_every_kind_of_edit_and_ties(spark):
    n = {"abcde": 10, "abcdf": 10, "abcd": 9, "abcdee": 5, "xbcde": 5, "bcde": 4, "abcxx": 4, "zzzzz": 3}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert {w: r["form"] for w, r in got.items()} == {"abcde": None, "abcdf": None, "abcd": None, "abcdee": "abcde", "xbcde": "abcde", "bcde": "abcde", "abcxx": None, "zzzzz": None}
    assert (got["zzzzz"]["n_near"], got["abcde"]["n_near"], got["bcde"]["root"]) == (0, 5, "abcde")


def test_chains_of_forms_and_none(spark):
    chain = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    n = {w: 3 * 2**i for i, w in enumerate(chain)}
    got = as_set(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n) and {r[2] for r in got} == {chain[-1]}
    assert as_set(spelling.variants(spark.createDataFrame([], "word string, n long"))) == set()
