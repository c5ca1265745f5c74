"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0).  A rule has unknown accuracies: how often it casts either
vote on documents of good and of bad hidden quality.  Expectation-maximisation over the counts of vote patterns (at
most 3^rules rows, whatever the corpus) estimates them and the share of good documents; a document's posterior
probability of being good decides.  Every rule is taken to err on ERRS of the good documents at least: one bad vote against
many good ones does not drop a document, several do, and rules that withhold the votes they cast on nearly all good documents
speak against one that no rule votes bad on.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_out

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
KEEP = 0.5
#: Share of good documents on which a rule votes bad, at least.
ERRS = 0.02

#: name: (feature, bad if, good if); features are those of measure().
RULES = {
    "length": ("n_words", lambda x: (x < 50) | (x > 100_000), lambda x: (x >= 80) & (x <= 50_000)),
    "word_length": ("mean_word", lambda x: (x < 2.5) | (x > 12), lambda x: (x >= 3.2) & (x <= 9)),
    "symbols": ("symbol_ratio", lambda x: x > 0.1, lambda x: x < 0.03),
    "letters": ("letter_ratio", lambda x: x < 0.66, lambda x: x > 0.75),
    "repeats": ("repeat_ratio", lambda x: x > 0.4, lambda x: x < 0.2),
    "lines": ("dup_line_ratio", lambda x: x > 0.4, lambda x: x < 0.2),
    "bare": ("bare_ratio", lambda x: x > 0.2, lambda x: x < 0.05),
    "sentences": ("stop_ratio", lambda x: x < 0.005, lambda x: x > 0.02),
}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of this width that occur twice or more among these words."""
    n = F.size(words)
    names = [f"w{k}" for k in range(width)]

    m = F.greatest(n - width + 1, F.lit(0))
    shifted = [F.slice(words, k + 1, m).alias(c) for k, c in enumerate(names)]
    zipped = F.arrays_zip(*shifted, F.sequence(F.lit(1), F.greatest(m, F.lit(1))).alias("i"))
    windows = F.transform(zipped, lambda x: F.struct(F.xxhash64(*[x[c] for c in names]).alias("h"), *[x[c].alias(c) for c in names], x["i"].alias("i")))

    def twice(s: Column) -> Column:
        """Places of the windows whose words equal those of a neighbour; the hash only settles most comparisons early."""

        def same(x: Column, j: Column) -> Column:
            y = F.get(s, j)
            return reduce(lambda a, c: a & (x[c] == y[c]), names, x["h"] == y["h"]).eqNullSafe(True)

        return F.transform(F.filter(s, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, j - 1))), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
        )

    found = _let(F.sort_array(windows), lambda s: _let(F.sort_array(twice(s)), covered))
    return F.when(n < width + 1, F.lit(0)).otherwise(found).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' features) per row; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    base = split.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"\p{L}")).alias("n_letters"),
        F.regexp_count("t", F.lit(r"[.!?,](?=\s|$)")).alias("n_stops"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])")).alias("n_bare"),
    )
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return base.withColumns({"mean_word": part("word_chars", "n_words"), "symbol_ratio": part("n_symbols", "word_chars"), "letter_ratio": part("n_letters", "word_chars"), "repeat_ratio": part("n_repeat_words", "n_words"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "stop_ratio": part("n_stops", "n_words"), "bare_ratio": part("n_bare", "n_words")})


def votes(features: DataFrame, rules: dict = RULES) -> DataFrame:
    return features.withColumns({f"vote_{k}": F.when(bad(F.col(f)), -1).when(good(F.col(f)), 1).otherwise(0) for k, (f, bad, good) in rules.items()})


#: accuracy[rule] = (P(votes bad | good), P(votes bad | bad), P(votes good | good), P(votes good | bad))
Accuracies = dict[str, tuple[float, float, float, float]]


def _posterior(names: list[str], accuracy: Accuracies, prior: float) -> Column:
    """Probability of being good by the votes cast and withheld."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k in names:
        bad_good, bad_bad, good_good, good_bad = accuracy[k]
        none = math.log((1 - bad_good - good_good) / (1 - bad_bad - good_bad))
        odds = odds + F.when(F.col(f"vote_{k}") == -1, math.log(bad_good / bad_bad)).when(F.col(f"vote_{k}") == 1, math.log(good_good / good_bad)).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[Accuracies, float]:
    """Each rule's accuracies on good and on bad documents, and the share of good ones, by expectation-maximisation over all rows.

    The first guess goes by the number of bad votes: none, one, or more.  A bad vote stays at least twice as likely on bad
    documents as on good ones, so that the classes keep their meaning.  Without rows a plain guess stays.
    """
    patterns = write_out(voted.groupBy(*[f"vote_{k}" for k in names]).agg(F.count(F.lit(1)).alias("n")), "votes")
    n_bad = reduce(lambda a, b: a + b, [(F.col(f"vote_{k}") == -1).cast("int") for k in names])
    posterior = F.when(n_bad == 0, 0.95).when(n_bad == 1, 0.5).otherwise(0.05)
    accuracy, prior = dict.fromkeys(names, (ERRS, 0.3, 0.9, 0.5)), 0.9
    for _ in range(rounds):
        p = patterns.withColumn("g", F.col("n") * posterior).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum(F.when(F.col(f"vote_{k}") == v, F.col(y)).otherwise(0.0)).alias(f"{k}_{v}_{y}") for k in names for v in (-1, 1) for y in "gb"]
        r = p.agg(F.sum("g").alias("good"), F.sum("b").alias("bad"), *sums).first()
        if not r["good"]:
            break
        good, bad = r["good"], r["bad"]
        prior = min(0.98, max(0.02, good / (good + bad)))
        for k in names:
            bad_good = min(0.25, max(ERRS, (r[f"{k}_-1_g"] + 0.2) / (good + 20)))
            bad_bad = min(0.9, max(2 * bad_good, (r[f"{k}_-1_b"] + 2) / (bad + 20)))
            good_good = min(0.995 - bad_good, (r[f"{k}_1_g"] + 16) / (good + 20))
            good_bad = max(0.01, min(0.995 - bad_bad, (r[f"{k}_1_b"] + 10) / (bad + 20)))
            accuracy[k] = (bad_good, bad_bad, good_good, good_bad)
        posterior = _posterior(names, accuracy, prior)
    return accuracy, prior


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """measure()'s columns, the votes, posterior and kept, per row of docs.

    Null texts are empty: no words, every ratio 0.  Repeated rows count as often as they stand.  No rows give no rows;
    other columns are not read, whatever their names.
    """
    voted = write_out(votes(measure(docs, id_col, text_col), rules), "features")
    accuracy, prior = fit(voted, list(rules), rounds)
    return voted.withColumn("posterior", _posterior(list(rules), accuracy, prior)).withColumn("kept", F.col("posterior") >= keep)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = score(read(spark, sf_dir, "documents")).withColumn("base_failed", failed)
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"), "posterior", F.col("kept").alias("rules_kept"))
