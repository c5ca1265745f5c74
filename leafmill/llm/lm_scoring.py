"""Hidden Markov language model: Baum-Welch training over the whole corpus, exact likelihoods by the scaled forward recursion.

Counts.  All training tokens are counted (pre-aggregated in each task, then summed by token); every token's count enters the
scores, however rare it is: the ``known`` most frequent tokens of at most LONGEST bytes are broadcast, all others are joined.

Model.  ``STATES`` hidden states emit classes: each of the ``emitted`` most frequent tokens is a class of its own, and every other
token belongs to one of ``ENDINGS`` classes by a hash of its last three bytes, inside which it has the probability
(c + 0.5) / (N_class + 0.5 (V_class + 1)).  This is a proper distribution over known tokens and one unseen token a class.

Encoding.  The texts are read once more and become arrays of class numbers, written to the shared folder; training and scoring
read these alone.

Training.  Every Baum-Welch round goes over all training documents, whole: each task sums expected counts over its documents, and
a shuffle by class adds the tasks up.  Rounds end when the likelihood's gain falls below ``GAIN`` of it, or after ``ROUNDS``.
Documents are taken side by side, place by place; stretches of places are held one at a time, the forward variables at
their edges are kept, and the backward ones are carried over them, so that a document of any length counts as one sequence.

Scoring.  The forward recursion runs over a whole text and its end token, with scaling at each token.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_out

STATES = 8
KNOWN = 200_000
EMITTED = 32_768
ENDINGS = 512
#: Longest token, in bytes, that is broadcast and emitted by itself.
LONGEST = 64
ROUNDS = 8
GAIN = 1e-3
#: Tokens of the documents taken side by side, and of a stretch of places whose variables are held at once.
POOL_TOKENS = 1_000_000
STRETCH_TOKENS = 400_000
#: Tokens that a task counts before it passes their counts on.
COUNTED = 300_000
END = b""


def tokens(raw: bytes | None) -> list[bytes]:
    """Lower-cased words and the end, which no word equals."""
    return [*(raw or b"").lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """The most frequent tokens with their counts, and what is needed of the rest."""

    words: list[bytes]
    counts: np.ndarray
    emitted: int
    total: int
    distinct: int
    rest_total: np.ndarray  # of the tokens that are not emitted by themselves, by ending
    rest_distinct: np.ndarray

    def __post_init__(self):
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.class_of = np.array([i if i < self.emitted else self.emitted + ending(w) for i, w in enumerate(self.words)], np.int64)
        self.log_count = np.log10(self.counts + 0.5)
        self.log_rest = np.log10(self.rest_total + 0.5 * (self.rest_distinct + 1))

    def __getstate__(self):
        return self.words, self.counts, self.emitted, self.total, self.distinct, self.rest_total, self.rest_distinct

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def classes(self) -> int:
        return self.emitted + ENDINGS

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Place of each token among the frequent ones, or -1."""
        get = self.rank.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def encode(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        out = self.class_of[ranks] if len(self.words) else np.zeros(len(ranks), np.int64)
        for i in np.flatnonzero(ranks < 0).tolist():
            out[i] = self.emitted + ending(words[i])
        return out

    def class_prior(self) -> np.ndarray:
        p = np.concatenate([self.counts[: self.emitted] + 0.5, self.rest_total + 0.5])
        return p / p.sum()


class Hmm:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit  # emit: classes by states

    @staticmethod
    def first(prior: np.ndarray, states: int, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.lognormal(0, 0.5, (len(prior), states))
        step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Hmm(np.full(states, 1 / states), step, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        start, step, emit = start + 0.1, step + 0.1, emit + 200 * prior[:, None] + 1e-9
        return Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expect(self, seqs: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray, stretch: int = STRETCH_TOKENS) -> float:
        """Add expected counts of these sequences (forward and backward, all sequences at once); returns the log-likelihood."""
        ids, sizes = _by_time(seqs)
        at = np.r_[0, np.cumsum(sizes)]
        table, move, ones = self.emit.astype(np.float32), self.step.astype(np.float32), np.ones(len(self.start), np.float32)
        back = np.ascontiguousarray(move.T)
        edges = [0]
        while edges[-1] < len(sizes):
            edges.append(max(edges[-1] + 1, int(np.searchsorted(at, at[edges[-1]] + stretch, side="right")) - 1))

        def forward(k: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Emissions, forward variables and scales of stretch k, whose first place follows the variables ``before``."""
            first, last = edges[k], edges[k + 1]
            e = table[ids[at[first] : at[last]]]
            alpha, scale = np.empty_like(e), np.empty(len(e), np.float32)
            spans = (at[first : last + 1] - at[first]).tolist()
            for lo, hi in zip(spans[:-1], spans[1:], strict=True):
                p = alpha[lo:hi]
                if before is None:
                    p[:] = self.start
                else:
                    np.matmul(before[: hi - lo], move, out=p)
                p *= e[lo:hi]
                np.matmul(p, ones, out=scale[lo:hi])
                p /= scale[lo:hi, None]
                before = p
            return e, alpha, scale

        kept: list[np.ndarray | None] = [None]
        total = 0.0
        for k in range(len(edges) - 1):
            made = forward(k, kept[k])
            kept.append(made[1][len(made[1]) - sizes[edges[k + 1] - 1] :].copy())
            total += float(np.log(made[2], dtype=np.float64).sum())
        after = None  # backward variables of the next stretch's first place, moved to this stretch's last
        for k in range(len(edges) - 2, -1, -1):
            first, last = edges[k], edges[k + 1]
            e, alpha, scale = made if k == len(edges) - 2 else forward(k, kept[k])
            e /= scale[:, None]
            beta = np.ones_like(e)
            spans = (at[first : last + 1] - at[first]).tolist()
            if after is not None:
                beta[spans[-2] : spans[-2] + len(after)] = after
            for i in range(last - first - 1, -1, -1):
                lo, hi = spans[i], spans[i + 1]
                w = e[lo:hi]
                w *= beta[lo:hi]
                if i:
                    np.matmul(w, back, out=beta[spans[i - 1] : spans[i - 1] + hi - lo])
            n = sizes[first]
            if k:
                after = e[:n] @ back
                step += self.step * (kept[k][:n].T @ e[:n])
            inner = np.arange(n, len(e))
            before = alpha[inner - np.repeat(sizes[first : last - 1], sizes[first + 1 : last])]
            step += self.step * (before.T @ e[n:])
            alpha *= beta
            if not k:
                start += alpha[:n].sum(axis=0)
            here = ids[at[first] : at[last]]
            for s in range(alpha.shape[1]):
                emit[:, s] += np.bincount(here, weights=alpha[:, s], minlength=len(emit))
        return total

    def likelihoods(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion."""
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        ids, sizes = _by_time([seqs[i] for i in order])
        out, at, alpha = np.zeros(len(seqs)), 0, None
        for n in sizes.tolist():
            p = self.emit[ids[at : at + n]] * (self.start if alpha is None else alpha[:n] @ self.step)
            s = p.sum(axis=1)
            alpha = p / s[:, None]
            out[:n] += np.log10(s)
            at += n
        back = np.empty_like(out)
        back[order] = out
        return back


def _by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences' items in order of their place (longest sequence first in each), and how many have each place."""
    seqs = sorted(seqs, key=len, reverse=True)
    length = np.array([len(s) for s in seqs])
    sizes = np.bincount(np.minimum(length, length[0]), minlength=length[0] + 1)[::-1].cumsum()[::-1][1:]
    first = np.r_[0, np.cumsum(sizes)][:-1]
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    ids = np.empty(length.sum(), np.int32)
    ids[first[place] + np.repeat(np.arange(len(seqs)), length)] = np.concatenate(seqs)
    return ids, sizes


def count_tokens(train: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of train (column raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return write_out(train.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def _beyond(last) -> Column:
    """Whether a token comes after this one in order of count and bytes."""
    return (F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > F.lit(bytearray(last["word"]))))


def _least_count(counts: DataFrame, known: int) -> int:
    """The smallest count of the frequent tokens, from a histogram of at most a few thousand bars, so that at most ``known`` have it."""
    bar = F.floor(F.log2("c") * 64).alias("bar")
    bars = counts.groupBy(bar).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("bar")).collect()
    least, n = 0, 0
    for r in bars:
        n += r["n"]
        if n > known:
            break
        least = r["least"]
    return least or (bars[0]["least"] + (1 << 40) if bars else 0)


def vocabulary(counts: DataFrame, known: int = KNOWN, emitted: int = EMITTED) -> Vocabulary:
    short = counts.where(F.octet_length("word") <= LONGEST)
    frequent = short.where(F.col("c") >= _least_count(short, known)).collect()
    top = sorted(frequent, key=lambda r: (-r["c"], bytes(r["word"])))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rest = counts.where(_beyond(top[min(emitted, len(top)) - 1]) | (F.octet_length("word") > LONGEST)) if top else counts
    by_ending = rest.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % ENDINGS).cast("int").alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        n[r["e"]], v[r["e"]] = r["n"], r["v"]
    return Vocabulary([bytes(r["word"]) for r in top], np.array([r["c"] for r in top], float), min(emitted, len(top)), whole["n"] or 0, whole["v"], n, v)


def encode(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """Rows of docs (columns id, raw, learn) as class numbers, with what the frequent tokens add to the scores, and the rare ones."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        names = ["id", "learn", "n_tokens", "n_known", "base", "inside", "words", "times", "classes"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some, out = b.slice(at, 500), []
                for t in some.column(1):
                    words = tokens(t.as_py())
                    ranks = voc.ranks(words)
                    ids = voc.encode(words, ranks)
                    found = ranks >= 0
                    base = float(voc.log_count[ranks[found]].sum())
                    inside = float(voc.log_count[ranks[ranks >= voc.emitted]].sum()) - float(voc.log_rest[ids[ids >= voc.emitted] - voc.emitted].sum())
                    rare = Counter(words[j] for j in np.flatnonzero(~found).tolist())
                    out.append((len(words), int(found.sum()), base, inside, list(rare.keys()), list(rare.values()), ids.astype("<i4" if voc.classes >> 16 else "<u2").tobytes()))
                yield pa.record_batch([some.column(0), some.column(2), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], names=names)

    schema = f"id {kind}, learn boolean, n_tokens long, n_known long, base double, inside double, words array<binary>, times array<long>, classes binary"
    return write_out(docs.select("id", "raw", "learn").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "encoded")


def _read(column: pa.Array, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<i4" if wide else "<u2") for x in column]


def _flat(hmm: Hmm) -> bytes:
    return np.concatenate([hmm.start, hmm.step.ravel(), hmm.emit.ravel()]).astype("<f8").tobytes()


def _unflat(raw: bytes, states: int) -> Hmm:
    v = np.frombuffer(raw, "<f8")
    k = states + states * states
    return Hmm(v[:states], v[states:k].reshape(states, states), v[k:].reshape(-1, states))


def baum_welch(train: DataFrame, voc: Vocabulary, hmm: Hmm) -> tuple[Hmm, float]:
    """One round over all training documents (column classes): the next model, and the log-likelihood under this one."""
    states, classes, wide = len(hmm.start), voc.classes, bool(voc.classes >> 16)
    shared = train.sparkSession.sparkContext.broadcast(_flat(hmm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = _unflat(shared.value, states)
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        held, n, total = [], 0, 0.0
        for b in batches:
            for x in _read(b.column(0), wide):
                held.append(x)
                n += len(x)
                if n >= POOL_TOKENS:
                    total += hmm.expect(held, start, step, emit)
                    held, n = [], 0
        if held:
            total += hmm.expect(held, start, step, emit)
        used = np.flatnonzero(emit.any(axis=1))
        rows = np.vstack([emit[used], step, start, np.full(states, total)])
        names = np.concatenate([used, -1 - np.arange(states + 2)])
        yield pa.record_batch([pa.array(names, pa.int64()), *[pa.array(rows[:, s]) for s in range(states)]], names=["k", *[f"s{s}" for s in range(states)]])

    cols = [f"s{s}" for s in range(states)]
    got = train.select("classes").mapInArrow(run, "k long, " + ", ".join(f"{c} double" for c in cols)).groupBy("k").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    shared.destroy()
    start, step, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0
    for r in got:
        k, v = r["k"], list(r[1:])
        if k >= 0:
            emit[k] = v
        elif k >= -states:
            step[-1 - k] = v
        elif k == -1 - states:
            start[:] = v
        else:
            total = v[0]
    return Hmm.from_counts(start, step, emit, voc.class_prior()), total


def train_model(train: DataFrame, voc: Vocabulary, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> Hmm:
    """Baum-Welch over the encoded training documents from a seeded first guess, until it settles."""
    hmm, before = Hmm.first(voc.class_prior(), states), None
    for _ in range(rounds if voc.total else 0):
        hmm, now = baum_welch(train, voc, hmm)
        if before is not None and now - before < gain * abs(before):
            break
        before = now
    return hmm


def score(encoded: DataFrame, counts: DataFrame, voc: Vocabulary, hmm: Hmm) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per encoded row."""
    states, wide = len(hmm.start), bool(voc.classes >> 16)
    shared = encoded.sparkSession.sparkContext.broadcast(_flat(hmm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = _unflat(shared.value, states)
        rows, seqs, n = [], [], 0

        def out():
            return pa.record_batch([pa.array(rows, pa.int64()), pa.array(hmm.likelihoods(seqs))], names=["row", "forward"])

        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), _read(b.column(1), wide), strict=True):
                rows.append(row)
                seqs.append(x)
                n += len(x)
                if n >= POOL_TOKENS:
                    yield out()
                    rows, seqs, n = [], [], 0
        if rows:
            yield out()

    forward = encoded.select("row", "classes").mapInArrow(run, "row long, forward double")
    marked = encoded.drop("classes")
    rare = marked.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    joined = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    floor = float(np.log10(voc.total + 0.5 * (voc.distinct + 1)))
    rare_score = F.coalesce("rare", F.lit(0.0))
    return marked.join(forward, "row").join(joined, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + rare_score - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("forward") + F.col("inside") + rare_score).alias("score"),
    )


def score_corpus(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, emitted: int = EMITTED, **training) -> DataFrame:
    """Train on the rows where ``learn`` holds and score all rows of docs; ``training`` goes to train_model().

    A null text is empty: the end token alone.  Repeated rows count as often as they stand.  With no training rows every
    token is unseen.  No rows give no rows; other columns of docs are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), learn.alias("learn"))
    counts = count_tokens(rows.where("learn"))
    voc = vocabulary(counts, known, emitted)
    encoded = encode(rows, voc)
    hmm = train_model(encoded.where("learn"), voc, **training)
    return score(encoded, counts, voc, hmm).withColumn("train_tokens", F.lit(voc.total).cast("long"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    got = score_corpus(read(spark, sf_dir, "documents"), ~held_out)
    return got.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
