"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its character n-grams (of UTF-8 bytes, ASCII letters lower-cased, runs of other ASCII characters one
space) hashed to ``BUCKETS`` rows of an embedding table; the text is their mean, and a linear layer with softmax gives
the languages' probabilities.  Stochastic gradient descent in numpy trains both on a bounded sample of labelled rows.  A
temperature fitted on held-back rows of the sample calibrates the probabilities.  A text is rejected if its calibrated
probability, or the share of its three-byte n-grams that training has met, is below a threshold: of the rightly named held-back
rows and pieces of like length, all but the share REJECTED are above it.  (The mean of embeddings that training never moved may
fall anywhere, so that the probability alone does not tell other scripts.)  For prediction, table and layer are multiplied once, so a text costs one look-up per n-gram of its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BUCKETS = 1 << 15
DIM = 16
GRAMS = (1, 2, 3, 4)
#: Bounds of the training sample: rows and bytes per language on average, and bytes of a row that may be in it.
SAMPLE_PER_LANG = 1500
SAMPLE_BYTES = 8 << 20
SAMPLE_ROW = 256 << 10
#: Share of rightly named held-back rows below the rejection threshold, and how far below it that is set.
REJECTED = 0.002
MARGIN = 0.9
#: Numbers of n-grams at which another threshold begins: short texts are named with less certainty.
LENGTHS = (0, 100, 400, 1600, 6400)
#: Slots of the n-grams of this length that training has met.
MET, MET_GRAM = 1 << 20, 3
EPOCHS = 6
SEED = 11
UND = "und"
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
#: Bytes of a text that are turned into n-grams at once.
_PIECE = 1 << 20


def _letters(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def pieces(raw: bytes, piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers of a text's n-grams, and slots of those of MET_GRAM, a piece of the text at a time; n-grams over the edges count like others."""
    most = max(GRAMS)
    tail = np.array([32], np.uint32)  # the last characters before the piece
    for at in range(0, len(raw) + 1, piece):
        a = _FOLD[np.frombuffer(raw[at : at + piece], np.uint8)]
        if at + piece > len(raw):
            a = np.append(a, np.uint8(32))
        a = np.concatenate([tail, a.astype(np.uint32)])
        old = len(tail)
        keep = np.r_[np.ones(old, bool), (a[old:] != 32) | (a[old - 1 : -1] != 32)]
        a = a[keep]
        out, h, slots = [], np.zeros(len(a), np.uint32), np.empty(0, np.uint32)
        for n in range(1, most + 1):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1 :]
            if n in GRAMS:
                mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                # those that end in this piece; the blank before a text is its own first character
                mixed = (mixed ^ (mixed >> np.uint32(15)))[max(0, old - n + 1) if at else 0 :]
                out.append(mixed % np.uint32(BUCKETS))
                if n == MET_GRAM:
                    slots = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(12)
        yield np.concatenate(out) if out else np.empty(0, np.uint32), slots
        tail = a[-(most - 1) :]


def grams(raw: bytes) -> np.ndarray:
    """Bucket numbers of the n-grams of a text."""
    return np.concatenate([some for some, _ in pieces(raw)])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets by languages: embedding times layer
    bias: np.ndarray
    temperature: float
    thresholds: list[float]  # by length, as LENGTHS
    met: np.ndarray  # slots of the n-grams that training has met
    shares: list[float]  # least shares of them, by length

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); und with 0, rejected, for null, or no letters, or a model without languages."""
        if not raw or not self.langs or not _letters(raw):
            return UND, 0.0, True
        total, n, tried, found = np.zeros(len(self.langs)), 0, 0, 0
        for some, slots in pieces(raw):
            counts = np.bincount(some, minlength=BUCKETS)
            total += counts @ self.table
            n += len(some)
            tried += len(slots)
            found += int(np.count_nonzero(self.met[slots]))
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        sure = float(p[best] / p.sum())
        k = int(np.searchsorted(LENGTHS, n, side="right")) - 1
        return self.langs[best], sure, sure < self.thresholds[k] or found < self.shares[k] * tried


def train(rows: list[tuple[str, bytes]], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fit on (language, text) rows; every fifth is held back for calibration."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, [0.0] * len(LENGTHS), np.zeros(MET, bool), [0.0] * len(LENGTHS))
    rng = np.random.default_rng(seed)
    number = {k: i for i, k in enumerate(langs)}
    feats: list[tuple] = []  # number of the language, buckets, their shares, n-grams, slots
    back: list[tuple] = []
    for i, (lang, raw) in enumerate(rows):
        words = raw.split()
        short = [b" ".join(words[k : k + n]) for n in (3, 12) for k in [int(rng.integers(0, max(1, len(words) - n)))]]
        for piece in [raw, *short]:
            parts = list(pieces(piece))
            idx, count = np.unique(np.concatenate([x for x, _ in parts]), return_counts=True)
            if len(idx):
                (back if i % 5 == 4 else feats).append((number[lang], idx, (count / count.sum()).astype(np.float32), int(count.sum()), np.concatenate([x for _, x in parts])))
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    layer += rng.normal(0, 0.3, layer.shape).astype(np.float32)
    weight = 1 / np.maximum(1, np.bincount([f[0] for f in feats], minlength=len(langs)))
    weight *= len(feats) / len(langs)
    for e in range(epochs):
        rate = 2.0 * (1 - e / epochs)
        for k in rng.permutation(len(feats)):
            y, idx, w = feats[k][:3]
            v = w @ table[idx]
            z = v @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * min(3.0, weight[y])
            back_v = layer @ p
            layer -= 0.5 * np.outer(v, p)
            bias -= 0.1 * p
            table[idx] -= np.outer(w, back_v) * 4
    product = (table @ layer).astype(np.float64)
    z = np.array([w @ product[idx] + bias for _, idx, w, *_ in back or feats])
    y = np.array([f[0] for f in back or feats])
    size = np.array([f[3] for f in back or feats])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.2, 500, 120), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y
    met = np.zeros(MET, bool)
    for f in feats:
        met[f[4]] = True
    share = np.array([np.count_nonzero(met[f[4]]) / max(1, len(f[4])) for f in back or feats])
    thresholds, shares = [], []
    for lo, hi in zip(LENGTHS, [*LENGTHS[1:], 1 << 62], strict=True):
        some = right & (size >= lo) & (size < hi)
        for values, out in ((p.max(axis=1)[some], thresholds), (share[some], shares)):
            # of few rows, the smallest value is further from what others may have
            least = np.quantile(values, REJECTED) * (MARGIN if len(values) * REJECTED >= 1 else MARGIN * MARGIN) if len(values) else 0.0
            out.append(float(least) if len(values) or not out else out[-1])
    return Model(langs, product, bias.astype(np.float64), float(temperature), thresholds, met, shares)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, bytes_per_lang: int = SAMPLE_BYTES, longest: int = SAMPLE_ROW) -> Model:
    """Train on a hash sample of labelled rows: about per_lang rows and bytes_per_lang bytes a language, of at most longest bytes each.

    Rows with a null text or label are no labelled rows; of rows that agree in id, text and label one is taken.  The sample is a
    documented bound on the classifier's training rows alone; every language has a row in it at least, and which rows the sample holds
    depends on their ids and texts only.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("raw"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(SEED)).alias("h")).where("raw is not null and lang is not null")
    short = labelled.where(F.octet_length("raw") <= longest)
    top = 1 << 30
    n = F.approx_count_distinct("h")  # rows that repeat do not make a language's sample smaller
    rate = F.least(F.lit(1.0), per_lang / n, F.try_divide(F.lit(float(bytes_per_lang)), F.avg(F.octet_length("raw")) * n))
    counts = short.groupBy("lang").agg(F.coalesce(rate, F.lit(1.0)).alias("rate"), F.min(F.pmod("h", F.lit(top))).alias("least")).collect()
    if not counts:
        return train([])
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(int(top * r["rate"]), r["least"] + 1))])
    rows = short.where(F.pmod("h", F.lit(top)) < bound[F.col("lang")]).dropDuplicates(["lang", "h"])

    def fit_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = train([(lang, raw) for _, lang, raw in sorted(got)])
        blob = np.concatenate([model.table.ravel(), model.bias, [model.temperature], model.thresholds, model.shares]).astype("<f8").tobytes()
        yield pa.record_batch([pa.array([model.langs], pa.list_(pa.string())), pa.array([blob], pa.binary()), pa.array([np.packbits(model.met).tobytes()], pa.binary())], names=["langs", "blob", "met"])

    made = rows.repartition(1).mapInArrow(fit_here, "langs array<string>, blob binary, met binary").first()
    langs, values = list(made["langs"]), np.frombuffer(bytes(made["blob"]), "<f8")
    met = np.unpackbits(np.frombuffer(bytes(made["met"]), np.uint8)).astype(bool)
    k, n, some = BUCKETS * len(langs), len(langs), len(LENGTHS)
    return Model(langs, values[:k].reshape(BUCKETS, n), values[k : k + n], float(values[k + n]), values[k + n + 1 : -some].tolist(), met, values[-some:].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; only the text is read for it.

    Null texts and texts without a letter are und with score 0, and rejected; so are texts whose calibrated probability is
    or share of known n-grams is below the model's threshold for their length (they keep their best language).  Repeated rows are judged alike; existing columns of
    these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            got = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["lang", "score", "rejected"])

    predict = F.arrow_udf(run, "lang string, score double, rejected boolean")
    held = "_judged"
    while held in map(str.lower, docs.columns):
        held += "_"
    judged = docs.withColumn(held, predict(F.col(text_col).cast("binary")))
    return judged.withColumns({f"lang_{new}": F.col(held)[c] for new, c in (("pred", "lang"), ("score", "score"), ("rejected", "rejected"))}).drop(held)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = fit(docs.where(rest != 0))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
