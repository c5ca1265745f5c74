"""Fetching as a join with attempts: the first attempt that settles a request, its status, and its body as text.

Attempts are rows.  Which of a request's attempts counts is decided over their numbers and errors alone; only that one's body is
joined, inflated and decoded, by its header, its mark or its content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import urls
from leafmill.sources import files

#: Attempts of a request, and what an error says that is worth another one; fixed values.
MOST = 3
AGAIN = ("EOF", "timeout", "connection reset", "broken pipe")


def worth_another(error: Column) -> Column:
    """Whether a failed attempt is made again."""
    return F.coalesce(error.rlike("|".join(AGAIN)), F.lit(False))


def _inflated(data: bytes) -> bytes:
    """A body that came as gzip, zlib or raw deflate; what cannot be inflated stays as it is."""
    for bits in (47, -15):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data) + d.flush()
            if d.eof:
                return out
        except zlib.error:
            continue
    return data


@F.arrow_udf(T.BinaryType())
def inflated(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bodies whose content encoding is gzip or deflate, inflated; others as they are."""
    for bodies, encodings in parts:
        rows = zip(bodies.to_pylist(), encodings.to_pylist(), strict=True)
        yield pa.array([None if b is None else _inflated(b) if (e or "").strip().lower() in ("gzip", "x-gzip", "deflate") else b for b, e in rows], pa.binary())


def settled_attempt(responses: DataFrame, most: int = MOST, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """(by, attempt, attempts): the first of a request's attempts that does not ask for another one, else its last; numbers from 1 on."""
    made = responses.where(F.col("attempt").between(1, most))
    end = F.coalesce(F.min(F.when(~worth_another(F.col("error")), F.col("attempt"))), F.max("attempt"))
    return made.groupBy(*by).agg(end.alias("attempt")).withColumn("attempts", F.col("attempt"))


def fetched(requests: DataFrame, responses: DataFrame, most: int = MOST, url: str = "url", key: str | None = None) -> DataFrame:
    """requests with attempts, status, error, outcome, text and charset.

    responses: url, attempt, status, error, content_type, content_encoding, body (binary).  outcome is 'ok', 'failed' (with its
    error), 'refused' (the URL may not be asked for) or 'no response'; a status is no failure.  Without a body the text is ''.
    With a key, a column of both, a URL that several requests ask for has attempts of each.
    """
    by = ("url",) if key is None else ("url", key)
    plan = settled_attempt(responses, most, by)
    one = responses.dropDuplicates([*by, "attempt"]).join(plan, [*by, "attempt"])
    held = one.select(F.col("url").alias("_url"), *[F.col(k).alias("_key") for k in by[1:]], "attempts", "status", "error", "content_type", "content_encoding", "body")
    asked = requests.withColumn("_asked", F.when(urls.is_allowed(F.col(url)), F.col(url)))
    same = F.col("_asked") == F.col("_url")
    joined = asked.join(held, same if key is None else same & (F.col(key) == F.col("_key")), "left")
    outcome = F.when(F.col("_asked").isNull(), "refused").when(F.col("_url").isNull(), "no response").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    read = files.decoded(inflated(F.when(F.col("error").isNull(), F.col("body")), F.col("content_encoding")), F.coalesce("content_type", F.lit("")))
    done = joined.withColumn("outcome", outcome).withColumn("_read", read)
    ok = F.col("outcome") == "ok"
    return done.select(*[F.col(c) for c in requests.columns], "attempts", "status", "error", "outcome", F.when(ok, F.col("_read.text")).otherwise("").alias("text"), F.when(ok, F.col("_read.charset")).alias("charset"))
