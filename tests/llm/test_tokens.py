import random
import zlib

import numpy as np
import pytest
from leafmill.llm import common, token_output

from .cases import ODD, documents


def test_offsets_by_select():
    random.seed(3)
    for sizes in ([1], [0, 0, 5, 0], [random.choice([0, 1, 3, 70, 9000]) for _ in range(700)], [50_000, *[1] * 300], [0] * 10):
        docs = [np.arange(n, dtype="<u2") for n in sizes]
        block = token_output.Block(token_output.pack(docs, 2))
        ends = np.cumsum(sizes)
        for i in random.sample(range(len(sizes)), min(len(sizes), 90)):
            assert block.end(i) == ends[i] and block.offset(i) == ends[i] - sizes[i]
            assert block.ids(i).tolist() == docs[i].tolist()


@pytest.mark.parametrize("block", [token_output.BLOCK_TOKENS, 50])
def test_tokens_round_trip(spark, sf, block):
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60] + [(1000 + (i or 0), t) for i, t in ODD] + [(None, "z"), (3000, "a  b"), (3001, "  lead"), (3002, "x's 12 ,, \r\n y")]
    path = common.new_path(spark, "t")
    token_output.write_tokens(documents(spark, rows), path, block_tokens=block)
    got = sorted(((r["id"] is not None, r["id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.documents_of(spark, path).collect())
    tok, at, want = Tokenizer.from_file(token_output.default_tokenizer()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append(((i is not None, i or 0), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_tokens_of_nothing(spark):
    path = common.new_path(spark, "t")
    token_output.write_tokens(documents(spark, []), path)
    assert token_output.documents_of(spark, path).count() == 0


def test_encoder_equals_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    random.seed(8)
    path = token_output.default_tokenizer()
    tok = Tokenizer.from_file(path)
    bits = ["a", "b", "don't", "x's", "12", "é", "ß", " ", "　", "\n", "\n\n", "\t", "\r", "  ", " ", " ", " ", " ", ",", "...", "<|endoftext|>", "\x1c", "\x85", "Ġ", "日本", "_", "😀"]
    texts = ["", " ", "Ġ", "a Ġ b", *("".join(random.choices(bits, k=random.randint(1, 30))) for _ in range(3000))]
    for room in (1, token_output.CACHE_BYTES):
        monkeypatch.setattr(token_output, "CACHE_BYTES", room)
        enc = token_output.Encoder(path)
        for at in range(0, len(texts), 700):
            for t, got in zip(texts[at : at + 700], enc.encode(texts[at : at + 700]), strict=True):
                assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_rows_of_one_id_are_dealt_to_several_tasks(spark):
    rows = [(7, f"text {k:04d}") for k in range(2000)]
    path = common.new_path(spark, "t")
    token_output.write_tokens(documents(spark, rows), path)
    parts = spark.read.parquet(path).groupBy("part").agg({"n_tokens": "sum"}).collect()
    assert len(parts) == 4 and token_output.documents_of(spark, path).count() == 2000
