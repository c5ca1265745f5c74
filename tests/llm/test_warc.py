import gzip
import hashlib
import io
import os
import random
import zlib

import duckdb
import pytest
from leafmill.llm import warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id long, url string, html string, file string, nth long, payload_bytes long, payload string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    raw = [(i, (html or "").encode()) for i, _, html in rows]
    best = {}
    for i, b in raw:
        best[b] = max(best.get(b, -1), -1 if i is None else i)
    seen, out = set(), []
    for i, b in raw:
        first = (-1 if i is None else i) == best[b] and b not in seen
        seen |= {b} if first else set()
        revisit = len(b) >= 1000 and not first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", (best[b] if best[b] >= 0 else None) if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def read(spark, path, **options):
    got = warc.read_records(spark, path, **options)
    return got.withColumns({c: got[c].cast("long") for c in ("page_id", "refers_to")})


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = rows_of(warc.op11_warc(spark, sf))
    assert got == brute(rows)
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(duckdb.sql(f"select {', '.join(COLUMNS)} from ({warc.ORACLE['op11_warc']})").fetchall(), key=str)


LONG = "é" * 700
ROWS = [(1, "http://a/1", LONG), (2, None, LONG), (9, "http://a/9\r\nX: y", LONG), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "x" * 1000), (3, "u", "x" * 1000)]
ROWS += [(10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60), (11, "u", "\r\n\r\n" * 300), (12, "ü", "\r\n\r\n" * 300), (None, "u", LONG), (9, "u", LONG), (None, "u", "null" * 300), (None, "u", "null" * 300), (13, "u", "z" * 3_000_000 + "\0\x1f")]


@pytest.mark.parametrize("file_bytes", [1, 4000, 1 << 28])
def test_odd_pages_come_back(spark, tmp_path, file_bytes):
    path = str(tmp_path / "out")
    warc.archive(table(spark, ROWS).repartition(3), path, file_bytes=file_bytes)
    assert rows_of(read(spark, path, payload=False, read_bytes=500)) == brute(ROWS)
    whole = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]).decode() for r in read(spark, path).where("record_type = 'response'").collect()}
    assert set(whole.values()) == {html or "" for _, _, html in ROWS}
    assert {r["url"] for r in read(spark, path).where("page_id = 9").collect()} == {"http://a/9%0D%0AX: y", "u"}


def test_members_offsets_and_names(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.archive(table(spark, ROWS).coalesce(1), path)
    files = sorted(os.listdir(path))
    assert [f for f in files if not f.startswith(".")] == ["part-000000-000.warc.gz", "part-000000-000.warc.gz.idx"]
    raw = open(f"{path}/{files[-2]}", "rb").read()
    index = sorted(warc.read_index(spark, path).collect(), key=lambda r: r["offset"])
    assert [r["offset"] for r in index] == [0, *(r["offset"] + r["length"] for r in index[:-1])] and index[-1]["offset"] + index[-1]["length"] == len(raw)
    ids = {}
    for r in index:
        one = gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and zlib.decompressobj(31).decompress(raw[r["offset"] :]) == one
        fields = warc.head_of(warc.Inflated(io.BytesIO(raw[r["offset"] :]), "x"))
        ids[fields["warc-record-id"]] = fields
    for f in (f for f in ids.values() if f["warc-type"] == "revisit"):
        to = ids[f["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["warc-payload-digest"] == f["warc-payload-digest"]


def test_part_of_the_index_reads_these_records_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.archive(table(spark, ROWS).coalesce(2), path)
    some = warc.read_index(spark, path).where("uri = 'ü'")
    assert [r["page_id"] for r in warc.read_records(spark, path, some).collect()] == ["12"]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.archive(table(spark, ROWS).limit(0), path)
    assert warc.read_records(spark, path).count() == 0


def foreign(members):
    """A foreign file: folded field, hex digest, other record types, several members with padding."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nX-Long: a\r\n b\r\n\r\nhello\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    page = b"WARC/1.0\r\nwarc-type: response\r\nContent-Length: %d\r\nWARC-Payload-Digest: sha1:%s\r\n\r\n%s\r\n\r\n" % (len(http), hashlib.sha1(b"abc").hexdigest().encode(), http)
    return b"".join(gzip.compress(x) for x in ([info, page, page] if members else [info + page + page])) + b"\0" * 9


@pytest.mark.parametrize("members", [False, True])
def test_files_of_others(spark, tmp_path, members):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(foreign(members))
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r["type"] for r in warc.read_index(spark, str(tmp_path / "out")).orderBy("offset").collect()] == ["warcinfo", "response", "response"]
    got = warc.read_records(spark, str(tmp_path / "out"), warc.read_index(spark, str(tmp_path / "out")).where("type = 'response'")).collect()
    assert [bytes(r["payload"]) for r in got] == [b"abc"] * 2


def test_a_block_without_an_http_head_ends_where_its_length_says():
    bare = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nno head\r\n\r\n" for _ in range(2))
    out = type("Out", (), {"at": 0, "name": "y", "write": lambda self, b: None})()
    got = list(warc.normalise_file(io.BytesIO(gzip.compress(bare)), "x", out, iter([(0, "5", "f", 3)])))
    assert [x["type"] for x in got] == ["revisit", "response"]


def test_damaged_streams_raise():
    rng = random.Random(1)
    whole = foreign(False).rstrip(b"\0")
    for cut in [3, 20, *rng.sample(range(20, len(whole)), 10)]:
        with pytest.raises(ValueError, match="x.warc.gz"):
            out = type("Out", (), {"at": 0, "name": "y", "write": lambda self, b: None})()
            list(warc.normalise_file(io.BytesIO(whole[:cut]), "x.warc.gz", out, iter(())))
