"""Every registered query of the library against DuckDB on the same tables."""

import duckdb
import pytest
from leafmill.operators import books
from leafmill.plans import catalogue
from leafmill.sources import feeds, files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in catalogue.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert norm(got) == norm([tuple(x[i] for i in at) for x in r.fetchall()])


def test_documents_do_not_grow_with_a_key(spark, tmp_path, monkeypatch):
    """One user, one brand and one nation hold all rows."""
    n, docs = 5000, []
    ids = spark.range(n)
    ids.selectExpr("id AS event_id", "7L AS user_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    ids.selectExpr("id AS p_partkey", "'b' AS p_brand", "concat('n', id) AS p_name", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    ids.selectExpr("id AS s_suppkey", "1 AS s_nationkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    for module, name, at in ((feeds, "rss_items", "body"), (files, "collection", "doc"), (books, "list_page", "doc")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, f=f, at=at: docs.append(df.select(at)) or f(df, *a))
    got = {k: catalogue.queries()[k](spark, str(tmp_path)) for k in ("rss_reader", "collection_import", "json_list_rules", "json_list_default")}
    assert [tuple(r)[:2] for r in got["rss_reader"].collect()] == [(7, n)]
    for k in ("collection_import", "json_list_rules", "json_list_default"):
        assert got[k].select("name").distinct().count() == got[k].count() == n
    assert len(docs) == 3
    for d in docs:
        assert 1 < d.count() and max(len(r[0]) for r in d.collect()) < n * 40
