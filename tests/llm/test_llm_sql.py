"""The secret scan's rows equal those of its SQL."""

from __future__ import annotations

import duckdb

from sparkstrata.llm import queries

SF = "/root/testdata/sf0.001"


def test_op8_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cur = con.execute(queries.oracle_sql()["op8_secrets"])
    names = [d[0] for d in cur.description]
    df = queries.queries()["op8_secrets"](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


def test_every_operator_has_one_query():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
