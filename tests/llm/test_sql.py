"""Registered queries against their SQL, and what the rest of the contract asks of them."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from cairnstore.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[key](spark, SF)
    relation = con.sql(queries.ORACLE_SQL[key])
    order = sorted(got.columns)
    assert order == sorted(relation.columns)
    want = sorted(tuple(map(plain, r)) for r in relation.project(", ".join(f'"{c}"' for c in order)).fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*order).collect()) == want


def test_all_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
