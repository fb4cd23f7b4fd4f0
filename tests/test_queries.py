"""Every registered query of the store against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cairnstore.plans import catalog, stored
from cairnstore.store import Volume

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, duck, key):
    got = catalog.QUERIES[key](spark, sf_dir)
    relation = duck.sql(catalog.ORACLE_SQL[key])
    assert sorted(got.columns) == sorted(relation.columns)
    order = sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in relation.project(", ".join(f'"{c}"' for c in order)).fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in order]).collect()) == want


def test_entry_is_the_dedup_report(spark):
    out = entry.entry(spark)
    assert out.columns == ["name", "total_chunks", "new_chunks", "deduped", "new_bytes", "size"] and out.count() == 200


def test_the_rest_works_without_the_optional_modules(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("cairnstore.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Removed:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("cairnstore.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name.split(".queries")[0])

    monkeypatch.setattr(sys, "meta_path", [Removed(), *sys.meta_path])
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)


def same_as_sql(spark, sf_dir, duck, key):
    got = catalog.QUERIES[key](spark, sf_dir)
    relation = duck.sql(catalog.ORACLE_SQL[key])
    order = sorted(relation.columns)
    want = sorted(tuple(map(plain, r)) for r in relation.project(", ".join(f'"{c}"' for c in order)).fetchall())
    return sorted(got.columns) == order and sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in order]).collect()) == want


@pytest.fixture
def tight(monkeypatch):
    """Smaller volumes for the stores of the queries, made anew; other tests keep theirs."""

    def with_budgets(*kib):
        monkeypatch.setattr(stored, "VOLUMES", tuple(Volume(f"v{k}", threshold=n << 10) for k, n in enumerate(kib)))
        monkeypatch.setattr(stored, "_made", made)

    return with_budgets


#: The store of the tests below, made by the first of them.
made = {}


@pytest.mark.parametrize("key", ["store_put_stats", "store_segment_listing", "store_tail", "store_seg_index"])
def test_a_plain_store_may_list_more_than_its_budgets(spark, sf_dir, duck, tight, key):
    """The third put and the pages have more bytes than the room there is, and less as they are stored."""
    tight(192, 192, 512)
    assert same_as_sql(spark, sf_dir, duck, key)
    s = stored.store(spark, sf_dir, False)[0].state()
    assert sum(s.used().values()) > 2 * 192 << 10 and max(s.held().values()) <= 192 << 10


def test_an_ingest_is_bounded_by_what_is_stored(spark, sf_dir, duck, tight):
    tight(64, 64, 512)
    assert same_as_sql(spark, sf_dir, duck, "store_ingest")
