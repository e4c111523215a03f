"""Every query with SQL equals DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cadenza.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return bytes(v) if isinstance(v, bytearray) else v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = table_of(df.columns, df.collect())
    cur = duck.execute(registry.ORACLE[name])
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_gives_rows_without_bad_numbers(spark, sf_dir, name):
    """Values are held against plain versions in ``test_plain`` and ``test_operators``."""
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert not any(isinstance(v, float) and math.isinf(v) for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_no_cartesian_products(spark, sf_dir, capsys):
    for name in sorted(n for n in registry.ORACLE if n[0] in "ajrw" or n in ("k2_search_with_audio", "k3_timestamps_for_text", "c1_interference_visibility", "c9_similar_segments")):
        registry.QUERIES[name](spark, sf_dir).explain()
        assert "Cartesian" not in capsys.readouterr().out
