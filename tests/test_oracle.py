"""Every query with SQL gives the SQL's result in DuckDB."""

import math

import duckdb
import pytest

from plumbline.plans import registry

registry.load()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    sql_types = {x[0]: str(x[1]) for x in cur.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == sql_types
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(
        cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
