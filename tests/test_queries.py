"""Every registered query of the reference operators against its SQL, as the driver compares them."""

import duckdb
import pytest

from kelpline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in [*TABLES, "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    rows = lambda x: sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in x)
    assert rows(got) == rows(want)


def test_json_groups_of_large_sums(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    scale = "CASE event_type WHEN 'click' THEN 10000 WHEN 'view' THEN 100000000 ELSE 1 END"
    con.execute(f"COPY (SELECT * REPLACE (value * {scale} AS value) FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.queries()["met_json_groups"](spark, str(tmp_path)).select("base", "n", "members")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog.oracle_sql()["met_json_groups"]).fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
