"""Every registered query equals its DuckDB oracle on sf0.01 (rows, columns,
values; order-insensitive)."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE
from replicakit.plans import queries as base
from tools.oracle_check import digest, duck

NAMES = sorted(base.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


# Spark type -> DuckDB type of the same column.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


# Operators no registered query may plan: pair-producing joins, windows that
# put a whole group in one task, Python evaluation.
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "Window", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_ORACLE)
    text = plan_text(df)
    assert not [w for w in FORBIDDEN if w in text]
    got = digest([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql()[name]
    rel = con.sql(sql)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields} == types
    res = con.execute(sql)
    want = digest(res.fetchall(), [d[0] for d in res.description])
    assert got == want


def test_every_query_has_oracle():
    assert set(base.QUERIES) == set(base.ORACLE_SQL)
    assert set(base.QUERIES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["table_name", "n_a", "n_b", "verdict"]
    assert {r["verdict"] for r in rows} == {"match", "mismatch", "waiting"}
