"""Registered queries against their SQL, and the wiring."""

import pytest

from penprint.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF001
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    ok, said = compare(spark, SF001, name, QUERIES[name], ORACLE_SQL[name], duck(SF001))
    assert ok, said


def test_all_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_decontaminate"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("InArrow", "InPandas", "EvalPython", "PythonUDF"))
