"""Every query over a table of cases gives the rows that are written beside the cases, types included."""

import duckdb
import pytest

from auditlake.plans import registry

NAMES = sorted(n for n in registry.QUERIES if n.endswith("_cases"))
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", NAMES)
def test_cases(spark, name):
    got = registry.QUERIES[name](spark, "")
    want = duckdb.sql(registry.ORACLE_SQL[name])
    assert dict(zip(want.columns, map(str, want.types))) == {f.name: _TYPES[f.dataType.simpleString()] for f in got.schema}
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((str([r[c] for c in order]) for r in got.collect())) == sorted(str([r[k] for k in at]) for r in want.fetchall())
