"""The library's operators over small inline tables, against expected rows stated as SQL.

These run constructs that the given tables do not hold: what they show is the operators'
rules, not their work at scale, so they are tests and no registered queries."""

import duckdb
import pytest
from inline import engine, fixtures
from pyspark import cloudpickle

QUERIES, ORACLES = {**fixtures.QUERIES, **engine.QUERIES}, {**fixtures.ORACLES, **engine.ORACLES}
cloudpickle.register_pickle_by_value(engine)  # workers do not see this folder


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [sorted(columns), *sorted(repr(tuple(r[i] for i in order)) for r in rows)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_expected_rows(spark, name):
    found = QUERIES[name](spark, None)
    want = duckdb.connect().execute(ORACLES[name])
    assert lines(found.columns, [tuple(r) for r in found.collect()]) == lines([c[0] for c in want.description], want.fetchall())


def test_all_have_expectations():
    assert QUERIES.keys() == ORACLES.keys()
