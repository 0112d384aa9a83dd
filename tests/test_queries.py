"""Every query beside its SQL text on the smallest tables."""

import pytest
from check import compare, connect
from samples import FOLDER

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    count, wrong = compare(QUERIES[name](spark, FOLDER), con, ORACLES.get(name))
    assert not wrong, "\n".join(wrong)
    assert count > 0


def test_entry(spark):
    assert {r["variant"] for r in entry.entry(spark).collect()} == {"A", "N", "R", "ALL"}


def test_merge_looks_frames_up_before_the_grid(spark):
    """No join of a manifest's merge has records of the whole grid on a side."""
    plan = QUERIES["manifest_merge"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if line.lstrip(" :+-").startswith("Join"):
            below = plan[at + 1 :]
            end = next((i for i, other in enumerate(below) if depth(other) <= depth(line)), len(below))
            assert not any("Generate" in other for other in below[:end]), line
