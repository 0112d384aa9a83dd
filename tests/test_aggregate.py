"""Aggregates with a merge against pandas: hot keys, null keys, many tasks, states that grow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitlake.operators import aggregate as ag

SPREAD = ag.summed(
    ["v"], 3, lambda c: np.array([len(c[0]), np.nansum(c[0]), np.nansum(c[0] ** 2)]),
    lambda s: [int(s[0]), s[1], s[2]], "n bigint, total double, squares double",
)
#: A state of any length: the distinct whole numbers seen.
DISTINCT = ag.Aggregate(
    ("v",), lambda: np.zeros(0), lambda s, c: np.union1d(s, c[0][~np.isnan(c[0])]), np.union1d, lambda s: [len(s), s.tolist()],
    "kinds int, seen array<double>",
)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    key = [None if i % 50 == 7 else "hot" if i % 3 == 0 else f"k{rng.integers(20)}" for i in range(3000)]
    value = [None if i % 11 == 0 else float(rng.integers(0, 40)) for i in range(3000)]
    return pd.DataFrame({"k": key, "j": rng.integers(0, 2, 3000), "v": value})


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [tuple(None if pd.isna(x) else x for x in row) for row in table.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, j int, v double").repartition(7).withColumn("other", F.lit(1))


@pytest.mark.parametrize(("fan", "held"), [(64, 10_000), (2, 10_000), (3, 5)])
def test_sums(table, df, monkeypatch, fan, held):
    monkeypatch.setattr(ag, "FAN", fan)
    monkeypatch.setattr(ag, "HELD", held)
    found = {(r["k"], r["j"]): (r["n"], r["total"], r["squares"]) for r in ag.aggregated(df, ["k", "j"], SPREAD).collect()}
    groups = table.assign(v=table["v"].astype(float), k=table["k"].where(table["k"].notna(), None)).groupby(["k", "j"], dropna=False)["v"]
    want = {(None if pd.isna(k) else k, j): (len(v), v.sum(), (v**2).sum()) for (k, j), v in groups}
    assert found == want and None in {k for k, _ in found}


def test_states_that_grow_and_no_keys(table, df, monkeypatch):
    monkeypatch.setattr(ag, "FAN", 2)
    values = sorted(set(table["v"].dropna().astype(float)))
    (row,) = ag.aggregated(df, [], DISTINCT).collect()
    assert row["kinds"] == len(values) and row["seen"] == values
    assert ag.aggregated(df.limit(0), ["k"], DISTINCT).collect() == []
    assert ag.aggregated(df.limit(0), [], SPREAD).collect() == []


def test_only_states_are_shuffled(df):
    states = ag.partials(df, ["k"], SPREAD)
    assert states.count() <= 7 * 22
    assert set(states.columns) == {"k", "_part", "_state"}


BY_ROW = ag.summed(
    ["v"], 3, None, SPREAD.finish, SPREAD.made, lambda c: np.column_stack([np.ones(len(c[0])), np.nan_to_num(c[0]), np.nan_to_num(c[0]) ** 2])
)


@pytest.mark.parametrize(("fan", "rows"), [(64, 1 << 18), (2, 5)])
def test_sums_row_by_row(df, monkeypatch, fan, rows):
    """Summands of many keys at a time give what the function of one key's rows gives."""
    want = sorted(map(str, ag.aggregated(df, ["k", "j"], SPREAD).collect()))
    monkeypatch.setattr(ag, "FAN", fan)
    monkeypatch.setattr(ag, "ROWS", rows)
    assert sorted(map(str, ag.aggregated(df, ["k", "j"], BY_ROW).collect())) == want
    assert ag.aggregated(df.limit(0), [], BY_ROW).collect() == []


@pytest.mark.parametrize("aggregate", [SPREAD, BY_ROW])
def test_no_call_of_pandas_per_key(df, aggregate, monkeypatch):
    """A table of many keys has no group function that Spark calls key by key, in no round."""
    monkeypatch.setattr(ag, "FAN", 2)
    plan = ag.aggregated(df, ["k", "j"], aggregate)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_minus_zero_and_not_a_number_are_one_key_each(spark):
    rows = [(0.0, 1.0), (-0.0, 2.0), (float("nan"), 4.0), (None, 8.0), (float("nan"), 16.0)]
    df = spark.createDataFrame(rows, "k double, v double").repartition(3)
    for aggregate in (SPREAD, BY_ROW):
        assert sorted(r["total"] for r in ag.aggregated(df, ["k"], aggregate).collect()) == [3.0, 8.0, 20.0]
