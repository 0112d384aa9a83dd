"""Orders by a keyed permutation: one to one, undone, unlike each other, and without a sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitlake.operators import sampling
from nitlake.operators.permute import permuted, sides


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 101, 1000, 4099])
def test_one_to_one_and_undone(spark, n):
    a, b = sides(n)
    assert a * b - n < a
    there = permuted(spark.range(n), "id", n, 5, "to")
    rows = permuted(there, "to", n, 5, "back", inverse=True).collect()
    assert sorted(r["to"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_many_seeds_of_few_numbers(spark):
    """With few numbers walks leave often, and circles outside occur."""
    for n in (3, 5, 7, 11, 13):
        for seed in range(4):
            assert sorted(r[1] for r in permuted(spark.range(n), "id", n, seed, "to").collect()) == list(range(n))


def test_looks_drawn(spark):
    n = 4099
    one, two = (
        np.array([r["to"] for r in permuted(spark.range(n), "id", n, s, "to").orderBy("id").collect()]) for s in (1, 2)
    )
    for order in (one, two):
        assert abs(np.corrcoef(order, np.arange(n))[0, 1]) < 0.06
        assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.06
        assert (order == np.arange(n)).sum() < 10
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.06


def test_numbers_outside(spark):
    assert permuted(spark.range(0), "id", 0, 1, "to").count() == 0
    for wrong in (spark.range(6), spark.range(5).withColumn("id", F.lit(None).cast("bigint")), spark.range(-1, 3)):
        with pytest.raises(Exception, match="not a number from 0 to 4"):
            permuted(wrong, "id", 5, 1, "to").collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_epochs_from_numbers(spark, tmp_path):
    """The same batches with and without stored numbers; with them nothing is sorted or shuffled."""
    records = spark.range(103).selectExpr("concat('k', id) AS k", "id AS v")
    sampling.ordinals(records, ["k"]).write.parquet(str(tmp_path / "numbered"))
    numbered = spark.read.parquet(str(tmp_path / "numbered"))
    assert sorted(r["ordinal"] for r in numbered.collect()) == list(range(103))
    place = lambda df: {r["k"]: (r["batch_id"], r["place"]) for r in df.collect()}
    stored = sampling.epoch_batches(numbered, ["k"], 1, 0, 10, "ordinal")
    plan = plan_of(stored)
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    whole = place(stored)
    assert whole == place(sampling.epoch_batches(records, ["k"], 1, 0, 10))
    assert sorted(whole.values()) == [(b, p) for b in range(10) for p in range(10)]
    other = place(sampling.epoch_batches(numbered, ["k"], 1, 1, 10, "ordinal"))
    assert sum(whole.get(k) == at for k, at in other.items()) < 15
    for first, last in ((2, 4), (9, 20), (5, 5), (-3, 1), (10, 12)):
        some = sampling.epoch_batches(numbered, ["k"], 1, 0, 10, "ordinal", (first, last))
        assert place(some) == {k: at for k, at in whole.items() if first <= at[0] < last}
    assert "ordinal" in stored.columns and "_ordinal" not in stored.columns
    with pytest.raises(ValueError, match="at least one record"):
        sampling.epoch_batches(numbered, ["k"], 1, 0, 0, "ordinal")


def test_empty_corpus(spark):
    none = spark.range(0).withColumnRenamed("id", "k")
    assert sampling.epoch_batches(none, ["k"], 1, 0, 4).count() == 0
    assert sampling.epoch_batches(none, ["k"], 1, 0, 4, batches=(0, 2)).count() == 0
