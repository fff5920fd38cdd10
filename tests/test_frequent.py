"""Frequent values from a sketch and a recount, against counts of all values."""

import numpy as np
import pytest

from postloom.operators import frequent as FQ
from postloom.operators.profile import value_counts


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(5)


def both(df, k, tracked):
    exact = [tuple(r) for r in value_counts(df, "v", k).collect()]
    return [tuple(r) for r in FQ.frequent_values(df, "v", k, tracked).collect()], exact


def test_proven_with_many_more_values_than_tracked(spark):
    draw = np.random.default_rng(3)
    # a third of all rows is one value, 20 values stand out, 20,000 occur about once
    values = ["hot"] * 15_000 + [f"w{k % 20}" for k in range(12_000)]
    values += [f"rare{k}" for k in draw.integers(0, 40_000, 20_000)]
    df = frame(spark, values)
    found = FQ.proven_counts(df, "v", 21, tracked=1000)
    assert found is not None and found.count() <= 1000
    got, exact = both(df, 21, 1000)
    assert got == exact


def test_values_that_do_not_stand_out_are_all_counted(spark):
    df = frame(spark, [f"v{k % 5000}" for k in range(20_000)])
    assert FQ.proven_counts(df, "v", 10, tracked=100) is None
    got, exact = both(df, 10, 100)
    assert got == exact


@pytest.mark.parametrize("values", [[], [None, None], [None, "", "a", "a"], ["b", "a", "c"]])
def test_few_values(spark, values):
    got, exact = both(frame(spark, values), 5, 100)
    assert got == exact


def test_more_asked_for_than_tracked(spark):
    with pytest.raises(ValueError, match="more values"):
        FQ.frequent_values(frame(spark, ["a"]), "v", 11, tracked=10)
