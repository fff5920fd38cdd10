"""Stored sketches of days against exact figures of the same days."""

from datetime import date

import numpy as np
import pytest

from postloom.operators import sketch_days as SD

COLUMNS = ["name", "n", "x"]
SCHEMA = "day date, name string, n int, x double"
DAYS = [date(2024, 1, d) for d in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def given():
    draw = np.random.default_rng(4)
    rows = []
    for k in range(12_000):
        # the first day holds two thirds of all rows
        day = DAYS[0] if k % 3 else DAYS[1 + k % 2]
        x = float(draw.normal()) if k % 11 else [None, float("nan"), -0.0, 0.0][k // 11 % 4]
        rows.append((day, f"u{k % 700}" if k % 5 else None, k % 40, x))
    return [*rows, (None, "lost", 99, 1.0)]


def check(rows, found):
    assert set(found) == set(COLUMNS)
    for place, name in enumerate(COLUMNS, 1):
        present = [r[place] for r in rows if r[place] is not None]
        exact = len({str(v + 0.0) if isinstance(v, float) else v for v in present})
        got = found[name]
        assert (got["rows"], got["present"]) == (len(rows), len(present))
        assert abs(got["distinct_values"] - exact) <= 0.04 * exact
        if name == "name":
            assert got["quantiles"] is None
            continue
        numbers = np.array([v for v in present if v == v])
        for rank, value in zip((0.25, 0.5, 0.75), got["quantiles"], strict=True):
            assert np.mean(numbers <= value) >= rank - 0.02
            assert np.mean(numbers < value) <= rank + 0.02


def profile(spark, path, *ends):
    return {r["column"]: r for r in SD.profile_of_days(spark, path, *ends).collect()}


def test_ranges_reruns_and_emptied_days(spark, given, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.createDataFrame(given, SCHEMA)
    SD.update_sketches(df.where("n < 5"), path, DAYS[:2], COLUMNS)
    SD.update_sketches(df, path, DAYS, COLUMNS)
    check([r for r in given if r[0]], profile(spark, path))
    check([r for r in given if r[0] in DAYS[1:3]], profile(spark, path, DAYS[1], DAYS[2]))
    assert profile(spark, path, DAYS[3]) == {}
    # one row per day and column, of a size that the data don't decide
    stored = spark.read.parquet(path).where("column is not null")
    assert stored.count() == 3 * len(COLUMNS)
    assert max(len(r["values"]) for r in stored.collect()) < 2**SD.LG_K + 100
    # a rerun without rows takes the day back
    SD.update_sketches(df.where("false"), path, DAYS[:1], COLUMNS)
    check([r for r in given if r[0] in DAYS[1:]], profile(spark, path))


def test_empty_and_null_columns(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = [(DAYS[0], None, None, float("nan")), (DAYS[1], None, None, None)]
    SD.update_sketches(spark.createDataFrame(rows, SCHEMA), path, DAYS[:2], COLUMNS)
    found = profile(spark, path)
    assert {k: (r["rows"], r["present"], r["distinct_values"]) for k, r in found.items()} == {
        "name": (2, 0, 0), "n": (2, 0, 0), "x": (2, 1, 1)
    }
    assert all(r["quantiles"] is None for r in found.values())
