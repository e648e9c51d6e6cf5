"""Ranks by histogram and by range against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from fleetfootprint.operators.selection import nth_values, ranked


def rows(seed, n):
    rng = random.Random(seed)
    # a third of all rows in one group, ties, steep and negative values, unknown ones and a group without a name
    value = [lambda: float(rng.randint(0, 3)), lambda: rng.lognormvariate(0, 20), lambda: -rng.random(), lambda: None, lambda: float("nan"), lambda: 1e308 * rng.choice((-1, 1))]
    return [(rng.choice(["a", "b", "c", None]) if rng.random() < 0.67 else "hot", rng.choice(value)(), i) for i in range(n)]


@pytest.fixture(scope="module")
def data():
    return rows(1, 3000)


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "grp string, metric double, id long").repartition(7)


def known(data, group):
    return sorted((m for g, m, _ in data if g == group and m is not None and m == m), reverse=True)


@pytest.mark.parametrize("n", [1, 7, 120, 500, 5000])
@pytest.mark.parametrize("buckets, sorted_rows", [(4, 5), (64, 0), (4096, 100_000)])
def test_nth_value(frame, data, n, buckets, sorted_rows):
    got = {r["grp"]: r["metric"] for r in nth_values(frame, ["grp"], "metric", n, buckets, sorted_rows).collect()}
    want = {g: known(data, g)[n - 1] for g in ("a", "b", "c", "hot", None) if len(known(data, g)) >= n}
    assert got == want


def test_nth_value_of_whole_numbers_and_ties(spark):
    ties = spark.range(20_000).select(F.lit("x").alias("grp"), F.when(F.col("id") < 15_000, 5).otherwise(F.col("id")).cast("long").alias("metric"))
    found = nth_values(ties, ["grp"], "metric", 6000, buckets=8, sorted_rows=10)
    assert dict(found.dtypes)["metric"] == "bigint" and [tuple(r) for r in found.collect()] == [("x", 5)]
    assert nth_values(ties.filter("metric < 0"), ["grp"], "metric", 1).count() == 0


def test_a_far_rank_sorts_a_bucket_only(spark):
    """Rank 10^6 of two million rows: what reaches the sort is one bucket, and no task holds the group."""
    many = spark.range(2_000_000).select(F.lit("x").alias("grp"), ((F.col("id") * 7919) % 2_000_003).cast("double").alias("metric"))
    found = nth_values(many, ["grp"], "metric", 1_000_000, sorted_rows=1000)
    want = sorted(((i * 7919) % 2_000_003 for i in range(2_000_000)), reverse=True)[999_999]
    assert found.collect()[0]["metric"] == want
    plan = found._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan or "row_number" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_of_every_row(frame, data):
    order = [F.col("metric").desc_nulls_last(), F.col("id")]
    got = {r["id"]: (r["grp"], r["rank"]) for r in ranked(frame, ["grp"], order).collect()}
    assert len(got) == len(data)
    key = lambda r: (r[1] is None, 0 if r[1] is None else -float("inf") if r[1] != r[1] else -r[1], r[2])  # noqa: E731 - NaN is the largest
    for group in ("a", "b", "c", "hot", None):
        mine = sorted((r for r in data if r[0] == group), key=lambda r: (r[1] is None, r[1] is not None and r[1] == r[1], *key(r)[1:]))
        assert [got[r[2]] for r in mine] == [(group, i + 1) for i in range(len(mine))]
    assert ranked(frame.limit(0), ["grp"], order).count() == 0
    assert "rank" in ranked(frame, ["grp"], order).columns
