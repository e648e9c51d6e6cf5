"""Editions as bits against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from fleetfootprint.operators.lifecycle import presence_history
from fleetfootprint.operators.presence import LAST, edition_list, has_edition, list_turnover, n_editions, presence_bits


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 2, 2, 3, None]), rng.choice([None, 1970.0, 2001.0, 2001.5, 2002.0, 2032.5, 2095.5, 1970 + rng.randint(0, LAST) / 2])) for _ in range(400)]
    return rows + [(9, None)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "system long, edition double").repartition(5)


def test_lists_and_counts(frame, data):
    bits = presence_bits(frame, "system", "edition").withColumn("editions", edition_list(F.col("bits"), F.col("first_edition"), F.col("final_edition")))
    got = {r["system"]: (r["editions"], r["n_appearances"], r["n"]) for r in bits.withColumn("n", n_editions(F.col("bits"))).collect()}
    for system in {s for s, _ in data}:
        mine = [e for s, e in data if s == system]
        known = sorted({e for e in mine if e is not None})
        assert got[system] == (known, len(mine), len(known))
    assert len(got) == len({s for s, _ in data})


def test_same_as_the_history_with_counts(frame):
    plain = {r["system"]: (r["editions"], r["n_appearances"], r["final_edition"]) for r in presence_history(frame.filter("edition is not null"), "system", "edition").collect()}
    bits = presence_bits(frame.filter("edition is not null"), "system", "edition")
    listed = edition_list(F.col("bits"), F.col("first_edition"), F.col("final_edition")).alias("editions")
    assert {r[0]: (r[1], r[2], r[3]) for r in bits.select("system", listed, "n_appearances", "final_edition").collect()} == plain


def test_turnover(frame, data):
    sets = {s: {e for k, e in data if k == s and e is not None} for s, _ in data}
    got = {r["edition"]: (r["listed"], r["entered"], r["left"]) for r in list_turnover(presence_bits(frame, "system", "edition"), 1970.0, 2010.0).collect()}
    assert len(got) == 80
    for edition, counts in got.items():
        now, was = {s for s in sets if edition in sets[s]}, {s for s in sets if edition - 0.5 in sets[s]}
        assert counts == (len(now), len(now - was), len(was - now))
    assert list_turnover(presence_bits(frame, "system", "edition"), 2000.0, 2000.0).count() == 0


def test_what_is_no_half_year_is_an_error(spark):
    for edition in (2000.25, 1969.5, 2096.0):
        with pytest.raises(Exception, match="half-year"):
            presence_bits(spark.createDataFrame([(1, edition)], "system long, edition double"), "system", "edition").collect()


def test_one_shuffle(frame):
    plan = presence_bits(frame, "system", "edition")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Collect" not in plan and "collect" not in plan
    assert frame.select(has_edition(F.array(*[F.lit(5).cast("long")] * 4), F.lit(2)).alias("x")).first()["x"]
