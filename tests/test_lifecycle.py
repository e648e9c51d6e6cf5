"""Presence, exit reasons, first values and fills, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from fleetfootprint.operators import fill, lifecycle, skew
from fleetfootprint.operators.fill import first_non_null, group_fill


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", 2015.0, 10.0), ("a", 2015.5, 10.0), ("a", 2017.0, 10.0), ("a", 2015.0, 9.0),
        ("b", 2016.0, 50.0),
        ("c", 2018.0, 99.0),
    ]
    return spark.createDataFrame(data, "id string, edition double, metric double")


def test_presence_history_with_gap_and_repeat(rows):
    got = {r["id"]: r for r in lifecycle.presence_history(rows, "id", "edition").collect()}
    assert got["a"]["editions"] == [2015.0, 2015.5, 2017.0]
    assert [tuple(x) for x in got["a"]["appearances"]] == [(2015.0, 2), (2015.5, 1), (2017.0, 1)]
    assert got["a"]["n_appearances"] == 4 and got["a"]["final_edition"] == 2017.0


@pytest.mark.parametrize("min_rows", [skew.MIN_HOT_ROWS, 1])
def test_rows_get_their_history(rows, min_rows):
    hot = skew.hot_keys(rows, "id", min_rows)
    got = lifecycle.with_presence(rows.repartition(3), "id", "edition", hot).collect()
    assert len(got) == 6
    assert {(r["id"], r["final_edition"], len(r["editions"])) for r in got} == {("a", 2017.0, 3), ("b", 2016.0, 1), ("c", 2018.0, 1)}


def test_hot_keys_are_those_above_the_limit(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert skew.hot_keys(df, "k", min_rows=99).count() == 10
    assert skew.hot_keys(df, "k", min_rows=100).count() == 0
    assert skew.hot_keys(df, "k").isEmpty()


def test_exit_reason(spark, rows):
    listed = spark.createDataFrame(
        [(2017.5, 1, 100.0), (2017.5, 2, 20.0), (2016.5, 2, 30.0)], "edition double, rank int, metric double"
    )
    limits = lifecycle.rank_thresholds(listed, "rank", 2, "edition", "metric")
    present = lifecycle.with_presence(rows, "id", "edition")
    got = {(r["id"], r["exit_reason"]) for r in lifecycle.with_exit_reason(present, limits, "metric", 2018.0).collect()}
    # c is still listed; b beats the next threshold; a does not
    assert got == {("a", "Dropped"), ("b", "Removed")}
    kept = lifecycle.with_exit_reason(present, limits, "metric", 2018.0, keep_active=True).collect()
    assert {r["exit_reason"] for r in kept if r["id"] == "c"} == {"Active"}


def test_no_threshold_means_removed(spark, rows):
    none = spark.createDataFrame([], "final_edition double, threshold double")
    present = lifecycle.with_presence(rows, "id", "edition")
    assert {r["exit_reason"] for r in lifecycle.with_exit_reason(present, none, "metric", 2024.5).collect()} == {"Removed"}


def test_top_per_edition(rows):
    got = lifecycle.top_per_edition(rows, ["edition"], [F.col("metric").desc()], 1).collect()
    assert len(got) == 5 and all(r["rank"] == 1 for r in got)


def gappy(n=400, keys=5, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        out.append((i, key, rng.choice([None, None, None, float(i)]), rng.choice([None, None, f"t{i}"])))
    return out


def expected_fill(data):
    result = {}
    for key in {d[1] for d in data}:
        mine = sorted(d for d in data if d[1] == key)
        for c in (2, 3):
            known = [d[c] for d in mine]
            last = None
            out = []
            for v in known:
                last = v if v is not None else last
                out.append(last)
            first = next((v for v in known if v is not None), None)
            for d, v in zip(mine, out):
                result.setdefault(d[0], []).append(first if v is None else v)
    return {k: tuple(v) for k, v in result.items()}


@pytest.mark.parametrize("min_rows", [skew.MIN_HOT_ROWS, 50])
@pytest.mark.parametrize("parts", [1, 7])
def test_group_fill(spark, min_rows, parts):
    data = gappy()
    df = spark.createDataFrame(data, "seq long, id int, x double, y string").repartition(parts, "seq")
    hot = skew.hot_keys(df, "id", min_rows)
    got = {r["seq"]: (r["x"], r["y"]) for r in group_fill(df, "id", "seq", ["x", "y"], hot).collect()}
    assert hot.isEmpty() == (min_rows == skew.MIN_HOT_ROWS)
    assert got == expected_fill(data)


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_scan_fill_by_brute_force(spark, pieces):
    """Keys that end with a piece, span several, and columns that are known only far away."""
    rng = random.Random(pieces)
    data = gappy(600, 7, seed=pieces)
    # a key of 300 rows whose only values are its 1st (x) and its last (y): every piece but one takes them from afar
    data += [(1000 + i, 50, 1.5 if i == 0 else None, "end" if i == 299 else None) for i in range(300)]
    data += [(2000 + i, None, None, rng.choice([None, "n"])) for i in range(60)]
    df = spark.createDataFrame(data, "seq long, id int, x double, y string").repartition(5, "y")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fill.scan_fill(df, "id", "seq", ["x", "y"])
        assert got.columns == df.columns
        assert {r["seq"]: (r["x"], r["y"]) for r in got.collect()} == expected_fill(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_scan_fill_of_empty_tables_and_ties(spark):
    schema = "seq long, id string, x double, tags map<string, int>"
    assert fill.scan_fill(spark.createDataFrame([], schema), "id", "seq", ["x"]).isEmpty()
    rows = [(None, "a", None, {"k": i}) for i in range(50)] + [(1, "a", 3.0, None)] * 2 + [(2, "a", None, None), (1, "b", None, None)]
    got = fill.scan_fill(spark.createDataFrame(rows, schema).repartition(3), "id", "seq", ["x"]).collect()
    assert len(got) == 54 and {(r["id"], r["x"]) for r in got} == {("a", 3.0), ("b", None)}


def test_fill_of_all_null_and_lonely_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (1, "b", 5.0)], "seq int, id string, x double")
    got = {(r["id"], r["seq"]): r["x"] for r in group_fill(df, "id", "seq", ["x"]).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 1): 5.0}


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_first_non_null_ignores_physical_order(spark, parts):
    data = gappy()
    random.Random(parts).shuffle(data)
    df = spark.createDataFrame(data, "seq long, id int, x double, y string").repartition(parts)
    got = {r["id"]: (r["x"], r["y"]) for r in first_non_null(df, "id", "seq", ["x", "y"]).collect()}
    want = {}
    for key in {d[1] for d in data}:
        mine = sorted(d for d in data if d[1] == key)
        want[key] = tuple(next((d[c] for d in mine if d[c] is not None), None) for c in (2, 3))
    assert got == want


def test_first_value_keeps_null_of_first_row(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "seq int, x double")
    row = df.agg(fill.first_value(F.col("x"), F.col("seq")), fill.first_known(F.col("x"), F.col("seq"))).first()
    assert list(row) == [None, 4.0]


def test_thresholds_of_any_edition(spark):
    listed = spark.createDataFrame(
        [(2015.0, 1, 9.0), (2015.25, 1, 99.0), (10001.0, 1, 5.0), (-1.0, 1, 6.0)], "edition double, rank long, metric double"
    )
    got = {r["final_edition"]: r["threshold"] for r in lifecycle.rank_thresholds(listed, "rank", 1, "edition", "metric").collect()}
    assert got == {2014.5: 9.0, 2014.75: 99.0, 10000.5: 5.0, -1.5: 6.0}


@pytest.mark.parametrize("n", [3, 5000])
def test_top_of_one_large_edition(spark, n):
    df = spark.range(20_000, numPartitions=7).select((F.col("id") % 2).alias("edition"), F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("metric"))
    top = lifecycle.top_per_edition(df, ["edition"], [F.col("metric").desc()], n)
    got = {(r["edition"], r["rank"]): r["metric"] for r in top.collect()}
    for edition in (0, 1):
        want = sorted(((i * 7919) % 20_011 for i in range(edition, 20_000, 2)), reverse=True)[:n]
        assert [got[edition, k + 1] for k in range(n)] == want
    assert top.columns == ["edition", "metric", "rank"]
    # every window but the last is split by reading task or salt
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_salt") >= 2 and plan.count("_task") >= 2


def test_pieces_grow_with_the_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(None).cast("int")).otherwise(1).alias("k"))
    got = {r["k"]: r["pieces"] for r in skew.hot_keys(df, "k", min_rows=50, piece_rows=10).collect()}
    assert got == {None: 90, 1: skew.MIN_PIECES + 2}


def test_fill_agrees_for_null_order_and_null_key(spark):
    """Rows without an order come first; rows without a key are one group; hot or not."""
    data = [(None, 1, 7.0), (None, 2, None)] + [(i, 3 + i, 9.0 if i == 150 else None) for i in range(200)]
    df = spark.createDataFrame([(k, *d) for k in ("a", None) for d in data], "id string, seq long, row long, x double")
    want = {1: 7.0, 2: 7.0} | {3 + i: 7.0 if i < 150 else 9.0 for i in range(200)}
    for min_rows in (skew.MIN_HOT_ROWS, 50):
        hot = skew.hot_keys(df, "id", min_rows, piece_rows=20)
        got = group_fill(df, "id", "seq", ["x"], hot).collect()
        assert len(got) == 404
        for r in got:
            if r["row"] > 2:
                assert r["x"] == want[r["row"]]
            else:  # two rows without an order: which of them is first is open
                assert r["x"] == 7.0


def test_next_thresholds_by_brute_force(spark):
    import random

    from fleetfootprint.operators.lifecycle import next_thresholds

    rng = random.Random(7)
    for _ in range(4):
        lists = {2000 + rng.randint(0, 40) / 2: rng.choice([None, float(rng.randint(1, 99))]) for _ in range(9)}
        moments = [rng.choice([None, 2000 + rng.randint(-4, 46) / 2]) for _ in range(200)]
        limits = spark.createDataFrame(list(lists.items()), "final_edition double, threshold double")
        asked = spark.createDataFrame([(m,) for m in moments], "final_edition double")
        got = {r["final_edition"]: r["threshold"] for r in next_thresholds(asked, limits).collect()}
        later = {m: [k for k in lists if k >= m] for m in moments if m is not None}
        assert got == {m: lists[min(k)] if k else None for m, k in later.items()}


def test_as_of_equals_the_shifted_join_on_regular_editions(spark):
    from fleetfootprint.operators.lifecycle import with_exit_reason

    rows = spark.createDataFrame([(i, 2000 + (i % 9) / 2, float(i % 13)) for i in range(100)], "id long, final_edition double, metric double")
    limits = spark.createDataFrame([(2000 + k / 2, 3.0 + k) for k in range(7)], "final_edition double, threshold double")
    plain, as_of = (sorted(map(str, with_exit_reason(rows, limits, "metric", 2004.0, as_of=a).collect())) for a in (False, True))
    assert plain == as_of
