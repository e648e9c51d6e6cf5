"""The stored cube: slices and SQL calls equal to the plans over the fleet."""

import random
from dataclasses import replace

import pytest

from fleetfootprint.operators.expansion import impact_series
from fleetfootprint.operators.slicing import slice_condition
from fleetfootprint.plans import cube as cubes
from fleetfootprint.plans import impact as plans
from fleetfootprint.schemas import ImpactParams

SCHEMA = (
    "entity_id string, row_seq long, edition double, installation_year double, country string, segment string, listing string, "
    "metric double, cpu_tdp double, gpu_tdp double, num_cpus double, num_gpus double, intensity_a double, intensity_b double, several string"
)
PARAMS = ImpactParams(span=(2012.0, 2020.0), time_after_drop=2.0)
COUNTRIES, SEGMENTS, LISTINGS = ("France", "Spain", "Chad"), ("Research", "Industry", "Academic", "Vendor"), ("Top", "Green")


def rows_of(n=90, seed=3):
    rng = random.Random(seed)
    out, seq = [], 0
    for i in range(n):
        # some systems keep to one place, others change country, segment and listing
        moves = i % 3
        home = (rng.choice([*COUNTRIES, None]), rng.choice([*SEGMENTS, None]), rng.choice([*LISTINGS, None]))
        start = rng.choice([2010.0, 2012.0, 2013.5, 2016.0])
        for k in range(rng.randint(1, 5)):
            seq += 1
            place = home if not moves else (
                rng.choice([home[0], *COUNTRIES]) if moves == 2 else home[0], rng.choice([*SEGMENTS, None]), rng.choice([*LISTINGS, None])
            )
            number = lambda *v: rng.choice([None, *v])
            out.append(
                (
                    None if i == 7 else f"s{i}", None if seq % 41 == 0 else seq, start + 0.5 * k, number(start, start, start - 1), *place,
                    number(5.0, 50.0), number(100.0, 250.0), number(300.0), number(10.0, 40.0), number(8.0), number(50.0, 400.0), number(90.0), "x",
                )
            )
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data(spark):
    fleet = spark.createDataFrame(rows_of(), SCHEMA)
    limits = spark.createDataFrame([(2010.0 + i / 2, 20.0 + i) for i in range(24)], "final_edition double, threshold double")
    return fleet, limits, cubes.build_cube(fleet, limits, PARAMS, 2018.0)


def by_semester(df):
    return {r["semester"]: r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for semester, row in want.items():
        assert got[semester].keys() == row.keys()
        for c, value in row.items():
            assert got[semester][c] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), (semester, c)


def random_slices(n, seed=11):
    rng = random.Random(seed)
    for _ in range(n):
        segments = rng.choice([None, tuple(rng.sample(SEGMENTS, rng.randint(1, 4)))])
        yield replace(PARAMS, country=rng.choice([None, *COUNTRIES]), segments=segments, listing=rng.choice([None, *LISTINGS]))


def test_slices_equal_the_plan(data):
    fleet, limits, cube = data
    assert cube.crossing.count() and cube.changes.count()
    slices = {f"s{i}": params for i, params in enumerate(random_slices(20))}
    scopes = {name: slice_condition(params) for name, params in slices.items()}
    # all slices by one pass over the fleet
    systems = plans.systems_by_scope(fleet, scopes, PARAMS.intensity_column)
    systems = plans.with_lifecycle(systems, limits, scopes, PARAMS.intensity_column, 2018.0)
    want = {}
    for row in impact_series(systems, PARAMS, by=["scope"]).collect():
        values = row.asDict()
        want.setdefault(values.pop("scope"), {})[row.semester] = values
    for name, params in slices.items():
        same(by_semester(cubes.cube_impact(cube, params)), want.get(name, {}))


def test_slices_without_systems(data):
    _, _, cube = data
    for params in (replace(PARAMS, country="Peru"), replace(PARAMS, segments=()), replace(PARAMS, segments=("None", "Nobody"))):
        assert cubes.cube_impact(cube, params).isEmpty()


def test_comparison_equals_the_plan(data):
    fleet, limits, cube = data
    for params in random_slices(2, seed=5):
        same(by_semester(cubes.cube_comparison(cube, params)), by_semester(plans.entity_vs_fleet(fleet, limits, params, 2018.0)))


def test_saved_cube_and_plan(spark, data, tmp_path):
    _, _, cube = data
    cubes.save_cube(cube, str(tmp_path / "cube"))
    stored = cubes.load_cube(spark, str(tmp_path / "cube"), PARAMS)
    params = replace(PARAMS, country="France", segments=("Research", "Vendor"))
    answer = cubes.cube_impact(stored, params)
    same(by_semester(answer), by_semester(cubes.cube_impact(cube, params)))
    read = {f.rsplit("/", 2)[-2] for f in answer.inputFiles()}
    assert read <= {"changes", "crossing"}
    one = cubes.cube_impact(stored, replace(PARAMS, country="France"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_other_parameters_are_an_error(data):
    with pytest.raises(ValueError):
        cubes.cube_impact(data[2], replace(PARAMS, time_after_drop=5.0))


def test_empty_fleet(spark, data):
    _, limits, _ = data
    cube = cubes.build_cube(spark.createDataFrame([], SCHEMA), limits, PARAMS)
    assert cubes.cube_impact(cube, PARAMS).isEmpty()
    assert cubes.cube_impact(cube, replace(PARAMS, segments=SEGMENTS)).isEmpty()
    assert cubes.cube_comparison(cube, PARAMS).isEmpty()


def test_sql_functions(spark, data):
    fleet, limits, cube = data
    cubes.register_functions(cube, "demo")
    calls = {
        "()": PARAMS,
        "(country => 'France', segment => 'Research')": replace(PARAMS, country="France", segments=("Research",)),
        "(NULL, NULL, 'Green')": replace(PARAMS, listing="Green"),
    }
    for given, params in calls.items():
        same(by_semester(spark.sql(f"SELECT * FROM demo_impact{given}")), by_semester(plans.impact(fleet, limits, params, 2018.0)))
        got = spark.sql(f"SELECT * FROM demo_comparison{given}")
        same(by_semester(got), by_semester(plans.entity_vs_fleet(fleet, limits, params, 2018.0)))
    total = spark.sql("SELECT sum(i.total_gwh) AS gwh FROM (VALUES ('France'), ('Spain')) c(name), LATERAL demo_impact(c.name) i").first().gwh
    want = sum(r["total_gwh"] for name in ("France", "Spain") for r in plans.impact(fleet, limits, replace(PARAMS, country=name), 2018.0).collect())
    assert total == pytest.approx(want)
