"""The impact model: worked values, brute force, and equality of its two forms."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetfootprint.operators.expansion import churn, expand_semesters, grid_size, impact_series, semester_grid
from fleetfootprint.plans import impact as plans
from fleetfootprint.schemas import ImpactParams

SCHEMA = (
    "entity_id string, installation_year double, lifespan double, exit_reason string, cpu_tdp double, gpu_tdp double, "
    "num_cpus double, num_gpus double, intensity_a double, intensity_b double"
)
ONE = ("s1", 2015.0, 5.0, "Removed", 100.0, None, 10.0, 0.0, 50.0, None)


def systems(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def series(df, params, **kw):
    return {r["semester"]: r.asDict() for r in impact_series(df, params, **kw).collect()}


def test_worked_example(spark):
    got = series(systems(spark, [ONE]), ImpactParams())
    assert len(got) == 25 and min(got) == 2012.0 and max(got) == 2024.0
    energy = {s: r["total_gwh"] for s, r in got.items()}
    assert energy[2014.5] == 0 and energy[2020.0] == 0
    assert energy[2015.0] == pytest.approx(0.0022995)
    assert energy[2015.5] == pytest.approx(0.00292365)
    assert energy[2016.0] == energy[2019.5] == pytest.approx(0.0035478)
    assert sum(energy.values()) == pytest.approx(0.03360555)
    assert got[2015.0]["total_carbon_t"] == pytest.approx(0.114975)
    assert [s for s, r in got.items() if r["systems_added"]] == [2015.0]
    assert [s for s, r in got.items() if r["systems_removed"]] == [2020.0]
    assert all(r["active_systems"] == (2015.0 <= s < 2020.0) for s, r in got.items())
    assert all(r["total_systems"] == 1 for r in got.values())
    assert got[2012.5]["year_month"] == dt.date(2012, 6, 1)


def test_dropped_systems_run_on(spark):
    dropped = (*ONE[:3], "Dropped", *ONE[4:])
    got = series(systems(spark, [dropped]), ImpactParams(time_after_drop=2.0))
    assert sum(r["total_gwh"] for r in got.values()) == pytest.approx(0.04779675)
    assert sum(r["active_systems"] for r in got.values()) == 14


def test_idle_power_of_the_whole_system(spark):
    got = series(systems(spark, [ONE]), ImpactParams(idle_scope="system"))
    assert got[2015.0]["cpu_gwh"] == pytest.approx(730 * (0.5 * 500 + 0.5 * 1000) / 1e9 * 6)


def test_other_provider(spark):
    got = series(systems(spark, [ONE]), ImpactParams(provider="Ember"))
    assert sum(r["total_carbon_t"] for r in got.values()) == 0


def random_systems(n=120, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(
            (
                f"s{i}",
                rng.choice([2009.0, 2011.0, 2012.0, 2013.0, 2018.0, 2023.0, 2024.0, 2030.0, 2015.25, None]),
                rng.choice([0.0, 0.5, 1.0, 1.5, 3.0, 20.0, -1.0, None]),
                rng.choice(["Dropped", "Removed"]),
                rng.choice([None, 0.0, 100.0, 250.0]),
                rng.choice([None, 0.0, 300.0]),
                rng.choice([None, 1.0, 12.5]),
                rng.choice([None, 0.0, 4.0]),
                rng.choice([None, 50.0, 410.5]),
                1.0,
            )
        )
    return out


def brute_force(rows, params):
    """The model stated system by system and semester by semester."""
    out, previous = {}, set()
    for step in range(grid_size(params.span)):
        s = params.span[0] + step / 2
        cpu = gpu = carbon = 0.0
        active = set()
        for ident, install, life, reason, cpu_tdp, gpu_tdp, n_cpu, n_gpu, rate, _ in rows:
            life = 0 if life is None else life + (params.time_after_drop if reason == "Dropped" else 0)
            age = s - (install or 0)
            low, high = params.tau
            tau = low if age == 0 else (low + high) / 2 if age == 0.5 else high if 1 <= age < life else None
            if tau is None:
                continue
            energy = []
            for tdp, n in ((cpu_tdp or 0, n_cpu or 0), (gpu_tdp or 0, n_gpu or 0)):
                energy.append(730 * ((1 - tau) * tdp * params.alpha + tau * tdp * n) / 1e9 * 6)
            cpu, gpu, carbon = cpu + energy[0], gpu + energy[1], carbon + sum(energy) * (rate or 0)
            if max(energy) > 0:
                active.add(ident)
        out[s] = (cpu, gpu, carbon, len(active - previous), len(previous - active), len(active), len(rows))
        previous = active
    return out


PARAMS = [
    ImpactParams(),
    ImpactParams(alpha=0.0, tau=(0.0, 0.7), time_after_drop=0.5),
    ImpactParams(alpha=0.0, tau=(0.0, 0.0)),
    ImpactParams(span=(2013.0, 2013.5)),
    ImpactParams(span=(2010.0, 2020.0), time_after_drop=35.0),
]


@pytest.mark.parametrize("params", PARAMS)
def test_both_forms_agree_with_brute_force(spark, params):
    rows = random_systems()
    df = systems(spark, rows)
    want = brute_force(rows, params)
    got = series(df, params)
    assert got.keys() == want.keys()
    for s, w in want.items():
        g = got[s]
        assert [g["cpu_gwh"], g["gpu_gwh"], g["total_carbon_t"]] == pytest.approx(list(w[:3]), abs=1e-12)
        assert (g["systems_added"], g["systems_removed"], g["active_systems"], g["total_systems"]) == w[3:]
    expanded = expand_semesters(df, params)
    for r in churn(expanded, params.span).collect():
        assert (r["systems_added"], r["systems_removed"], r["active_systems"]) == want[r["semester"]][3:6]
    sums = expanded.groupBy("semester").agg(F.sum("cpu_gwh"), F.sum("gpu_gwh"), F.sum("total_carbon_t")).collect()
    for r in sums:
        assert list(r)[1:] == pytest.approx(list(want[r[0]][:3]), abs=1e-12)


def test_expansion_holds_only_running_rows(spark):
    rows = expand_semesters(systems(spark, [ONE]), ImpactParams()).collect()
    assert sorted(r["semester"] for r in rows if r["active"]) == [2015.0 + i / 2 for i in range(10)]
    assert [r["semester"] for r in rows if r["removed"]] == [2020.0]
    assert len(rows) == 11


def test_empty_fleet_gives_no_rows(spark):
    assert impact_series(systems(spark, []), ImpactParams()).isEmpty()


def test_grid(spark):
    assert [r[0] for r in semester_grid(spark, (2012.0, 2013.5)).collect()] == [2012.0, 2012.5, 2013.0]


FLEET = (
    "entity_id string, row_seq long, edition double, installation_year double, country string, segment string, "
    "listing string, metric double, cpu_tdp double, gpu_tdp double, num_cpus double, num_gpus double, "
    "intensity_a double, intensity_b double"
)


def fleet_rows(seed=11, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ident = f"s{0 if rng.random() < 0.3 else rng.randrange(40)}"
        country = ["FR", "US", "JP", None][int(ident[1:]) % 4]
        out.append(
            (
                ident, i, 2012.0 + rng.randrange(20) / 2, 2010.0 + int(ident[1:]) % 9, country,
                rng.choice(["Research", "Industry"]), rng.choice(["Top500", "Green500"]), float(rng.randrange(100)),
                rng.choice([None, 100.0, 200.0]), rng.choice([None, 300.0]), float(rng.randrange(9)), 2.0,
                rng.choice([None, 40.0, 80.0]), 1.0,
            )
        )
    return out


@pytest.fixture(scope="module")
def fleet(spark):
    return spark.createDataFrame(fleet_rows(), FLEET)


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([(2012.0 + i / 2, 40.0) for i in range(0, 20, 2)], "final_edition double, threshold double")


def python_entities(rows, keep, limit):
    out = []
    for ident in sorted({r[0] for r in rows}):
        every = [r for r in rows if r[0] == ident]
        mine = sorted((r for r in every if keep(r)), key=lambda r: r[1])
        final = max(r[2] for r in every)
        if not mine or final >= 2021.5:
            continue
        first = [next((r[c] for r in mine if r[c] is not None), None) for c in range(14)]
        reason = "Dropped" if limit.get(final) is not None and mine[0][7] < limit[final] else "Removed"
        out.append((ident, first[3], final - first[3], reason, *first[8:14]))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_slice_to_series(fleet, limits, parts):
    rows, limit = fleet_rows(), {2012.0 + i / 2: 40.0 for i in range(0, 20, 2)}
    params = ImpactParams(country="US", segments=("Research",), listing="Top500")
    picked = python_entities(rows, lambda r: (r[4], r[5], r[6]) == ("US", "Research", "Top500"), limit)
    want = brute_force(picked, params)
    got = {r["semester"]: r for r in plans.impact(fleet.repartition(parts), limits, params, 2021.5).collect()}
    assert picked and got.keys() == want.keys()
    for s, w in want.items():
        assert [got[s]["cpu_gwh"], got[s]["gpu_gwh"], got[s]["total_carbon_t"]] == pytest.approx(list(w[:3]), abs=1e-12)
        assert got[s]["active_systems"] == w[5] and got[s]["total_systems"] == w[6]


def test_comparison_is_the_two_series_side_by_side(fleet, limits):
    params = ImpactParams(country="FR", segments=("Industry",))
    own = {r["semester"]: r for r in plans.impact(fleet, limits, params, 2021.5).collect()}
    average = {r["semester"]: r for r in plans.fleet_average(fleet, limits, params, 2021.5).collect()}
    world = {r["semester"]: r for r in plans.impact(fleet, limits, replace(params, country=None), 2021.5).collect()}
    paired = plans.entity_vs_fleet(fleet, limits, params, 2021.5)
    rows = paired.collect()
    assert len(rows) == 25
    for r in rows:
        s = r["semester"]
        assert r["total_gwh"] == pytest.approx(own[s]["total_gwh"])
        assert r["fleet_total_gwh"] == pytest.approx(average[s]["total_gwh"])
        # three countries and the missing one
        assert average[s]["total_carbon_t"] == pytest.approx(world[s]["total_carbon_t"] / 4)
    figures = plans.key_figures(paired).first()
    running = [r for r in rows if r["total_gwh"] > 0]
    assert figures["energy_gwh"] == pytest.approx(sum(r["total_gwh"] for r in running))
    assert figures["first_month"] == min(r["year_month"] for r in running)
    long = plans.comparison_long(paired).collect()
    assert len(long) == 2 * 25 * 6
    assert {(r["measure"], r["component"]) for r in long} == {(m, c) for m in ("energy", "carbon") for c in ("cpu", "gpu", "total")}


def test_unknown_country_is_an_empty_answer(fleet, limits):
    params = ImpactParams(country="Nowhere")
    assert plans.impact(fleet, limits, params, 2021.5).isEmpty()
    assert plans.entity_vs_fleet(fleet, limits, params, 2021.5).isEmpty()


def test_a_cohort_has_five_changes_at_most(spark):
    """Changes instead of a row per semester: installed before, at, between and after the grid's points, with every length of life."""
    import random

    from pyspark.sql import functions as F

    from fleetfootprint.operators import expansion

    rng = random.Random(11)
    params = ImpactParams(span=(2000.0, 2006.0), tau=(0.0, 0.8))
    rows = []
    for i in range(400):
        install = rng.choice([None, 1990.0, 1998.5, 1999.0, 1999.5, 2000.0, 2000.5, 2001.25, 2003.0, 2005.5, 2006.0, 2010.0])
        life = rng.choice([None, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.25, 7.0, 30.0])
        rows.append((i, rng.choice("ab"), install, life, rng.choice(["Dropped", "Removed"]), *[rng.choice([None, 0.0, 100.0, 33.3]) for _ in range(2)], *[float(rng.randint(0, 3)) for _ in range(2)], rng.choice([None, 50.0, 400.5])))
    systems = spark.createDataFrame(rows, "entity_id long, grp string, installation_year double, lifespan double, exit_reason string, cpu_tdp double, gpu_tdp double, num_cpus double, num_gpus double, intensity_a double")
    cohorts = expansion._cohorts(systems, params, ["grp"])
    changes = expansion._events(cohorts, params, ["grp"])
    assert changes.count() <= 5 * cohorts.count() and changes.filter("step < 0 or step > 11").count() == 0
    series = {(r["grp"], r["semester"]): r for r in expansion.impact_series(systems, params, ["grp"]).collect()}
    assert len(series) == 24
    # every system in every semester by its own formula
    watts = expansion.with_power(systems, params).collect()
    level = lambda age, life: 0 if age == 0 else 1 if age == 0.5 else 2 if 1 <= age < life else None
    taus = params.tau_levels
    power = lambda r, p, k: 0.0 if k is None else r[f"{p}_idle"] * (1 - taus[k]) + r[f"{p}_full"] * taus[k]
    for (grp, semester), got in series.items():
        own = [r for r in watts if r["grp"] == grp]
        now = [level(semester - r["install"], r["life"]) for r in own]
        was = [level(semester - 0.5 - r["install"], r["life"]) if semester > 2000 else None for r in own]
        runs, ran = ([max(power(r, p, k) for p in ("cpu", "gpu")) > 0 for r, k in zip(own, ks)] for ks in (now, was))
        gwh = {p: [power(r, p, k) * 24 * (365 / 12) / 1e9 * 6 for r, k in zip(own, now)] for p in ("cpu", "gpu")}
        assert got["cpu_gwh"] == pytest.approx(sum(gwh["cpu"]), abs=1e-12) and got["gpu_gwh"] == pytest.approx(sum(gwh["gpu"]), abs=1e-12)
        assert got["total_carbon_t"] == pytest.approx(sum((a + b) * r["intensity"] for a, b, r in zip(gwh["cpu"], gwh["gpu"], own)), abs=1e-9)
        assert (got["active_systems"], got["systems_added"], got["systems_removed"], got["total_systems"]) == (
            sum(runs), sum(a and not b for a, b in zip(runs, ran)), sum(b and not a for a, b in zip(runs, ran)), len(own)
        )
    assert expansion.impact_series(systems.filter("false"), params).count() == 0
    assert expansion.impact_series(systems, ImpactParams(span=(2000.0, 2000.0))).count() == 0
