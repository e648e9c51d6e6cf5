"""The indexed join of names against every name with every spec."""

import os
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetfootprint.functions.similarity import Scorer, block_candidates, lcs_lengths
from fleetfootprint.operators import fuzzy
from fleetfootprint.plans import catalog

SF_DIR = "/root/testdata/sf0.01"
PARTS = ["Xeon", "EPYC", "AMD", "Intel", "Gold", "E5-2670", "E5-2690", "7V12", "6148", "8C", "20C", "2.4GHz", "2.45GHz", "POWER9", "x", "x", "ß", "é"]


def block_form(names, specs):
    names, specs = sorted(set(names)), sorted(set(specs))
    found = block_candidates(pd.Series(names), pd.Series(specs), 99.0, 0.9)
    return {(r.name_, r.spec, round(r.score, 9)) for r in found.set_axis(["name_", "spec", "score"], axis=1).itertuples() if r.score > 0}


def indexed(spark, names, specs):
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame([(s,) for s in specs], "spec_name string")
    return {(r.name, r.spec_name, round(r.score, 9)) for r in fuzzy.fuzzy_candidates(left, right).collect()}


def written(rng, n):
    return [" ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.mark.parametrize("known_keys", [4000, 5])
def test_equal_to_all_pairs(spark, monkeypatch, known_keys):
    monkeypatch.setattr(fuzzy, "KNOWN_KEYS", known_keys)
    rng = random.Random(known_keys)
    specs = written(rng, 60)
    # names like the specs, mutilated ones, one that shares a letter with few, long ones and blank ones
    names = written(rng, 150) + ["".join(c for c in s if rng.random() < 0.8) or "q" for s in specs] + ["z", "???", "x " * 40, "", "  ", specs[0].lower()]
    assert indexed(spark, names, specs) == block_form([n for n in names if n.split()], specs)


def test_empty_sides(spark):
    assert indexed(spark, [], ["a"]) == indexed(spark, ["a"], []) == set()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_few_pairs_are_opened(spark):
    """On the driver's parts less than four in ten pairs are scored, each at most twice, and the result is that of all pairs."""
    names = catalog._systems(spark, SF_DIR).select(catalog.F.col("processor").alias("name")).distinct()
    specs = catalog._spec_sheet(spark, SF_DIR)
    pairs = fuzzy.candidate_pairs(names, specs)
    opened, total = pairs.select("name", "spec_name").distinct().count(), names.count() * specs.count()
    assert opened < 0.4 * total and pairs.count() < 2 * opened
    got = {(r.name, r.spec_name, round(r.score, 9)) for r in fuzzy.fuzzy_candidates(names, specs).collect()}
    assert got == block_form([r.name for r in names.collect()], [r.spec_name for r in specs.collect()])


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=150), st.text("abc", max_size=150)), min_size=1, max_size=6))
def test_subsequences_over_word_edges(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert lcs_lengths(left, right).tolist() == [plain_lcs(a, b) for a, b in pairs]


def test_long_names_with_shared_tokens():
    rng = random.Random(4)
    names = sorted(set(written(rng, 30) + [" ".join(written(rng, 12))]))
    specs = sorted(set(written(rng, 30) + [" ".join(written(rng, 15))]))
    whole = block_candidates(pd.Series(names), pd.Series(specs), 101.0, 0.0)
    score = {(r.name_, r.spec): r.score for r in whole.set_axis(["name_", "spec", "score"], axis=1).itertuples()}
    first = pd.Series([0]).to_numpy()
    assert len(score) == len(names) * len(specs)
    assert all(Scorer([n], [s]).scores(first, first)[0] == pytest.approx(value) for (n, s), value in score.items())
