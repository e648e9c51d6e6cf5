"""Name similarity: hand values, and block scoring against a plain pairwise definition."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetfootprint.functions.similarity import block_candidates, lcs_lengths, token_ratio


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
    return new


def indel(a, b):
    total = len(a) + len(b)
    return 100 - 100 * (total - 2 * lcs(a, b)) / total if total else 100.0


def pair_score(a, b):
    ta, tb = a.split(), b.split()
    by_sort = indel(" ".join(sorted(ta)), " ".join(sorted(tb)))
    common, left, right = set(ta) & set(tb), set(ta) - set(tb), set(tb) - set(ta)
    if common and (not left or not right):
        return 100.0
    base = " ".join(sorted(common))
    full_a = " ".join([*sorted(common), *sorted(left)]) if common else " ".join(sorted(left))
    full_b = " ".join([*sorted(common), *sorted(right)]) if common else " ".join(sorted(right))
    # the common start cancels, so the distance is that of what follows it
    rest = len(" ".join(sorted(left))) + len(" ".join(sorted(right))) - 2 * lcs(" ".join(sorted(left)), " ".join(sorted(right)))
    by_set = [100 - 100 * rest / (len(full_a) + len(full_b))]
    if common:
        for full in (full_a, full_b):
            by_set.append(100 - 100 * (len(full) - len(base)) / (len(base) + len(full)))
    return max(by_sort, *by_set)


def all_candidates(names, specs, hit, relative):
    found = {}
    for n in names:
        scores = {s: pair_score(n, s) for s in specs}
        best = max(scores.values())
        cut = hit if best >= hit else relative * best
        found |= {(n, s): round(v, 9) for s, v in scores.items() if v >= cut}
    return found


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("AMD 7V12", "AMD EPYC 7V12 48C 2.45GHz", 100),
        ("AMD EPYC7V12 60C 2.45GHz", "AMD EPYC 7V12 48C 2.45GHz", 73.46938775510205),
        ("Xeon E5-2690 8C", "Xeon E5-2670 8C", 93.33333333333333),
        ("Xeon 8C", "8C Xeon", 100),
        ("xeon", "XEON", 0),
    ],
)
def test_hand_values(a, b, score):
    assert token_ratio(a, b) == pytest.approx(score)


def test_lcs_of_long_texts():
    a, b = "ab" * 100, "ba" * 100
    assert list(lcs_lengths([a, ""], [b, "x"])) == [lcs(a, b), 0]


words = st.text(alphabet="abcE5- ", min_size=1, max_size=14).filter(lambda t: t.split())


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=6, unique=True), st.lists(words, min_size=1, max_size=8, unique=True))
def test_blocks_agree_with_all_pairs(names, specs):
    found = block_candidates(pd.Series(names), pd.Series(specs), 99.0, 0.9)
    mine = {(r.name_, r.spec): round(r.score, 9) for r in found.set_axis(["name_", "spec", "score"], axis=1).itertuples()}
    assert mine == all_candidates(names, specs, 99.0, 0.9)
