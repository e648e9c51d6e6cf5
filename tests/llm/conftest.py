import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, spans string, fp long, found string"
WORDS = "the of and to in is that it for was with on be by this stone river cloud table window garden paper light green".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.7 else "") for _ in range(n))


def rows():
    """Documents with nulls in every column, empty, blank and long texts, ties, repeats and clashing extra columns."""
    rng = random.Random(4)
    extra = (7, "x", "y", 5, "z")
    out = []
    for i in range(60):
        text = prose(rng, rng.randint(1, 200))
        out.append((i, text, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 7 == 0], len(text), *extra))
    base = prose(rng, 300)
    for i in range(60, 66):
        near = base.split(" ")
        near[i - 60] = "changed"
        out.append((i, " ".join(near), "en", "s0", None, *extra))
    out += [(i, base, "en", "s1", 9, *extra) for i in (70, 71, 71)]
    out += [(80, None, None, None, None, None, None, None, None, None), (81, "", "en", "s2", 0, *extra), (82, " \t\n ", "en", "s2", 4, *extra)]
    out += [(None, "a text without an id", "en", "s3", 20, *extra), (83, "é" * 5, "fr", "s3", 5, *extra), (84, "w" * 40_000, "en", "s3", 40_000, *extra)]
    out += [(85, prose(rng, 6000), "en", "s3", 1, *extra), (86, "12 34", None, "s3", 5, *extra)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
