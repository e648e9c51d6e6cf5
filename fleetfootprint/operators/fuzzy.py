"""Approximate name matching against a specification list, and estimates drawn from the matches."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.functions.similarity import pair_scores
from fleetfootprint.schemas import DEFAULT_TDP, FUZZY_EXPONENT, FUZZY_HIT, FUZZY_RELATIVE
from fleetfootprint.session import settle

# Index keys whose frequency is known everywhere, each with up to two specs that have it; other keys count as the rarest.
KNOWN_KEYS = 4_000
PROBES = 4
LETTERS, TOKENS = 0, 1
CANDIDATES = "name string, spec_name string, score double"
KEYS = "text string, kind int, size double, keys array<long>, rests array<double>"


def _letter_keys(text: str) -> list[int]:
    """A key for the first, second ... occurrence of each letter, so that common letters are common keys."""
    seen: Counter = Counter()
    keys = []
    for letter in text:
        keys.append(ord(letter) << 32 | seen[letter])
        seen[letter] += 1
    return keys


def _token_key(token: str) -> int:
    """62 bits of the token; two tokens of one key only add pairs to be scored."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


def _index_rows(text: str, frequency: dict[tuple[int, int], int]) -> list[tuple]:
    """(text, kind, size, keys, rests) of a name or spec, keys from rare to frequent.

    ``rests`` bounds what a pair can have in common if the key is the first that it has in common: letters from there on, or
    the joined length of the tokens from there on. ``size`` is what this is measured by. A text that repeats a token is
    compared with and without the repetition, so it has letter keys for both.
    """
    tokens = sorted(text.split())
    distinct = sorted(set(tokens))
    rows = []
    for form in {" ".join(tokens), " ".join(distinct)}:
        keys = sorted(_letter_keys(form), key=lambda k: (frequency.get((LETTERS, k), 0), k))
        rows.append((text, LETTERS, float(len(keys)), keys, [float(len(keys) - at) for at in range(len(keys))]))
    by_key: dict[int, int] = {}
    for token in distinct:
        by_key[_token_key(token)] = by_key.get(_token_key(token), 0) + len(token) + 1
    keys = sorted(by_key, key=lambda k: (frequency.get((TOKENS, k), 0), k))
    rest, rests = -1.0, []
    for key in reversed(keys):
        rest += by_key[key]
        rests.append(rest)
    rows.append((text, TOKENS, float(len(" ".join(distinct))), keys, rests[::-1]))
    return rows


def _spec_index(specs: DataFrame, frequency: dict[tuple[int, int], int]) -> DataFrame:
    """The specs' index rows, with their keys in the order of ``frequency``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for text in frame["spec_name"] for row in _index_rows(text, frequency)]
            yield pd.DataFrame(rows, columns=["text", "kind", "size", "keys", "rests"])

    return specs.mapInPandas(run, KEYS)


def candidate_pairs(names: DataFrame, specs: DataFrame, hit: float = FUZZY_HIT, relative: float = FUZZY_RELATIVE) -> DataFrame:
    """name, spec_name and ``cut``: every pair that can reach the name's cut-off, and the cut-off known so far.

    The specs are indexed by their tokens and letters. A name is scored with a few specs that share a rare key with it,
    which puts a floor under its best score and so under its cut-off. A pair can reach the cut-off by its letters only if
    twice the common ones make up that share of both, and by its tokens only if the common ones make up enough of either. Both
    follow from the place of the first common key, so names and specs meet in an equi-join on keys, and each pair comes
    from its first common key. A name that shares no letter with any spec has no pair.

    ``names`` has a column ``name`` and ``specs`` a column ``spec_name``. Names are spread over the cores; the index is
    joined without a hint.
    """
    spark = names.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = names.select("name").filter(F.col("name").isNotNull()).repartition(tasks, "name").distinct()
    specs = specs.select("spec_name").filter(F.col("spec_name").isNotNull()).distinct()
    per_key = _spec_index(specs, {}).select("text", "kind", F.explode("keys").alias("key")).groupBy("kind", "key")
    known = per_key.agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))
    top = known.orderBy(F.desc("n"), "kind", "key").limit(KNOWN_KEYS).collect()
    frequency = {(r["kind"], r["key"]): r["n"] for r in top}
    probes = {(r["kind"], r["key"]): (r["first"], r["last"]) for r in top}
    index = settle(_spec_index(specs, frequency), "spec-index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for name in frame["name"] for row in _index_rows(name, frequency)]
            indexed = pd.DataFrame(rows, columns=["text", "kind", "size", "keys", "rests"])
            # what a rare token or letter leads to is likely to be near
            tried = dict.fromkeys(
                (text, spec)
                for text, kind, _, keys, _ in rows
                for key in itertools.islice((k for k in keys if (kind, k) in probes), PROBES // 2)
                for spec in probes[kind, key]
            )
            pairs = pd.DataFrame(list(tried), columns=["name", "spec_name"])
            floor = pair_scores(pairs["name"], pairs["spec_name"]) if len(pairs) else []
            floors = pairs.assign(floor=floor).groupby("name")["floor"].max()
            best = indexed["text"].map(floors).fillna(0.0).astype(float)
            yield indexed.assign(cut=(best * relative).clip(upper=hit))

    wanted = names.mapInPandas(run, KEYS + ", cut double")
    # a sum of common lengths that is tau of the mean of two lengths is tau / (2 - tau) of the smaller one at least
    tau = F.col("cut") / 100
    share = tau / (2 - tau)
    slack = 1e-9

    def spread(rows: DataFrame, side: str) -> DataFrame:
        placed = rows.select("*", F.posexplode("keys").alias("place", "key")).withColumn("rest", F.element_at("rests", F.col("place") + 1))
        names = {c: f"{side}_{c}" for c in ("text", "size", "keys", "rest")}
        return placed.drop("place", "rests").withColumnsRenamed(names)

    # a letter key too near to the end of the name can't be the first of enough letters
    left = spread(wanted, "l").filter((F.col("kind") == TOKENS) | (F.col("l_rest") >= share * F.col("l_size") - slack))
    right = spread(index, "r")
    sizes = F.col("l_size") + F.col("r_size")
    by_letters = 2 * F.least("l_rest", "r_rest") >= tau * sizes - slack
    by_tokens = (F.col("l_rest") >= share * F.col("l_size") - slack) | (F.col("r_rest") >= share * F.col("r_size") - slack)
    reachable = F.when(F.col("kind") == LETTERS, by_letters).otherwise(by_tokens)
    met = left.join(right, ["kind", "key"]).filter(reachable)
    common = F.array_intersect("l_keys", "r_keys")
    enough = (F.col("kind") == TOKENS) | (2 * F.size(common) >= tau * sizes - slack)
    first = met.filter((F.get(common, F.lit(0)) == F.col("key")) & enough)
    return first.select(F.col("l_text").alias("name"), F.col("r_text").alias("spec_name"), "cut")


def fuzzy_candidates(names: DataFrame, specs: DataFrame, hit: float = FUZZY_HIT, relative: float = FUZZY_RELATIVE) -> DataFrame:
    """All specs scoring at least ``hit`` for a name or, if none does, at least ``relative`` x its best, and above 0.

    Only pairs that the index lets through are scored, and nothing that belongs to the result is lost: see ``candidate_pairs``.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates(["name", "spec_name"], ignore_index=True)
            scored = frame.assign(score=pair_scores(frame["name"], frame["spec_name"]))
            yield scored.loc[(scored["score"] >= scored["cut"]) & (scored["score"] > 0), ["name", "spec_name", "score"]]

    scored = candidate_pairs(names, specs, hit, relative).mapInPandas(score, CANDIDATES)
    best = F.max("score").over(Window.partitionBy("name"))
    cut = F.when(F.col("_best") >= hit, hit).otherwise(F.col("_best") * relative)
    # a pair may come by its letters and by its tokens
    return scored.withColumn("_best", best).filter(F.col("score") >= cut).drop("_best").distinct()


def estimate_sources(candidates: DataFrame, specs: DataFrame, value: str, exponent: int = FUZZY_EXPONENT) -> DataFrame:
    """The candidates an estimate is drawn from, one row each: name, spec_name, ``value`` and its weight (score/100)^exponent."""
    known = candidates.join(specs.select("spec_name", value), "spec_name")
    known = known.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.select("name", "spec_name", value, (F.pow(F.col("score") / 100, F.lit(exponent)) * 100).alias("weight"))


def weighted_estimates(
    candidates: DataFrame,
    specs: DataFrame,
    value: str,
    exponent: int = FUZZY_EXPONENT,
    default: float = DEFAULT_TDP,
) -> DataFrame:
    """Estimate per name: weighted mean of its sources' values, to one decimal, and their number.

    ``default`` where no candidate has a value. Only sums are kept per name, so a name may have any number of sources.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    weight = F.when(usable, F.pow(F.col("score") / 100, F.lit(exponent)) * 100)
    known = candidates.join(specs.select("spec_name", value), "spec_name").withColumn("_w", weight)
    mean = F.try_divide(F.sum(F.when(usable, F.col("_w") * F.col(value))), F.sum("_w"))
    return known.groupBy("name").agg(
        F.coalesce(F.round(mean, 1), F.lit(float(default))).alias("estimate"), F.count("_w").alias("n_sources")
    )


def best_match(candidates: DataFrame) -> DataFrame:
    """Single best spec per name; the alphabetically first one wins a tie."""
    top = F.struct(-F.col("score"), F.col("spec_name"))
    return candidates.groupBy("name").agg(
        F.min_by("spec_name", top).alias("spec_name"), F.max("score").alias("score")
    )
