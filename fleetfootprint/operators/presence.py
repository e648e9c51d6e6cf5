"""Editions of a system as bits: one aggregate that combines before the shuffle, in place of lists.

Editions are half-years. Bit k of the words stands for half-year ``EPOCH`` + k / 2; four words of 63 bits reach from 1970
to 2095. Lists, counts, first and last editions and turnover between two editions all follow from the bits.

Defined cases: a NULL edition sets no bit; an edition that is no half-year of that range is an error; a system without an edition has empty
words, an empty list and count 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = 1970.0
WORD_BITS = 63
WORDS = 4
LAST = WORD_BITS * WORDS - 1


def _place(edition: Column) -> Column:
    """Number of the edition's bit."""
    at = (edition - EPOCH) * 2
    known = (at == F.floor(at)) & at.between(0, LAST)
    message = F.concat(F.lit("no half-year of 1970 to 2095: "), edition.cast("string"))
    return F.when(edition.isNull(), F.lit(None).cast("int")).when(known, at.cast("int")).otherwise(F.raise_error(message).cast("int"))


def edition_bits(edition: Column) -> Column:
    """Aggregate: the editions of a group as an array of ``WORDS`` longs."""
    place = _place(edition)
    words = []
    for word in range(WORDS):
        inside = F.floor(place / WORD_BITS) == word
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD_BITS).cast("int"))
        words.append(F.coalesce(F.bit_or(F.when(inside, bit)), F.lit(0).cast("long")))
    return F.array(*words)


def has_edition(bits: Column, place: Column) -> Column:
    """Whether the bit of number ``place`` is set."""
    word = F.get(bits, F.floor(place / WORD_BITS).cast("int"))
    return F.call_function("getbit", word, (place % WORD_BITS).cast("int")) == 1


def n_editions(bits: Column) -> Column:
    """How many editions."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(bits, F.lit(word))) for word in range(WORDS)])


def edition_list(bits: Column, first: Column, last: Column) -> Column:
    """The editions in order, given the first and last of them; empty where there is none."""
    places = F.sequence(_place(first), _place(last))
    found = F.transform(F.filter(places, lambda k: has_edition(bits, k)), lambda k: F.lit(EPOCH) + k / 2)
    return F.when(first.isNotNull(), found).otherwise(F.array().cast("array<double>"))


def presence_bits(rows: DataFrame, key: str, edition: str) -> DataFrame:
    """One row per system: its editions as ``bits``, how often it was listed, first and final edition. A single shuffle."""
    return rows.groupBy(key).agg(
        edition_bits(F.col(edition)).alias("bits"), F.count(F.lit(1)).alias("n_appearances"), F.min(edition).alias("first_edition"), F.max(edition).alias("final_edition")
    )


def list_turnover(presence: DataFrame, first: float, before: float) -> DataFrame:
    """edition, listed, entered and left for the half-years in [first, before), from the systems' bits.

    ``entered`` and ``left`` compare with the half-year before. One scan; what is shuffled is a row of sums per task.
    """
    places = [round((first - EPOCH) * 2) + k for k in range(max(0, round((before - first) * 2)))]
    sums = []
    for place in places:
        now, was = has_edition(F.col("bits"), F.lit(place)), has_edition(F.col("bits"), F.lit(place - 1)) if place else F.lit(False)
        sums.append(F.struct(
            F.lit(EPOCH + place / 2).alias("edition"), F.count_if(now).alias("listed"), F.count_if(now & ~was).alias("entered"), F.count_if(was & ~now).alias("left")
        ))
    if not sums:
        return presence.sparkSession.createDataFrame([], "edition double, listed long, entered long, left long")
    return presence.agg(F.array(*sums).alias("_all")).select(F.inline("_all"))
