"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral, scaled to the words the source has to
deliver, is the cumulative demand; the inverse of the demand turns the number of words of the source that came
before a document into the document's training position. Documents are then range-sorted by position.

Defined cases: a null or empty text has size 0 and takes nothing, also where its source has no other; a null source is a source of its own and comes
last; rows that repeat (also with the same doc_id) count each by itself; documents whose ids have the same hash follow
each other by id, then size, and rows that tie in all of these take their turns in any order, which changes no count; texts are counted whole, of
any length; an empty table gives an empty result; columns of the input other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3

# Relative weight of a source at training time t, as (t, weight) knots joined by straight lines, by the source's
# weight class: light sources fade out, heavy ones come in.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sized`` (source, size): rank, rows, source_size, weight class and target.

    Sources by code point (null last) take the weights in turn and share all words; a target stops at
    ``max_repeats`` times the source's size and the excess is shared again by weight. With the sources ordered by
    their stop per weight, the final level is the largest of the levels that are left after each stopped prefix.
    The windows run over one row per source, never over documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("source_rank", F.row_number().over(by_name) - 1)
        .withColumn("weight_class", F.col("source_rank") % len(weights))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("weight_class") + 1).cast("long"))
        .withColumn("stop", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
    )
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source_rank").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    stopped = F.coalesce(F.sum("stop").over(before), F.lit(0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("total") - stopped).cast("double") / (F.col("all_weights") - used)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("stop").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "source_rank", "source_rows", "source_size", "weight_class", "target")
    )


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which a source has delivered ``share`` (0..1) of its words under the schedule ``knots``."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    time = F.lit(1.0)
    for t0, t1, w0, w1, done in reversed(pieces):
        rest = share * area - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            inside = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - F.lit(w0)) / slope
        else:
            inside = F.lit(t0) + rest / w0
        end = done + (t1 - t0) * (w0 + w1) / 2
        time = F.when(share * area < F.lit(end), inside).otherwise(time)
    return time


def assign_positions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    schedules=SCHEDULES,
    keep_rows: bool = False,
) -> DataFrame:
    """Per document: size, source_size, target, taken and ``occurrences`` (epoch, words, position) in the mix.

    A source is read in passes over its documents in the order of a hash of the id, until its target is met; the
    last document is cut there, so a source delivers the whole part of its target exactly. The running count of
    words within a source is a sum over hash buckets plus a running sum inside the bucket; buckets number the
    square root of the source's rows, so no task holds a source. ``keep_rows`` adds the whole input row as the
    struct ``row``; without it only ids and sizes are kept, written once.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("place"),
        *([F.struct(*docs.columns).alias("row")] if keep_rows else []),
    )
    kept = ["row"] if keep_rows else []
    if not keep_rows:
        sized = settle(sized, "mix-sizes")
    targets = settle(source_targets(sized, weights, max_repeats), "mix-targets")
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    dealt = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.size", "d.place", *(f"d.{c}" for c in kept), *(f"t.{c}" for c in targets.columns if c != "source"))
        .withColumn("buckets", F.ceil(F.sqrt("source_rows")).cast("long"))
        .withColumn("bucket", F.shiftright(number * F.col("buckets"), 32))
    )
    sums = dealt.groupBy("source_rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_rank", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = (
        Window.partitionBy("source_rank", "bucket")
        .orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source_rank", "bucket"])
    start = F.col("bucket_start") + F.col("upto") - F.col("size")
    words = F.floor("target").cast("long")

    def occurrence(epoch: Column) -> Column:
        offset = start + epoch * F.col("source_size")
        share = F.try_divide(offset, F.col("target"))
        position = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            position = F.when(F.col("weight_class") % len(schedules) == k, inverse_demand(share, knots)).otherwise(position)
        return F.struct(
            epoch.cast("int").alias("epoch"),
            F.greatest(F.least(words - offset, F.col("size")), F.lit(0)).alias("words"),
            position.alias("position"),
        )

    passes = F.transform(F.array(*(F.lit(e) for e in range(max_repeats))), occurrence)
    return (
        placed.withColumn("occurrences", F.filter(passes, lambda x: x["words"] > 0))
        .withColumn("taken", F.aggregate("occurrences", F.lit(0).cast("long"), lambda total, x: total + x["words"]))
        .select("doc_id", "size", "source_size", "target", "taken", "occurrences", *kept)
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per occurrence, range-sorted by training position."""
    return assigned.select("doc_id", "size", F.inline("occurrences")).orderBy("position", "doc_id", "epoch")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (documents) as the mix delivers them, a row per occurrence, range-sorted by training position.

    Documents stay whole: the one in which its source's target ends is in where at least half of it belongs to the mix, and out
    otherwise, so a source's words miss its target by half a document at most.
    """
    rows = assign_positions(docs, keep_rows=True).select("row", "size", F.inline("occurrences"))
    whole = rows.filter(F.col("words") * 2 >= F.col("size"))
    return whole.orderBy("position", "row.doc_id", "epoch").select("row.*")
