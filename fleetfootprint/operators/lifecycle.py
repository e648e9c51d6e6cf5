"""Presence of a system over the editions of a list, and why it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.operators.presence import edition_list, presence_bits
from fleetfootprint.operators.skew import hot_from_counts, join_per_key
from fleetfootprint.session import settle


SALTS = 64


def top_per_edition(rows: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each edition with their rank.

    A handful of editions holds the whole table, so the top ``n`` are taken per edition and reading task, then per
    edition and one of ``SALTS`` salts, then per edition: the last step sees at most ``n * SALTS`` rows of an edition,
    whatever ``n`` and however large the edition.
    """
    best = rows.withColumn("_task", F.spark_partition_id()).withColumn("_salt", F.pmod("_task", F.lit(SALTS)))
    for salt in (["_task", "_salt"], ["_salt"], []):
        window = Window.partitionBy(*groups, *salt).orderBy(*order)
        best = best.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return best.drop("_task", "_salt")


def presence_history(rows: DataFrame, key: str, edition: str) -> DataFrame:
    """One row per system: editions it appeared in (with counts), first and final edition.

    Rows are counted per (system, edition) before lists are built, so a list is as long as the number
    of editions, never as the number of rows.
    """
    appearances = rows.groupBy(key, edition).agg(F.count(F.lit(1)).alias("_n"))
    history = appearances.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(edition).alias("edition"), F.col("_n").alias("n")))).alias("appearances"),
        F.sum("_n").alias("n_appearances"),
        F.min(edition).alias("first_edition"),
        F.max(edition).alias("final_edition"),
    )
    return history.withColumn("editions", F.col("appearances.edition"))


def with_presence(rows: DataFrame, key: str, edition: str, hot: DataFrame | None = None) -> DataFrame:
    """Every row together with its system's edition list and final edition.

    The history is written once: its appearance counts tell which systems have so many rows that the join spreads them.
    """
    bits = presence_bits(rows, key, edition)
    listed = edition_list(F.col("bits"), F.col("first_edition"), F.col("final_edition")).alias("editions")
    history = settle(bits.select(key, listed, "n_appearances", "final_edition"), "history")
    hot = hot_from_counts(history, key, "n_appearances") if hot is None else hot
    return join_per_key(rows, history, key, hot)


def rank_thresholds(ranked: DataFrame, rank: str, n: int, edition: str, metric: str) -> DataFrame:
    """Metric of the n-th system of each edition, keyed by the edition half a year before it.

    A handful of editions would make a very uneven shuffle key for the systems; as a written table its size is known,
    so Spark broadcasts it while it is small.
    """
    thresholds = (
        ranked.filter(F.col(rank) == n)
        .groupBy((F.col(edition) - 0.5).alias("final_edition"))
        .agg(F.max(metric).alias("threshold"))
    )
    return settle(thresholds, "thresholds")


def next_thresholds(moments: DataFrame, thresholds: DataFrame, moment: str = "final_edition") -> DataFrame:
    """``moment`` and ``threshold``: for each of ``moments`` the threshold of the first list after it.

    ``thresholds`` is keyed as ``rank_thresholds`` keys it, half a year before the list, so a list decides on what left at
    its key or earlier, however large the gap to the list before. Moments without a later list have no threshold; a NULL moment has none.
    Both sides are points in time of lists, made distinct before they meet, so the pass over time sees one row per moment and list, never a system.
    """
    asked = moments.select(F.col(moment).alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    rows = asked.withColumns({"threshold": F.lit(None).cast(dict(thresholds.dtypes)["threshold"]), "_is_list": F.lit(False)})
    lists = thresholds.select(F.col("final_edition").alias("_at"), "threshold", F.lit(True).alias("_is_list"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_at"), F.desc("_is_list")).rowsBetween(Window.unboundedPreceding, 0)
    # a list may have no threshold of its own, being shorter; it decides all the same, by having none
    carried = F.last(F.when(F.col("_is_list"), F.struct("threshold")), ignorenulls=True).over(later)
    found = rows.unionByName(lists).withColumn("_next", carried).filter(~F.col("_is_list"))
    return found.select(F.col("_at").alias(moment), F.col("_next.threshold").alias("threshold"))


def exit_label(metric: Column, threshold: Column) -> Column:
    """Overtaken by the next edition's n-th system, or taken off the list for another reason."""
    return F.when(metric < threshold, "Dropped").otherwise("Removed")


def with_exit_reason(
    present: DataFrame, thresholds: DataFrame, metric: str, max_edition: float, keep_active: bool = False, as_of: bool = False
) -> DataFrame:
    """Label each row of a frame that carries ``final_edition``; systems still listed are left out
    (or labelled ``Active``). With ``as_of`` the first list after a system's last one decides, also where editions are missing.
    """
    if as_of:
        thresholds = settle(next_thresholds(present, thresholds), "next-thresholds")
    reason = exit_label(F.col(metric), F.col("threshold"))
    left = F.col("final_edition") < max_edition
    if keep_active:
        reason = F.when(left, reason).otherwise("Active")
    else:
        present = present.filter(left)
    return present.join(thresholds, "final_edition", "left").withColumn("exit_reason", reason)
