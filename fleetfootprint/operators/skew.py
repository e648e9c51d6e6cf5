"""Hot keys: find them, and split the work of the groups they would otherwise overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.session import settle

# A key is hot above the rows one task handles with ease. Its pieces grow with its rows, so a piece never gets more
# than about PIECE_ROWS of them; tables of hot keys are joined without a hint, because their number is not bounded.
MIN_HOT_ROWS = 5_000_000
PIECE_ROWS = 1_000_000
MIN_PIECES = 8


def hot_from_counts(counts: DataFrame, key: str, rows: str, min_rows: int = MIN_HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """key and ``pieces`` of the keys whose count ``rows`` is above ``min_rows``; a NULL key is a key."""
    pieces = F.greatest(F.ceil(F.col(rows) / piece_rows).cast("int"), F.lit(MIN_PIECES))
    return settle(counts.filter(F.col(rows) > min_rows).select(key, pieces.alias("pieces")), "hot-keys")


def hot_keys(rows: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Keys with so many rows that one task should not take them all, with the number of pieces to cut them into."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return hot_from_counts(counts, key, "_rows", min_rows, piece_rows)


def with_pieces(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows with the ``_pieces`` of their key, NULL where it is not hot."""
    named = hot.select(F.col(key).alias("_hot_key"), F.col("pieces").alias("_pieces"))
    return rows.join(named, F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with a table that has one row per key, spreading each hot key over its pieces.

    The piece of a row is the number of the task that read it, so a retried task sends its rows to the
    same place, and copies of one row do not pile up. ``hot`` is ``hot_keys`` of the rows, if at hand.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(per_key, key)
    piece = F.coalesce(F.pmod(F.spark_partition_id(), F.col("_pieces")), F.lit(0))
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    spread_rows = with_pieces(rows, key, hot).withColumn("_piece", piece).drop("_pieces")
    spread_keys = with_pieces(per_key, key, hot).withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return spread_rows.join(spread_keys, [key, "_piece"]).drop("_piece")
