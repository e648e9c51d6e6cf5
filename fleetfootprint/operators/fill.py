"""Order-aware aggregation and filling of missing values within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.operators.skew import hot_keys
from fleetfootprint.session import settle


def first_value(value: Column, order: Column, where: Column | None = None) -> Column:
    """Value in the first row by ``order``, NULL if that row has none."""
    return F.min_by(value, order if where is None else F.when(where, order))


def first_known(value: Column, order: Column, where: Column | None = None) -> Column:
    """First non-null value by ``order``: an aggregate that combines before the shuffle."""
    known = value.isNotNull() if where is None else where & value.isNotNull()
    return F.min_by(value, F.when(known, order))


def first_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key holding the first non-null value of each column in row order."""
    return df.groupBy(key).agg(*[first_known(F.col(c), F.col(order)).alias(c) for c in columns])


def group_fill(
    df: DataFrame, key: str, order: str, columns: list[str], hot: DataFrame | None = None
) -> DataFrame:
    """Forward, then backward fill of ``columns`` within each key.

    Rows without an order come first, and rows without a key are a group. Where a key is hot (``hot``, by default
    ``hot_keys``) the table is filled by ``scan_fill``, else each key in one task.
    """
    hot = hot_keys(df, key) if hot is None else hot
    if hot.isEmpty():
        return _fill_pieces(df, [key], [order], columns)
    return scan_fill(df, key, order, columns)


def scan_fill(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``group_fill`` as a scan: the same work for every key, however its rows are spread.

    The table is cut by range over key and order, so a key has as many pieces as its rows need. Only the first and the last key of a
    piece can go on in another one; these keys, fewer than there are pieces, have a summary row per piece, from which a piece takes
    what it cannot answer itself: the last value of an earlier piece, else the first one of a later. Rows that tie in the order are told apart by
    a hash of the row, so reruns agree and a large tie is cut as well.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    cut = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(key, order, "_tie")
    cut = settle(cut.withColumn("_piece", F.spark_partition_id()), "pieces")

    ends = cut.groupBy("_piece").agg(F.min(F.struct(key)).alias("_low"), F.max(F.struct(key)).alias("_high"))
    ends = ends.select("_piece", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_end"))
    goes_on = ends.groupBy(F.col("_end")[key].alias("_open_key")).agg(F.count(F.lit(1)).alias("_pieces")).filter("_pieces > 1")
    goes_on = settle(goes_on.select("_open_key"), "open-keys")

    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col("_tie").alias("tie"))
    summary = (
        cut.join(goes_on, F.col(key).eqNullSafe(F.col("_open_key")), "left_semi")
        .groupBy(key, "_piece")
        .agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}") for c in columns],
            *[first_known(F.col(c), place).alias(f"_first_{c}") for c in columns],
        )
    )
    by_piece = Window.partitionBy(key).orderBy("_piece")
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = settle(
        summary.select(
            F.col(key).alias("_carried_key"),
            F.col("_piece").alias("_carried_piece"),
            *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns],
            # used only where neither this piece nor an earlier one has a value: then the first known is in a later piece
            *[F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_after_{c}") for c in columns],
        ),
        "carried",
    )
    same = F.col(key).eqNullSafe(F.col("_carried_key")) & (F.col("_piece") == F.col("_carried_piece"))
    with_carried = cut.join(carried, same, "left")
    return _fill_pieces(with_carried, [key, "_piece"], [order, "_tie"], columns, carry=True).select(*df.columns)


def _fill_pieces(df: DataFrame, group: list[str], order: list[str], columns: list[str], carry: bool = False) -> DataFrame:
    # A row with nothing known before it takes the first known value of the whole group, so both frames
    # cost one step per row; a frame from the current row to the end would cost one pass per row.
    ordered = Window.partitionBy(*group).orderBy(*order)
    back = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {}
    for c in columns:
        options = [F.last(c, ignorenulls=True).over(back)]
        if carry:
            options.append(F.col(f"_before_{c}"))
        options.append(F.first(c, ignorenulls=True).over(whole))
        if carry:
            options.append(F.col(f"_after_{c}"))
        filled[c] = F.coalesce(*options)
    return df.withColumns(filled)
