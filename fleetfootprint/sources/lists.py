"""Ranking lists: one CSV or parquet export per edition, headers differing by era."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfootprint.functions.calendar import edition_label, label_to_edition
from fleetfootprint.functions.power import efficiency_ratio, relative_gap, repaired_rpeak
from fleetfootprint.functions.text import entity_key, normal_country
from fleetfootprint.operators.lifecycle import top_per_edition
from fleetfootprint.operators.reshape import union_all
from fleetfootprint.schemas import (
    EFFICIENCY_COLUMNS,
    EFFICIENCY_ERAS,
    EFFICIENCY_LISTING,
    LIST_LENGTH,
    PERFORMANCE_COLUMNS,
    PERFORMANCE_ERAS,
    PERFORMANCE_LISTING,
    Era,
)
from fleetfootprint.sources.list_source import FORMAT, NAMED_EDITION, RankingLists

HEADER_READERS = 16


def edition_number(year: int, month: int) -> float:
    return year + (0.5 if month == 11 else 0.0)


def era_value(edition: Column, eras: tuple[Era, ...], target: str) -> Column:
    """Value of ``target`` when rows of several eras share one frame: source column and factor by edition."""
    value = F.lit(None).cast("double")
    for era in eras:
        if target in era.columns:
            source, factor = era.columns[target]
            in_era = (edition >= era.first) & (edition < era.before)
            value = F.when(in_era, F.col(f"`{source}`").cast("double") * factor).otherwise(value)
    return value


def with_derived(rows: DataFrame, listing: str) -> DataFrame:
    """Key, repaired peak, ratios and tags of a list; the key uses the country as listed."""
    rows = rows.withColumns(
        {
            "entity_id": entity_key(*[F.col(c) for c in ("computer", "site", "name", "country", "year")]),
            "rpeak": repaired_rpeak(F.col("rmax"), F.col("rpeak")),
            "listing": F.lit(listing),
        }
    )
    return rows.withColumns(
        {
            "perf_ratio": efficiency_ratio(F.col("rmax"), F.col("rpeak")),
            "relative_gap": relative_gap(F.col("rmax"), F.col("rpeak")),
            "country": normal_country(F.col("country")),
            "edition": label_to_edition(F.col("rank_year")),
        }
    )


def _hadoop_path(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def edition_paths(spark: SparkSession, folder: str, first: tuple[int, int], last: tuple[int, int]) -> dict[tuple[int, int], str]:
    """Paths of the editions ``first`` to ``last`` (year, month) in a folder, which is listed once."""
    system, name = _hadoop_path(spark, folder)
    found = {}
    for status in system.listStatus(name):
        named = NAMED_EDITION.search(status.getPath().getName())
        if named and first <= (int(named[1]), int(named[2])) <= last:
            found[int(named[1]), int(named[2])] = status.getPath().toString()
    return dict(sorted(found.items()))


def _by_header(spark: SparkSession, paths: dict[tuple[int, int], str], fmt: str) -> list[tuple[DataFrame, dict[tuple[int, int], str]]]:
    """One scan per distinct header, with the paths it reads: files of an era may still order or add columns differently."""
    reader = spark.read.format(fmt).option("header", True)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = pool.map(lambda path: tuple(reader.load(path).columns), paths.values())
    groups: dict[tuple[str, ...], dict[tuple[int, int], str]] = {}
    for (edition, path), header in zip(paths.items(), headers):
        groups.setdefault(header, {})[edition] = path
    return [(reader.load(list(same.values())), same) for same in groups.values()]


def _edition_of_path(spark: SparkSession, paths: dict[tuple[int, int], str]) -> Column:
    """Label of the edition whose path (a file or a folder) a row was read from."""
    plain = lambda path: re.sub(r"^file:/+", "file:/", path)
    read = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    label = F.lit(None).cast("string")
    for (year, month), path in paths.items():
        system, name = _hadoop_path(spark, path)
        full = plain(system.makeQualified(name).toUri().toString())
        label = F.when((read == full) | read.startswith(full + "/"), edition_label(F.lit(year), F.lit(month))).otherwise(label)
    return label


def _mapped(raw: DataFrame, paths: dict[tuple[int, int], str], era: Era, fixed: dict[str, tuple[str, str]]) -> DataFrame:
    """Common column names; a header is found whatever its case. Columns of the era must be there, others may be NULL."""
    by_name = {c.lower(): c for c in raw.columns}
    absent = [header for header, _ in era.columns.values() if header.lower() not in by_name]
    if absent:
        raise ValueError(f"columns {absent} of the editions from {era.first} are not in the header of {sorted(paths.values())}")

    def source(header: str) -> Column:
        return F.col(f"`{by_name[header.lower()]}`") if header.lower() in by_name else F.lit(None)

    columns = [_edition_of_path(raw.sparkSession, paths).alias("rank_year")]
    columns += [source(header).try_cast(kind).alias(target) for target, (header, kind) in fixed.items()]
    columns += [(source(h).try_cast("double") * factor).alias(target) for target, (h, factor) in era.columns.items()]
    return raw.select(*columns)


def _read_list(
    spark: SparkSession, paths: dict[tuple[int, int], str], eras: tuple[Era, ...], fixed: dict, listing: str, n: int, fmt: str
) -> DataFrame:
    known = lambda era, edition: era.first <= edition_number(*edition) < era.before
    strange = [edition for edition in paths if not any(known(era, edition) for era in eras)]
    if strange or not paths:
        raise ValueError(f"editions {strange} of {listing} are outside the known eras" if paths else f"no edition of {listing}")
    frames = []
    for era in eras:
        chosen = {edition: path for edition, path in sorted(paths.items()) if known(era, edition)}
        frames += [_mapped(raw, same, era, fixed) for raw, same in _by_header(spark, chosen, fmt)]
    rows = union_all(frames)
    rows = rows.withColumn("rank", F.col("rank").cast("long"))
    rows = top_per_edition(rows, ["rank_year"], [F.col("rank"), F.col("computer"), F.col("site")], n, "_row").drop("_row")
    return with_derived(rows, listing)


def read_performance_lists(
    spark: SparkSession, paths: dict[tuple[int, int], str], n: int = LIST_LENGTH, fmt: str = "csv"
) -> DataFrame:
    """Performance lists by (year, month) -> path, first ``n`` rows of each."""
    return _read_list(spark, paths, PERFORMANCE_ERAS, PERFORMANCE_COLUMNS, PERFORMANCE_LISTING, n, fmt).withColumn(
        "accel_present", F.col("accel_name").isNotNull()
    )


def read_efficiency_lists(
    spark: SparkSession, paths: dict[tuple[int, int], str], n: int = LIST_LENGTH, fmt: str = "csv"
) -> DataFrame:
    """Efficiency lists; their accelerator column only tells whether there is one."""
    rows = _read_list(spark, paths, EFFICIENCY_ERAS, EFFICIENCY_COLUMNS, EFFICIENCY_LISTING, n, fmt)
    return rows.withColumn("accel_present", F.col("accel_name").isNotNull()).drop("accel_name")


def read_lists(
    spark: SparkSession, folder: str, listing: str = PERFORMANCE_LISTING, first: float = 0.0, last: float = 9999.0, n: int = LIST_LENGTH
) -> DataFrame:
    """First ``n`` rows of each edition in a folder, by the data source: headers and title lines are found by the tasks that read the files."""
    spark.dataSource.register(RankingLists)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(FORMAT).option("listing", listing).option("pushdown", pushdown)
    rows = reader.option("first", first).option("last", last).load(folder).drop("edition", "listing")
    rows = rows.withColumn("rank", F.col("rank").cast("long"))
    rows = top_per_edition(rows, ["rank_year"], [F.col("rank"), F.col("computer"), F.col("site")], n, "_row").drop("_row")
    rows = with_derived(rows, listing).withColumn("accel_present", F.col("accel_name").isNotNull())
    return rows if listing == PERFORMANCE_LISTING else rows.drop("accel_name")


def read_editions(
    spark: SparkSession,
    performance: dict[tuple[int, int], str],
    efficiency: dict[tuple[int, int], str],
    n: int = LIST_LENGTH,
    fmt: str = "csv",
) -> DataFrame:
    """Both listings as one table, one row per (system, edition, listing), with a row order.

    ``row_seq`` puts performance rows first, then editions in order, then ranks.
    """
    frames = []
    if performance:
        frames.append(read_performance_lists(spark, performance, n, fmt))
    if efficiency:
        frames.append(read_efficiency_lists(spark, efficiency, n, fmt))
    return both_listings(frames)


def both_listings(frames: list[DataFrame]) -> DataFrame:
    """Rows of the listings as one table with all columns and ``row_seq``."""
    rows = union_all(frames)
    shared = {target: kind for target, (_, kind) in PERFORMANCE_COLUMNS.items()}
    shared |= {target: "double" for target in EFFICIENCY_ERAS[0].columns} | {"rank": "long"}
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in shared.items() if c not in rows.columns})
    # 15 bits hold any half-year up to the year 9999, 46 bits any rank below 7 * 10^13
    seq = (
        F.when(F.col("listing") == PERFORMANCE_LISTING, 0).otherwise(1).cast("long") * 2**61
        + (F.col("edition") * 2).cast("long") * 2**46
        + F.coalesce("rank", F.lit(0).cast("long"))
    )
    return rows.withColumn("row_seq", seq)
