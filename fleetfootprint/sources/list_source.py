"""Ranking lists as a data source: ``spark.read.format("ranking_lists").option("listing", "Top500").load(folder)``.

A partition is one file of one edition; the task that reads it finds its header, so files of an era may order or add
columns differently and nothing is opened while planning but the folder's list of names. Lists up to 2007 have a title line in front of the header;
it is skipped where it is there. Options:

* ``listing``: ``Top500`` (default) or ``Green500``
* ``first``, ``last``: editions to read, as half-years (2019.0 for June, 2019.5 for November)
* ``pushdown``: ``true`` to take conditions on ``edition`` as well, which Spark passes on only with
  ``spark.sql.python.filterPushdown.enabled``

Files are CSV, plain or compressed (by extension); an edition may be a file or a folder of files that Spark wrote, named by year and
month as ``top_2019_11.csv`` or ``edition=2019_11``. Any place that Arrow's file systems reach will do; for others,
``lists.read_editions`` reads by Spark's own CSV reader.

Defined cases: an empty file has no rows; a value that is no number is NULL in a column of numbers; other files of
the folder are left alone; an edition outside the known eras, or a file without its era's columns, is an error.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from fleetfootprint.schemas import (
    EFFICIENCY_COLUMNS,
    EFFICIENCY_ERAS,
    EFFICIENCY_LISTING,
    PERFORMANCE_COLUMNS,
    PERFORMANCE_ERAS,
    PERFORMANCE_LISTING,
    Era,
)

FORMAT = "ranking_lists"
# Editions appear in June and November; a file or folder is named by its year and month, e.g. top_2019_11.csv.
NAMED_EDITION = re.compile(r"(\d{4})_?(06|11)(?:\.[A-Za-z.]+)?$")
TITLED_UNTIL = 2007
KINDS = {PERFORMANCE_LISTING: (PERFORMANCE_ERAS, PERFORMANCE_COLUMNS), EFFICIENCY_LISTING: (EFFICIENCY_ERAS, EFFICIENCY_COLUMNS)}
TAGS = "rank_year string, edition double, listing string"


def columns_of(listing: str) -> dict[str, str]:
    """Column -> type of a listing's rows, after the tags."""
    eras, fixed = KINDS[listing]
    return {target: kind for target, (_, kind) in fixed.items()} | {target: "double" for target in eras[-1].columns}


def open_lines(path: str) -> Iterator[str]:
    """Lines of a text file, decompressed by its extension; a line break inside quotes stays with the reader of the lines."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with system.open_input_stream(name, compression="detect") as stream, io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="") as text:
        yield from text


def value_of(text: str | None, kind: str) -> str | float | int | None:
    """A cell in its column's type; NULL where it is empty or no such number."""
    text = (text or "").strip() if kind != "string" else text
    if not text:
        return None
    if kind == "string":
        return text
    try:
        number = float(text) if "_" not in text else None
    except ValueError:
        return None
    if kind == "double" or number is None:
        return number
    return int(number) if number.is_integer() and abs(number) < 2**31 else None


def parsed(lines: Iterable[str], edition: float, listing: str, path: str = "") -> Iterator[tuple]:
    """Rows of one list, from its header on, in the order of ``columns_of``."""
    eras, fixed = KINDS[listing]
    era = next((e for e in eras if e.first <= edition < e.before), None)
    if era is None:
        raise ValueError(f"edition {edition} of {listing} is outside the known eras")
    rows = csv.reader(lines)
    header = _header(rows, era, edition, path)
    if header is None:
        return
    places = [(header.get(source.lower()), kind, 1) for source, kind in fixed.values()]
    # a column of the era that is also a fixed one keeps the era's header
    own = {target: (header[source.lower()], "double", factor) for target, (source, factor) in era.columns.items()}
    chosen = dict(zip(fixed, places)) | own
    wanted = [chosen[target] for target in columns_of(listing)]
    label = f"{int(edition)}-{'11' if edition % 1 else '06'}"
    for row in rows:
        if not row:
            continue
        cells = []
        for at, kind, factor in wanted:
            value = value_of(row[at] if at is not None and at < len(row) else None, kind)
            cells.append(value * factor if kind == "double" and value is not None else value)
        yield (label, edition, listing, *cells)


def _header(rows: Iterator[list[str]], era: Era, edition: float, path: str) -> dict[str, int] | None:
    """Place of each column by lower-case name, from the first line that is not blank, or the second behind a title; None without any."""
    lines = []
    for line in rows:
        if not line:
            continue
        lines.append(line)
        found = {name.strip().lower(): at for at, name in reversed(list(enumerate(line)))}
        absent = [source for source, _ in era.columns.values() if source.lower() not in found]
        if not absent:
            return found
        if len(lines) > (edition < TITLED_UNTIL + 1):
            break
    if not lines:
        return None
    raise ValueError(f"columns {absent} of the editions from {era.first} are not in the header of {path}")


@dataclass
class ListFile(InputPartition):
    path: str
    edition: float


class ListReader(DataSourceReader):
    """Reads the editions within the limits, a partition a file."""

    def __init__(self, folder: str, listing: str, first: float, last: float) -> None:
        self.folder, self.listing, self.first, self.last = folder, listing, first, last

    def partitions(self) -> list[ListFile]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        scheme = self.folder[: len(self.folder) - len(base)] if self.folder.endswith(base) else ""
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            inside = info.path[len(base) :].strip("/").split("/")
            named = NAMED_EDITION.search(inside[0])
            if info.type != fs.FileType.File or not named or inside[-1][0] in "._":
                continue
            edition = int(named[1]) + (0.5 if named[2] == "11" else 0.0)
            if self.first <= edition <= self.last:
                found.append(ListFile(scheme + info.path, edition))
        return sorted(found, key=lambda f: (f.edition, f.path))

    def read(self, partition: ListFile) -> Iterator[tuple]:
        return parsed(open_lines(partition.path), partition.edition, self.listing, partition.path)


class PushingListReader(ListReader):
    """Also takes conditions on the edition, which Spark still checks itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            value = getattr(condition, "value", None)
            if value is not None and condition.attribute == ("edition",):
                if isinstance(condition, EqualTo):
                    low, high = value, value
                elif isinstance(condition, In):
                    low, high = min(value), max(value)
                elif isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
                    low, high = value, self.last
                elif isinstance(condition, (LessThan, LessThanOrEqual)):
                    low, high = self.first, value
                else:
                    low, high = self.first, self.last
                self.first, self.last = max(self.first, float(low)), min(self.last, float(high))
            yield condition


class RankingLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _listing(self) -> str:
        listing = self.options.get("listing", PERFORMANCE_LISTING)
        if listing not in KINDS:
            raise ValueError(f"listing {listing} is none of {list(KINDS)}")
        return listing

    def schema(self) -> str:
        return TAGS + "".join(f", {name} {kind}" for name, kind in columns_of(self._listing()).items())

    def reader(self, schema: StructType) -> ListReader:
        kind = PushingListReader if self.options.get("pushdown", "false").lower() == "true" else ListReader
        return kind(self.options["path"], self._listing(), float(self.options.get("first", "0")), float(self.options.get("last", "9999")))
