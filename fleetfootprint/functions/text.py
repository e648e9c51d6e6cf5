"""Keys, country names and other text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfootprint.schemas import COUNTRY_ALIASES


def entity_key(*parts: Column) -> Column:
    """md5 of the dash-joined parts; a missing part counts as the text ``nan``."""
    texts = [F.coalesce(p.cast("string"), F.lit("nan")) for p in parts]
    return F.md5(F.concat_ws("-", *texts))


def normal_country(country: Column, aliases: dict[str, str] = COUNTRY_ALIASES) -> Column:
    """Trimmed name with exact aliases replaced."""
    name = F.trim(country)
    result = name
    for alias, canonical in aliases.items():
        result = F.when(name == alias, canonical).otherwise(result)
    return result


def folded(name: Column) -> Column:
    """Case-folded join key."""
    return F.lower(name)


def unknown_if_missing(value: Column, label: str = "Unknown") -> Column:
    return F.coalesce(value, F.lit(label))


def null_if(value: Column, *markers: str) -> Column:
    """NULL where the text is one of the missing-value markers."""
    return F.when(~value.isin(*markers), value)
