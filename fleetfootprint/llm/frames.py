"""Helpers for frames: strings that Arrow takes as they are, and column names that are free."""

from __future__ import annotations

import pandas as pd


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame`` with its string columns as Python objects, None where missing, so that each is one Arrow array."""
    for name in frame.columns:
        if isinstance(frame[name].dtype, pd.StringDtype):
            column = frame[name].astype(object)
            frame = frame.assign(**{name: column.where(column.notna(), None)})
    return frame


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to be none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
