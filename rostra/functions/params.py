"""Parameters of queries: defaults, lists, and choices that can't name arbitrary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.schema import M7


def by_dtype(df: DataFrame, dtype: str | None = "") -> DataFrame:
    """Empty and ALL mean every type; anything else matches exactly."""
    return df.where(F.col("dtype") == dtype) if dtype and dtype != "ALL" else df


def measure(name: str | None) -> str:
    return name if name in M7 else "final_score"


def group_column(name: str | None) -> str:
    return "country" if name == "country" else "dtype"


def parts(text: str | None, separator: str) -> list[str]:
    return [x.strip() for x in (text or "").split(separator) if x.strip()]


def selection(chosen: list[str], least: int = 1, most: int | None = None) -> list[str]:
    """The chosen names, if there are as many as allowed."""
    if len(chosen) < least or most is not None and len(chosen) > most:
        raise ValueError(f"choose at least {least}" + (f" and at most {most}" if most else "") + f", not {len(chosen)}")
    return chosen


def toggled(chosen: list[str], name: str, least: int = 1, most: int | None = None) -> list[str]:
    """The selection after a choice of name: out if it was in, else in; unchanged where the number isn't allowed."""
    after = [x for x in chosen if x != name] if name in chosen else [*chosen, name]
    return after if len(after) >= least and (most is None or len(after) <= max(most, len(chosen))) else chosen
