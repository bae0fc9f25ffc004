"""Names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def others(frame: DataFrame, *names: str) -> list[str]:
    """The columns that have none of ``names``, in either case."""
    gone = {n.lower() for n in names}
    return [c for c in frame.columns if c.lower() not in gone]
