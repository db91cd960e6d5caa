"""Column names that a caller's table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that is no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out
