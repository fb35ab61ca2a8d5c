"""Names of helper columns that clash with none of a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores behind it as it takes. Spark's names don't tell upper from lower case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
