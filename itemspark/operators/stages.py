"""Evaluate expensive columns once.

The optimizer merges neighbouring projections and pushes filters through them, which copies a long
expression into every place that uses it. Columns produced by a one-row generator are plain attributes
afterwards: nothing above can pull their expressions up, and no shuffle is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add (or replace) columns, each evaluated exactly once per row."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
