"""Completeness rules: the first that fails names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]], ok: str = "OK") -> Column:
    """The name of the first rule whose condition holds; a condition that is null doesn't hold."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules], F.lit(ok))


def missing_columns(rows: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Required columns that a table lacks, from its schema alone."""
    return sorted(set(wanted) - set(rows.columns))


def conform(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are null, others go."""
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("double").alias(c) for c in wanted])
