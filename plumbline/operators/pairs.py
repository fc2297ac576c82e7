"""Two datasets as one table with a side column, so a whole comparison is a grouped aggregate."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import numeric_columns

LARGEST = sys.float_info.max


def finite(c: Column) -> Column:
    """Missing and NaN become 0, infinities the largest finite double."""
    v = c.cast("double")
    return (
        F.when(v.isNull() | F.isnan(v), 0.0)
        .when(v == float("inf"), LARGEST)
        .when(v == float("-inf"), -LARGEST)
        .otherwise(v)
    )


def stack_pair(syn: DataFrame, orig: DataFrame, cols: Sequence[str] | None = None, validation_id: str | None = None) -> DataFrame:
    """Union of both sides on their common numeric columns: validation_id, side, columns.

    Columns are matched by name. ``validation_id`` names a column present on both sides when many pairs
    are compared at once; otherwise the single pair is called ``all``.
    """
    key = F.col(validation_id) if validation_id else F.lit("all")
    skip = {validation_id} if validation_id else set()
    wanted = numeric_columns(syn, cols, exclude=skip)
    common = [c for c in wanted if c in numeric_columns(orig, exclude=skip)]
    if not common:
        raise ValueError("the two datasets have no numeric column in common")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key.alias("validation_id"), F.lit(name).alias("side"), *[finite(F.col(c)).alias(c) for c in common])

    return side(syn, "syn").unionByName(side(orig, "orig"))


def trim_to_common(syn: DataFrame, orig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to their common numeric columns, cleaned; an empty side is an error."""
    if syn.isEmpty() or orig.isEmpty():
        raise ValueError("both datasets need at least one row")
    common = [c for c in numeric_columns(syn) if c in numeric_columns(orig)]
    if not common:
        raise ValueError("the two datasets have no numeric column in common")
    pick = [finite(F.col(c)).alias(c) for c in common]
    return syn.select(*pick), orig.select(*pick)


def pair_columns(pair: DataFrame) -> list[str]:
    return numeric_columns(pair, exclude=["validation_id", "side"])


def is_syn() -> Column:
    return F.when(F.col("side") == "syn", 1).otherwise(0)


def is_orig() -> Column:
    return F.when(F.col("side") == "orig", 1).otherwise(0)
