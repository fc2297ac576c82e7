"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Aggregates wider than this are split so the generated method stays under the JVM limit.
MAX_EXPRESSIONS = 400

# Largest aggregate that may travel through the driver to become a broadcast relation.
SMALL_ROWS = 50_000


def numeric_columns(df: DataFrame, target_columns: Sequence[str] | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, or the user's choice checked against the schema."""
    skip = set(exclude)
    if target_columns is not None:
        missing = [c for c in target_columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the dataset: {missing}")
        return [c for c in target_columns if c not in skip]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def select_numeric(df: DataFrame, target_columns: Sequence[str] | None = None) -> DataFrame:
    """Keep only the numeric columns."""
    return df.select(*numeric_columns(df, target_columns))


def number(col: str | Column) -> Column:
    """Double value of a column; NaN counts as missing."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c), c)


def row_text(cols: Sequence[str]) -> Column:
    """One text per row that differs wherever a value differs: fields joined by ``|``, with ``|`` and ``\\`` escaped and NULL as ``\\N``."""
    escaped = [F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in cols]
    return F.concat_ws("|", *[F.coalesce(e, F.lit("\\N")) for e in escaped])


def melt(df: DataFrame, keys: Sequence[str], per_column: dict[str, dict[str, Column]], name: str = "col") -> DataFrame:
    """Turn per-column expressions into rows: ``{column: {field: expr}}`` -> keys, name, fields."""
    rows = [F.struct(F.lit(c).alias(name), *[e.alias(f) for f, e in fields.items()]) for c, fields in per_column.items()]
    return df.select(*keys, F.inline(F.array(*rows)))


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """Materialise an aggregate as a local relation if it has at most ``max_rows`` rows, else None."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def same_key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys that also matches null keys; the key columns are those of ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join with a per-key aggregate: broadcast when its size is checked, shuffle join otherwise. Null keys match."""
    local = checked_small(small, max_rows)
    right = small if local is None else F.broadcast(local)
    return same_key_join(big, right, on) if on else big.crossJoin(right)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """``c`` within bounds; NaN is NULL (Spark would order it above every bound)."""
    return F.least(F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.greatest(c, F.lit(lo))), F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.lit(hi)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; NULL where a side is constant (the built-in raises in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def wide_aggregate(df: DataFrame, keys: Sequence[str], exprs: Sequence[Column]) -> DataFrame:
    """One grouped aggregate, or several joined on the keys when it would be too wide."""
    parts = [exprs[i : i + MAX_EXPRESSIONS] for i in range(0, len(exprs), MAX_EXPRESSIONS)]
    out = None
    for part in parts:
        agg = df.groupBy(*keys).agg(*part)
        if out is None:
            out = agg
        else:
            out = same_key_join(out, agg, keys) if keys else out.crossJoin(agg)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row work on a scan with few partitions (a small file with one row group).

    A scan that already has enough partitions, or an input that was shuffled, is left as it is.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
