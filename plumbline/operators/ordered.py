"""Order-dependent work without a single-task window.

The order key is cut at literal quantile points, so every (group, bucket) holds a bounded share of the
whole input no matter how large one group is. Positions inside a bucket come from a partitioned window;
positions of buckets come from a prefix sum over the small table of bucket sizes.
"""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import number, same_key_join

INF = float("inf")
#: Stand for null and for minus infinity, so that both can be frequent values like any other.
NULL_PLACE = -sys.float_info.max
LEAST_PLACE = math.nextafter(NULL_PLACE, 0.0)


def default_buckets(df: DataFrame, per: int = 1) -> int:
    """About two buckets per shuffle partition, shared by ``per`` columns."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, math.ceil(2 * partitions / max(1, per)))


def order_numbers(df: DataFrame, name: str) -> list[Column]:
    """Doubles that, compared one after another, order rows as the column does (nulls first, NaN last).

    A string counts by six bytes at a time, from where the least and the greatest string part, and last by its length.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        ends = df.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.max(F.octet_length(name)).alias("length")).head()
        shared = len(os.path.commonprefix([(ends["low"] or "").encode(), (ends["high"] or "").encode()]))
        body = F.encode(F.col(name), "utf-8")
        at = range(shared + 1, max(shared + 1, ends["length"] or 0) + 1, 6)
        values = [F.conv(F.rpad(F.hex(F.substring(body, i, 6)), 12, "0"), 16, 10).cast("double") for i in at]
        values.append(F.octet_length(name).cast("double"))
    elif isinstance(kind, T.DateType):
        values = [F.datediff(F.col(name), F.lit("1970-01-01").cast("date")).cast("double")]
    elif isinstance(kind, (T.NumericType, T.TimestampType, T.BooleanType)):
        values = [F.col(name).cast("double")]
    elif isinstance(kind, T.TimestampNTZType):
        values = [F.col(name).cast("timestamp").cast("double")]
    else:
        raise TypeError(f"cannot order by {name}: {kind.simpleString()}")
    return [F.coalesce(F.when(F.isnan(v), F.lit(INF)).otherwise(F.greatest(v, F.lit(LEAST_PLACE))), F.lit(NULL_PLACE)) for v in values]


def quantile_edges(df: DataFrame, keys: dict[str, Column], n: int) -> dict[str, tuple[list[float], list[float]]]:
    """Literal cut points per key, and the values so frequent that they span several quantiles."""
    probs = [i / n for i in range(1, n)]
    accuracy = max(10_000, 20 * n)
    aggs = [F.percentile_approx(c, probs, accuracy).alias(k) for k, c in keys.items()]
    row = df.agg(*aggs).head()
    out = {}
    for k in keys:
        points = [p for p in (row[k] or []) if p is not None and math.isfinite(p)]
        heavy = sorted(v for v, times in Counter(points).items() if times > 1)
        # a heavy value gets a bucket of its own: [v, next double)
        cuts = sorted(set(points) | {math.nextafter(v, INF) for v in heavy})
        out[k] = (cuts, heavy)
    return out


def bucketize(df: DataFrame, columns: dict[str, str], cuts: dict[str, list[float]]) -> DataFrame:
    """Add a bucket column per input column by binary search over literal cut points."""
    live = {c: b for c, b in columns.items() if cuts[c]}
    for c, b in columns.items():
        if c not in live:
            df = df.withColumn(b, F.lit(0.0))
    if live:
        df = Bucketizer(
            splitsArray=[[-INF, *cuts[c], INF] for c in live],
            inputCols=list(live),
            outputCols=list(live.values()),
            handleInvalid="keep",
        ).transform(df)
    return df


def with_order_bucket(df: DataFrame, order_cols: Sequence[str], out: str = "_bucket", n_buckets: int | None = None) -> DataFrame:
    """Add a bucket number that is non-decreasing in ``order_cols`` and bounded in size.

    A value frequent enough to fill a bucket is cut again by the next of the columns' order numbers.
    """
    n = n_buckets or default_buckets(df)
    bucket, open_, most = F.lit(0).cast("long"), F.lit(True), 1
    keys = (key for name in order_cols for key in order_numbers(df, name))
    for key in keys:
        cuts, heavy = quantile_edges(df.filter(open_), {"k": key}, n)["k"]
        if most * (len(cuts) + 1) >= 1 << 62:  # no room for further digits
            break
        cut = bucketize(df.withColumn("_k", key), {"_k": "_b"}, {"_k": cuts})
        bucket, most = bucket * F.lit(len(cuts) + 1) + F.when(open_, F.col("_b")).otherwise(0.0).cast("long"), most * (len(cuts) + 1)
        df = cut.withColumn(out, bucket).withColumn("_open", open_ & F.col("_k").isin(heavy)).drop("_k", "_b")
        bucket, open_ = F.col(out), F.col("_open")
        if not heavy:
            break
    return df.withColumn(out, bucket).drop("_open")


def with_running_sums(
    df: DataFrame,
    order_cols: Sequence[str],
    sums: dict[str, Column],
    group_cols: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """Add inclusive running sums in ``order_cols`` order, inside each group if groups are given."""
    cut = with_order_bucket(df, order_cols, n_buckets=n_buckets)
    groups = list(group_cols)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumns({f"_in_{k}": F.sum(e).over(inside) for k, e in sums.items()})
    starts = bucket_starts(cut, groups, {f"_start_{k}": F.sum(e) for k, e in sums.items()})
    if groups:
        joined = same_key_join(ranked, starts, [*groups, "_bucket"])
    else:
        joined = ranked.join(F.broadcast(starts), "_bucket")  # one row per bucket
    return joined.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_start_{k}")).alias(k) for k in sums])


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str],
    out: str = "row_id",
    group_cols: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """Contiguous 0-based position in ``order_cols`` order, inside each group if groups are given.

    Ties are broken by the other columns in their order; rows that are still equal are interchangeable.
    """
    rest = [f.name for f in df.schema.fields if f.name not in (*order_cols, *group_cols) and "map<" not in f.dataType.simpleString()]
    counted = with_running_sums(df, [*order_cols, *rest], {out: F.lit(1)}, group_cols, n_buckets)
    return counted.withColumn(out, (F.col(out) - 1).cast("long"))


def bucket_starts(df: DataFrame, groups: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums of per-bucket totals; the window runs over bucket rows only."""
    sizes = df.groupBy(*groups, "_bucket").agg(*[e.alias(f"_t{k}") for k, e in totals.items()])
    parts = list(groups) or [F.lit(0)]
    before = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(k) for k in totals],
    )


def with_previous(df: DataFrame, group_cols: Sequence[str], index: str, value: str, out: str, offset: int = 1) -> DataFrame:
    """Value ``offset`` positions earlier in the same group, found by an equi-join on (group, position)."""
    groups = list(group_cols)
    earlier = df.select(*groups, (F.col(index) + offset).alias(index), F.col(value).alias(out))
    return df.join(earlier, [*groups, index], "left")


def ranked_values(
    df: DataFrame,
    cols: Sequence[str],
    weights: dict[str, Column] | None = None,
    keys: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """Distinct values per (keys, column) with weights, running weights, totals and the next value.

    Output: keys, col, value, ``w``, ``cum_w`` (inclusive), ``tot_w`` for every weight ``w``, next_value.
    Equal values are merged before the ordered step, so a value held by a third of all rows is one row.
    """
    weights = weights or {"n": F.lit(1)}
    names = list(weights)
    keys = list(keys)
    base = df.select(*keys, *[number(c).alias(c) for c in cols], *[w.cast("long").alias(f"_w_{k}") for k, w in weights.items()])
    n = n_buckets or default_buckets(df, len(cols))
    edges = quantile_edges(base, {c: F.col(c) for c in cols}, n)
    cut = bucketize(base, {c: f"_b_{c}" for c in cols}, {c: e[0] for c, e in edges.items()})
    rows = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"_b_{c}").cast("int").alias("_bucket"), F.col(c).alias("value")) for c in cols
    ])
    flat = cut.select(*keys, *[f"_w_{k}" for k in names], F.inline(rows)).filter(F.col("value").isNotNull())
    counts = flat.groupBy(*keys, "col", "_bucket", "value").agg(*[F.sum(f"_w_{k}").alias(k) for k in names])

    groups = [*keys, "col"]
    per_bucket = counts.groupBy(*groups, "_bucket").agg(
        *[F.sum(k).alias(f"_t_{k}") for k in names], F.min("value").alias("_first")
    )
    ahead = Window.partitionBy(*groups).orderBy("_bucket")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = per_bucket.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in names],
        *[F.sum(f"_t_{k}").over(whole).alias(f"tot_{k}") for k in names],
        F.lead("_first").over(ahead).alias("_next_first"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(
        *groups,
        "_bucket",
        "value",
        *names,
        *[F.sum(k).over(running).alias(f"_c_{k}") for k in names],
        F.lead("value").over(inside).alias("_next"),
    )
    joined = same_key_join(ranked, starts, [*groups, "_bucket"])
    return joined.select(
        *groups,
        "value",
        *names,
        *[(F.col(f"_c_{k}") + F.col(f"_s_{k}")).alias(f"cum_{k}") for k in names],
        *[f"tot_{k}" for k in names],
        F.coalesce("_next", "_next_first").alias("next_value"),
    )


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: dict[str, float],
    keys: Sequence[str] = (),
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles and the distinct count per (keys, column)."""
    ranked = ranked_values(df, cols, keys=keys) if ranked is None else ranked
    before = F.col("cum_n") - F.col("n")
    picks = []
    for name, p in probs.items():
        at = (F.col("tot_n") - 1) * F.lit(float(p))
        low = F.max(F.when(before <= F.floor(at), F.col("value")))
        high = F.max(F.when(before <= F.ceil(at), F.col("value")))
        part = F.first(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys, "col").agg(F.count(F.lit(1)).alias("unique"), F.first("tot_n").alias("count"), *picks)
