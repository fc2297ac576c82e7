"""Streaming operators. Every function takes a static or a streaming DataFrame unless it says otherwise."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import melt, number, numeric_columns
from ..operators.histogram import bin_index
from ..operators.materialise import ensure_checkpoint_dir

WATERMARK = "10 minutes"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream with what is available now and return the sink as a table.

    ``append`` writes files; other modes replace a snapshot per batch. Both live next to the stream's
    checkpoint in the shared folder.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    out = f"{base}/out"
    if mode == "append":
        query = writer.format("parquet").start(out)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_counted(stream: DataFrame, batch_seconds: float = 0.2) -> tuple[DataFrame, dict[str, int]]:
    """``run_to_table`` in append mode with what the stream's progress says: input_rows, late_rows (dropped behind the
    watermark) and duplicate_rows (dropped as repeated).

    Late rows are counted as the stateful operator meets them; before an aggregate, rows of one group and batch are one. The
    progress of every batch is read while the stream runs, because Spark keeps only the last hundred.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    out = f"{base}/out"
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(out)
    seen: dict[int, dict[str, int]] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(batch_seconds)
        for p in query.recentProgress:
            operators = p.stateOperators
            seen[p.batchId] = {
                "input_rows": p.numInputRows, "late_rows": sum(o.numRowsDroppedByWatermark for o in operators),
                "duplicate_rows": sum(int(o.customMetrics.get("numDroppedDuplicateRows", 0)) for o in operators)}
    counts = {k: sum(p[k] for p in seen.values()) for k in ("input_rows", "late_rows", "duplicate_rows")}
    return spark.read.schema(stream.schema).parquet(out), counts


def distinct_updates(updates: DataFrame, id_cols: Sequence[str] = ("update_id",), watermark: str = WATERMARK) -> DataFrame:
    """Updates without those that repeat an id. A stream remembers an id for the watermark's delay after its time, so state
    stays bounded, and forgets it then; a batch looks at all rows. Of equal ids any one row stays."""
    if not updates.isStreaming:
        return updates.dropDuplicates(list(id_cols))
    return updates.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(id_cols))


def stream_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Running statistics per column with quantiles from a mergeable sketch (complete or update mode)."""
    cols = numeric_columns(df, cols)
    v = F.col("value")
    rows = melt(df, [], {c: {"value": number(c)} for c in cols})
    agg = rows.groupBy("col").agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v).alias("_k"),
    )
    q = lambda p: F.kll_sketch_get_quantile_double("_k", F.lit(p))
    return agg.select("col", "count", "sum", "mean", "std", "min", "max", q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"))


def progress_latest(updates: DataFrame) -> DataFrame:
    """Latest state per validation: percent done and the time left at the average pace.

    ``updates``: validation_id, ts, models_completed, models_total, elapsed_seconds.
    """
    last = F.max_by(F.struct("status", "models_completed", "models_total", "elapsed_seconds", "ts"), F.struct("ts", "update_id"))
    agg = updates.groupBy("validation_id").agg(last.alias("_l"))
    done, total = F.col("_l.models_completed"), F.col("_l.models_total")
    pace = F.col("_l.elapsed_seconds") / done
    return agg.select(
        "validation_id", F.col("_l.status").alias("status"), F.col("_l.ts").alias("ts"),
        F.try_divide(100.0 * done, total).alias("progress_percent"),
        F.when(done > 0, pace * (total - done)).otherwise(0.0).alias("eta_seconds"),
    )


def rate_windows(events: DataFrame, width: str = "1 minute", keys: Sequence[str] = ("user_id", "endpoint"), watermark: str = WATERMARK) -> DataFrame:
    """Requests per key and tumbling window. As a stream, a window is emitted once the watermark passes its end."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    agg = source.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("request_count"))
    return agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "request_count")


def drift_monitor(events: DataFrame, value: str, edges: tuple[float, float], baseline: Sequence[float], width: str = "1 day", alert: float = 0.2) -> DataFrame:
    """Total-variation distance of each window's histogram from the baseline shares, with an alert flag.

    One aggregate per window holds all bins, so the same plan runs on batches and on streams.
    """
    bins = len(baseline)
    source = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    lo, hi = edges
    inside = F.least(F.greatest(number(value), F.lit(lo)), F.lit(hi))  # values beyond the baseline fall into the outer bins
    b = bin_index(inside, F.lit(lo), F.lit(hi), bins)
    agg = source.select("ts", b.alias("_b")).groupBy(F.window("ts", width)).agg(
        F.count("_b").alias("n"), *[F.count_if(F.col("_b") == i).alias(f"_n{i}") for i in range(bins)]
    )
    gap = sum((F.abs(F.try_divide(f"_n{i}", "n") - F.lit(float(p))) for i, p in enumerate(baseline)), F.lit(0.0)) / 2.0
    return agg.select(F.col("window.start").alias("window_start"), "n", gap.alias("distance"), (gap > alert).alias("alert"))


def histogram_baseline(df: DataFrame, value: str, bins: int = 20) -> tuple[tuple[float, float], list[float]]:
    """Range and bin shares of a reference dataset: ``bins`` numbers."""
    lo, hi = df.agg(F.min(number(value)), F.max(number(value))).head()
    counts = dict(df.select(bin_index(number(value), F.lit(lo), F.lit(hi), bins).alias("b")).groupBy("b").count().collect())
    total = sum(v for k, v in counts.items() if k is not None)
    return (lo, hi), [counts.get(i, 0) / total for i in range(bins)]


# --- sliding rate limit ---------------------------------------------------------------------------------


def _fold(times, state: list[float], limit: int, seconds: float) -> list[bool]:
    """Sequential rule: accept if fewer than ``limit`` accepted requests lie inside the window. Mutates ``state``."""
    out, start = [], 0
    for t in times:
        while start < len(state) and t - state[start] >= seconds:
            start += 1
        ok = len(state) - start < limit
        if ok:
            state.append(t)
        out.append(ok)
    del state[:start]
    return out


def rate_violations(events: DataFrame, limit: int = 100, seconds: float = 60.0, key: str = "user_id", id_col: str = "event_id") -> DataFrame:
    """Whether each request of a log passes a sliding limit in which rejected requests do not count (batch).

    Only overloaded stretches need the sequential rule. Time is cut into blocks of one window length; a block
    in which every trailing count stays within the limit is accepted as a whole. A run of overloaded blocks is
    folded together with the calm block before it, which holds everything its first decision depends on.
    A key is never one group: its runs are independent.
    """
    base = events.select(key, id_col, "ts", F.unix_micros("ts").alias("_us"))
    span = int(seconds * 1_000_000)
    own = base.withColumn("_block", F.expr(f"_us div {span}"))
    # every row also visits the next block, where it may still lie inside a trailing window
    seen = own.withColumn("_at", F.explode(F.array(F.col("_block"), F.col("_block") + 1)))
    trailing = Window.partitionBy(key, "_at").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = seen.withColumn("_n", F.count(F.lit(1)).over(trailing)).filter(F.col("_at") == F.col("_block"))
    hot = counted.groupBy(key, "_block").agg((F.max("_n") > limit).alias("_hot")).filter("_hot").select(key, "_block")
    # islands of consecutive hot blocks; one row per overloaded block and key
    order = Window.partitionBy(key).orderBy("_block")
    runs = hot.withColumn("_run", F.col("_block") - F.row_number().over(order))
    entry = runs.groupBy(key, "_run").agg((F.min("_block") - 1).alias("_block")).withColumn("_seed", F.lit(True))
    members = runs.withColumn("_seed", F.lit(False)).unionByName(entry)
    work = own.join(members, [key, "_block"])
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    # rows arrive sorted and are folded one by one; the state is at most ``limit`` times
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for pdf in batches:
            allowed = []
            for group, t, seed in zip(zip(pdf[key], pdf["_run"]), pdf["_us"], pdf["_seed"]):
                if group != current:
                    current, state = group, []
                if seed:
                    state.append(t)
                    allowed.append(True)
                else:
                    allowed += _fold([t], state, limit, span)
            pdf["allowed"] = allowed
            yield pdf.loc[~pdf["_seed"], [id_col, "allowed"]]

    sorted_runs = work.repartition(F.col(key), F.col("_run")).sortWithinPartitions(key, "_run", "_us", id_col)
    judged = sorted_runs.select(key, "_run", "_us", "_seed", id_col).mapInPandas(fold, f"{id_col} {kind[id_col]}, allowed boolean")
    return base.join(judged, id_col, "left").select(key, id_col, "ts", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def rate_limiter_stream(events: DataFrame, limit: int = 100, seconds: float = 60.0, key: str = "user_id", id_col: str = "event_id") -> DataFrame:
    """The same rule on a stream: per key, the state is the accepted times of the last window."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    span = int(seconds * 1_000_000)

    def judge(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["_us", id_col])  # one micro-batch of one key
        rows["allowed"] = _fold(rows["_us"].tolist(), accepted, limit, span)
        state.update((accepted,))
        yield rows[[key, id_col, "ts", "allowed"]]

    prepared = events.select(key, id_col, "ts", F.unix_micros("ts").alias("_us"))
    return prepared.groupBy(key).applyInPandasWithState(
        judge,
        f"{key} {kind[key]}, {id_col} {kind[id_col]}, ts timestamp, allowed boolean",
        "accepted array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLimit(StatefulProcessor):
    """Judges the requests of one key in the order of their times once the watermark has passed them.

    State: requests that wait for the watermark, and the accepted times of the last window. A timer wakes the key when its
    first waiting request is due; another clears what is left when the window of the last accepted request has passed.
    """

    def __init__(self, limit: int, span: int, key: str, id_col: str, id_type: str):
        self.limit, self.span, self.key, self.id_col, self.id_type = limit, span, key, id_col, id_type

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, id {self.id_type}")
        self.accepted = handle.getListState("accepted", "us long")

    def handleInputRows(self, key, rows, timerValues):
        # a key that is only woken up comes with an empty frame
        new = [(int(us), i) for pdf in rows if len(pdf) for us, i in zip(pdf["us"].tolist(), pdf[self.id_col].tolist())]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(us for us, _ in new) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        accepted = [us for (us,) in self.accepted.get()] if self.accepted.exists() else []
        due, rest = [w for w in waiting if w[0] < passed], [w for w in waiting if w[0] >= passed]
        allowed = _fold([us for us, _ in due], accepted, self.limit, self.span)
        accepted = [us for us in accepted if us > passed - self.span]
        for state, values in ((self.waiting, rest), (self.accepted, [(us,) for us in accepted])):
            if values:
                state.put(values)
            else:
                state.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif accepted:
            self.handle.registerTimer((accepted[-1] + self.span) // 1000 + 1)
        if due:
            times = pd.to_datetime([us for us, _ in due], unit="us", utc=True).tz_localize(None)
            yield pd.DataFrame({self.key: [key[0]] * len(due), self.id_col: [i for _, i in due], "ts": times, "allowed": allowed})

    def close(self) -> None:
        pass


def ordered_limiter_stream(events: DataFrame, limit: int = 100, seconds: float = 60.0, delay: str = WATERMARK, key: str = "user_id", id_col: str = "event_id") -> DataFrame:
    """The sliding limit on a stream whose rows come late by up to ``delay``: the answers of the batch, in whatever order rows arrive.

    A request is judged once the watermark has passed its time, so requests less than ``delay`` behind the last one wait; rows
    later than the watermark are dropped and counted by ``run_counted``. State of a key goes when its window has passed. Needs
    the RocksDB state store: run it inside ``with rocksdb_state(spark)``.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    span = int(seconds * 1_000_000)
    prepared = events.withWatermark("ts", delay).select(key, id_col, "ts", F.unix_micros("ts").alias("us"))
    return prepared.groupBy(key).transformWithStateInPandas(
        SlidingLimit(limit, span, key, id_col, kind[id_col]), f"{key} {kind[key]}, {id_col} {kind[id_col]}, ts timestamp, allowed boolean", "append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
