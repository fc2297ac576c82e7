"""Reports, samples and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: row ids a report lists; all of them go to a table beside it (write_problem_rows).
LISTED_ROWS = 100


def build_report(decision: DataFrame, scores: DataFrame, top_rows: DataFrame | None = None, key: str = "validation_id") -> DataFrame:
    """Nested report row per validation: decision, dimension scores, and the first problem rows.

    ``top_rows`` is (validation_id, row_id, impact). The report counts all of them and lists the ids of the
    highest impact; ties go to the smaller id.
    """
    dims = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("dimensions"))
    out = decision.join(dims, key, "left")
    if top_rows is not None:
        best = Window.partitionBy(key).orderBy(F.desc("impact"), "row_id")
        first = top_rows.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= LISTED_ROWS)
        listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "row_id"))), lambda r: r["row_id"]).alias("row_ids"))
        counts = top_rows.groupBy(key).agg(F.count(F.lit(1)).alias("listed_rows"))
        out = out.join(counts, key, "left").join(listed, key, "left")
    else:
        out = out.withColumn("row_ids", F.array().cast("array<long>")).withColumn("listed_rows", F.lit(0).cast("long"))
    return out.select(
        key,
        F.struct("approved", "confidence", "reason").alias("final_decision"),
        F.struct("overall_score", "diversity_score", "dimensions").alias("results"),
        F.struct("listed_rows", "row_ids").alias("localization"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per validation."""
    report.write.mode("overwrite").json(path)


def write_problem_rows(top_rows: DataFrame, path: str) -> None:
    """Every problem row (validation_id, row_id, impact) as the table that goes with a report."""
    top_rows.write.mode("overwrite").parquet(path)


def write_sample(sample: DataFrame, path: str) -> None:
    sample.write.mode("overwrite").parquet(path)


def write_arrow(df: DataFrame, folder: str) -> DataFrame:
    """One Arrow IPC file per input partition; returns (file, rows)."""
    from .arrow_ipc import _filesystem

    columns = df.columns

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, local = _filesystem(folder)
        system.create_dir(local, recursive=True)
        file, rows, writer, sink = f"{local}/part-{task:05d}.arrow", 0, None, None
        for batch in batches:
            if writer is None:
                sink = system.open_output_stream(file)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "rows": [rows]})

    return df.select(*columns).mapInArrow(save, "file string, rows long")
