"""Reading datasets in the supported formats, and facts about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ordered import with_row_index
from .arrow_ipc import ArrowIpcSource

# File extensions and the format each stands for.
FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".parquet": "parquet",
    ".arrow": "arrow",
    ".feather": "arrow",
}


def detect_format(path: str) -> str:
    """Format from the file extension, ignoring case."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, fmt in FORMATS.items():
        if name.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported dataset format: {path}")


def read_dataset(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, drop_malformed: bool = False
) -> DataFrame:
    """Load a file or folder. A declared schema avoids the extra pass that infers one."""
    fmt = fmt or detect_format(path)
    if fmt == "arrow":
        spark.dataSource.register(ArrowIpcSource)
        reader = spark.read.format("arrow_ipc")
        return (reader.schema(schema) if schema is not None else reader).load(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    if fmt in ("csv", "tsv"):
        sep = "\t" if fmt == "tsv" else ","
        return reader.csv(path, header=True, sep=sep, mode=mode, inferSchema=None if schema is not None else True)
    if fmt == "json":
        return reader.json(path, multiLine=True, mode=mode)
    if fmt == "jsonl":
        return reader.json(path, mode=mode)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported dataset format: {fmt}")


def dataset_metadata(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One row: format, size in bytes, rows, columns, names and types. Counting reads no column."""
    fmt = fmt or detect_format(path)
    df = read_dataset(spark, path, fmt)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").agg(F.sum("length").alias("size_bytes"))
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    names, kinds = [n for n, _ in df.dtypes], [t for _, t in df.dtypes]
    return rows.crossJoin(F.broadcast(size)).select(  # one row each
        F.lit(fmt).alias("format"),
        "size_bytes",
        "row_count",
        F.lit(len(names)).alias("column_count"),
        F.array(*[F.lit(n) for n in names]).alias("column_names"),
        F.array(*[F.lit(k) for k in kinds]).alias("column_types"),
    )


def stream_dataset(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 16, pattern: str | None = None
) -> DataFrame:
    """Incremental read of a growing folder in bounded batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(folder)
    if fmt in ("json", "jsonl"):
        return reader.json(folder)
    return reader.parquet(folder)


def slice_rows(df: DataFrame, start: int, end: int, order_cols: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``start`` (inclusive) to ``end`` (exclusive) in the given order, and the chosen columns."""
    picked = list(columns or df.columns)
    needed = list(dict.fromkeys([*order_cols, *picked]))
    indexed = with_row_index(df.select(*needed), order_cols, "_row")
    return indexed.filter((F.col("_row") >= start) & (F.col("_row") < end)).select(*picked)
