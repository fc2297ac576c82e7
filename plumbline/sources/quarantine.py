"""Reading text files with rows that do not parse: the good rows, the bad ones as they stand, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .readers import detect_format

#: The column that holds a bad row's text; a dataset must not have a column of this name.
CORRUPT = "_corrupt_row"


def read_marked(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str | None = None) -> DataFrame:
    """All rows of a csv, tsv, json or jsonl dataset with ``_corrupt_row``: null for a good row, the whole text of a bad one.

    A row is bad if a value does not have its declared type, if a csv row has too few or too many fields, or if a line is no
    JSON object. Parsing is one distributed pass; whole-file json is one record a file, so a bad file is one bad row. The
    schema is declared, because an inferred one would make every bad value a string.
    """
    fmt = fmt or detect_format(path)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if CORRUPT in schema.names:
        raise ValueError(f"the dataset has a column {CORRUPT}")
    marked = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.fields), T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt in ("csv", "tsv"):
        return reader.csv(path, header=True, enforceSchema=True, sep="\t" if fmt == "tsv" else ",").withColumn("source_file", F.input_file_name())
    if fmt in ("json", "jsonl"):
        return reader.option("multiLine", fmt == "json").json(path).withColumn("source_file", F.input_file_name())
    raise ValueError(f"{fmt} has no rows that fail to parse")


def parsed_whole(marked: DataFrame) -> DataFrame:
    """The same rows, each with all columns parsed: a reader that is asked for few columns would call other rows bad."""
    data = [f for f in marked.schema.fields if f.name not in (CORRUPT, "source_file")]
    values = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in data]
    return marked.filter(F.xxhash64(*values).bitwiseAND(1) <= 1)  # always so, but it names every column


def read_with_quarantine(spark: SparkSession, path: str, schema: T.StructType | str, quarantine: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); bad rows go to the Parquet table ``quarantine`` as source_file and raw text before this returns.

    No row is lost: together both have every row of the input. An empty input gives two empty tables.
    """
    marked = parsed_whole(read_marked(spark, path, schema, fmt))
    bad = marked.filter(F.col(CORRUPT).isNotNull()).select("source_file", F.col(CORRUPT).alias("raw"))
    bad.write.mode("overwrite").parquet(quarantine)
    good = marked.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file")
    return good, spark.read.schema("source_file string, raw string").parquet(quarantine)


def quarantine_summary(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: good_rows, bad_rows and bad_pct (0 for an empty dataset)."""
    counts = good.agg(F.count(F.lit(1)).alias("good_rows")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad_rows"))))  # one row each
    return counts.withColumn("bad_pct", F.coalesce(F.try_divide(100.0 * F.col("bad_rows"), F.col("good_rows") + F.col("bad_rows")), F.lit(0.0)))
