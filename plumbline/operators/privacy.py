"""Personal data in text columns: validated pattern counts in one aggregate of JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import melt

# Shapes of e-mail addresses, North American phone numbers, social security numbers and payment cards. Every
# shape starts only where the run before it ends and repeats without bound nothing but a class, so scans are linear.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"
PHONE = r"(?<![0-9A-Za-z])(?:\+1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}\b"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}\b"
KINDS = ["emails", "phones", "ssns", "cards"]


def luhn(number: Column) -> Column:
    """Does a number, with spaces and dashes between its digits, meet the Luhn rule?"""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0


def found(text: Column) -> dict[str, Column]:
    """How many of each kind a text holds; characters beyond ASCII only separate."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", " ")
    cards = F.filter(F.regexp_extract_all(plain, F.lit(CARD), F.lit(0)), luhn)
    counts = {"emails": F.regexp_count(plain, F.lit(EMAIL)), "phones": F.regexp_count(plain, F.lit(PHONE)), "ssns": F.regexp_count(plain, F.lit(SSN)), "cards": F.size(cards)}
    return {k: F.when(text.isNull(), 0).otherwise(v).cast("long") for k, v in counts.items()}


def privacy_scan(df: DataFrame, text_cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column: rows, emails, phones, ssns, cards (found in all rows), flagged_rows (rows with any) and has_pii.

    A social security number must lie in the issued ranges, a card number of 13 to 19 digits must meet the Luhn rule. Null
    and empty texts hold nothing; a table without rows has no rows in the result, one without text columns is an error.
    """
    cols = list(text_cols if text_cols is not None else [n for n, t in df.dtypes if t == "string"])
    if not cols:
        raise ValueError("the dataset has no text column")
    counted = melt(df, [], {c: found(F.col(c)) for c in cols})
    any_found = sum((F.col(k) for k in KINDS), F.lit(0)) > 0
    out = counted.groupBy("col").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(k).alias(k) for k in KINDS], F.count_if(any_found).alias("flagged_rows"))
    return out.withColumn("has_pii", F.col("flagged_rows") > 0)
