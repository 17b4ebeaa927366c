"""Sets of whole numbers as bitmaps of fixed size: 32,768 numbers to a bucket, 4 KiB each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket bigint, bits binary"


def bucket(key: str) -> str:
    """SQL for the bucket of a number."""
    return f"bitmap_bucket_number({key})"


def _place(key: str) -> str:
    return f"bitmap_bit_position({key})"


def bitmaps(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """bucket, bits of the numbers of a column or expression, for every value of ``by``. NULLs are left out."""
    read = rows.where(f"({key}) is not null")
    return read.groupBy(*by, F.expr(bucket(key)).alias("bucket")).agg(F.expr(f"bitmap_construct_agg({_place(key)})").alias("bits"))


def merged(maps: DataFrame, *by: str) -> DataFrame:
    """One bitmap per bucket of those that hold parts of it."""
    return maps.groupBy(*by, "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def is_set(key: str) -> str:
    """SQL for whether a number is in ``bits``, the bitmap of its bucket or NULL."""
    byte = f"cast(conv(hex(substring(bits, cast({_place(key)} div 8 as int) + 1, 1)), 16, 10) as int)"
    return f"coalesce(shiftright({byte}, cast({_place(key)} % 8 as int)) & 1 = 1, false)"


def marked(rows: DataFrame, key: str, maps: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the number is in the bitmaps (one per bucket). NULL is in none."""
    met = rows.withColumn("_bucket", F.expr(bucket(key))).join(maps.withColumnRenamed("bucket", "_bucket"), "_bucket", "left")
    return met.withColumn(out, F.expr(is_set(key))).select(*rows.columns, out)
