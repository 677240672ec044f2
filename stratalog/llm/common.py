"""Shared plumbing of this package."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ship import ship
from ..work import discard, shared_dir, work_path, written

__all__ = ["bit_marks", "discard", "may_hold", "release", "shared_dir", "table", "work_path", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory back that a worker has freed, since the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bits by which digests are told apart before rows are shuffled: bitmaps of 4 KB each, 8 MB in all.
MARK_BITS = 1 << 26


def _bit(digest: str):
    return F.pmod(F.xxhash64(digest), F.lit(MARK_BITS)) + 1


def bit_marks(digests: DataFrame, digest: str) -> DataFrame:
    """``(number, bits)``: bitmaps of hashed digests, ``MARK_BITS`` bits at most, however many there are."""
    bit = _bit(digest)
    return digests.groupBy(F.bitmap_bucket_number(bit).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def may_hold(rows: DataFrame, digest: str, marks: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a flag: false only if ``marks``, which is broadcast, holds no bit for the digest."""
    at = F.bitmap_bit_position(_bit(digest))
    joined = rows.withColumn("__number", F.bitmap_bucket_number(_bit(digest))).join(F.broadcast(marks.select(F.col("number").alias("__n"), "bits")), F.col("__number") == F.col("__n"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(flag, held).drop("__number", "__n", "bits")
