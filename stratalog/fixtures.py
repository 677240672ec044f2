"""Log lines derived from the driver's tables, so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ship import ship

REGIME = "TIMESTAMP_NTZ'2024-01-20 00:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/events.parquet")


def ms(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000)


def body() -> Column:
    """A line without its time."""
    return F.concat(
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" session u"), F.col("user_id").cast("string"), F.lit("q did "), F.col("event_type"),
        F.lit(" latency="), F.format_string("%.2f", "value"), F.lit("ms props="), F.col("props"),
        F.when((F.col("event_type") == "error") & (F.col("ts") >= F.expr(REGIME)), " pool exhausted").otherwise(""),
    )


def line() -> Column:
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), body())


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group an event, in the order of the ids."""
    return events(spark, sf_dir).select(F.lit("events").alias("source"), F.col("event_id").alias("seq"), line().alias("header"), F.array().cast("array<string>").alias("continuation"), F.lit(None).cast("long").alias("source_ts"))


def raw_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no template has, for some of the sign-ups, with times of their own."""
    kept = events(spark, sf_dir).where("event_type = 'signup' AND event_id % 50 = 0")
    return kept.select(F.lit("fixture").alias("source"), F.col("event_id").alias("seq"), F.concat(F.lit("unparsed "), "props").alias("header"), F.array().cast("array<string>").alias("continuation"), ms().alias("source_ts"))


def multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines: errors with ``event_id % 4`` stack lines, a blank line after every tenth event."""
    own = events(spark, sf_dir).withColumn("line", line())
    stack = F.when(F.col("event_type") == "error", F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < F.col("event_id") % 4), lambda j: F.concat(F.lit("\tat com.example.C"), F.col("event_id").cast("string"), F.lit(".m(C.java:"), j.cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    blank = F.when(F.col("event_id") % 10 == 9, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = own.select("event_id", F.posexplode(F.concat(F.array("line"), stack, blank)).alias("j", "value"))
    return rows.select(F.lit("events.log").alias("source"), F.floor(F.col("event_id") / 4096).alias("block"), (F.col("event_id") * 8 + F.col("j")).alias("line_no"), "value")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue records whose values have one more line for some events."""
    extra = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n\tat frame "), F.col("event_id").cast("string"))).otherwise("")
    return events(spark, sf_dir).select(F.lit("events").alias("topic"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(line(), extra).alias("value"))
