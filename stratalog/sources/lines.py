"""Lines and groups from files, in-memory lists and message queues."""

from __future__ import annotations

from collections.abc import Iterable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..work import work_path


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, block, line_no, value)``: the lines of text files in order. Lines end at ``\\n``,
    ``\\r\\n`` or ``\\r``; ``(block, line_no)`` orders the lines of a file."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")


def listed_lines(spark: SparkSession, lines: Iterable[str], source: str = "stdin") -> DataFrame:
    """The same for lines that are already here, such as standard input."""
    rows = [(source, 0, i, x.rstrip("\r\n")) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "source string, block long, line_no long, value string")


def spooled_lines(spark: SparkSession, stream: BinaryIO, chunk: int = 4 << 20) -> DataFrame:
    """The same for a stream of bytes such as standard input: it is copied, a chunk at a time, to a
    file in the shared folder, which is read like any other."""
    folder = work_path(spark, "spool")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/stdin")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    try:
        while data := stream.read(chunk):
            out.write(data)
    finally:
        out.close()
    return text_files(spark, folder).withColumn("source", F.lit("stdin"))


def message_groups(messages: DataFrame, value: str = "value", timestamp: str = "timestamp", source: str = "topic", order: str = "offset") -> DataFrame:
    """Queue records as groups: the first line is the header, the rest its continuation, and the
    record's own time is authoritative. Null and empty records are left out."""
    lines = F.split(F.col(value).cast("string"), "\n", -1)
    kept = messages.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    return kept.select(
        F.col(source).cast("string").alias("source"),
        F.col(order).cast("long").alias("seq"),
        F.get(lines, F.lit(0)).alias("header"),
        F.slice(lines, 2, 1 << 30).alias("continuation"),
        F.unix_millis(F.col(timestamp).cast("timestamp")).alias("source_ts"),
    )


def kafka(spark: SparkSession, servers: str, topic: str, from_beginning: bool = False, group_id: str | None = None, batch: int | None = 1000, flush: str = "5 seconds", most: int | None = None) -> DataFrame:
    """A topic as a stream, where the connector is on the class path.

    A micro-batch begins when there are ``batch`` records or ``flush`` has passed, and takes all
    there are then, ``most`` at most if given, so that a backlog is read in a few large batches.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if from_beginning else "latest"}
    if group_id:
        options["kafka.group.id"] = group_id
    if batch:
        options |= {"minOffsetsPerTrigger": str(batch), "maxTriggerDelay": flush}
    if most:
        options["maxOffsetsPerTrigger"] = str(most)
    return spark.readStream.format("kafka").options(**options).load()


def search_hits(spark: SparkSession, path: str, id_field: str = "_id") -> DataFrame:
    """Search-engine hits exported as JSON lines, flattened: each id once, broken lines left out."""
    schema = f"{id_field} string, _index string, _source map<string,string>, broken string"
    hits = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return hits.where(F.col("broken").isNull() & F.col(id_field).isNotNull()).dropDuplicates([id_field]).select(id_field, "_index", F.col("_source.message").alias("message"), "_source")
