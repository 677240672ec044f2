"""Continuous ingest: micro-batches into a store, with periodic relearning and compaction."""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import masking
from ..plans.store import Store
from ..sources.lines import message_groups

log = logging.getLogger(__name__)


class StreamIngest:
    """Writes a stream of queue records ``(topic, offset, timestamp, value)`` to a store.

    Each micro-batch is one version of the store, which notes the batch's number, so a batch that
    runs again after a failure changes nothing, whatever maintenance came between. The template
    dimension is read again for every batch; a pattern that no template fits becomes one, and
    relearning folds them later. Records without a value go to the dead-letter folder, if there is
    one. A batch that fails is ingested by halves, until the records that make it fail are alone;
    those go there, too, with the error, and the stream goes on.
    """

    def __init__(self, store: Store, dead_letters: str | None = None, compact_every: float = 300.0, name: str = "stream", source: str | None = None, max_records: int | None = None, **options):
        self.store, self.dead_letters, self.compact_every, self.name, self.source, self.options = store, dead_letters, compact_every, name, source, options
        self.max_records, self.records, self.full = max_records, 0, threading.Event()
        self.compacted = time.monotonic()

    def batch(self, records: DataFrame, number: int) -> None:
        if self.store.done(stream=(self.name, number)):
            return
        if self.max_records is not None:
            n = records.count()
            if self.records + n >= self.max_records:
                records = records.orderBy("topic", "offset").limit(max(0, self.max_records - self.records))
                self.full.set()
            self.records += n
        empty = F.coalesce(F.col("value").cast("string"), F.lit("")) == ""
        self._dead(records.where(empty), f"batch={number:012d}", "no value")
        try:
            self.store.ingest(self._groups(records), stream=(self.name, number), learn=False, **self.options)
        except Exception as e:
            log.warning("batch %d failed, its records are tried apart: %s", number, e)
            self._apart(records.where(~empty), number, "")
            self.store.mark((self.name, number))
        if time.monotonic() - self.compacted >= self.compact_every:
            self.maintain()

    def _groups(self, records: DataFrame) -> DataFrame:
        groups = message_groups(records)
        return groups if self.source is None else groups.withColumn("source", F.lit(self.source))

    def _apart(self, records: DataFrame, number: int, part: str) -> None:
        """Ingest the records of a failing batch by halves of a hash, each under a label of its own."""
        side = F.pmod(F.shiftright(F.xxhash64("topic", "offset", "value"), len(part)), F.lit(2))
        for half in (0, 1):
            some, label = records.where(side == half), f"{self.name}-{number}/{part}{half}"
            try:
                if not some.isEmpty():
                    self.store.ingest(self._groups(some), label=label, learn=False, **self.options)
            except Exception as e:
                if len(part) < 62 and some.count() > 1:
                    self._apart(some, number, f"{part}{half}")
                else:
                    log.warning("records of batch %d can't be ingested: %s", number, e)
                    self._dead(some, f"batch={number:012d}-{part}{half}", str(e).split("\n")[0][:500])

    def _dead(self, records: DataFrame, folder: str, why: str) -> None:
        if self.dead_letters and not records.isEmpty():
            records.withColumn("error", F.lit(why)).write.mode("overwrite").parquet(f"{self.dead_letters}/{folder}")

    def maintain(self) -> None:
        """Relearn and compact; a failure is logged, and the stream goes on."""
        try:
            self.store.compact()
        except Exception:
            log.exception("compaction failed; the next one includes its rows")
        self.compacted = time.monotonic()

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = "5 seconds") -> StreamingQuery:
        """Run until stopped or full, or, without an interval, until what is there now has been read."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        query = writer.start()
        if self.max_records is not None:

            def watch() -> None:
                while query.isActive and not self.full.wait(0.5):
                    pass
                query.stop()

            threading.Thread(target=watch, daemon=True).start()
        return query

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """Read all there is now, then relearn and compact."""
        self.start(stream, checkpoint, None).awaitTermination()
        self.maintain()


def live_rollup(records: DataFrame, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts by masked pattern and time window of a stream, late records dropped."""
    timed = masking.masked(records.withColumn("line", F.split(F.col("value").cast("string"), "\n", 2)[0]), "line")
    return timed.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", width), "pattern").agg(F.count("*").alias("n"))
