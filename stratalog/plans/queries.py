"""The queries over a store, each a DataFrame.

Time windows are epoch milliseconds and include both ends. Every order ends in a key that makes it
unique. Predicates go into the plan, so results are exact however many rows there are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import masking, text
from .store import Store, reconstructed

# Fixed value: words by which a pattern counts as an anomaly.
ANOMALY = "ERROR|EXCEPTION|FAILED|WARN|CRITICAL"
QUERY_LIMIT, REPLAY_LIMIT, RAW_LIMIT, INVESTIGATE_TOP = 5000, 50_000, 5000, 20
#: Template ids that go into a scan's predicate.
MAX_IDS = 1000


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None else max(1, min(most, value))


@dataclass
class Capped:
    """A bounded result with word of whether there was more."""

    items: DataFrame
    returned: int
    total: int
    truncated: bool
    hint: str


def capped(df: DataFrame, limit: int) -> Capped:
    total = df.count()
    cut = total > limit
    return Capped(df.limit(limit), min(total, limit), total, cut, f"{total - limit} more; narrow the window or raise the limit" if cut else "")


class LogStore:
    """Templates, entries and raw rows with the analytic queries over them."""

    def __init__(self, templates: DataFrame, entries: DataFrame, raws: DataFrame):
        self.templates, self.entries, self.raws = templates, entries, raws

    @classmethod
    def of(cls, store: Store) -> LogStore:
        return cls(store.templates(), store.entries(), store.raws())

    @property
    def spark(self) -> SparkSession:
        return self.templates.sparkSession

    def _within(self, df: DataFrame, start: int | None, end: int | None) -> DataFrame:
        out = df if start is None else df.where(F.col("log_timestamp") >= start)
        return out if end is None else out.where(F.col("log_timestamp") <= end)

    def _named(self, counts: DataFrame) -> DataFrame:
        """Counts by template with patterns; the template may be missing."""
        return counts.join(self.templates.select("template_id", "pattern"), "template_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit("(unknown)")))

    # -- templates

    def top_templates(self, limit: int = 50, since_ms: int | None = None, exact: bool = False) -> DataFrame:
        """Templates by occurrences, as the store's counter has them; ``exact`` counts the entries."""
        out = self.templates if since_ms is None else self.templates.where(F.col("updated_at") >= F.timestamp_millis(F.lit(since_ms)))
        if exact:
            hits = self.entries.groupBy("template_id").agg(F.count("*").alias("hits"))
            out = out.join(hits, "template_id", "left").withColumn("occurrences", F.coalesce("hits", F.lit(0)).cast("long")).drop("hits")
        return out.select("template_id", "pattern", "occurrences").orderBy(F.desc("occurrences"), "template_id").limit(limit if limit > 0 else 50)

    def search_templates(self, search: str, limit: int = 50) -> DataFrame:
        found = self.templates.where(F.col("pattern").like(text.like_text(search)))
        return LogStore(found, self.entries, self.raws).top_templates(limit)

    def anomalies(self, since_ms: int | None = None, limit: int = 100) -> DataFrame:
        """Templates that are new since a time, or whose pattern has a word of trouble."""
        since = int(time.time() * 1000) - 3_600_000 if since_ms is None else since_ms
        found = self.templates.where((F.col("created_at") >= F.timestamp_millis(F.lit(since))) | F.upper("pattern").rlike(ANOMALY))
        return found.orderBy(F.desc("created_at"), F.desc("occurrences"), "template_id").limit(limit)

    def suggestions(self, pattern: str, limit: int = 5) -> DataFrame:
        """Templates that share a word of three or more characters with a pattern: of each word the
        ``2 * limit`` most frequent, words in order until there are ``3 * limit``."""
        import re

        words = [w for w in re.split(r"[\s{}]+", pattern) if len(w) >= 3]
        if not words:
            return self.templates.limit(0).select("template_id", "pattern", "occurrences")
        parts = None
        for i, w in enumerate(words):
            one = self.templates.where(F.col("pattern").like(text.like_text(w))).orderBy(F.desc("occurrences"), "template_id").limit(2 * limit).select("template_id", "pattern", "occurrences", F.lit(i).alias("word"))
            parts = one if parts is None else parts.unionByName(one)
        first = parts.groupBy("template_id", "pattern", "occurrences").agg(F.min("word").alias("word"))
        from pyspark.sql import Window

        # a few templates for each word of the question, so one task may add them up
        sizes = first.groupBy("word").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("word").alias("w"), "before")
        kept = first.join(before, F.col("word") == F.col("w")).where(F.col("before") < 3 * limit)
        return kept.select("template_id", "pattern", "occurrences").orderBy(F.desc("occurrences"), "template_id").limit(limit)

    def slot_table(self) -> DataFrame:
        """Templates with their unique slot names."""
        return self.templates.withColumn("slots", masking.slot_names(masking.slots(F.col("pattern"))))

    def inspect_slots(self, template_id: int, top: int = 5, start: int | None = None, end: int | None = None, exact: bool = True) -> DataFrame:
        """One row a slot: distinct values, the most frequent ones, and a numeric summary where all
        numbers have one unit. One pass over the template's entries. Exact percentiles hold a slot's
        distinct numbers in one task; without ``exact`` they are within a ten-thousandth of the ranks,
        in bounded memory."""
        rows = self._within(self.entries.where(F.col("template_id") == template_id), start, end)
        names = self.slot_table().where(F.col("template_id") == template_id).select(F.posexplode("slots").alias("slot", "name"))
        values = rows.select(F.posexplode("params").alias("slot", "value")).groupBy("slot", "value").agg(F.count("*").alias("n"))
        return self._slots(values, names, top, exact)

    def _slots(self, values: DataFrame, names: DataFrame, top: int, exact: bool) -> DataFrame:
        from pyspark.sql import Window

        stats = values.withColumns({"x": text.number(F.col("value")), "unit": text.unit(F.col("value"))})
        percentile = lambda p: F.percentile("x", p, F.col("n")) if exact else F.percentile_approx("x", p, 10_000)
        # approximate ranks count rows, so values come as often as they are there
        stats = stats if exact else stats.withColumn("n", F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("n").cast("int"))))
        numeric = stats.where("x is not null").groupBy("slot").agg(
            F.sum("n").alias("num_count"), F.min("x").alias("num_min"), F.max("x").alias("num_max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("num_avg"),
            percentile(0.5).alias("num_p50"), percentile(0.95).alias("num_p95"),
            F.max("unit").alias("num_unit"), F.countDistinct(F.nullif("unit", F.lit(""))).alias("units"),
        ).where("units <= 1").drop("units")
        ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
        best = ranked.groupBy("slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))), lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n"))).alias("top_values"))
        distinct = values.groupBy("slot").agg(F.count("*").alias("distinct_values"))
        out = names.join(distinct, "slot").join(best, "slot").join(numeric, "slot", "left")
        for c in ("num_avg", "num_p50", "num_p95"):
            out = out.withColumn(c, text.rounded(F.col(c)))
        return out.orderBy("slot")

    def recent_entries(self, template_id: int, limit: int = 10, newest: bool = False) -> DataFrame:
        """The oldest entries of a template, or the newest."""
        order = [F.desc("log_timestamp"), F.desc("entry_id")] if newest else ["log_timestamp", "entry_id"]
        return reconstructed(self.entries.where(F.col("template_id") == template_id).orderBy(*order).limit(limit), self.templates).orderBy(*order)

    # -- counts

    def timeseries(self, template_id: int, start: int, end: int, bucket_ms: int = 60_000, fill: bool = False) -> DataFrame:
        """Counts by bucket, buckets without entries left out unless ``fill``."""
        b = bucket_ms if bucket_ms > 0 else 60_000
        rows = self._within(self.entries.where(F.col("template_id") == template_id), start, end)
        out = rows.groupBy((F.col("log_timestamp") - F.pmod("log_timestamp", F.lit(b))).alias("bucket_ms")).agg(F.count("*").alias("n"))
        if fill:
            grid = self.spark.range(start - start % b, end + 1, b).select(F.col("id").alias("bucket_ms"))
            out = grid.join(out, "bucket_ms", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return out.orderBy("bucket_ms")

    def template_counts(self, start: int | None, end: int | None) -> DataFrame:
        counts = self._within(self.entries, start, end).groupBy("template_id").agg(F.count("*").alias("n"))
        return self._named(counts).select("template_id", "pattern", "n").orderBy(F.desc("n"), "template_id")

    def template_count(self, template_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
        return self._within(self.entries.where(F.col("template_id") == template_id), start, end).agg(F.count("*").alias("n"))

    def _window_and_baseline(self, start: int, end: int, base_start: int | None, base_end: int | None) -> DataFrame:
        """Both counts from one scan; the baseline is by default as long and just before."""
        base_end = start if base_end is None else base_end
        base_start = start - (end - start) if base_start is None else base_start
        near = self.entries.where(F.col("log_timestamp").between(min(start, base_start), max(end, base_end)))
        counts = near.groupBy("template_id").agg(F.count_if(F.col("log_timestamp").between(start, end)).alias("window_count"), F.count_if(F.col("log_timestamp").between(base_start, base_end)).alias("baseline_count"))
        return counts.where("window_count > 0").withColumn("ratio", F.when(F.col("baseline_count") > 0, F.col("window_count") / F.col("baseline_count")))

    def template_counts_with_baseline(self, start: int, end: int, base_start: int | None = None, base_end: int | None = None) -> DataFrame:
        """Window counts beside baseline counts, templates without a baseline first, then by ratio."""
        out = self._named(self._window_and_baseline(start, end, base_start, base_end))
        return out.select("template_id", "pattern", "window_count", "baseline_count", "ratio").orderBy(F.desc_nulls_first("ratio"), F.desc("window_count"), "template_id")

    def new_templates(self, start: int, end: int) -> DataFrame:
        """Templates whose first entry ever lies in the window."""
        first = self.entries.groupBy("template_id").agg(F.min("log_timestamp").alias("first_seen_ms"), F.count_if(F.col("log_timestamp").between(start, end)).alias("window_count"))
        out = self._named(first.where(F.col("first_seen_ms").between(start, end)))
        return out.select("template_id", "pattern", "first_seen_ms", "window_count").orderBy("first_seen_ms", "template_id")

    def stats(self) -> DataFrame:
        """One row with the number of templates, entries and raw rows."""
        tables = {"template_count": self.templates, "log_entry_count": self.entries, "raw_log_count": self.raws}
        counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
        all_of = counts[0].unionByName(counts[1]).unionByName(counts[2])
        return all_of.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))

    # -- lines

    def matching_templates(self, pattern: str) -> DataFrame:
        """The templates of a pattern as people write it, with their slots."""
        return self.slot_table().where(F.col("pattern") == masking.pattern_query(pattern))

    def _matching(self, pattern: str, filters: dict[str, str] | None, start: int | None, end: int | None, alias_keys: bool = False) -> DataFrame:
        found = self.matching_templates(pattern).select("template_id", "pattern", "slots", masking.literals(F.col("pattern")).alias("literals"))
        # ids are looked up first, so that the scan of the entries prunes by them; a pattern is one template
        ids = [r["template_id"] for r in found.select("template_id").limit(MAX_IDS + 1).collect()]
        rows = self._within(self.entries, start, end)
        rows = (rows.where(F.col("template_id").isin(ids)) if len(ids) <= MAX_IDS else rows).join(found, "template_id")
        for key, value in (filters or {}).items():
            key = masking_alias(key) if alias_keys else key
            own = F.get("params", F.array_position("slots", key).cast("int") - 1)
            rows = rows.where((F.array_position("slots", key) > 0) & ((own == value) | (masking.strip_key_prefix(own, F.lit(key)) == value)))
        return rows

    def query_lines(self, pattern: str, filters: dict[str, str] | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
        """The lines of one pattern that pass all slot filters, oldest first."""
        rows = self._matching(pattern, filters, start, end).orderBy("log_timestamp", "entry_id").limit(QUERY_LIMIT if limit is None else max(0, limit))
        line = masking.with_continuation(masking.fill(F.col("literals"), F.col("params")), F.col("continuation_text"))
        return rows.select("log_timestamp", "entry_id", F.coalesce(line, F.concat(F.lit("[!] "), "pattern")).alias("line")).orderBy("log_timestamp", "entry_id")

    def query_structured(self, pattern: str, filters: dict[str, str] | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, select: list[str] | None = None) -> DataFrame:
        """The same as values of the slots, all or the selected ones in the pattern's order."""
        rows = self._matching(pattern, filters, start, end).orderBy("log_timestamp", "entry_id").limit(QUERY_LIMIT if limit is None else max(0, limit))
        pairs = F.arrays_zip(F.col("slots"), F.col("params"))
        kept = F.filter(pairs, lambda p: F.array_contains(F.array(*map(F.lit, select)), p["slots"])) if select else pairs
        values = F.transform(kept, lambda p: masking.strip_key_prefix(p["params"], p["slots"]))
        return rows.select("log_timestamp", "entry_id", "template_id", F.transform(kept, lambda p: p["slots"]).alias("slots"), values.alias("values")).orderBy("log_timestamp", "entry_id")

    def query_count(self, pattern: str, filters: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        return self._matching(pattern, filters, start, end).agg(F.count("*").alias("matched_count"))

    def replay(self, start: int | None, end: int | None, limit: int | None = None) -> DataFrame:
        """All lines of a window in order: entries before raw rows of the same time, each by id."""
        lines = reconstructed(self._within(self.entries, start, end), self.templates).select("log_timestamp", F.lit(0).alias("side"), F.col("entry_id").alias("id"), "line")
        raw = self._within(self.raws, start, end).select("log_timestamp", F.lit(1).alias("side"), F.col("log_id").alias("id"), F.col("content").alias("line"))
        out = lines.unionByName(raw).orderBy("log_timestamp", "side", "id")
        return out if limit is None else out.limit(clamp(limit, 5000, REPLAY_LIMIT))

    def raw_logs(self, start: int | None = None, end: int | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self._within(self.raws, start, end)
        if search and search.strip():
            rows = rows.where(F.col("content").like(text.like_text(search)))
        return rows.orderBy("log_timestamp", "log_id").limit(clamp(limit, 500, RAW_LIMIT))

    # -- incidents

    def investigate(self, start: int, end: int, top: int | None = None, raw_sample: int | None = None, time_basis: str = "ingest", compat_order: bool = False) -> dict[str, DataFrame]:
        """What changed in a window against the time before: a summary, spikes, new templates, raw rows.

        ``compat_order`` sorts spikes by ascending ratio; otherwise templates without a baseline
        come first and then the largest ratios.
        """
        top, raw_sample = clamp(top, 10, INVESTIGATE_TOP), clamp(raw_sample, 10, INVESTIGATE_TOP)
        counts = self._window_and_baseline(start, end, None, None).join(self.templates.select("template_id", "pattern", "created_at"), "template_id")
        counts = counts.withColumn("is_error", F.col("pattern").rlike(text.ERROR))
        total = F.coalesce(F.sum("window_count"), F.lit(0))
        errors = F.coalesce(F.sum(F.when(F.col("is_error"), F.col("window_count")).otherwise(0)), F.lit(0))
        summary = counts.agg(total.alias("total_window_entries"), F.coalesce(text.rounded(errors / F.nullif(total, F.lit(0)), 3), F.lit(0.0)).alias("error_rate"))
        summary = summary.select(F.lit(start).alias("window_from_ms"), F.lit(end).alias("window_to_ms"), F.lit(start - (end - start)).alias("baseline_from_ms"), F.lit(start).alias("baseline_to_ms"), "total_window_entries", "error_rate")
        order = [F.asc_nulls_last("ratio")] if compat_order else [F.desc_nulls_first("ratio")]
        spikes = counts.select("template_id", "pattern", "window_count", "baseline_count", text.rounded(F.col("ratio")).alias("ratio"), "is_error").orderBy(*order, F.desc("window_count"), "template_id").limit(top)
        if time_basis == "event":
            fresh = self.new_templates(start, end).limit(top)
        else:
            between = F.unix_millis("created_at").between(start, end)
            fresh = self.templates.where(between).orderBy("created_at", "template_id").limit(top)
        return {"summary": summary, "spikes": spikes, "new_templates": fresh, "raw_sample": self.raw_logs(start, end, None, raw_sample)}


def masking_alias(key: str) -> str:
    """The slot that people mean by ``id``, ``x`` or ``count``."""
    return "num" if key in ("id", "x", "count") else key
