"""From groups to templates, entries and raw rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import masking, text
from ..work import written
from . import learner

#: Sequence numbers in a block: windows run within a block, and blocks of one source run side by side.
#: So many blocks make a span, within which their sizes are summed up.
BLOCK, SPAN = 1 << 14, 1 << 12


@dataclass
class Ingested:
    """What a batch adds: entries, raws and plans are new rows, templates the whole dimension after it,
    whose counter ``counted`` brings up to date; rows are the parsed groups."""

    templates: DataFrame
    entries: DataFrame
    raws: DataFrame
    plans: DataFrame
    rows: DataFrame  # as a written table

    @property
    def unresolved(self) -> int:
        """How many groups had no time of their own."""
        return self.rows.where("not resolved").count()


def numbered(rows: DataFrame, name: str, first: int, *ties: str) -> DataFrame:
    """``rows(source, seq, ...)`` with ids from ``first`` in the order of source and sequence, and of
    ``ties`` where those are equal.

    Ids are counted within blocks of the sequence, the blocks' sizes within spans of blocks, and only
    the spans' sizes, a number for every 64 million rows, are summed up in one place.
    """
    block = rows.withColumn("__block", F.floor(F.col("seq") / BLOCK))
    sizes = block.groupBy("source", "__block").agg(F.count("*").alias("__n")).withColumn("__span", F.floor(F.col("__block") / SPAN))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.groupBy("source", "__span").agg(F.sum("__n").alias("__m"))
    spans = spans.select(F.col("source").alias("__s"), F.col("__span").alias("__p"), F.coalesce(F.sum("__m").over(before(Window.orderBy("source", "__span"))), F.lit(0)).alias("__far"))
    near = F.coalesce(F.sum("__n").over(before(Window.partitionBy("source", "__span").orderBy("__block"))), F.lit(0))
    offsets = sizes.withColumn("__near", near).join(spans, F.col("source").eqNullSafe(F.col("__s")) & F.col("__span").eqNullSafe(F.col("__p"))).drop("__s")
    offsets = offsets.select(F.col("source").alias("__s"), F.col("__block").alias("__b"), (F.col("__far") + F.col("__near")).alias("__before"))
    joined = block.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & F.col("__block").eqNullSafe(F.col("__b")))
    within = F.row_number().over(Window.partitionBy("source", "__block").orderBy("seq", *ties))
    return joined.withColumn(name, (F.col("__before") + within + first - 1).cast("long")).drop("__block", "__before", "__s", "__b")


def parsed(groups: DataFrame, now_ms: int, batch: int | None = None) -> DataFrame:
    """Groups with pattern, parameters and event time.

    A group without a time of its own takes the last one before it in its source (in its batch of
    ``batch`` groups, if given), or else ``now_ms``. Sources are cut into blocks of the sequence;
    a block takes over one value from the blocks before it.
    """
    size = batch or BLOCK
    dealt = groups.withColumn("block", F.floor((F.col("seq") - 1) / size)).repartition("source", "block")
    out = masking.masked(dealt, "header").withColumn("own_ts", F.coalesce("source_ts", text.event_time(F.col("header"))))
    before = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("log_timestamp", F.last("own_ts", ignorenulls=True).over(before)).withColumn("resolved", F.col("own_ts").isNotNull())
    if batch:
        return out.withColumn("log_timestamp", F.coalesce("log_timestamp", F.lit(now_ms))).drop("block")
    out = written(out, "timed")
    last = out.groupBy("source", "block").agg(F.max_by("own_ts", F.when(F.col("resolved"), F.col("seq"))).alias("last"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.last("last", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    joined = out.join(carried, F.col("source").eqNullSafe(F.col("__s")) & F.col("block").eqNullSafe(F.col("__b")), "left")
    joined = joined.withColumn("log_timestamp", F.coalesce("log_timestamp", "carried", F.lit(now_ms))).drop("__s", "__b", "carried", "block")
    joined._table = out  # the same rows, already written
    return joined


def counted(templates: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """Templates with new entries added to their counters."""
    more = entries.groupBy("template_id").agg(F.count("*").alias("more"))
    now = F.timestamp_millis(F.lit(now_ms))
    return templates.join(more, "template_id", "left").select("template_id", "pattern", (F.col("occurrences") + F.coalesce("more", F.lit(0))).alias("occurrences"), "created_at", F.when(F.col("more") > 0, now).otherwise(F.col("updated_at")).alias("updated_at"))


def ingest(groups: DataFrame, templates: DataFrame, known_plans: DataFrame, next_entry: int = 1, next_log: int = 1, now_ms: int = 0, learn: bool = True, max_branching: int = learner.MAX_BRANCHING, max_templates: int | None = None, batch: int | None = None) -> Ingested:
    """Ingest a bounded set of groups ``(source, seq, header, continuation, source_ts)``.

    Each distinct pattern resolves to its plan, to the first learned template that it fits, to
    itself if it is a template, to what the batch's own patterns teach, or else becomes a template. New templates are numbered by their first
    line. Lines that would not come back byte by byte are stored raw, whole, and so are those of
    templates beyond ``max_templates``, if given; without it there are as many as the lines make.
    With ``learn`` the batch's own patterns are learned from first.
    """
    spark = groups.sparkSession
    rows = parsed(groups, now_ms, batch)
    rows = written(rows, "parsed") if batch else rows
    opaque = masking.has_marks(F.col("header"))
    patterns = written(rows.where(~opaque).groupBy("pattern").agg(F.count("*").alias("n"), F.min(F.struct("source", "seq")).alias("first"), F.min("log_timestamp").alias("first_ts"), F.max("log_timestamp").alias("last_ts")), "patterns")
    new = patterns.join(templates.select("pattern"), "pattern", "left_anti").select("pattern")
    planned = known_plans.select(F.col("source_pattern").alias("pattern"), F.col("final_pattern").alias("planned"))
    found = learner.plans(new, max_branching) if learn else spark.createDataFrame([], "source_pattern string, final_pattern string")
    found = found.select(F.col("source_pattern").alias("pattern"), F.col("final_pattern").alias("learned"))
    fitting = learner.matches(patterns.select("pattern"), templates.where(F.contains("pattern", F.lit(learner.VAR)))).select("pattern", F.col("final_pattern").alias("fitting"))
    resolved = patterns.join(planned, "pattern", "left").join(fitting, "pattern", "left").join(found, "pattern", "left")
    resolved = resolved.join(templates.select("pattern", F.lit(True).alias("is_template")), "pattern", "left")
    resolved = resolved.select("pattern", "n", "first", "first_ts", "last_ts", F.coalesce("planned", "fitting", F.when(F.col("is_template"), F.col("pattern")), "learned", "pattern").alias("final_pattern"))
    resolved = written(resolved, "resolved")

    finals = resolved.groupBy("final_pattern").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    last = templates.agg(F.coalesce(F.max("template_id"), F.lit(0)), F.count("*")).first()
    fresh = finals.join(templates.select(F.col("pattern").alias("final_pattern")), "final_pattern", "left_anti")
    fresh = numbered(fresh.select("final_pattern", "first.source", "first.seq"), "template_id", last[0] + 1, "final_pattern")
    if max_templates is not None:
        fresh = fresh.where(F.col("template_id") <= last[0] + max(0, max_templates - last[1]))
    now = F.timestamp_millis(F.lit(now_ms))
    added = fresh.select("template_id", F.col("final_pattern").alias("pattern"), F.lit(0).cast("long").alias("occurrences"), now.alias("created_at"), now.alias("updated_at"))
    after = written(templates.unionByName(added), "templates-after")

    dimension = resolved.select(F.col("pattern").alias("source_pattern"), "final_pattern").join(after.select("template_id", F.col("pattern").alias("final_pattern")), "final_pattern", "left")
    dimension = dimension.withColumn("final_literals", masking.literals(F.col("final_pattern")))
    dimension = written(learner.with_programs(dimension), "dimension")
    joined = rows.join(dimension, (F.col("pattern") == F.col("source_pattern")) & ~opaque, "left")
    joined = joined.withColumn("final", F.when(F.col("source_pattern") == F.col("final_pattern"), F.col("params")).otherwise(learner.final_params(F.col("program"), F.col("params"))))
    exact = F.col("template_id").isNotNull() & F.coalesce(masking.fill(F.col("final_literals"), F.col("final")) == F.col("header"), F.lit(False))
    # taken twice, by the entries and by the few raw rows: cheaper than a copy of all rows
    checked = joined.select("source", "seq", "header", "continuation", "log_timestamp", "template_id", F.col("final").alias("params"), exact.alias("exact"))
    text_of = F.when(F.size("continuation") > 0, F.array_join("continuation", "\n"))
    entries = numbered(checked.where("exact"), "entry_id", next_entry).select("entry_id", "template_id", "log_timestamp", "params", text_of.alias("continuation_text"))
    raws = numbered(checked.where("not exact"), "log_id", next_log).select("log_id", F.concat_ws("\n", "header", text_of).alias("content"), "log_timestamp", "source", now.alias("created_at"))
    learned = dimension.where("template_id is not null and source_pattern <> final_pattern").select("source_pattern", "final_pattern")
    return Ingested(after, entries, raws, learned.join(known_plans.select("source_pattern"), "source_pattern", "left_anti"), getattr(rows, "_table", rows))
