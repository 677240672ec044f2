"""Multi-line grouping in closed form: running values instead of a sequential reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# What opens an event, and what continues one that has no time of its own.
STARTS = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
CONTINUES = r"^(?:\t| {4}|Caused by:|\.\.\.\s+\d+\s+more)"
BLANK = r"^\p{javaWhitespace}*$"


def groups(lines: DataFrame, continues: str = CONTINUES) -> DataFrame:
    """Lines ``(source, block, line_no, value)`` to groups ``(source, seq, header, continuation, source_ts)``.

    A line that starts with a time, or that follows a blank line, is hard: it opens an event
    whatever it looks like. Where the last hard line has a time all other lines continue it;
    elsewhere only those that look like a continuation do. Blank lines go.

    Windows run within a block of a source (a split of a file), so a long file has many tasks. One
    pass over the lines gives what each block does to whatever comes before it, a few values a
    block; those are carried from block to block, and joined to the lines in a second pass.
    """
    inside = Window.partitionBy("source", "block").orderBy("line_no")
    blocks = Window.partitionBy("source").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    blank = F.coalesce(F.col("value"), F.lit("")).rlike(BLANK)
    marked = lines.select("source", "block", "line_no", "value", blank.alias("blank"), F.coalesce(F.col("value").rlike(STARTS), F.lit(False)).alias("starts"), F.coalesce(F.col("value").rlike(continues), F.lit(False)).alias("continues"))
    # what is known inside a block: lines that are hard whatever comes before, and the time of the last of them
    last = F.lag("blank").over(inside)
    known = marked.withColumns({"first": last.isNull(), "hard": ~F.col("blank") & (F.col("starts") | F.coalesce(last, F.lit(False)))})
    known = known.withColumn("anchored", F.last(F.when(F.col("hard"), F.col("starts")), ignorenulls=True).over(inside))
    loose = ~F.col("blank") & ~F.col("continues")

    def summary(df: DataFrame) -> DataFrame:
        open_first = F.col("first") & ~F.col("blank") & ~F.col("hard")
        return df.groupBy("source", "block").agg(
            F.max_by("blank", "line_no").alias("ends_blank"),
            F.max_by("anchored", "line_no").alias("anchor"),
            F.bool_or(open_first).alias("open_first"),  # the first line is hard if a blank one comes before
            F.count_if(open_first & F.col("continues")).alias("first_continues"),
            F.count_if(F.col("anchored").isNull() & loose).alias("loose"),  # heads unless an event with a time goes on
            F.count_if(F.col("hard") | (F.col("anchored").isNotNull() & ~F.col("anchored") & loose)).alias("heads"),
        )

    state = summary(known).withColumn("after_blank", F.coalesce(F.lag("ends_blank").over(blocks), F.lit(True)))
    opens = F.col("open_first") & F.col("after_blank")
    state = state.withColumn("anchor", F.coalesce("anchor", F.when(opens, F.lit(False))))
    state = state.withColumn("anchored_before", F.coalesce(F.last("anchor", ignorenulls=True).over(earlier), F.lit(False)))
    heads = F.col("heads") + F.when(opens, F.col("loose") + F.col("first_continues")).when(F.col("anchored_before"), 0).otherwise(F.col("loose"))
    state = state.withColumn("heads_before", F.coalesce(F.sum(heads).over(earlier), F.lit(0)))
    state = state.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "after_blank", "anchored_before", "heads_before")
    joined = known.join(state, F.col("source").eqNullSafe(F.col("__s")) & F.col("block").eqNullSafe(F.col("__b")))
    hard = F.col("hard") | (F.col("first") & ~F.col("blank") & F.col("after_blank"))
    joined = joined.withColumn("hard", hard).where("not blank")
    anchored = F.coalesce(F.last(F.when(F.col("hard"), F.col("starts")), ignorenulls=True).over(inside), F.col("anchored_before"))
    joined = joined.withColumn("head", (F.col("hard") | (~anchored & ~F.col("continues"))).cast("long"))
    numbered = joined.withColumn("seq", F.col("heads_before") + F.sum("head").over(inside))
    line = F.struct("block", "line_no", "value")
    grouped = numbered.groupBy("source", "seq").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    values = F.transform("rows", lambda r: r["value"])
    return grouped.select("source", "seq", F.get(values, F.lit(0)).alias("header"), F.slice(values, 2, 1 << 30).alias("continuation"), F.lit(None).cast("long").alias("source_ts"))
