import random

from pyspark.sql import functions as F

from stratalog.operators.grouping import groups
from stratalog.sources.lines import listed_lines, message_groups, text_files


def sequential(lines):
    """The rules read one line after the other."""
    import re

    out, blank = [], True
    for x in lines:
        if not x.strip():
            blank = True
            continue
        starts = re.match(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d", x) is not None
        cont = re.match(r"\t| {4}|Caused by:|\.\.\.\s+\d+\s+more", x) is not None
        if out and not starts and not blank and (re.match(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d", out[-1][0]) or cont):
            out[-1][1].append(x)
        else:
            out.append((x, []))
        blank = False
    return out


def grouped(spark, lines):
    return [(r.header, list(r.continuation)) for r in groups(listed_lines(spark, lines)).orderBy("seq").collect()]


def test_rules_on_random_lines(spark):
    rng = random.Random(4)
    kinds = ["2024-01-01 00:00:00 a", "plain", "\tat x", "    four", "   three", "Caused by: y", "... 3 more", "", "  "]
    lines = [rng.choice(kinds) for _ in range(1500)]
    assert grouped(spark, lines) == sequential(lines)
    cut = listed_lines(spark, lines).withColumn("block", F.floor(F.col("line_no") / 7))  # events cross blocks
    assert [(r.header, list(r.continuation)) for r in groups(cut).orderBy("seq").collect()] == sequential(lines)


def test_traceback_and_empty(spark):
    lines = ["2024-01-01 00:00:00 ERROR boom", "Traceback:", '  File "x"', "    raise", "ValueError", "2024-01-01 00:00:01 INFO ok"]
    assert [len(c) for _, c in grouped(spark, lines)] == [4, 0]
    assert grouped(spark, []) == [] and grouped(spark, ["", ""]) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"2024-01-01 00:00:00 a\r\n\tb\r\n\r\nplain\n")
    rows = groups(text_files(spark, str(tmp_path / "a.log"))).orderBy("seq").collect()
    assert [(r.header, list(r.continuation)) for r in rows] == [("2024-01-01 00:00:00 a", ["\tb"]), ("plain", [])]


def test_messages(spark):
    df = spark.sql("SELECT * FROM VALUES ('t', 0L, TIMESTAMP'2024-01-01 00:00:01', 'a\nb\n'), ('t', 1L, TIMESTAMP'2024-01-01 00:00:02', ''), ('t', 2L, NULL, CAST(NULL AS STRING)) AS t(topic, offset, timestamp, value)")
    rows = message_groups(df).collect()
    assert [(r.seq, r.header, list(r.continuation), r.source_ts) for r in rows] == [(0, "a", ["b", ""], 1704067201000)]
