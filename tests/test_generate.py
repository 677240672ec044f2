import pytest
from pyspark.sql import functions as F

from stratalog import generate
from stratalog.__main__ import main
from stratalog.operators.grouping import groups
from stratalog.plans.queries import LogStore
from stratalog.plans.store import Store
from stratalog.sources.lines import listed_lines, text_files
from stratalog.streaming.ingest import live_rollup


@pytest.mark.parametrize(("kind", "most"), [("access", 40), ("syslog", 40), ("multiline", 4), ("pareto", 200), ("incident", 5)])
def test_lines_come_back_and_templates_are_few(spark, tmp_path, kind, most):
    want = [r.value for r in generate.lines(spark, kind, 1500).orderBy("line_no").collect()]
    assert want == [r.value for r in generate.lines(spark, kind, 1500).repartition(7).orderBy("line_no").collect()]
    assert want != [r.value for r in generate.lines(spark, kind, 1500, seed=1).orderBy("line_no").collect()]
    store = Store(spark, str(tmp_path / "s"))
    physical = [y for x in want for y in x.split("\n")]
    store.ingest(groups(listed_lines(spark, physical)), now_ms=0, label="a")
    q = LogStore.of(store)
    back = [r.line for r in q.entries.join(q.templates, "template_id").limit(0).collect()] + [r.line for r in q.replay(None, None).collect()]
    assert sorted("\n".join(back).split("\n")) == sorted(physical)
    assert 1 < store.templates().count() <= most and store.raws().count() == 0
    if kind == "pareto":  # a fifth of the shapes makes up two thirds of the lines
        hits = [r.occurrences for r in q.top_templates(most).collect()]
        assert sum(hits[:40]) > 0.62 * len(want)


def test_an_incident_shows_its_cause(spark, tmp_path):
    n = 4000
    store = Store(spark, str(tmp_path / "s"))
    physical = [r.value for r in generate.lines(spark, "incident", n).orderBy("line_no").collect()]
    store.ingest(groups(listed_lines(spark, physical)), now_ms=0)
    begin, end = (generate.BEGIN + int(n * share / 20) for share in (0.39, 0.7))
    q = LogStore.of(store)
    fresh = q.new_templates(begin * 1000, end * 1000).collect()
    assert "rollout" in fresh[0].pattern and any("exhausted" in r.pattern for r in fresh)
    assert "ERROR" in q.template_counts_with_baseline(begin * 1000, end * 1000).where("window_count > 100").first().pattern
    slot = q.inspect_slots(next(r.template_id for r in q.template_counts(None, None).collect() if "answered" in r.pattern), exact=False).where("name = 'size'").first()
    exact = q.inspect_slots(next(r.template_id for r in q.template_counts(None, None).collect() if "answered" in r.pattern)).where("name = 'size'").first()
    assert abs(slot.num_p50 - exact.num_p50) <= 1 and slot.num_count == exact.num_count and slot.num_avg == exact.num_avg


def test_generated_files(spark, tmp_path):
    assert main(["--store", str(tmp_path / "s"), "generate", "--kind", "syslog", "--lines", "300", "--output", str(tmp_path / "out")]) == 0
    assert text_files(spark, str(tmp_path / "out")).count() == 300
    with pytest.raises(ValueError):
        generate.lines(spark, "nothing", 1)


def test_live_rollup_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"job {i} ok\nmore", 1_700_000_000 + i) for i in range(90)], "value string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    df.repartitionByRange(3, "s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("rollup").collect()
    assert sum(r.n for r in rows) == 90 and {r.pattern for r in rows} == {"job {num} ok"} and len(rows) >= 2
