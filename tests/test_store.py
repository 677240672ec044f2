import pytest
from pyspark.sql import functions as F

from stratalog.plans.queries import LogStore, capped
from stratalog.plans.store import Conflict, Store
from stratalog.schema import GROUPS
from stratalog.sources.lines import message_groups, spooled_lines
from stratalog.streaming.ingest import StreamIngest


def groups(spark, headers, source="s", first=1, ts=None):
    rows = [(source, first + i, *(h if isinstance(h, tuple) else (h, [])), ts and ts + i) for i, h in enumerate(headers)]
    return spark.createDataFrame(rows, GROUPS)


def lines(store):
    return [r.line for r in LogStore.of(store).replay(None, None).collect()]


def test_ingest_compact_and_replay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.compact() and lines(store) == []
    first = ["2024-01-01T00:00:01Z a 1", ("no time {x} 2", ["\tat y", "z"]), "odd \u0001 line", "  ERROR  db\ttimeout  "]
    store.ingest(groups(spark, first), label="a", now_ms=5)
    want = ["2024-01-01T00:00:01Z a 1", "no time {x} 2\n\tat y\nz", "  ERROR  db\ttimeout  ", "odd \u0001 line"]
    assert lines(store) == want
    assert store.raws().count() == 1
    assert store.compact() and not store.compact()
    assert lines(store) == want
    store.ingest(groups(spark, ["2024-01-01T00:00:09Z a 7"]), label="b", now_ms=6)
    assert lines(store)[-1] == "2024-01-01T00:00:09Z a 7"
    ids = [r.entry_id for r in store.entries().collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    assert {r.pattern: r.occurrences for r in store.templates().collect()}["{ts} a {num}"] == 2
    store.ingest(groups(spark, ["2024-01-01T00:00:09Z a 7"]), label="b", now_ms=6)
    assert len(lines(store)) == 5  # the label was replaced
    assert store.size_bytes() > 0
    store.clear()
    assert store.size_bytes() == 0


def test_cap_keeps_whole_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, [("one x", []), ("two y z", ["\tat q"])]), label="a", now_ms=5, max_templates=1)
    assert [r.content for r in store.raws().collect()] == ["two y z\n\tat q"]
    assert store.templates().count() == 1


def test_relearn_folds_and_settles(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    jobs = [f"job j-{c}7x finished ok" for c in "abcdef"]
    store.ingest(groups(spark, jobs), label="a", now_ms=5, learn=False)
    assert store.templates().count() == 6
    assert store.relearn(4) == {"merged": 1, "folded": 6, "remapped": 0}
    assert [(r.pattern, r.occurrences) for r in store.templates().collect()] == [("job {var} finished ok", 6)]
    assert sorted(lines(store)) == sorted(jobs)
    assert store.relearn(4) == {"merged": 0, "folded": 0, "remapped": 0}
    store.ingest(groups(spark, ["job j-z7x finished ok", "job j-a7x finished ok"]), label="b", now_ms=6, learn=False)
    assert store.templates().count() == 1 and store.entries().count() == 8


def test_archived_templates_stay_and_later_lines_move(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    jobs = [f"job j-{c}7x finished ok" for c in "abcdef"]
    store.ingest(groups(spark, jobs), label="a", now_ms=5, learn=False)
    store.compact(relearn=False)
    assert store.relearn(4) == {"merged": 1, "folded": 0, "remapped": 6}
    assert store.relearn(4) == {"merged": 0, "folded": 0, "remapped": 0}
    store.ingest(groups(spark, jobs[:2]), label="b", now_ms=6, learn=False)
    assert {r.pattern: r.occurrences for r in store.templates().collect()}["job {var} finished ok"] == 2
    assert sorted(lines(store)) == sorted(jobs + jobs[:2])


def test_carry_forward_by_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, ["2024-01-01T00:00:01Z a", "b", "c"]), label="a", now_ms=77, batch=2)
    assert [r.log_timestamp for r in store.entries().orderBy("entry_id").collect()] == [1704067201000, 1704067201000, 77]


def test_carry_forward_over_blocks(spark, monkeypatch):
    from stratalog.operators import ingest

    monkeypatch.setattr(ingest, "BLOCK", 4)
    rows = ["a" if i % 7 else f"2024-01-01T00:00:{i:02d}Z a" for i in range(1, 40)]
    got = [r.log_timestamp for r in ingest.parsed(groups(spark, rows), 5).orderBy("seq").collect()]
    assert got == [5 if i < 7 else 1704067200000 + i // 7 * 7000 for i in range(1, 40)]


def test_windows_filters_and_ties(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, [f"user=u{i % 2} took {i}ms" for i in range(10)], ts=1000), label="a", now_ms=5)
    q = LogStore.of(store)
    assert q.replay(1002, 1004).count() == 3  # both ends count
    pattern = store.templates().orderBy("template_id").first().pattern
    assert pattern == "user=u0 took {size}"
    assert [r.line for r in q.query_lines(pattern, {"size": "4ms"}).collect()] == ["user=u0 took 4ms"]
    assert q.query_lines(pattern, {"nope": "4ms"}).count() == 0
    assert q.query_lines(pattern, limit=0).count() == 0
    assert q.query_structured("unknown {num}").count() == 0
    assert q.query_structured(pattern, select=["nope"]).first()["values"] == []
    slot = q.inspect_slots(1).first()
    assert (slot.name, slot.distinct_values, slot.num_count, slot.num_unit, slot.num_p50) == ("size", 5, 5, "ms", 4.0)
    assert [r.n for r in q.timeseries(1, 1000, 1009, 4, fill=True).collect()] == [2, 2, 1]
    assert q.template_count(1, 1000, 1004).first().n == 3
    assert q.stats().first().asDict() == {"template_count": 2, "log_entry_count": 10, "raw_log_count": 0}
    top = capped(q.replay(None, None), 4)
    assert (top.returned, top.total, top.truncated) == (4, 10, True)
    order = [r.window_count for r in q.investigate(1000, 1009, compat_order=True)["spikes"].collect()]
    assert order == [5, 5]
    assert q.recent_entries(1, 1, newest=True).first().line == "user=u0 took 8ms"


def test_search_takes_text_with_backslashes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, [r"path C:\dir x", "other"]), label="a", now_ms=5)
    assert LogStore.of(store).search_templates(r"C:\d").count() == 1
    assert LogStore.of(store).search_templates("C_").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("t", i, f"job j-{chr(97 + i)}7x {'ok' if i % 2 else 'bad'}" + ("\n\tat x" if i % 3 == 0 else "")) for i in range(24)] + [("t", 24, "")]
    df = spark.createDataFrame(rows, "topic string, offset long, value string").withColumn("timestamp", F.timestamp_millis(F.col("offset") + 1000))
    df.repartitionByRange(3, "offset").write.parquet(source)
    store = Store(spark, str(tmp_path / "s"))
    runner = StreamIngest(store, dead_letters=str(tmp_path / "dead"), now_ms=9)
    runner.drain(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "ck"))
    assert {(r.pattern, r.n) for r in LogStore.of(store).template_counts(None, None).collect()} == {("job {var} ok", 12), ("job {var} bad", 12)}
    assert lines(store) == [r[2] for r in rows[:-1]]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_shuffled_input_gives_the_same_templates(spark, tmp_path, sf_dir):
    from stratalog import fixtures

    all_of = []
    for name, order in (("a", "seq"), ("b", F.rand(3))):
        store = Store(spark, str(tmp_path / name))
        store.ingest(fixtures.event_groups(spark, sf_dir).orderBy(order), label="x", now_ms=1)
        all_of.append([(r.template_id, r.pattern, r.occurrences) for r in store.templates().orderBy("template_id").collect()])
    assert all_of[0] == all_of[1] and len(all_of[0]) == 6


JOBS = [f"job j-{c}7x finished ok" for c in "abcdef"]


def state(store):
    q = LogStore.of(store)
    counts = {r.template_id: r.n for r in q.template_counts(None, None).collect()}
    templates = {r.template_id: r.occurrences for r in store.templates().collect()}
    return sorted(lines(store)), {k: v for k, v in templates.items() if v}, counts


@pytest.mark.parametrize("what", ["ingest", "relearn", "compact"])
def test_a_writer_that_stops_anywhere_changes_nothing(spark, tmp_path, monkeypatch, what):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, JOBS[:5] + ["odd \u0001 line"]), label="a", now_ms=5, learn=False)
    before = state(store)
    put, commit = Store._put, Store._commit
    for k in range(8):
        count = iter(range(100))

        def failing(self, *args, **kw):
            if next(count) == k:
                raise OSError("stopped")
            return put(self, *args, **kw)

        monkeypatch.setattr(Store, "_put", failing)
        run = {"ingest": lambda: store.ingest(groups(spark, JOBS[3:]), label="b", now_ms=6, learn=False), "relearn": lambda: store.relearn(4), "compact": lambda: store.compact(relearn=False)}[what]
        try:
            run()
        except OSError:
            monkeypatch.undo()
            assert state(store) == before, k  # nothing of it counts
            continue
        break
    monkeypatch.undo()
    assert k >= 2  # it was stopped at every write before
    after = state(store)
    assert after[1] == after[2] and len(after[0]) == (9 if what == "ingest" else 6)
    if what == "ingest":
        assert store.ingest(groups(spark, JOBS[3:]), label="b") is None and state(store) == after
    store.compact()
    folders = {p.name for p in (tmp_path / "s" / "data" / "entries").iterdir()}
    live = {f.rsplit("/", 1)[1] for v in store._versions() for f in store._load(v).folders() if "/entries/" in f}
    assert folders == live  # what the stopped writers left is gone
    assert commit is Store._commit


def test_two_writers_and_readers_of_old_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, JOBS[:2]), label="a", now_ms=5)
    m = store.manifest()
    reader = LogStore.of(store)
    store.ingest(groups(spark, JOBS[2:]), label="b", now_ms=6)
    with pytest.raises(Conflict):
        store._commit(m)
    assert reader.replay(None, None).count() == 2  # the version it began with
    assert len(lines(store)) == 6


def test_rerun_batches_after_maintenance(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("t", i, x) for i, x in enumerate(JOBS)]
    df = spark.createDataFrame(rows, "topic string, offset long, value string").withColumn("timestamp", F.timestamp_millis(F.col("offset") + 1000))
    runner = StreamIngest(store, compact_every=0.0, now_ms=9)
    for _ in range(3):  # each run is followed by relearning and compaction
        runner.batch(df.where("offset < 3"), 0)
    runner.batch(df.where("offset >= 3"), 1)
    runner.batch(df.where("offset < 3"), 0)
    got = state(store)
    assert got[0] == sorted(JOBS) and sum(got[2].values()) == 6 and got[1] == got[2]


def test_poisoned_records_go_to_the_dead_letters(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("t", i, f"line {i} poison" if i in (3, 11) else f"line {i}") for i in range(16)] + [("t", 16, None)]
    df = spark.createDataFrame(rows, "topic string, offset long, value string").withColumn("timestamp", F.timestamp_millis(F.col("offset") + 1000))
    ingest = Store.ingest

    def poisoned(self, groups, **kw):
        if not groups.where(F.col("header").contains("poison")).isEmpty():
            raise ValueError("poison")
        return ingest(self, groups, **kw)

    monkeypatch.setattr(Store, "ingest", poisoned)
    runner = StreamIngest(store, dead_letters=str(tmp_path / "dead"), source="own", now_ms=9)
    runner.batch(df, 4)
    runner.batch(df, 4)
    assert lines(store) == [r[2] for r in rows if r[2] and "poison" not in r[2]]
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert sorted((r.offset, r.error) for r in dead) == [(3, "poison"), (11, "poison"), (16, "no value")]
    assert store.done(stream=("stream", 4)) and store.manifest().labels == []


def test_records_at_most(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([("t", i, f"line {i}") for i in range(40)], "topic string, offset long, value string").withColumn("timestamp", F.timestamp_millis(F.col("offset") + 1000))
    df.repartitionByRange(4, "offset").write.parquet(source)
    store = Store(spark, str(tmp_path / "s"))
    runner = StreamIngest(store, max_records=15, now_ms=9)
    runner.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "ck"), "1 second").awaitTermination(120)
    assert len(lines(store)) == 15


def test_scan_prunes_by_template(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ingest(groups(spark, [f"user=u{i % 2} took {i}ms" for i in range(10)], ts=1000), label="a", now_ms=5)
    store.compact()
    plan = LogStore.of(store).query_lines("user=u0 took {size}")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(template_id," in plan or "In(template_id," in plan


def test_lines_of_standard_input(spark):
    import io

    data = "".join(f"2024-01-01T00:00:{i % 60:02d}Z é line {i}\r\n" for i in range(3000)).encode()
    rows = spooled_lines(spark, io.BytesIO(data), chunk=1000).orderBy("block", "line_no").collect()
    assert [r.value for r in rows] == data.decode().split("\r\n")[:-1] and {r.source for r in rows} == {"stdin"}


def many(spark, n):
    """Queue records of one shape, each of a pattern of its own."""
    word = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    return spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("offset"), F.timestamp_millis(F.col("id") + 1000).alias("timestamp"), F.concat(F.lit("job j="), word, F.lit("x finished ok")).alias("value"))


def test_every_pattern_of_a_large_batch_becomes_a_template(spark, tmp_path):
    store, n = Store(spark, str(tmp_path / "s")), 100_003
    store.ingest(message_groups(many(spark, n)), label="a", now_ms=5, learn=False)
    templates = store.templates().agg(F.count("*"), F.countDistinct("template_id"), F.min("template_id"), F.max("template_id"), F.sum("occurrences")).first()
    assert tuple(templates) == (n, n, 1, n, n) and store.raws().isEmpty()
    assert store.templates().where(f"template_id = {n}").first().pattern == "job j=baaaacx finished ok"  # numbered by their first lines
    assert store.relearn() == {"merged": 1, "folded": n, "remapped": 0}
    assert store.compact(relearn=False) and store.relearn()["merged"] == 0 and not store.compact()
    assert [(r.template_id, r.pattern, r.occurrences) for r in LogStore.of(store).top_templates().collect()] == [(n + 1, "job j={var} finished ok", n)]


def test_a_stream_of_many_patterns_counts_like_a_batch(spark, tmp_path):
    source, n = str(tmp_path / "in"), 100_003
    many(spark, n).repartitionByRange(1, "offset").write.parquet(source)
    store = Store(spark, str(tmp_path / "s"))
    StreamIngest(store, now_ms=9).drain(spark.readStream.schema(many(spark, 1).schema).parquet(source), str(tmp_path / "ck"))
    assert [(r.pattern, r.n) for r in LogStore.of(store).template_counts(None, None).collect()] == [("job j={var} finished ok", n)]


def test_rerun_batches_of_many_patterns(spark, tmp_path):
    store, n = Store(spark, str(tmp_path / "s")), 100_013
    runner = StreamIngest(store, compact_every=0.0, now_ms=9)
    for number, part in ((0, "offset < 100003"), (0, "offset < 100003"), (1, "offset >= 100003"), (0, "offset < 100003")):
        runner.batch(many(spark, n).where(part), number)
    assert [(r.pattern, r.n) for r in LogStore.of(store).template_counts(None, None).collect()] == [("job j={var} finished ok", n)]
    assert store.templates().agg(F.sum("occurrences")).first()[0] == n
