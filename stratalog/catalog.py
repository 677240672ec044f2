"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures as X
from .functions import masking, text
from .operators import grouping, learner
from .operators.ingest import parsed
from .plans.queries import LogStore
from .plans.store import Store, reconstructed
from .ship import ship
from .sources.lines import message_groups, search_hits
from .streaming.ingest import StreamIngest
from .work import work_path, written

DAY = 86_400_000
#: 2024-01-20 to 2024-01-23 and the like, in epoch milliseconds.
FROM, TO = 1_705_708_800_000, 1_705_968_000_000
NOW = 1_706_745_600_000
ERROR_PATTERN = '{ts} ERROR session {var} did error latency={size} props={{"k": {num}}}'
VIEW_PATTERN = '{ts} INFO session {var} did view latency={size} props={{"k": {num}}}'

_stores: dict[tuple[str, str], Store] = {}


def fixture_store(spark: SparkSession, sf_dir: str) -> Store:
    """All events ingested once an application; the queries below read this store."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, work_path(spark, "store"))
        store.ingest(X.event_groups(spark, sf_dir), label="events", now_ms=NOW)
        # with no room for templates, lines that fit none are stored raw
        store.ingest(X.raw_groups(spark, sf_dir), label="raws", now_ms=NOW, learn=False, max_templates=0)
        _stores[key] = store
    return _stores[key]


def logs(spark: SparkSession, sf_dir: str) -> LogStore:
    return LogStore.of(fixture_store(spark, sf_dir))


def _by_pattern(df: DataFrame) -> DataFrame:
    return df.drop("template_id")


def _id_of(store: LogStore, pattern: str) -> int:
    return store.templates.where(F.col("pattern") == pattern).first()["template_id"]


def _join(values, by: str = chr(31)):
    return F.array_join(values, by)


# -- masking and learning


def mask_params(spark, sf_dir):
    rows = masking.masked(X.events(spark, sf_dir).withColumn("line", X.line()), "line")
    return rows.select("event_id", _join(F.col("params"), "|").alias("params"))


def mask_pattern_counts(spark, sf_dir):
    rows = masking.masked(X.events(spark, sf_dir).withColumn("line", X.line()), "line")
    return rows.groupBy("pattern").agg(F.count("*").alias("n"))


def learned_templates(spark, sf_dir):
    rows = masking.masked(X.events(spark, sf_dir).withColumn("line", X.line()), "line").groupBy("pattern").agg(F.count("*").alias("n"))
    rows = written(rows, "patterns")
    final = rows.join(learner.plans(rows).withColumnRenamed("source_pattern", "pattern"), "pattern", "left")
    return final.groupBy(F.coalesce("final_pattern", "pattern").alias("template")).agg(F.sum("n").alias("n"))


def learn_boundary(spark, sf_dir):
    """Eight users stay apart, nine become a variable."""
    out = None
    for users in (8, 9):
        rows = masking.masked(X.events(spark, sf_dir).where(F.col("user_id") < users).withColumn("line", X.line()), "line")
        rows = written(rows.select("pattern").distinct(), "patterns")
        final = rows.join(learner.plans(rows).withColumnRenamed("source_pattern", "pattern"), "pattern", "left")
        one = final.select(F.lit(users).alias("users"), F.coalesce("final_pattern", "pattern").alias("template")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def _roundtrip(table: str, key: list[str], column: str):
    def run(spark, sf_dir):
        rows = ship(spark).read.parquet(f"{sf_dir}/{table}.parquet").select(*key, F.posexplode(F.split(column, "\n", -1)).alias("line_no", "original"))
        rows = masking.masked(rows, "original")
        return rows.select(*key, "line_no", masking.unmask(F.col("pattern"), F.col("params")).alias("line"))

    return run


def roundtrip_events(spark, sf_dir):
    rows = masking.masked(X.events(spark, sf_dir).withColumn("original", X.line()), "original")
    return rows.select("event_id", masking.unmask(F.col("pattern"), F.col("params")).alias("line"))


def reconstruct_entries(spark, sf_dir):
    s = logs(spark, sf_dir)
    return reconstructed(s.entries, s.templates).select((F.col("entry_id") - 1).alias("event_id"), "line")


def similarity_best(spark, sf_dir):
    """For each event type's first line the most similar one of another type."""
    one = X.events(spark, sf_dir).groupBy("event_type").agg(F.min_by(F.split(X.body(), " ", -1), "event_id").alias("words"))
    one = written(one, "lines")
    found = learner.most_similar(one.withColumnRenamed("event_type", "id"), one.withColumnRenamed("event_type", "template_id"), 0.4, others=True)
    return found.select(F.col("id").alias("a"), F.col("template_id").alias("b"), text.rounded(F.col("similarity"), 4).alias("similarity"))


def sha256_lines(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", masking.digest(X.line()).alias("digest"))


# -- grouping, times and tokens


def multiline_groups(spark, sf_dir):
    found = grouping.groups(X.multiline(spark, sf_dir))
    return found.select((F.col("seq") - 1).alias("event_id"), F.size("continuation").alias("n_continuation"), F.sha2(F.concat_ws("\n", "header", _join(F.col("continuation"), "\n")), 256).alias("digest"))


def kafka_split(spark, sf_dir):
    found = message_groups(X.records(spark, sf_dir))
    return found.select(F.col("seq").alias("event_id"), "header", _join(F.col("continuation"), "\n").alias("rest"), F.col("source_ts").alias("ts_ms"))


def ts_extract(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", text.event_time(X.line()).alias("ts_ms"))


def ts_carry_forward(spark, sf_dir):
    """Every third event has its time in the line; the others take the one before."""
    header = F.when(F.col("event_id") % 3 == 0, X.line()).otherwise(X.body())
    groups = X.events(spark, sf_dir).select(F.lit("events").alias("source"), F.col("event_id").alias("seq"), header.alias("header"), F.array().cast("array<string>").alias("continuation"), F.lit(None).cast("long").alias("source_ts"))
    return parsed(groups, 0).select(F.col("seq").alias("event_id"), F.col("log_timestamp").alias("ts_ms"), "resolved")


TOKENS = {
    "-42": "NUM", "0.001": "NUM", "38%": "NUM", "2024-01-15": "TS", "2024-01-15T10:00:00Z": "TS", "06:21:06.123": "TIME", "10.0.0.1": "IP", "docker[25559]:": "PROC",
    "d41d8cd98f00b204e9800998ecf8427e": "HASH", "123e4567-e89b-12d3-a456-426614174000": "UUID", "user=42": "KV", "user=bob": "STATIC", "a=b=7": "KV", "a=b=c=d=e=f=7": "KV", "=7": "STATIC", "lane9": "STATIC", "r2beta3": "STATIC", "": "STATIC",
}
PATTERNS = {
    "moved {num} of {num} parcels": "num,num_1",
    "PUT /shelf/{{slot}} {state}": "state",
    "{ip} refused {num} times": "ip,num",
    '{{"n":{num}}}': "num",
    "plain": "",
    "{{}}": "",
    "{a}{a}{a}{b}": "a,a_1,a_2,b",
}
STRIPS = {("user=usr_1", "user"): "usr_1", ("num=5", "num_1"): "5", ("16ms", "duration"): "16ms", ("a=b", "user"): "a=b", ("=x", "x"): "=x"}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


def _listed(spark, names: str, rows) -> DataFrame:
    rows = [r for r in rows]
    return ship(spark).createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def token_classify(spark, sf_dir):
    return _listed(spark, "token", [(k,) for k in TOKENS]).select("token", text.token_class(F.col("token")).alias("kind"))


def slot_names(spark, sf_dir):
    return _listed(spark, "pattern", [(k,) for k in PATTERNS]).select("pattern", _join(masking.slot_names(masking.slots(F.col("pattern"))), ",").alias("names"))


def strip_key_prefix(spark, sf_dir):
    return _listed(spark, "value slot", STRIPS).select("value", "slot", masking.strip_key_prefix(F.col("value"), F.col("slot")).alias("stripped"))


def token_classes(spark, sf_dir):
    """How many tokens of all documents are of each class."""
    rows = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"[ \t\n\f\r]+", -1)).alias("token"))
    return rows.groupBy(text.token_class(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


def normalised_lines(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", text.normalised(X.line()).alias("line"))


def named_roundtrip(spark, sf_dir):
    """Lines back from values by slot name."""
    rows = masking.masked(X.events(spark, sf_dir).withColumn("original", X.line()), "original")
    own = masking.slots(F.col("pattern"))
    rows = rows.select("event_id", "pattern", masking.slot_count(F.col("pattern")).alias("n_slots"), masking.param_map(own, F.col("params")).alias("values"))
    return rows.select("event_id", "n_slots", F.col("values")["size"].alias("size"), masking.unmask_named(F.col("pattern"), F.col("values")).alias("line"))


def iso_times(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", text.iso_fixed(F.col("ts").cast("timestamp")).alias("iso"))


def search_export(spark, sf_dir):
    """Hits of a search engine, some twice and some broken, flattened."""
    path = work_path(spark, "hits")
    own = X.events(spark, sf_dir)
    hit = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("_id"), F.lit("logs").alias("_index"), F.struct(X.line().alias("message"), F.col("event_type").alias("kind")).alias("_source")))
    again = own.where("event_id % 7 = 0").select(hit.alias("value"))
    broken = own.where("event_id % 11 = 0").select(F.concat(F.lit('{"_id": "x'), F.col("event_id").cast("string")).alias("value"))
    own.select(hit.alias("value")).unionByName(again).unionByName(broken).write.text(path)
    found = search_hits(spark, path)
    return found.select("_id", "message", F.col("_source")["kind"].alias("kind"))


# -- queries over the store


def template_numbering(spark, sf_dir):
    """Templates are numbered by their first lines."""
    return fixture_store(spark, sf_dir).templates().select("template_id", "pattern", "occurrences")


def updated_templates(spark, sf_dir):
    """Templates that changed since a time, and since a later one."""
    s = logs(spark, sf_dir)
    return _by_pattern(s.top_templates(since_ms=NOW)).withColumn("since", F.lit(0)).unionByName(_by_pattern(s.top_templates(since_ms=NOW + 1)).withColumn("since", F.lit(1)))


def template_count(spark, sf_dir):
    s = logs(spark, sf_dir)
    return s.template_count(_id_of(s, VIEW_PATTERN), FROM, TO)


def recent_entries(spark, sf_dir):
    s = logs(spark, sf_dir)
    return s.recent_entries(_id_of(s, VIEW_PATTERN), 25, newest=True).select((F.col("entry_id") - 1).alias("event_id"), "line")


def investigate_new(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).investigate(FROM, TO, time_basis="event")["new_templates"])


def investigate_raw(spark, sf_dir):
    return logs(spark, sf_dir).investigate(FROM - 20 * DAY, TO, raw_sample=20)["raw_sample"].select("content", "log_timestamp")



def top_templates(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).top_templates())


def search_templates(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).search_templates("did error"))


def anomalies(spark, sf_dir):
    return logs(spark, sf_dir).anomalies(since_ms=NOW + 1).select("pattern", "occurrences")


def suggestions(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).suggestions("pool {num} exhausted view", 3))


def template_counts_window(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).template_counts(FROM, TO))


def template_counts_baseline(spark, sf_dir):
    found = logs(spark, sf_dir).template_counts_with_baseline(FROM, TO)
    return _by_pattern(found).withColumn("ratio", F.round("ratio", 6))


def new_templates(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).new_templates(FROM, TO))


def _series(bucket: int):
    def run(spark, sf_dir):
        s = logs(spark, sf_dir)
        return s.timeseries(_id_of(s, VIEW_PATTERN), FROM, TO, bucket)

    return run


def slot_top_values(spark, sf_dir):
    s = logs(spark, sf_dir)
    found = s.inspect_slots(_id_of(s, VIEW_PATTERN), 5)
    return found.select("name", F.posexplode("top_values").alias("place", "top")).where("name IN ('var', 'num')").select("name", "place", "top.value", "top.n")


def slot_distinct(spark, sf_dir):
    s = logs(spark, sf_dir)
    return s.inspect_slots(_id_of(s, VIEW_PATTERN)).select("name", "distinct_values")


def slot_numeric(spark, sf_dir):
    s = logs(spark, sf_dir)
    found = s.inspect_slots(_id_of(s, VIEW_PATTERN)).where("name = 'size'")
    return found.select("name", "num_count", "num_min", "num_max", "num_avg", "num_p50", "num_p95", "num_unit")


def query_structured(spark, sf_dir):
    found = logs(spark, sf_dir).query_structured(ERROR_PATTERN, None, FROM - 7 * DAY, FROM, 100)
    return found.select("log_timestamp", (F.col("entry_id") - 1).alias("event_id"), _join(F.col("values"), "|").alias("vals"))


def query_structured_filtered(spark, sf_dir):
    found = logs(spark, sf_dir).query_structured(VIEW_PATTERN, {"var": "u7q"}, None, None, 1000, ["size", "num"])
    return found.select("log_timestamp", (F.col("entry_id") - 1).alias("event_id"), _join(F.col("values"), "|").alias("vals"))


def query_lines(spark, sf_dir):
    return logs(spark, sf_dir).query_lines(VIEW_PATTERN.replace("{num}", "{id}"), {"var": "u3q"}, limit=200).select("log_timestamp", "line")


def replay_window(spark, sf_dir):
    return logs(spark, sf_dir).replay(FROM, FROM + DAY).select("log_timestamp", "side", "line")


def raw_logs_search(spark, sf_dir):
    return logs(spark, sf_dir).raw_logs(FROM - 20 * DAY, TO, 'k": 1').select("log_id", "content", "log_timestamp")


def investigate_summary(spark, sf_dir):
    return logs(spark, sf_dir).investigate(FROM, TO)["summary"]


def investigate_spikes(spark, sf_dir):
    return _by_pattern(logs(spark, sf_dir).investigate(FROM, TO)["spikes"])


def stats(spark, sf_dir):
    return logs(spark, sf_dir).stats()


# -- storage and streaming


def _half_store(spark, sf_dir, learn: bool = True) -> Store:
    """Two batches with a compaction between them."""
    store = Store(spark, work_path(spark, "store"))
    groups = X.event_groups(spark, sf_dir)
    middle = groups.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    store.ingest(groups.where(F.col("seq") <= middle), label="a", now_ms=NOW, learn=learn)
    store.compact(relearn=False)
    store.ingest(groups.where(F.col("seq") > middle), label="b", now_ms=NOW, learn=learn)
    return store


def compact_union(spark, sf_dir):
    """The same lines from archive and live tail as from the events."""
    store = _half_store(spark, sf_dir)
    store.compact()
    return reconstructed(store.entries(), store.templates()).select((F.col("entry_id") - 1).alias("event_id"), "line")


def relearn_fold(spark, sf_dir):
    """All patterns are stored as they come, then folded in the live tier."""
    store = Store(spark, work_path(spark, "store"))
    store.ingest(X.event_groups(spark, sf_dir), label="a", now_ms=NOW, learn=False)
    store.relearn()
    return _by_pattern(LogStore.of(store).top_templates())


def maintenance_reports(spark, sf_dir):
    """What relearning and compaction say they did, and what a second run finds to do."""
    store = Store(spark, work_path(spark, "store"))
    store.ingest(X.event_groups(spark, sf_dir), label="a", now_ms=NOW, learn=False)
    first, moved, again, rest = store.relearn(), store.compact(relearn=False), store.relearn(), store.compact()
    return ship(spark).createDataFrame([(first["merged"], first["folded"], first["remapped"], moved, again["merged"], rest)], "merged long, folded long, remapped long, compacted boolean, merged_again long, compacted_again boolean")


def stream_rerun(spark, sf_dir):
    """Micro-batches that run again after maintenance change nothing: counts and counters."""
    store = Store(spark, work_path(spark, "store"))
    runner = StreamIngest(store, compact_every=0.0, now_ms=NOW)
    records = X.records(spark, sf_dir)
    for number, half in ((0, 0), (0, 0), (1, 1), (0, 0), (1, 1)):
        runner.batch(records.where(F.col("offset") % 2 == half), number)
    counts = LogStore.of(store).template_counts(None, None)
    return _by_pattern(counts.join(store.templates().select("template_id", "occurrences"), "template_id"))


def stream_limit(spark, sf_dir):
    """A stream that ends after so many records."""
    store = Store(spark, work_path(spark, "store"))
    runner = StreamIngest(store, max_records=500, now_ms=NOW)
    runner.batch(X.records(spark, sf_dir).where("offset < 400"), 0)
    runner.batch(X.records(spark, sf_dir).where("offset >= 400"), 1)
    return LogStore.of(store).replay(None, None).select("line")


def cap_overflow(spark, sf_dir):
    """With two templates at most, the lines of the others are raw and whole."""
    store = Store(spark, work_path(spark, "store"))
    store.ingest(X.event_groups(spark, sf_dir), label="a", now_ms=NOW, max_templates=2)
    lines = LogStore.of(store).replay(None, None)
    return lines.select("line")


def stream_counts(spark, sf_dir):
    """Records read as a stream in micro-batches, relearned and compacted: counts as in one batch."""
    source, base = work_path(spark, "records"), work_path(spark, "stream")
    X.records(spark, sf_dir).repartitionByRange(2, "offset").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = Store(spark, f"{base}/store")
    runner = StreamIngest(store, now_ms=NOW)
    runner.start(stream, f"{base}/checkpoint", None).awaitTermination()
    store.relearn()
    store.compact(relearn=False)
    return _by_pattern(LogStore.of(store).template_counts(None, None))


QUERIES = {
    "mask_params": mask_params,
    "mask_pattern_counts": mask_pattern_counts,
    "learned_templates": learned_templates,
    "learn_boundary": learn_boundary,
    "roundtrip_events": roundtrip_events,
    "roundtrip_documents": _roundtrip("documents", ["doc_id"], "text"),
    "roundtrip_pages": _roundtrip("pages", ["page_id"], "html"),
    "roundtrip_conversations": _roundtrip("conversations", ["conv_id", "turn"], "text"),
    "reconstruct_entries": reconstruct_entries,
    "similarity_best": similarity_best,
    "sha256_lines": sha256_lines,
    "multiline_groups": multiline_groups,
    "kafka_split": kafka_split,
    "ts_extract": ts_extract,
    "ts_carry_forward": ts_carry_forward,
    "token_classify": token_classify,
    "slot_names": slot_names,
    "strip_key_prefix": strip_key_prefix,
    "top_templates": top_templates,
    "search_templates": search_templates,
    "anomalies": anomalies,
    "suggestions": suggestions,
    "template_counts_window": template_counts_window,
    "template_counts_baseline": template_counts_baseline,
    "new_templates": new_templates,
    "timeseries_hourly": _series(3_600_000),
    "timeseries_daily": _series(DAY),
    "slot_top_values": slot_top_values,
    "slot_distinct": slot_distinct,
    "slot_numeric": slot_numeric,
    "query_structured": query_structured,
    "query_structured_filtered": query_structured_filtered,
    "query_lines": query_lines,
    "replay_window": replay_window,
    "raw_logs_search": raw_logs_search,
    "investigate_summary": investigate_summary,
    "investigate_spikes": investigate_spikes,
    "stats": stats,
    "compact_union": compact_union,
    "relearn_fold": relearn_fold,
    "cap_overflow": cap_overflow,
    "stream_counts": stream_counts,
    "token_classes": token_classes,
    "normalised_lines": normalised_lines,
    "named_roundtrip": named_roundtrip,
    "iso_times": iso_times,
    "search_export": search_export,
    "template_numbering": template_numbering,
    "updated_templates": updated_templates,
    "template_count": template_count,
    "recent_entries": recent_entries,
    "investigate_new": investigate_new,
    "investigate_raw": investigate_raw,
    "maintenance_reports": maintenance_reports,
    "stream_rerun": stream_rerun,
    "stream_limit": stream_limit,
}

_MS = "(epoch_us(ts) // 1000)"
_LATE = "(event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00')"
_BODY = f"""CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' session u' || user_id || 'q did ' || event_type || ' latency=' || printf('%.2f', value) || 'ms props=' || props || CASE WHEN {_LATE} THEN ' pool exhausted' ELSE '' END"""
_LINE = f"strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || {_BODY}"


def _pattern(user: str) -> str:
    return f"""'{{ts}} ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' session ' || {user} || ' did ' || event_type || ' latency={{size}} props={{{{"k": {{num}}}}}}' || CASE WHEN {_LATE} THEN ' pool exhausted' ELSE '' END"""


_TEMPLATE = _pattern("'{var}'")
_OWN = _pattern("'u' || user_id || 'q'")
_IN = f"{_MS} BETWEEN {FROM} AND {TO}"
_BASE = f"{_MS} BETWEEN {FROM - (TO - FROM)} AND {FROM}"
_K = "regexp_extract(props, '[0-9]+')"
_SIZE = "printf('%.2f', value) || 'ms'"
_VIEW = "event_type = 'view'"
_COUNTS = f"WITH c AS (SELECT {_TEMPLATE} AS pattern, count(*) AS occurrences FROM events GROUP BY 1)"
_CLASS = " ".join(f"WHEN regexp_full_match(token, '{p}') THEN '{name}'" for name, p in text.CLASSES)
_RAW = f"SELECT row_number() OVER (ORDER BY event_id) AS log_id, 'unparsed ' || props AS content, {_MS} AS log_timestamp FROM events WHERE event_type = 'signup' AND event_id % 50 = 0"


def _split_sql(table: str, key: str, column: str) -> str:
    return f"SELECT {key}, (i - 1)::INTEGER AS line_no, parts[i] AS line FROM (SELECT {key}, string_split({column}, chr(10)) AS parts FROM {table}), unnest(generate_series(1, len(parts))) AS u(i)"


def _series_sql(bucket: int) -> str:
    return f"SELECT {_MS} // {bucket} * {bucket} AS bucket_ms, count(*) AS n FROM events WHERE {_VIEW} AND {_IN} GROUP BY 1"


SQL = {
    "mask_params": f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || {_SIZE} || '|' || {_K} AS params FROM events",
    "mask_pattern_counts": f"SELECT {_OWN} AS pattern, count(*) AS n FROM events GROUP BY 1",
    "learned_templates": f"SELECT {_TEMPLATE} AS template, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "learn_boundary": f"""
        WITH e AS (SELECT *, {_LATE} AS late FROM events WHERE user_id < 9),
        u AS (SELECT event_type, late, count(DISTINCT user_id) AS users FROM e GROUP BY ALL)
        SELECT DISTINCT 8 AS users, {_OWN} AS template FROM e WHERE user_id < 8
        UNION ALL SELECT DISTINCT 9, CASE WHEN u.users > 8 THEN {_TEMPLATE} ELSE {_OWN} END FROM e JOIN u USING (event_type, late)""",
    "roundtrip_events": f"SELECT event_id, {_LINE} AS line FROM events",
    "roundtrip_documents": _split_sql("documents", "doc_id", "text"),
    "roundtrip_pages": _split_sql("pages", "page_id", "html"),
    "roundtrip_conversations": _split_sql("conversations", "conv_id, turn", "text"),
    "reconstruct_entries": f"SELECT event_id, {_LINE} AS line FROM events",
    "similarity_best": f"""
        WITH w AS (SELECT event_type, string_split(arg_min({_BODY}, event_id), ' ') AS words FROM events GROUP BY 1)
        SELECT a, first(b ORDER BY similarity DESC, b) AS b, max(similarity) AS similarity FROM (SELECT a.event_type AS a, b.event_type AS b,
               floor(list_sum(list_transform(generate_series(1, greatest(len(a.words), len(b.words))), lambda i: CASE WHEN a.words[i] = b.words[i] THEN 1 ELSE 0 END))::DOUBLE
                     / greatest(len(a.words), len(b.words)) * 10000 + 0.5) / 10000.0 AS similarity
        FROM w a JOIN w b ON a.event_type <> b.event_type) WHERE similarity > 0.4 GROUP BY a""",
    "sha256_lines": f"SELECT event_id, sha256({_LINE}) AS digest FROM events",
    "multiline_groups": f"""
        WITH c AS (SELECT event_id, {_LINE} AS header, CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END AS n FROM events)
        SELECT event_id, n::INTEGER AS n_continuation,
               sha256(header || chr(10) || array_to_string(list_transform(generate_series(0, n - 1), lambda j: chr(9) || 'at com.example.C' || event_id || '.m(C.java:' || j || ')'), chr(10))) AS digest
        FROM c""",
    "kafka_split": f"SELECT event_id, {_LINE} AS header, CASE WHEN event_id % 5 = 0 THEN chr(9) || 'at frame ' || event_id ELSE '' END AS rest, {_MS} AS ts_ms FROM events",
    "ts_extract": f"SELECT event_id, {_MS} AS ts_ms FROM events",
    "ts_carry_forward": f"SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN {_MS} END IGNORE NULLS) OVER (ORDER BY event_id) AS ts_ms, event_id % 3 = 0 AS resolved FROM events",
    "token_classify": f"SELECT * FROM (VALUES {_values(TOKENS.items())}) AS t(token, kind)",
    "slot_names": f"SELECT * FROM (VALUES {_values(PATTERNS.items())}) AS t(pattern, names)",
    "strip_key_prefix": f"SELECT * FROM (VALUES {_values((*k, v) for k, v in STRIPS.items())}) AS t(value, slot, stripped)",
    "top_templates": f"{_COUNTS} SELECT pattern, occurrences FROM c",
    "search_templates": f"{_COUNTS} SELECT pattern, occurrences FROM c WHERE pattern LIKE '%did error%'",
    "anomalies": f"{_COUNTS} SELECT pattern, occurrences FROM c WHERE upper(pattern) LIKE '%ERROR%'",
    "suggestions": f"""{_COUNTS}, w AS (SELECT pattern, occurrences FROM c WHERE pattern LIKE '%pool%' OR pattern LIKE '%num%' OR pattern LIKE '%exhausted%' OR pattern LIKE '%view%')
        SELECT pattern, occurrences FROM c WHERE pattern IN (
            SELECT pattern FROM (
                SELECT pattern, min(word) AS word FROM (
                    SELECT pattern, 0 AS word FROM c WHERE pattern LIKE '%pool%'
                    UNION ALL SELECT pattern, 1 FROM c WHERE pattern LIKE '%num%'
                    UNION ALL SELECT pattern, 2 FROM c WHERE pattern LIKE '%exhausted%'
                    UNION ALL SELECT pattern, 3 FROM c WHERE pattern LIKE '%view%') GROUP BY 1))
        ORDER BY occurrences DESC LIMIT 3""",
    "template_counts_window": f"SELECT {_TEMPLATE} AS pattern, count(*) AS n FROM events WHERE {_IN} GROUP BY 1",
    "template_counts_baseline": f"""
        SELECT pattern, w AS window_count, b AS baseline_count, round(w::DOUBLE / nullif(b, 0), 6) AS ratio
        FROM (SELECT {_TEMPLATE} AS pattern, count(*) FILTER ({_IN}) AS w, count(*) FILTER ({_BASE}) AS b FROM events GROUP BY 1) WHERE w > 0""",
    "new_templates": f"SELECT pattern, first_seen_ms, window_count FROM (SELECT {_TEMPLATE} AS pattern, min({_MS}) AS first_seen_ms, count(*) FILTER ({_IN}) AS window_count FROM events GROUP BY 1) WHERE first_seen_ms BETWEEN {FROM} AND {TO}",
    "timeseries_hourly": _series_sql(3_600_000),
    "timeseries_daily": _series_sql(DAY),
    "slot_top_values": f"""
        WITH v AS (SELECT 'var' AS name, 'u' || user_id || 'q' AS value FROM events WHERE {_VIEW} UNION ALL SELECT 'num', {_K} FROM events WHERE {_VIEW}),
        r AS (SELECT name, value, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value) - 1 AS place FROM v GROUP BY 1, 2)
        SELECT name, place::INTEGER AS place, value, n FROM r WHERE place < 5""",
    "slot_distinct": f"""
        SELECT name, distinct_values FROM (
            SELECT 'ts' AS name, count(DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')) AS distinct_values FROM events WHERE {_VIEW}
            UNION ALL SELECT 'var', count(DISTINCT user_id) FROM events WHERE {_VIEW}
            UNION ALL SELECT 'size', count(DISTINCT {_SIZE}) FROM events WHERE {_VIEW}
            UNION ALL SELECT 'num', count(DISTINCT {_K}) FROM events WHERE {_VIEW})""",
    "slot_numeric": f"""
        WITH v AS (SELECT printf('%.2f', value)::DOUBLE AS x FROM events WHERE {_VIEW})
        SELECT 'size' AS name, count(*)::BIGINT AS num_count, min(x) AS num_min, max(x) AS num_max, floor(avg(x) * 100 + 0.5) / 100.0 AS num_avg,
               floor(quantile_cont(x, 0.5) * 100 + 0.5) / 100.0 AS num_p50, floor(quantile_cont(x, 0.95) * 100 + 0.5) / 100.0 AS num_p95, 'ms' AS num_unit FROM v""",
    "query_structured": f"""
        SELECT {_MS} AS log_timestamp, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|u' || user_id || 'q|' || {_SIZE} || '|' || {_K} AS vals
        FROM events WHERE event_type = 'error' AND NOT {_LATE} AND {_MS} BETWEEN {FROM - 7 * DAY} AND {FROM} ORDER BY 1, 2 LIMIT 100""",
    "query_structured_filtered": f"SELECT {_MS} AS log_timestamp, event_id, {_SIZE} || '|' || {_K} AS vals FROM events WHERE {_VIEW} AND user_id = 7 ORDER BY 1, 2 LIMIT 1000",
    "query_lines": f"SELECT {_MS} AS log_timestamp, {_LINE} AS line FROM events WHERE {_VIEW} AND user_id = 3 ORDER BY 1, event_id LIMIT 200",
    "replay_window": f"""
        SELECT {_MS} AS log_timestamp, 0 AS side, {_LINE} AS line FROM events WHERE {_MS} BETWEEN {FROM} AND {FROM + DAY}
        UNION ALL SELECT log_timestamp, 1, content FROM ({_RAW}) WHERE log_timestamp BETWEEN {FROM} AND {FROM + DAY}""",
    "raw_logs_search": f"""SELECT log_id, content, log_timestamp FROM ({_RAW}) WHERE content LIKE '%k": 1%' AND log_timestamp BETWEEN {FROM - 20 * DAY} AND {TO} ORDER BY log_timestamp, log_id LIMIT 500""",
    "investigate_summary": f"""
        SELECT {FROM}::BIGINT AS window_from_ms, {TO}::BIGINT AS window_to_ms, {FROM - (TO - FROM)}::BIGINT AS baseline_from_ms, {FROM}::BIGINT AS baseline_to_ms, count(*) AS total_window_entries,
               floor(count(*) FILTER (event_type = 'error')::DOUBLE / count(*) * 1000 + 0.5) / 1000.0 AS error_rate
        FROM events WHERE {_IN}""",
    "investigate_spikes": f"""
        SELECT pattern, w AS window_count, b AS baseline_count, floor(w::DOUBLE / nullif(b, 0) * 100 + 0.5) / 100.0 AS ratio, pattern LIKE '%ERROR%' AS is_error
        FROM (SELECT {_TEMPLATE} AS pattern, count(*) FILTER ({_IN}) AS w, count(*) FILTER ({_BASE}) AS b FROM events GROUP BY 1) WHERE w > 0""",
    "stats": f"SELECT (SELECT count(DISTINCT {_TEMPLATE}) FROM events) AS template_count, (SELECT count(*) FROM events) AS log_entry_count, (SELECT count(*) FROM ({_RAW})) AS raw_log_count",
    "compact_union": f"SELECT event_id, {_LINE} AS line FROM events",
    "relearn_fold": f"{_COUNTS} SELECT pattern, occurrences FROM c",
    "cap_overflow": f"SELECT {_LINE} AS line FROM events",
    "token_classes": f"""
        WITH t AS (SELECT unnest(string_split_regex(text, '[ \\t\\n\\f\\r]+')) AS token FROM documents)
        SELECT CASE WHEN token = '' THEN 'STATIC' {_CLASS} WHEN regexp_full_match(token, '[^=]+=(?:[^=]+=)*(?:{"|".join(f"(?:{p})" for _, p in text.CLASSES)})') THEN 'KV' ELSE 'STATIC' END AS kind, count(*) AS n FROM t GROUP BY 1""",
    "normalised_lines": f"SELECT event_id, regexp_replace(regexp_replace({_LINE}, '^[^ ]+', '{{ts}}'), '[0-9]+\\}}', '{{num}}') AS line FROM events",
    "named_roundtrip": f"SELECT event_id, 3 AS n_slots, {_SIZE} AS size, {_LINE} AS line FROM events",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS iso FROM events",
    "search_export": f"SELECT 'e' || event_id AS _id, {_LINE} AS message, event_type AS kind FROM events",
    "template_numbering": f"SELECT row_number() OVER (ORDER BY min(event_id)) AS template_id, {_TEMPLATE} AS pattern, count(*) AS occurrences FROM events GROUP BY 2",
    "updated_templates": f"{_COUNTS} SELECT pattern, occurrences, 0 AS since FROM c",
    "template_count": f"SELECT count(*) AS n FROM events WHERE {_VIEW} AND {_IN}",
    "recent_entries": f"SELECT event_id, {_LINE} AS line FROM events WHERE {_VIEW} ORDER BY {_MS} DESC, event_id DESC LIMIT 25",
    "investigate_new": f"SELECT pattern, first_seen_ms, window_count FROM (SELECT {_TEMPLATE} AS pattern, min({_MS}) AS first_seen_ms, count(*) FILTER ({_IN}) AS window_count FROM events GROUP BY 1) WHERE first_seen_ms BETWEEN {FROM} AND {TO}",
    "investigate_raw": f"SELECT content, log_timestamp FROM ({_RAW}) WHERE log_timestamp BETWEEN {FROM - 20 * DAY} AND {TO} ORDER BY log_timestamp, log_id LIMIT 20",
    "maintenance_reports": f"""
        WITH u AS (SELECT {_TEMPLATE} AS template, count(DISTINCT {_OWN}) AS own FROM events GROUP BY 1)
        SELECT count(*) FILTER (own > 8) AS merged, coalesce(sum(own) FILTER (own > 8), 0)::BIGINT AS folded, 0::BIGINT AS remapped, TRUE AS compacted, 0::BIGINT AS merged_again, FALSE AS compacted_again FROM u""",
    "stream_rerun": f"SELECT {_TEMPLATE} AS pattern, count(*) AS n, count(*) AS occurrences FROM events GROUP BY 1",
    "stream_limit": f"SELECT {_LINE} || CASE WHEN event_id % 5 = 0 THEN chr(10) || chr(9) || 'at frame ' || event_id ELSE '' END AS line FROM events ORDER BY event_id LIMIT 500",
    "stream_counts": f"SELECT {_TEMPLATE} AS pattern, count(*) AS n FROM events GROUP BY 1",
}
