import random

from pyspark.sql import functions as F

from stratalog.functions import masking
from stratalog.operators import learner


def test_words_never_merge():
    assert learner.learn(["Audit passed for shelf_{num}", "Audit failed for shelf_{num}"]) == {}


def test_boundary():
    ids = [f"worker w{i}x stopped" for i in range(5)]
    assert learner.learn(ids[:4], 4) == {}
    assert set(learner.learn(ids, 4).values()) == {"worker {var} stopped"}


def test_split_before_merge_and_key_prefix():
    rows = [f"job {s} id-{i}k done" for s in ("ok", "failed") for i in range(10)]
    assert set(learner.learn(rows).values()) == {"job ok {var} done", "job failed {var} done"}
    assert set(learner.learn([f"request done status=S{i}w" for i in range(10)]).values()) == {"request done status={var}"}


def test_order_does_not_count():
    rows = [f"a{i}b c {x}" for i in range(20) for x in ("one", "two")]
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    assert learner.learn(rows) == learner.learn(mixed)


def test_parameters_move_without_loss(spark):
    lines = [f"put block id-w{i}k7 k={{{i}}} from 10.0.0.{i} took {i}ms" for i in range(20)]
    df = masking.masked(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    plans = learner.with_programs(learner.plans(df))
    joined = df.join(plans, F.col("pattern") == F.col("source_pattern")).withColumn("final", learner.final_params(F.col("program"), F.col("params")))
    rows = joined.select("line", "final_pattern", "final", masking.unmask(F.col("final_pattern"), F.col("final")).alias("back")).collect()
    assert len(rows) == 20 and all(r.line == r.back for r in rows)
    assert {r.final_pattern for r in rows} == {"put block {var} k={{{num}}} from {ip} took {size}"}
    assert next(r.final for r in rows if r.line.startswith("put block id-w5k7")) == ["id-w5k7", "5", "10.0.0.5", "5ms"]


def test_matching_takes_the_first_template(spark):
    merged = spark.createDataFrame([(2, "job {var} done"), (1, "job j={var} done"), (3, "job {var} done now")], "template_id long, pattern string")
    new = spark.createDataFrame([("job j=7x done",), ("job q7x done",), ("job q7x failed",)], "pattern string")
    found = {r.pattern: r.final_pattern for r in learner.matches(new, merged).collect()}
    assert found == {"job j=7x done": "job j={var} done", "job q7x done": "job {var} done"}


def test_large_groups_are_split_in_the_cluster(spark):
    """The same result whether Spark splits and merges the groups or Python does."""
    rng = random.Random(7)
    rows = [f"job {s} id-{rng.randrange(400)}k took {{num}} k={rng.choice('abc')}{i % 11}x" for i in range(900) for s in ("ok", "failed")]
    rows += [f"u{i}q logged in from host-{i % 30}z" for i in range(300)] + ["one two three"] + [f"w{i} x" for i in range(50)]
    want = learner.learn(rows)
    df = spark.createDataFrame([(x,) for x in rows], "pattern string")
    for most in (5, 120):
        assert {r.source_pattern: r.final_pattern for r in learner.plans(df, group_rows=most).collect()} == want


def test_matching_joins_on_a_fixed_token(spark):
    merged = spark.createDataFrame([(1, "{var} {var}"), (2, "a {var}"), (3, "b {var}")], "template_id long, pattern string")
    new = spark.createDataFrame([("a 7x",), ("c 7x",), ("b x y",)], "pattern string")
    assert {r.pattern: r.final_pattern for r in learner.matches(new, merged).collect()} == {"a 7x": "{var} {var}", "c 7x": "{var} {var}"}
    plan = learner.matches(new, merged.where("template_id > 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "key#" in plan and "word#" in plan
