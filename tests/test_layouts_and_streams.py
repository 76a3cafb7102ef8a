"""Pages by layout, bucketed joins, percentiles, lineage, JSON values, builders, timers and streams into a ledger."""

import random
import uuid

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json
from jobloom.operators import builder, changes, intents, lifecycle, metrics, reads, workflow, workflow_writes
from jobloom.operators.percentiles import exact_percentiles
from jobloom.sources import clustered, keyed
from jobloom.sources.store import LedgerStore
from jobloom.streaming import feed, leases

NOW = "2024-01-02 00:00:00"


# ------------------------------------------------------------------ pages

def test_deep_pages_open_few_files(spark, tmp_path):
    rows = spark.range(12_000).select("id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.floor(F.col("id") / 3).cast("int"))).alias("created_at"), (F.col("id") % 5).alias("kind"))
    rows = rows.withColumn("created_at", F.when(F.col("id") >= 7, F.col("created_at"))).repartition(3)
    path = str(tmp_path / "jobs")
    clustered.write(rows, path, slice_rows=500)
    ordered = [(r["created_at"], r["id"], r["kind"]) for r in rows.orderBy(F.desc_nulls_first("created_at"), F.desc("id")).collect()]
    files = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert files == 24
    got = [tuple(r) for r in clustered.page(spark, path, limit=50).select("created_at", "id", "kind").collect()]
    assert got == ordered[:50]
    for depth in (9_000, 300, 11_980):
        at, last, _ = ordered[depth - 1]
        got = [tuple(r) for r in clustered.page(spark, path, after=(str(at), last), limit=60).select("created_at", "id", "kind").collect()]
        assert got == ordered[depth : depth + 60]
    at, last, _ = ordered[8_999]
    some = [x for x in ordered[9_000:] if x[2] == 3][:400]
    assert [tuple(r) for r in clustered.page(spark, path, F.col("kind") == 3, (str(at), last), 400).select("created_at", "id", "kind").collect()] == some


def test_a_page_reads_the_slices_it_needs(spark, tmp_path, monkeypatch):
    rows = spark.range(10_000).select("id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created_at"))
    path = str(tmp_path / "jobs")
    clustered.write(rows, path, slice_rows=200)
    asked = []
    real = Column.isin
    monkeypatch.setattr(Column, "isin", lambda self, *a: (asked.append(a[0]), real(self, *a))[1])
    clustered.page(spark, path, after=("2024-01-01 16:40:00", 1000), limit=100)
    assert sum(len(a) for a in asked) <= 3  # of 50 slices, at a depth of 9,000 rows


# ------------------------------------------------------------------ joins by job

def test_joins_by_job_need_no_exchange(spark, tmp_path):
    n = 400
    queue = spark.range(n).select("id", F.lit("t").alias("job_type"), F.lit(1).cast("long").alias("organization_id"), F.lit("PENDING").alias("status"))
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    attempts = spark.range(3 * n).select((F.col("id") % n).alias("job_id"), F.lit("TIMEOUT").alias("outcome"), at.alias("created_at"), at.alias("started_at"), (at + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("finished_at"))
    events = spark.range(2 * n).select("id", (F.col("id") % n).alias("job_id"), F.lit("LEASED").alias("event_type"), at.alias("occurred_at"))
    ledger = {"job_queue": queue, "job_attempts": attempts, "job_events": events, "job_logs": events.select("id", "job_id"), "job_dead_letters": events.select("job_id").distinct()}
    name = f"keyed_{uuid.uuid4().hex[:8]}"
    keyed.write_keyed(ledger, spark, name, buckets=4, path=str(tmp_path / "keyed"))
    there = keyed.read_keyed(spark, name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        detail = reads.job_detail(there)
        plan = detail._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
        recent = metrics.recent_attempts(there["job_attempts"], there["job_queue"], NOW)
        assert "Exchange" not in recent._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, detail.collect())) == sorted(map(tuple, reads.job_detail(ledger).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        keyed.forget_keyed(spark, name)


# ------------------------------------------------------------------ percentiles

def test_percentiles_against_spark(spark):
    rng = random.Random(9)
    rows = [("big" if rng.random() < 0.5 else f"g{rng.randrange(6)}", rng.choice([rng.random() * 1e6, float(rng.randrange(4)), -rng.paretovariate(0.2), 1e-300 * rng.random()])) for _ in range(6000)]
    rows += [(None, 5.0), (None, None), ("one", 3.5), ("same", 2.0), ("same", 2.0), ("two", -1e308), ("two", 1e308), ("none", None), ("nan", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, x double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for bins in (7, 1024):
        got = {r["g"]: [r[n] for n in shares] for r in exact_percentiles(frame, ["g"], "x", shares, bins=bins).collect()}
        kept = frame.where("x IS NOT NULL AND NOT isnan(x)")
        expected = {r["g"]: [r[n] for n in shares] for r in kept.groupBy("g").agg(*(F.percentile("x", p).alias(n) for n, p in shares.items())).collect()}
        assert set(got) == set(expected)
        for g, values in expected.items():
            assert got[g] == pytest.approx(values, rel=1e-12, abs=1e-300), g
    assert exact_percentiles(frame.where("false"), ["g"], "x", shares).collect() == []


# ------------------------------------------------------------------ JSON values, arrays, lineage

def test_json_values(spark):
    pairs = [('{"b":1.0,"a":[1e2,null]}', ' { "a" : [100, null], "b":1}', True), ('{"a":"x,5.0]"}', '{"a":"x,5]"}', False), ("-0.0", "0", True), ('{"a":{"d":1,"c":2}}', '{"a":{"c":2,"d":1.00}}', True), ("[1,2]", "[2,1]", False), ('"1"', "1", False), ('["\\u00e9"]', '["é"]', True), ("1e7", "1.0e7", True), ('{"a":1,"a":2}', '{"a":1, "a":2}', True)]
    frame = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(pairs)], "n int, a string, b string")
    alike = frame.select("n", (canonical_json("a") == canonical_json("b")).alias("same"))
    assert [r["same"] for r in alike.orderBy("n").collect()] == [p[2] for p in pairs]
    assert "Python" not in alike._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([("{",), (None,), ("",), ("nope",)], "t string").select(canonical_json("t").alias("j")).collect()
    assert [r["j"] for r in odd] == [None] * 4


def test_requests_that_are_spelt_otherwise(spark):
    new = "ordinal long, step_ordinal long, step_key string, execution_kind string, job_type string, payload string, priority int, max_attempts int, timeout_seconds int, stage string"
    steps = spark.createDataFrame([(1, 1, "a", "JOB", "t", '{"a":1.0}', None, None, None, None), (2, 2, "a", "JOB", "t", '{ "a": 1 }', None, None, None, None), (3, 3, "a", "JOB", "t", '{"a":2}', None, None, None, None)], new)
    edges = spark.createDataFrame([], "ordinal long, prerequisite_key string, dependent_key string, release_mode string")
    runs = spark.createDataFrame([(n, "w", None, "k", None) for n in (1, 2, 3)], "ordinal long, workflow_type string, organization_id long, idempotency_key string, result_step_key string")
    ledger = {"job_definitions": spark.createDataFrame([("t", 5, 3, 60, True)], "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean"), "workflow_runs": spark.createDataFrame([], "id long, workflow_type string, organization_id long, status string, idempotency_key string, enqueue_request string")}
    change = workflow_writes.enqueue_runs(ledger, runs, steps, edges, NOW, 100, 1000, 5000)
    assert {r["ordinal"]: r["outcome"] for r in change.outcomes.collect()} == {1: "INSERTED", 2: "EXISTING", 3: "CONFLICT"}
    request = workflow_writes.declared(steps.where("ordinal = 1"), edges).select("ordinal", "request")
    assert workflow_writes.same_append(request, steps.where("ordinal = 2").withColumn("ordinal", F.lit(1).cast("long")), edges).first()["same"]
    own = steps.select(F.col("ordinal").alias("workflow_run_id"), F.col("step_ordinal").alias("id"), "step_key", "execution_kind", "job_type", "payload")
    links = spark.createDataFrame([], "workflow_run_id long, prerequisite_step_id long, dependent_step_id long, release_mode string")
    assert workflow.canonical_request(own, links).select("request").distinct().count() == 2


def test_parallel_arrays(spark):
    frame = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [], []), (3, None, ["z"]), (4, None, None)], "k int, ids array<long>, names array<string>")
    got = changes.rows_from_arrays(frame, ["k"], {"ids": "id", "names": "name"}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (3, None, "z")], key=repr)


def test_replay_lineage(spark):
    jobs = spark.createDataFrame([(1, 7, "SUCCEEDED", 1), (2, 7, "PENDING", 3), (3, None, "SUCCEEDED", 1)], "id long, organization_id long, status string, run_number int")
    replays = spark.createDataFrame([(2, 1, 1, "k", "why"), (9, 3, 1, "k", "why")], "replay_job_id long, source_job_id long, source_run_number int, replay_request_key string, reason string")
    asked = [(1, 1, 1, "k", 7, "why"), (2, 1, 1, "k", 7, "other"), (3, 1, 1, "k", 8, "why"), (4, 1, 2, "k", 7, "why"), (5, 3, 1, "k", None, "why"), (6, 1, 1, "x", 7, "why")]
    commands = spark.createDataFrame(asked, "ordinal int, source_job_id long, source_run_number int, replay_request_key string, organization_id long, reason string")
    got = sorted(map(tuple, reads.replay_lineage(jobs, replays, commands).collect()))
    assert got == [(1, 2, "why", "PENDING", 3), (2, 2, "why", None, None), (5, 9, "why", None, None)]


def test_promotion_failures(spark):
    kind = "id long, job_type string, organization_id long, status string, idempotency_key string, enqueue_request string, promotion_attempts int, next_promotion_at timestamp_ntz, promoted_job_id long, promoted_at timestamp_ntz, conflicted_at timestamp_ntz, created_at timestamp_ntz"
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    requests = ['{"n":1}', "[1]", "nope", None, '{"execution_resource_key":" "}', '{"execution_resource_key":"r"}', '{"stage":"late"}', '{"stage":"queued"}', '{"execution_resource_key":"' + "é" * 300 + '"}']
    table = spark.createDataFrame([(n, "t", None, "PENDING", f"k{n}", r, 0, None, None, None, None, None) for n, r in enumerate(requests)], kind).withColumns({"next_promotion_at": at, "created_at": at})
    jobs = spark.createDataFrame([(50, "t", None, "k0", '{ "n" : 1.0 }')], "id long, job_type string, organization_id long, idempotency_key string, enqueue_request string")
    definitions = spark.createDataFrame([("t", 5, 3, True)], "job_type string, default_priority int, max_attempts int, is_enabled boolean")
    change = intents.promote(table, jobs, definitions, ["t"], NOW, 1000)
    after = {r["id"]: (r["status"], r["promoted_job_id"]) for r in change.upserts["job_enqueue_intents"].collect()}
    assert after == {0: ("PROMOTED", 50), 1: ("CONFLICTED", None), 2: ("CONFLICTED", None), 3: ("CONFLICTED", None), 4: ("CONFLICTED", None), 5: ("PROMOTED", 1005), 6: ("CONFLICTED", None), 7: ("PROMOTED", 1007), 8: ("CONFLICTED", None)}


# ------------------------------------------------------------------ builders

def test_builder(spark):
    plain = builder.Run("flow").job("a", "t", {"n": 1}, priority=4).external("gate").job("b", "t")
    run = plain.after_success("b", "a").after_end("b", "gate").of(idempotency_key="k", result_step_key="b", organization_id=7)
    assert plain.edges == () and plain.idempotency_key is None
    made = builder.frames(spark, [run, run.of(idempotency_key=None)])
    ledger = {"job_definitions": spark.createDataFrame([("t", 5, 3, 60, True)], "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean"), "workflow_runs": spark.createDataFrame([], "id long, workflow_type string, organization_id long, status string, idempotency_key string, enqueue_request string")}
    change = workflow_writes.enqueue_runs(ledger, *made, NOW, 100, 1000, 5000)
    assert {r["ordinal"]: r["outcome"] for r in change.outcomes.collect()} == {1: "INSERTED", 2: "INSERTED"}
    assert sorted((r["step_key"], r["status"], r["pending"]) for r in change.upserts["workflow_steps"].where("workflow_run_id = 101").collect()) == [("a", "ENQUEUED", 0), ("b", "BLOCKED", 2), ("gate", "WAITING_FOR_EXTERNAL", 0)]


@pytest.mark.parametrize(("make", "code"), [
    (lambda r: r.of(workflow_type=" "), "BLANK_WORKFLOW_TYPE"), (lambda r: builder.Run("f"), "EMPTY_STEPS"), (lambda r: r.of(idempotency_key=" "), "BLANK_IDEMPOTENCY_KEY"), (lambda r: r.of(active_key=""), "BLANK_ACTIVE_KEY"),
    (lambda r: r.of(active_key="é" * 257), "ACTIVE_KEY_TOO_LONG"), (lambda r: r.job(" ", "t"), "BLANK_KEY"), (lambda r: r.job("a", "t"), "DUPLICATE_KEY"), (lambda r: r.job("c", " "), "BLANK_JOB_TYPE"), (lambda r: r.job("c", None), "BLANK_JOB_TYPE"),
    (lambda r: r.job("c", "t", max_attempts=0), "NON_POSITIVE_MAX_ATTEMPTS"), (lambda r: r.job("c", "t", timeout_seconds=-1), "NON_POSITIVE_TIMEOUT_SECONDS"), (lambda r: r.of(result_step_key="x"), "UNKNOWN_RESULT_STEP_KEY"), (lambda r: r.of(result_step_key=""), "BLANK_RESULT_STEP_KEY"),
    (lambda r: r.after_end("a", "x"), "MISSING_PREREQUISITE"), (lambda r: r.after_end("x", "a"), "UNKNOWN_STEP"), (lambda r: r.after_end("a", "a"), "SELF_DEPENDENCY"), (lambda r: r.after_end("b", "a").after_success("b", "a"), "DUPLICATE_DEPENDENCY"),
    (lambda r: r.after_end("b", "a").after_end("a", "b"), "CYCLE"),
])
def test_builder_errors(make, code):
    with pytest.raises(builder.BuildError) as wrong:
        make(builder.Run("f").job("a", "t").job("b", "t")).checked()
    assert wrong.value.code == code


def test_a_long_chain_is_checked_without_recursion():
    run = builder.Run("f", steps=tuple(builder.Step(f"s{n}", "t") for n in range(5000)), edges=tuple((f"s{n}", f"s{n + 1}", "ON_SUCCESS") for n in range(4999)))
    assert run.checked() is run


# ------------------------------------------------------------------ streams

EVENT = "id long, job_id long, run_number int, attempt int, worker_id string, event_type string, occurred_at timestamp, lease_expires_at timestamp"


def test_leases_expire_once(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    clock = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"

    def feed_batch(rows):
        frame = spark.createDataFrame([(n, j, r, a, w, k, clock(t), None if u is None else clock(u)) for n, j, r, a, w, k, t, u in rows], "id long, job_id long, run_number int, attempt int, worker_id string, event_type string, occurred_at string, lease_expires_at string")
        frame.select("id", "job_id", "run_number", "attempt", "worker_id", "event_type", F.to_timestamp("occurred_at").alias("occurred_at"), F.to_timestamp("lease_expires_at").alias("lease_expires_at")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        found = leases.expired_leases(stream, "10 seconds")
        found.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    try:
        feed_batch([(1, 1, 1, 1, "w", "LEASED", 0, 60), (2, 2, 1, 1, "w", "LEASED", 0, 60), (3, 3, 1, 1, "w", "LEASED", 0, 60), (4, 4, 2, 1, "w", "LEASED", 0, 60)])
        feed_batch([(5, 2, 1, 1, "w", "HEARTBEAT", 30, 150), (6, 3, 1, 1, "w", "SUCCEEDED", 40, None), (7, 4, 1, 1, "x", "SUCCEEDED", 41, None)])
        feed_batch([(8, 9, 1, 1, "w", "LEASED", 90, 900)])  # the watermark goes to 80
        feed_batch([(9, 9, 1, 1, "w", "HEARTBEAT", 100, 900)])
        feed_batch([(10, 9, 1, 1, "w", "HEARTBEAT", 200, 900)])  # and to 190
        feed_batch([(11, 9, 1, 1, "w", "HEARTBEAT", 201, 900)])
        got = sorted((r["job_id"], r["run_number"], r["attempt"], r["occurred_at"].strftime("%M:%S")) for r in spark.read.schema(leases.OUTPUT).parquet(out).collect())
        assert got == [(1, 1, 1, "01:00"), (2, 1, 1, "02:30"), (4, 2, 1, "01:00")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_a_restarted_stream_writes_each_batch_once(spark, tmp_path, monkeypatch):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    queue = "id long, job_type string, organization_id long, payload string, status string, priority int, run_number int, attempt int, max_attempts int, next_run_at timestamp_ntz, stage string, idempotency_key string, enqueue_request string, execution_resource_key string, created_at timestamp_ntz"
    events = "job_id long, run_number int, attempt int, event_type string, stage string, payload string, occurred_at timestamp_ntz"
    store.create({"job_queue": spark.createDataFrame([], queue), "job_events": spark.createDataFrame([], events)}, buckets=3)
    definitions = spark.createDataFrame([("t", 5, 3, 60, True)], "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean")
    command = "ordinal long, job_type string, organization_id long, payload string, priority int, max_attempts int, next_run_at timestamp_ntz, idempotency_key string, stage string"
    source = str(tmp_path / "commands")

    def send(rows):
        spark.createDataFrame([(n, "t", None, "{}", None, None, None, k, None) for n, k in rows], command).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(command).option("maxFilesPerTrigger", 1).parquet(source)
        decide = lambda batch, now: lifecycle.enqueue(now["job_queue"], definitions, batch, NOW, 1000)
        feed.write_batches(stream, store, decide, str(tmp_path / "check"), available_now=True).awaitTermination()

    send([(1, "a"), (2, "b"), (3, None)])
    run()
    seen = store.versions()[-1]
    send([(4, "a"), (5, "c"), (6, None)])
    real = LedgerStore.apply

    def killed(self, *args):  # after the ledger has the batch, before the stream knows
        real(self, *args)
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(LedgerStore, "apply", killed)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    after = store.read()
    assert sorted((r["id"], r["idempotency_key"]) for r in after["job_queue"].collect()) == [(1001, "a"), (1002, "b"), (1003, None), (1005, "c"), (1006, None)]
    assert after["job_events"].count() == 5 and store.manifest()["batch"] == 2
    fresh = feed.changes_since(store, "job_queue", seen, ["id", "status"])
    assert sorted(r["id"] for r in fresh.collect()) == [1005, 1006] and feed.changes_since(store, "job_queue", store.versions()[-1], ["id", "status"]).count() == 0
