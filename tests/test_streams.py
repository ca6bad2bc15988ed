"""Streams against their batch twins: any order, late rows, restarts, replays; and the job surface of the engine."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from evidentia.engine import Engine
from evidentia.operators import jobs
from evidentia.streaming import flows as stream
from evidentia.streaming import life

T0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id string, event string, at timestamp, error string, outcome string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def job_events():
    """Jobs of every kind: with and without a queue, a start, an end in time, late, failed, skipped, and ended twice."""
    out = []
    for j in range(60):
        t, end = j * 30, {1: (50, None, None), 2: (60, "boom", None), 3: (70, None, "skipped"), 4: (400, None, None), 5: (240, "", "partial")}.get(j % 6)
        out += [(f"j{j}", life.QUEUED, at(t), None, None)] * (j % 9 != 0)
        out += [(f"j{j}", life.STARTED, at(t + 5), None, None)] * (1 + (j % 4 == 0)) * (j % 7 != 0)
        if end:
            out.append((f"j{j}", life.FINISHED, at(t + 5 + end[0]), *end[1:]))
            out += [(f"j{j}", life.FINISHED, at(t + 5 + end[0] + d), "again", None) for d in (0, 9)] * (j % 5 == 0)
    return out


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_job_life_in_any_order_equals_batch(spark, tmp_path, seed):
    events = job_events()
    events += random.Random(seed).sample(events, 20)  # replayed
    random.Random(seed).shuffle(events)
    last = [("y", life.STARTED, at(10_700), None, None), ("z", life.QUEUED, at(10_800), None, None)]
    for rows in [*[events[k::4] for k in range(4)], last]:  # each within the watermark; the last takes it beyond all deadlines
        written(spark, rows, EVENTS, f"{tmp_path}/in")
        time.sleep(0.02)
    events += last
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "1 hour")
    changes = stream.finish(life.stream(source), str(tmp_path), stream.ROCKS)
    now = max(e[2] for e in events) - dt.timedelta(hours=1)
    want = life.batch(spark.createDataFrame(events, EVENTS), F.lit(now))
    got = life.latest(changes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.status for r in want.collect()} >= {"queued", "running", "completed", "failed", "timeout", "skipped", "partial"}
    assert jobs.active(got).first()[0] == want.where(F.col("status").isin(*life.ACTIVE)).count()


def test_a_timer_ends_a_job_that_says_no_more(spark, tmp_path):
    """A start, then nothing but other jobs' events until the watermark passes its deadline."""
    for k in range(4):
        rows = [("quiet", life.STARTED, at(10), None, None)] * (k == 0) + [(f"j{k}", life.QUEUED, at(200 * k), None, None)]
        written(spark, rows, EVENTS, f"{tmp_path}/in")
        time.sleep(0.02)  # files are read in the order of their times
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "1 minute")
    changes = stream.finish(life.stream(source), str(tmp_path), stream.ROCKS).where("job_id = 'quiet'").orderBy("revision").collect()
    assert [r.status for r in changes] == ["running", "timeout"] and changes[1].ended_at == at(10 + life.LIMIT)


def test_jobs_of_a_bucket_share_their_state_and_timer(spark, tmp_path, monkeypatch):
    """Calls to the state follow buckets, not jobs: 600 jobs register far fewer timers; jobs of one bucket end at their own deadlines."""
    monkeypatch.setattr(life, "BUCKETS", 8, raising=False)
    events = [(f"j{j}", e, at(j + d), None, None) for j in range(600) for e, d in ((life.STARTED, 0), (life.FINISHED, 20 + j % 300))]
    events += [(None, life.STARTED, at(3), None, None), ("odd", "other", at(3), None, None), ("ended", life.FINISHED, at(9), "", "")]
    ends = [("z", life.QUEUED, at(4_000 + t), None, None) for t in (300, 500, 9_000)]  # some deadlines pass, then more, then all
    for rows in [events, *([e] for e in ends)]:
        written(spark, rows, EVENTS, f"{tmp_path}/in")
        time.sleep(0.02)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "1 hour")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stream.ROCKS)
    try:
        q = run(life.stream(source), tmp_path)
    finally:
        spark.conf.set(key, before)
    timers = sum(o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"])
    assert 8 <= timers <= 8 * len(q.recentProgress)
    changes = spark.read.schema(life.STATUS).parquet(f"{tmp_path}/out")
    want = life.batch(spark.createDataFrame(events + ends, EVENTS), F.lit(at(13_000 - 3_600)))
    assert sorted(map(tuple, life.latest(changes).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert changes.groupBy("job_id").agg((F.max("revision") - F.count(F.lit(1))).alias("x")).where("x <> 0").count() == 0
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16  # but for those never started, jobs are gone


FLOWS, JOBS = "src string, at timestamp, n int", "job_id string, worker_ip string, started_at timestamp, finished_at timestamp"


def joined(spark, path):
    read = lambda schema, name, on: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}").withWatermark(on, "1 minute")
    return stream.interval_joined(read(FLOWS, "flows", "at"), read(JOBS, "jobs", "started_at"), "2 minutes")


def run(found, path):
    q = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_join_survives_restarts_and_drops_what_lies_behind(spark, tmp_path):
    rows = [("10.0.0.1", at(s), s) for s in (0, 30, 90, 150, 5000)] + [("10.0.0.2", at(30), 1)]
    known = [("a", "10.0.0.1", at(0), at(90)), ("b", "10.0.0.1", at(100), at(110)), ("c", "10.0.0.2", at(0), at(60))]
    written(spark, rows[:3], FLOWS, f"{tmp_path}/flows")
    written(spark, known[:1], JOBS, f"{tmp_path}/jobs")
    run(joined(spark, tmp_path), tmp_path)
    written(spark, rows[3:], FLOWS, f"{tmp_path}/flows")  # after a restart, from the checkpoint: a job that was late for its flow
    written(spark, known[1:], JOBS, f"{tmp_path}/jobs")
    run(joined(spark, tmp_path), tmp_path)
    out = lambda: sorted((r.job_id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = spark.createDataFrame(rows, FLOWS).join(spark.createDataFrame(known, JOBS), (F.col("src") == F.col("worker_ip")) & F.col("at").between(F.col("started_at"), F.col("finished_at")))
    assert out() == sorted((r.job_id, r.n) for r in batch.collect()) == [("a", 0), ("a", 30), ("a", 90), ("c", 1)]
    written(spark, [("d", "10.0.0.9", at(5000), at(5100))], JOBS, f"{tmp_path}/jobs")
    written(spark, [("10.0.0.9", at(5050), 2)], FLOWS, f"{tmp_path}/flows")
    q = run(joined(spark, tmp_path), tmp_path)
    assert ("d", 2) in out() and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # old rows are gone from the state
    before = out()
    written(spark, [("10.0.0.1", at(1), 99)], FLOWS, f"{tmp_path}/flows")  # far behind the watermark
    run(joined(spark, tmp_path), tmp_path)
    assert out() == before


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    import json

    log, to = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    for k in range(3):
        (log / f"{k}.json").write_text("\n".join(json.dumps({"ts": at(60 * k + i).isoformat() + "+00:00", "src": "10.0.0.1", "kind": "dns", "qname": f"q{k}{i}"}) for i in range(5)) + "\n{broken\n")
    flows = lambda: stream.read(spark, str(log), per_trigger=1).drop("at")
    write = lambda: stream.append_log(flows(), to).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    write()
    names = lambda: sorted(r.qname for r in stream.read_log(spark, to).collect())
    assert names() == sorted(f"q{k}{i}" for k in range(3) for i in range(5))
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the writer had died after writing its last batch and before saying so
    for p in (tmp_path / "ck" / "commits").glob(f".{commits[-1].name}.crc"):
        p.unlink()
    write()
    assert names() == sorted(f"q{k}{i}" for k in range(3) for i in range(5))


def test_reports_are_awaited_and_deleted_in_place(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "reports"))
    with pytest.raises(TimeoutError):
        e.wait_for("x", poll_interval=0.05, max_wait=0.1)
    days = [("2024-01-01", ["a", "b"]), ("2024-01-02", ["c"]), ("2024-01-03", ["a"])]
    rows = [(j, "completed", d) for d, js in days for j in js]
    late = threading.Timer(1.0, lambda: spark.createDataFrame(rows, "job_id string, status string, day string").write.partitionBy("day").parquet(e.path))
    late.start()
    assert e.wait_for("c", poll_interval=0.2, max_wait=60).status == "completed"
    late.join()
    untouched = {p.name for p in (tmp_path / "reports" / "day=2024-01-02").glob("*.parquet")}
    assert e.delete("a") and not e.delete("a") and not e.delete("nobody")
    assert sorted((str(r.day), r.job_id) for r in e.reports().collect()) == [("2024-01-01", "b"), ("2024-01-02", "c")]
    assert {p.name for p in (tmp_path / "reports" / "day=2024-01-02").glob("*.parquet")} == untouched
    statuses = spark.createDataFrame([("a", "queued"), ("b", "running"), ("c", "failed")], "job_id string, status string")
    assert e.active(statuses) == 2
