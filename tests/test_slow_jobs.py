"""Jobs followed by a stream, restarted in the middle, against one pass over all messages."""

import datetime
import json
import random

from pyspark.sql import functions as F

from strataloom.streaming import slow_jobs as slow

START = datetime.datetime(2024, 5, 1)


def _messages(n=60):
    r = random.Random(9)
    rows = []
    for j in range(n):
        at = START + datetime.timedelta(seconds=60 * j)
        if j % 9:
            rows.append((f"j{j}", at, "submitted"))
        if j % 13 == 0:
            rows.append((f"j{j}", at + datetime.timedelta(seconds=30), "submitted"))
        for _ in range(r.randint(0, 3)):
            rows.append((f"j{j}", at + datetime.timedelta(seconds=r.randint(-100, 900)), r.choice(["running", "done", "failed"])))
    return sorted(rows, key=lambda x: (x[1] + datetime.timedelta(seconds=r.randint(0, 100)), x[0]))


def test_a_stream_in_parts_equals_one_pass(spark, tmp_path):
    rows = _messages() + [("flush", START + datetime.timedelta(days=1), "running"), (None, START, "done")]
    schema = "job string, ts timestamp, kind string"
    source, sink, mark = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "mark")
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    for k in range(3):  # the query ends after each part and goes on from its checkpoint
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        slow.follow(stream, 600, "10 minutes", sink, mark).awaitTermination(120)
    got = sorted(map(tuple, slow.judged(spark, sink).collect()))
    whole = spark.createDataFrame(rows, schema)
    want = slow.all_at_once(whole, 600, F.lit(START + datetime.timedelta(days=1) - datetime.timedelta(minutes=10)))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 40
    assert {"done", "failed", "timed out"} == {r[4] for r in got} and len({r[0] for r in got}) == len(got)


def test_outcome():
    limit = 100
    assert slow.outcome([(5, "done")], limit) is None
    assert slow.outcome([(10, "submitted"), (5, "done")], limit) == (10, None, None, "timed out", 1)
    assert slow.outcome([(10, "submitted"), (111, "done")], limit) == (10, None, None, "timed out", 1)
    assert slow.outcome([(50, "failed"), (10, "submitted"), (110, "done"), (20, "running"), (60, "running"), (12, "submitted")], limit) == (10, 20, 50, "failed", 3)


def test_many_jobs_cost_a_call_to_the_state_per_bucket(spark, tmp_path):
    """Jobs of a bucket are held and judged together: rows of Python's state calls don't grow with the jobs."""
    rows = [(f"j{j}", START + datetime.timedelta(seconds=j % 7), kind) for j in range(3000) for kind in ("submitted", "done")]
    rows.append(("flush", START + datetime.timedelta(days=1), "running"))
    source, sink, mark = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "mark")
    spark.createDataFrame(rows, "job string, ts timestamp, kind string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("job string, ts timestamp, kind string").parquet(str(source))
    done = slow.follow(stream, 600, "10 minutes", sink, mark)
    done.awaitTermination(120)
    state = [p["stateOperators"][0] for p in (json.loads(x.json) for x in done.recentProgress)]
    assert slow.judged(spark, sink).groupBy("status", "messages").count().collect() == [("done", 2, 3000)]
    assert max(s["customMetrics"].get("numRegisteredTimers", 0) for s in state) <= slow.BUCKETS


def test_jobs_judged_together_equal_one_by_one():
    r = random.Random(3)
    kinds = ["submitted", "running", "done", "failed", "other"]
    m = [(f"j{r.randint(0, 40)}", r.randint(0, 60), r.choice(kinds)) for _ in range(400)]
    got = {row[0]: tuple(None if x is slow.pd.NA else x for x in row[1:]) for row in slow.outcomes(slow.pd.DataFrame(m, columns=["job", "at", "kind"]), 20).itertuples(index=False)}
    for job in {x[0] for x in m}:
        own = [(t, kind) for j, t, kind in m if j == job]
        submitted = min((t for t, kind in own if kind == "submitted"), default=None)
        if submitted is None:
            assert job not in got
            continue
        within = sorted((t, kind) for t, kind in own if submitted <= t <= submitted + 20 and kind != "submitted")
        end = next(((t, kind) for t, kind in within if kind in ("done", "failed")), (None, "timed out"))
        counted = [x for x in within if end[0] is None or x <= end]
        started = next((t for t, kind in counted if kind == "running"), None)
        assert got[job] == (submitted, started, *end, len(counted) + 1)


def test_a_message_ahead_of_its_submission_stays():
    frame = lambda rows: slow.pd.DataFrame(rows, columns=["job", "at", "kind"])
    closed = slow.pd.DataFrame({"job": slow.pd.Series(dtype=object), "until": slow.pd.Series(dtype="int64")})
    judged, rest, closed = slow.expired(frame([("a", 0, "running"), ("a", 120, "done"), ("b", 0, "submitted"), ("c", 10, "submitted")]), closed, 100, 100)
    assert judged["job"].tolist() == ["b"] and rest.values.tolist() == [["a", 120, "done"], ["c", 10, "submitted"]]
    assert closed.values.tolist() == [["b", 200]]
    assert slow.expired(rest, closed, 200, 100)[2]["job"].tolist() == ["c"]
