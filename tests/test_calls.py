"""Calls in flight against a plain simulation of a provider that fails by a plan."""

import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strataloom.functions import calls
from strataloom.functions.calls import Limits


def _failures(text):
    """How often a request fails before it is answered."""
    return zlib.crc32(text.encode()) % 5


class Fake:
    """Fails by plan, and notes how many calls run at once."""

    def __init__(self):
        self.seen, self.now, self.most, self.lock = {}, 0, 0, threading.Lock()

    def __call__(self, text):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[text] = self.seen.get(text, 0) + 1
            bad = self.seen[text] <= _failures(text)
        time.sleep(0.001 + zlib.crc32(text.encode()) % 7 / 1000)
        with self.lock:
            self.now -= 1
        if bad:
            raise OSError("busy")
        return text.upper()


def _plan(texts, limits, fallback):
    """The same one after another; with a breaker, a request sees what those at least in_flight places before it have told."""
    out, row, skip, told = [], 0, 0, []
    for i, t in enumerate(texts):
        if i >= limits.in_flight:
            good = told[i - limits.in_flight]
            if good is not None:
                row = 0 if good else row + 1
                if limits.trip and row >= limits.trip:
                    row, skip = limits.trip - 1, limits.rest
        open_ = skip > 0
        skip -= open_
        f = _failures(t)
        tries = 0 if open_ else min(limits.tries, f + 1)
        good = not open_ and f < limits.tries
        told.append(None if open_ else good)
        out.append((t.upper(), "ok", tries) if good else (t + "!", "fallback", tries) if fallback else (None, "failed", tries))
    return out


@pytest.mark.parametrize("limits", [Limits(in_flight=7, wait=0.001), Limits(in_flight=3, tries=2, wait=0, trip=2, rest=4), Limits(in_flight=1, tries=1, trip=1, rest=1)])
@pytest.mark.parametrize("fallback", [None, lambda t: t + "!"])
def test_against_a_plain_simulation(limits, fallback):
    texts = [f"request {i}" for i in range(120)]
    fake = Fake()
    got = [r[:3] for r in calls.answers(iter(texts), fake, fallback, limits)]
    assert got == _plan(texts, limits, fallback) and fake.most <= limits.in_flight
    assert limits.in_flight == 1 or fake.most > 1


def test_waits_grow_and_the_rate_holds():
    assert [Limits(wait=1, longest_wait=5).before(n) for n in range(1, 6)] == [0, 1, 2, 4, 5]
    now, slept = [0.0], []
    bucket = calls.Bucket(4, lambda: now[0], slept.append)
    for _ in range(4):
        bucket.take()
    assert slept == [0.25, 0.5, 0.75]
    slow = calls.answers(iter(["a"]), lambda t: time.sleep(0.05) or t, None, Limits(tries=1, seconds=0.01))
    assert next(slow)[1:3] == ("failed", 1)
    silent = calls.answers(iter(["a", "b"]), lambda t: None, lambda t: 1 / 0, Limits(tries=2, wait=0))
    assert [r[:3] for r in silent] == [(None, "failed", 2)] * 2


def test_rows_keep_their_replies(spark):
    def call(text):
        if zlib.crc32(text.encode()) % 5 > 2:
            raise OSError("busy")
        return {"n": len(text)} if text.endswith("0") else text.upper()

    rows = spark.range(200).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("r"), "id")).alias("request"), F.lit("old").alias("status"))
    got = calls.called(rows, "request", call, lambda t: "fell", Limits(in_flight=4, tries=2, wait=0), tasks=3)
    assert got.columns == ["id", "request", "reply", "status", "tries", "error"] and got.count() == 200
    for r in got.collect():
        if r["request"] is None:
            assert r[2:] == (None, None, None, None)
        elif zlib.crc32(r["request"].encode()) % 5 > 2:
            assert r[2:] == ("fell", "fallback", 2, "OSError: busy")
        else:
            want = f'{{"n": {len(r["request"])}}}' if r["request"].endswith("0") else r["request"].upper()
            assert r[2:] == (want, "ok", 1, None)
    assert calls.called(rows.where("id % 7 = 0"), "request", call).where("status is null").count() == 29
    assert calls.called(rows.where("false"), "request", call).count() == 0


def test_a_large_batch_costs_in_proportion(spark):
    """The requests of a batch were counted again for each reply: 20,000 in one batch took 400 million looks."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 20_000)
    try:
        rows = spark.range(20_000).coalesce(1).selectExpr("id", "case when id % 5 <> 0 then cast(id as string) end as request")
        calls.called(rows.limit(10), "request", str.upper).count()  # starts the worker
        began = time.monotonic()
        got = calls.called(rows, "request", lambda x: x + "!").agg(F.count("reply"), F.sum(F.expr("int(reply = concat(request, '!'))"))).first()
        took = time.monotonic() - began
    finally:
        spark.conf.unset(size)
    assert tuple(got) == (16_000, 16_000) and took < 6
