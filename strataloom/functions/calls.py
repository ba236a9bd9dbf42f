"""Calls that take time: some at once per task, at a bounded rate, tried again with growing waits, and a breaker.

A row is a request; its reply is one row, in the order of requests, with what happened: status, tries and who answered. No
more than `in_flight` calls of a task run at once, so no more than that times the tasks of the job. After `trip` failures in
a row a task's breaker opens: calls go to the fallback at once, until `rest` requests later one is let through again.
"""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship

OK, FELL_BACK, FAILED = "ok", "fallback", "failed"


@dataclass(frozen=True)
class Limits:
    """in_flight: calls of a task at once. rate: calls a second of a task, without a bound if 0. tries: of one request with
    the main provider. wait: seconds before the second try, doubled before each one after it, up to longest_wait. seconds:
    what a call may take; an answer after that is a failure. trip and rest: see above; no breaker if trip is 0."""

    in_flight: int = 5
    rate: float = 0.0
    tries: int = 3
    wait: float = 0.5
    longest_wait: float = 30.0
    seconds: float = 1200.0
    trip: int = 0
    rest: int = 20

    def before(self, attempt: int) -> float:
        """Seconds to wait before the given try, the first being 1."""
        return 0.0 if attempt < 2 else min(self.longest_wait, self.wait * 2 ** (attempt - 2))


class Bucket:
    """Lets callers through at a rate; each takes the next free moment."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = (1 / rate if rate else 0.0), clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def take(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class Breaker:
    """Counts failures in a row of finished requests, in the order of requests, so that reruns open it at the same ones."""

    def __init__(self, limits: Limits):
        self.limits, self.row, self.skip = limits, 0, 0

    def open(self) -> bool:
        if self.skip:
            self.skip -= 1
            return True
        return False

    def told(self, good: bool) -> None:
        self.row = 0 if good else self.row + 1
        if self.limits.trip and self.row >= self.limits.trip:
            # the next request that is let through alone decides
            self.skip, self.row = self.limits.rest, self.limits.trip - 1


def _once(call: Callable[[Any], Any], request: Any, seconds: float) -> Any:
    began = time.monotonic()
    reply = call(request)
    if time.monotonic() - began > seconds:
        raise TimeoutError(f"answered after {seconds:g} seconds")
    return reply


def _answered(request: Any, call, fallback, limits: Limits, bucket: Bucket, open_: bool, sleep) -> tuple:
    """(reply, status, tries, error): None as a reply counts as a failure."""
    error, tries = None, 0
    for attempt in range(1, 0 if open_ else limits.tries + 1):
        sleep(limits.before(attempt))
        bucket.take()
        tries = attempt
        try:
            reply = _once(call, request, limits.seconds)
            if reply is not None:
                return reply, OK, tries, None
            error = "no reply"
        except Exception as e:  # any failure of a provider is a failed try, told in the row
            error = f"{type(e).__name__}: {e}"[:200]
    if fallback is not None:
        try:
            reply = _once(fallback, request, limits.seconds)
            if reply is not None:
                return reply, FELL_BACK, tries, error
        except Exception as e:
            error = f"{error or 'open'}; {type(e).__name__}: {e}"[:200]
    return None, FAILED, tries, error or "open"


def answers(
    requests: Iterator[Any], call: Callable[[Any], Any], fallback: Callable[[Any], Any] | None = None, limits: Limits = Limits(),
    sleep: Callable[[float], None] = time.sleep,
) -> Iterator[tuple]:
    """(reply, status, tries, error) of each request, in their order. At most in_flight requests are held at a time. With a
    breaker, requests start when the one in_flight places before has been told, so that what it decides is the same on
    every run."""
    bucket, breaker, running = Bucket(limits.rate), Breaker(limits), deque()
    with ThreadPoolExecutor(limits.in_flight) as pool:

        def first() -> tuple:
            future, passed = running.popleft()
            out = future.result()
            if passed:
                breaker.told(out[1] == OK)
            return out

        for request in requests:
            if len(running) >= limits.in_flight:
                yield first()
            open_ = breaker.open()
            running.append((pool.submit(_answered, request, call, fallback, limits, bucket, open_, sleep), not open_))
        while running:
            yield first()


def called(
    rows: DataFrame, request: str, call: Callable[[str], Any], fallback: Callable[[str], Any] | None = None, limits: Limits = Limits(),
    tasks: int | None = None, name: str = "reply",
) -> DataFrame:
    """rows with `reply` (text; what isn't text is JSON), `status`, `tries` and `error`. Null requests are not sent: their
    status is null. `tasks` deals the rows to so many tasks, which bounds the calls of the whole job; else a task takes a
    partition as it is. Columns of rows with these names are replaced."""
    ship(rows.sparkSession)
    own = rows.drop(name, "status", "tries", "error")
    dealt = own.repartition(tasks) if tasks else own
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in own.schema)}, `{name}` string, status string, tries int, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[tuple[pd.DataFrame, int]] = deque()  # with the requests of each, which are counted once

        def asked() -> Iterator[str]:
            for pdf in batches:
                own = [x for x in pdf[request] if isinstance(x, str)]
                held.append((pdf, len(own)))
                yield from own

        told = answers(asked(), call, fallback, limits)
        ready: deque[tuple] = deque()

        def filled(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [ready.popleft() if isinstance(x, str) else (None, None, None, None) for x in pdf[request]]
            pdf = pdf.assign(**{name: [r[0] if r[0] is None or isinstance(r[0], str) else json.dumps(r[0]) for r in out], "status": [r[1] for r in out]})
            return pdf.assign(tries=pd.array([r[2] for r in out], "Int32"), error=[r[3] for r in out])

        for reply in told:
            ready.append(reply)
            while held and len(ready) >= held[0][1]:
                if len(held) == 1 and held[0][1] == 0:
                    break
                yield filled(held.popleft()[0])
        while held:
            yield filled(held.popleft()[0])

    return dealt.mapInPandas(run, schema)


def provided(rows: DataFrame, request: str, providers: Any, kind: str, fallback: Any = None, limits: Limits = Limits(), tasks: int | None = None, name: str = "reply") -> DataFrame:
    """called() with one of the providers' functions of a text (embed, expand, describe, label, ask, judge, route), and the
    same function of other providers to fall back on."""
    call = getattr(providers, kind)
    if call is None:
        raise ValueError(f"these providers can't {kind}")
    return called(rows, request, call, getattr(fallback, kind) if fallback is not None else None, limits, tasks, name)
