"""Jobs that take time, followed by their messages: submitted, running, then done, failed or timed out.

Messages come as a stream of (job, ts, kind), somewhat out of order. A job is judged once its limit has passed by event time:
by the first message that ends it between its submission and the limit, whatever the order of arrival; what comes later is
ignored. Jobs are dealt to buckets by hash, whose messages are held and judged together: a call to the state costs more than
the few messages of a job. State of a bucket is the messages of its open jobs and marks of those closed; a timer stands at
the first job that is due, or mark that goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..runtime import ship

SUBMITTED, RUNNING, DONE, FAILED, TIMED_OUT = "submitted", "running", "done", "failed", "timed out"
SCHEMA = "job string, submitted timestamp, started timestamp, ended timestamp, status string, messages int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that jobs are dealt to: a task holds the open messages of one at a time. A checkpoint goes with its number.
BUCKETS = 512
_TIMES = ("submitted", "started", "ended")
_JUDGED = "job string, submitted long, started long, ended long, status string, messages int"


def outcomes(m: pd.DataFrame, limit: int) -> pd.DataFrame:
    """(job, submitted, started, ended, status, messages that count) in milliseconds of all messages (job, at, kind) of some
    jobs; those never submitted have no row."""
    out = m[m["kind"] == SUBMITTED].groupby("job")["at"].min().rename("submitted").to_frame()
    own = m[(m["kind"] != SUBMITTED) & m["job"].isin(out.index)]
    since = own["job"].map(out["submitted"])
    own = own[(own["at"] >= since) & (own["at"] <= since + limit)].sort_values(["job", "at", "kind"])
    ends = own[own["kind"].isin((DONE, FAILED))].drop_duplicates("job").set_index("job")
    ended, status = own["job"].map(ends["at"]), own["job"].map(ends["kind"]).fillna("")
    counted = own[ended.isna() | (own["at"] < ended) | ((own["at"] == ended) & (own["kind"] <= status))]
    out["started"] = counted[counted["kind"] == RUNNING].drop_duplicates("job").set_index("job")["at"].astype("Int64")
    out["ended"], out["status"] = ends["at"].astype("Int64"), ends["kind"]
    out["messages"] = counted.groupby("job").size()
    out = out.astype({"submitted": "Int64", "started": "Int64", "ended": "Int64"})
    out["status"], out["messages"] = out["status"].fillna(TIMED_OUT), (out["messages"].fillna(0) + 1).astype("int32")
    return out.reset_index()


def outcome(messages: list[tuple[int, str]], limit: int) -> tuple | None:
    """(submitted, started, ended, status, messages that count) of all messages (at, kind) of one job; None if it was never
    submitted."""
    found = outcomes(pd.DataFrame({"job": "", "at": [t for t, _ in messages], "kind": [k for _, k in messages]}), limit)
    return next((tuple(None if x is pd.NA else x for x in row[1:]) for row in found.itertuples(index=False)), None)


def due(m: pd.DataFrame, limit: int) -> pd.Series:
    """When each job's limit has passed; of one not submitted, when its first message is too old for a submission to come."""
    first = m.groupby("job")["at"].min()
    return m[m["kind"] == SUBMITTED].groupby("job")["at"].min().reindex(first.index).fillna(first).astype("int64") + limit


def expired(m: pd.DataFrame, closed: pd.DataFrame, now: int, limit: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(rows of the jobs that are due, messages of those still open, marks of those closed (job, until)) at a watermark."""
    at = due(m, limit)
    gone = at[at <= now]
    judged = outcomes(m[m["job"].isin(gone.index)], limit)
    # what has come for a job that isn't submitted yet stays, as long as a submission before it may come
    rest = m[~m["job"].isin(gone.index) | (~m["job"].isin(judged["job"]) & (m["at"] >= now))]
    marks = pd.DataFrame({"job": judged["job"], "until": judged["job"].map(gone).astype("int64") + limit})
    return judged, rest, pd.concat([closed[closed["until"] > now], marks[marks["until"] > now]], ignore_index=True)


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Followed(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "open binary, closed binary")

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if self.kept.exists():
            return tuple(_unpacked(bytes(x)) for x in self.kept.get())
        return pd.DataFrame({"job": pd.Series(dtype=object), "at": pd.Series(dtype="int64"), "kind": pd.Series(dtype=object)}), pd.DataFrame({"job": pd.Series(dtype=object), "until": pd.Series(dtype="int64")})

    def _keep(self, m: pd.DataFrame, closed: pd.DataFrame) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not len(m) and not len(closed):
            self.kept.clear()
            return
        self.kept.update((_packed(m), _packed(closed)))
        self.handle.registerTimer(int(min(x.min() for x in (due(m, self.limit), closed["until"]) if len(x))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, closed = self._held()
        new = pd.concat([pdf[["job", "at", "kind"]] for pdf in rows], ignore_index=True)
        new = new[~new["job"].isin(closed["job"])]
        if len(new):
            self._keep(pd.concat([m, new], ignore_index=True) if len(m) else new, closed)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m, closed = self._held()
        judged, m, closed = expired(m, closed, timerValues.getCurrentWatermarkInMs(), self.limit)
        self._keep(m, closed)
        yield judged if len(judged) else pd.DataFrame()


def followed(messages: DataFrame, limit_seconds: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """A row for each job, once its limit has passed, of a stream of messages (job, ts, kind); `late` is how far messages
    may be out of order."""
    spark = messages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.where("job is not null and ts is not null and kind is not null").withWatermark("ts", late)
    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, "job", "ts", F.unix_millis("ts").alias("at"), "kind")
    out = rows.groupBy("bucket").transformWithStateInPandas(_Followed(limit_seconds * 1000), _JUDGED, "append", "eventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in _TIMES})


def follow(messages: DataFrame, limit_seconds: int, late: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there of the stream, and ends; goes on from the checkpoint when started again. A batch's folder is
    overwritten if it comes again."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = followed(messages, limit_seconds, late).writeStream.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(batch).start()


def judged(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{sink}/batch=*")


def all_at_once(messages: DataFrame, limit_seconds: int, until) -> DataFrame:
    """The same rows from a whole table, without a stream: jobs whose limit has passed by `until`."""
    m = messages.where("job is not null and ts is not null and kind is not null")
    at = m.where(F.col("kind") == SUBMITTED).groupBy("job").agg(F.min("ts").alias("submitted"))
    end = F.col("submitted") + F.make_interval(secs=F.lit(limit_seconds))
    own = m.where(F.col("kind") != SUBMITTED).join(at, "job").where((F.col("ts") >= F.col("submitted")) & (F.col("ts") <= end))
    ends = own.where(F.col("kind").isin(DONE, FAILED)).groupBy("job").agg(F.min(F.struct("ts", "kind")).alias("e"))
    counted = own.join(ends, "job", "left").where(F.col("e").isNull() | (F.struct("ts", "kind") <= F.col("e")))
    told = counted.groupBy("job").agg(F.min(F.when(F.col("kind") == RUNNING, F.col("ts"))).alias("started"), F.count("*").alias("n"))
    out = at.where(end <= until).join(ends, "job", "left").join(told, "job", "left")
    status, n = F.coalesce("e.kind", F.lit(TIMED_OUT)).alias("status"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("messages")
    return out.select("job", "submitted", "started", F.col("e.ts").alias("ended"), status, n)
