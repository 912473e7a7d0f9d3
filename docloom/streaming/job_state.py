"""Job states in Spark's state store: a row of state for each job, moved on by events, forgotten an hour after the job has ended.

``transformWithState`` keeps the state; a timer of event time ends it, so that late and repeated events are told from new ones as long as
it lives. A job moves from pending over processing to done or failed and never back: what would go back is told and changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.schemas import JOB_STATES
from docloom.shared import by_value

by_value(__name__)
EVENTS = "job_id string, file_name string, state string, message string, at timestamp"
STATES = "job_id string, file_name string, state string, message string, queued_at timestamp, finished_at timestamp, at timestamp, change string"
_HELD = "file_name string, state string, message string, queued_at timestamp, finished_at timestamp, at timestamp"
#: A job's place on its way; both ends are one place, of which the first reached counts.
PLACE = {name: min(i, 2) for i, name in enumerate(JOB_STATES)}
HOURS = 1
#: Where Spark keeps state on each executor while it runs; what it commits lies in the checkpoint.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Jobs(StatefulProcessor):
    """For each event of a job what became of it: ``new``, ``moved``, ``repeated``, ``refused`` (it would go back, or there is no such
    state), and ``expired`` once its state is forgotten."""

    def __init__(self, hours: int = HOURS) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Of one job in a micro-batch; without a time last.
        events = sorted(rows, key=lambda e: (e.at is None, e.at or dt.datetime.min, PLACE.get(e.state, -1), e.state is None, e.state or ""))
        now = list(self.state.get()) if self.state.exists() else None
        before = None if now is None else tuple(now)
        for e in events:
            if e.state not in PLACE:
                yield self._told(key, now or [e.file_name, None, None, None, None, e.at], "refused")
                continue
            place = PLACE[e.state]
            if now is None:
                now, change = [e.file_name, e.state, e.message, e.at, e.at if place == 2 else None, e.at], "new"
            elif e.state == now[1]:
                change = "repeated"
            elif place > PLACE[now[1]]:
                now, change = [now[0] if now[0] is not None else e.file_name, e.state, e.message, now[3], e.at if place == 2 else None, e.at], "moved"
            else:
                change = "refused"
            yield self._told(key, now, change)
        if now is None or tuple(now) == before:
            return
        self.state.update(tuple(now))
        if now[4] is not None:  # it ends once: no timer is there
            self.handle.registerTimer(int((now[4].replace(tzinfo=now[4].tzinfo or dt.timezone.utc)).timestamp() * 1000) + self.hours * 3_600_000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            now = list(self.state.get())
            self.state.clear()
            yield self._told(key, now, "expired")

    @staticmethod
    def _told(key: tuple, now: list, change: str) -> Row:
        return Row(job_id=key[0], file_name=now[0], state=now[1], message=now[2], queued_at=now[3], finished_at=now[4], at=now[5], change=change)

    def close(self) -> None:
        pass


def kept_states(events: DataFrame, late: str = "10 minutes", hours: int = HOURS) -> DataFrame:
    """The changes of jobs from a stream of ``events(job_id, file_name, state, message, at)``. An event later than ``late`` is dropped."""
    timed = events.withWatermark("at", late)
    return timed.groupBy("job_id").transformWithState(statefulProcessor=Jobs(hours), outputStructType=STATES, outputMode="Update", timeMode="EventTime")


def track(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", hours: int = HOURS, available_now: bool = True):
    """Start keeping states; the changes are written under their micro-batch, which a restart replaces."""
    spark = events.sparkSession
    spark.conf.set(*PROVIDER)

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = kept_states(events, late, hours).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="3 seconds")).start()


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STATES}, seq long, batch long").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state of each job that isn't forgotten."""
    last = changes(spark, path).where("change <> 'refused' or state is not null").groupBy("job_id").agg(F.max_by(F.struct("file_name", "state", "message", "queued_at", "finished_at", "at", "change"), F.struct("batch", "seq")).alias("x"))
    return last.select("job_id", "x.*").where("change <> 'expired' and state is not null").drop("change")


def state_of(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """One job's state: no row where there is no such job, or it has been forgotten."""
    return current(spark, path).where(F.col("job_id") == job_id)
