"""Job states in the state store: order, late and repeated events, expiry, state by id."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.streaming import job_state as J

AT = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)


@pytest.fixture
def jobs(spark, tmp_path):
    base = f"file://{tmp_path}"
    before = spark.conf.get(J.PROVIDER[0], None)

    class Jobs:
        def run(self, *rows):
            rows = [(j, f"{j}.txt", s, m, at) for j, s, m, at in rows]
            spark.createDataFrame(rows, J.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/events")
            J.track(spark.readStream.schema(J.EVENTS).parquet(f"{base}/events"), f"{base}/states", f"{base}/cp").awaitTermination()

        def told(self, job):
            return [(r.state, r.change) for r in J.changes(spark, f"{base}/states").where(F.col("job_id") == job).orderBy("batch", "seq").collect()]

        def current(self):
            return {r.job_id: (r.state, r.message) for r in J.current(spark, f"{base}/states").collect()}

        def one(self, job):
            return [r.asDict() for r in J.state_of(spark, f"{base}/states", job).collect()]

    yield Jobs()
    if before is not None:
        spark.conf.set(J.PROVIDER[0], before)
    else:
        spark.conf.unset(J.PROVIDER[0])


def test_states_move_on_and_never_back(jobs):
    jobs.run(("a", "pending", None, AT(9)), ("b", "pending", None, AT(9)), ("a", "processing", None, AT(9, 1)))
    assert jobs.current() == {"a": ("processing", None), "b": ("pending", None)}
    jobs.run(("a", "done", "3 chunks", AT(9, 5)), ("b", "failed", "no chunks", AT(9, 4)), ("a", "processing", None, AT(9, 1)))
    assert jobs.current() == {"a": ("done", "3 chunks"), "b": ("failed", "no chunks")}
    jobs.run(("a", "processing", None, AT(9, 6)), ("a", "failed", "late", AT(9, 6)), ("b", "failed", "again", AT(9, 6)), ("c", "nonsense", None, AT(9, 6)))
    assert jobs.current() == {"a": ("done", "3 chunks"), "b": ("failed", "no chunks")}
    assert jobs.told("a") == [("pending", "new"), ("processing", "moved"), ("processing", "repeated"), ("done", "moved"), ("done", "refused"), ("done", "refused")]
    assert jobs.told("b")[-1] == ("failed", "repeated") and jobs.told("c") == [(None, "refused")]
    (a,) = jobs.one("a")
    assert (a["queued_at"], a["finished_at"], a["file_name"]) == (AT(9), AT(9, 5), "a.txt") and jobs.one("nobody") == [] and jobs.one("c") == []


def test_ended_jobs_are_forgotten_after_an_hour(jobs):
    jobs.run(("a", "done", None, AT(9)), ("b", "done", None, AT(9, 30)), ("c", "processing", None, AT(9)))
    jobs.run(("x", "pending", None, AT(10, 15)))  # the watermark is ten minutes behind
    jobs.run(("x", "processing", None, AT(10, 16)))
    assert set(jobs.current()) == {"b", "c", "x"} and jobs.one("a") == [] and jobs.told("a")[-1] == ("done", "expired")
    jobs.run(("a", "pending", "anew", AT(10, 20)))
    assert jobs.current()["a"] == ("pending", "anew") and jobs.told("a")[-1] == ("pending", "new")


def test_late_events_are_dropped(jobs):
    jobs.run(("a", "processing", None, AT(9)), ("b", "pending", None, AT(11)))
    jobs.run(("z", "pending", None, AT(11, 1)))
    jobs.run(("a", "done", "too late", AT(9, 1)), ("b", "done", "in time", AT(11, 2)))
    assert jobs.current()["a"] == ("processing", None) and jobs.current()["b"] == ("done", "in time")


def test_many_events_of_a_job_cost_little():
    """Each event is a row, not a table of its own."""
    import time

    from pyspark.sql import Row

    class State:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    class Handle:
        timers = []
        getValueState = lambda self, name, schema: State()
        registerTimer = timers.append

    jobs = J.Jobs()
    jobs.init(Handle())
    events = [Row(job_id="a", file_name="f", state=("pending", "processing", None)[i % 3], message=None, at=AT(9) + dt.timedelta(seconds=i)) for i in range(20_000)]
    began = time.process_time()
    told = list(jobs.handleInputRows(("a",), iter([*events, Row(job_id="a", file_name="f", state="done", message="m", at=None)]), None))
    assert time.process_time() - began < 5 and len(told) == 20_001
    assert [told[i].change for i in (0, 1, 2, 3, 4)] == ["new", "moved", "refused", "refused", "repeated"]
    assert (told[-1].change, told[-1].state, told[-1].at) == ("moved", "done", None) and jobs.state.get()[1] == "done" and not Handle.timers
