"""Ingestion jobs: the latest state of each, clean-up of old ones, housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.store import latest


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job of ``events(job_id, state, message, at, ...)``; of equal times the one furthest on."""
    order = F.array_position(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), F.col("state"))
    return latest(events.withColumn("_o", order), ["job_id"], "at", "_o").drop("_o")


def purge(states: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Without jobs that finished more than ``hours`` ago."""
    old = F.col("finished_at").isNotNull() & (F.col("finished_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return states.where(~old)


def job(states: DataFrame, job_id: str) -> DataFrame:
    return states.where(F.col("job_id") == job_id)


def stale_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return files.where(F.col("modificationTime") < now - F.make_dt_interval(hours=F.lit(hours)))
