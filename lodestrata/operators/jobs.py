"""The job state machine on tables of jobs and stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States that a job ends in, and how good a stored result is.
FINAL = ("completed", "partial", "failed")
STATUS_RANK = {"complete": 2, "partial": 1}


def reap(jobs: DataFrame, cutoff: Column, done: tuple[str, ...] = FINAL) -> DataFrame:
    """Jobs that aren't done and were touched, or made, at the cutoff or before: failed, with the state they were in."""
    stale = jobs.filter(~F.col("status").isin(*done) & ((F.col("updated_at") <= cutoff) | (F.col("created_at") <= cutoff)))
    return stale.select("job_id", F.col("status").alias("old_status"), F.lit("failed").alias("status"), F.concat(F.lit("stale while "), "status").alias("message"))


def progress(events: DataFrame, tie: str) -> DataFrame:
    """(job_id, stage, at, points) -> those, ``progress`` (never falls), ``stage_started`` and ``stage_seen``."""
    so_far = Window.partitionBy("job_id").orderBy("at", tie).rowsBetween(Window.unboundedPreceding, 0)
    stage = Window.partitionBy("job_id", "stage")
    return events.withColumns({"progress": F.max("points").over(so_far), "stage_started": F.min("at").over(stage), "stage_seen": F.max("at").over(stage)})


def rank(status: Column) -> Column:
    out = F.lit(0)
    for name, n in STATUS_RANK.items():
        out = F.when(status == name, F.lit(n)).otherwise(out)
    return out


def final_run(run: str, status: str, old_run: str, old_status: str) -> Column:
    """The stored run if it is at least as good as the fresh one."""
    return F.when(F.col(old_run).isNotNull() & (rank(F.col(old_status)) >= rank(F.col(status))), F.col(old_run)).otherwise(F.col(run))


def complete(jobs: DataFrame, stages: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (job_id, status, ...) and stages (job_id, stage, status, started_at, completed_at) after the jobs in ``done`` (job_id, run_id,
    final_status, at) have ended: their pending and running stages are completed, failed ones stay failed. Keys of ``done`` are unique."""
    ended = jobs.join(done, "job_id", "left")
    hit = F.col("final_status").isNotNull()
    new = ended.select(
        "job_id",
        F.when(hit, F.col("final_status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(100)).otherwise(F.col("progress")).alias("progress"),
        F.when(hit, F.col("run_id")).alias("run_id"),
    )
    marked = stages.join(done.select("job_id", "at"), "job_id", "left")
    open_ = F.col("at").isNotNull() & F.col("status").isin("pending", "running")
    return new, marked.select(
        "job_id", "stage",
        F.when(open_, "completed").otherwise(F.col("status")).alias("status"),
        F.when(open_, F.coalesce("started_at", "at")).otherwise(F.col("started_at")).alias("started_at"),
        F.when(open_, F.col("at")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def fail(jobs: DataFrame, stages: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for jobs in ``failed`` (job_id, error, at): only the stage a job was in fails with it."""
    ended = jobs.join(failed, "job_id", "left")
    hit = F.col("at").isNotNull()
    new = ended.select("job_id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), "progress", F.when(hit, F.col("error")).alias("error"))
    current = failed.join(jobs.select("job_id", F.col("current_stage").alias("stage")), "job_id").select("job_id", "stage", F.col("at").alias("_at"))
    marked = stages.join(current, ["job_id", "stage"], "left")
    hit = F.col("_at").isNotNull()
    return new, marked.select("job_id", "stage", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), "started_at", F.when(hit, F.col("_at")).otherwise(F.col("completed_at")).alias("completed_at"))
