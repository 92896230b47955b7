"""Job state as an append-only log of events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def latest(events: DataFrame, job: str, ts: str, event: str) -> DataFrame:
    """The last event of each job by time, ties by event id; a maximum that tasks combine, not a sort of each job."""
    others = [c for c in events.columns if c not in (job, ts, event)]
    best = events.groupBy(job).agg(F.max(F.struct(ts, event, *others)).alias("e"))
    return best.select(job, *(F.col(f"e.{c}").alias(c) for c in (ts, event, *others)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100)).otherwise(0.0)


def friendly_error(message: Column) -> Column:
    """The class of an error message, the first rule that holds; null for others."""
    m = F.lower(message)
    has = lambda s: F.contains(m, F.lit(s))
    return (
        F.when(has("basemodeloutputwithpooling") & has("norm"), "structured_output")
        .when(has("out of memory") | (has("cuda") & has("memory")), "out_of_memory")
        .when(has("no images found"), "no_images")
        .when(has("trust_remote_code"), "remote_code")
    )


def run_state(polling: Column, rows: Column, scanned: Column, model_ready: Column) -> Column:
    """What the screen of a job shows: running, done once there are rows, ready or scanned once images are counted, else idle."""
    counted = F.coalesce(~F.isnan(scanned) & (scanned > 0), F.lit(False))
    return F.when(polling, "running").when(rows > 0, "done").when(counted & model_ready, "ready").when(counted, "scanned").otherwise("idle")


def states(log: DataFrame) -> DataFrame:
    """(job_id, status, done) of a log (job_id, seq, kind) of progress, cancel, failed and completed events.

    The first end of a job decides. A request to cancel that comes before it makes it cancelled, or cancelling as long as it hasn't ended; one that comes
    after it changes nothing. done counts the progress before the end. Two sums by job that tasks combine.
    """
    ends = log.groupBy("job_id").agg(
        F.min(F.when(F.col("kind").isin("failed", "completed"), F.struct("seq", "kind"))).alias("end"),
        F.min(F.when(F.col("kind") == "cancel", F.col("seq"))).alias("asked"),
    )
    ended, first = F.col("end.seq"), F.col("asked").isNull() | (F.col("end.seq") < F.col("asked"))
    status = F.when(ended.isNotNull() & first, F.col("end.kind")).when(ended.isNotNull(), "cancelled").when(F.col("asked").isNotNull(), "cancelling").otherwise("running")
    done = log.filter("kind = 'progress'").join(ends.select("job_id", ended.alias("ended")), "job_id").filter("ended IS NULL OR seq < ended").groupBy("job_id").agg(F.count("*").alias("done"))
    return ends.join(done, "job_id", "left").select("job_id", status.alias("status"), F.coalesce("done", F.lit(0)).cast("long").alias("done"))


def failures(failed: DataFrame, job: str, error: str, stage: str) -> DataFrame:
    """(job, status, hint, report) for jobs that failed: the class of their error, and a JSON report with error and stage."""
    report = F.to_json(F.struct(F.col(job), F.lit("job_failed").alias("phase"), F.col(stage).alias("stage"), F.col(error).alias("error")))
    return failed.select(job, F.lit("failed").alias("status"), friendly_error(F.col(error)).alias("hint"), report.alias("report"))


class JobGroup:
    """Runs Spark work under a job group that can be cancelled."""

    def __init__(self, spark: SparkSession, job_id: str):
        self.spark, self.job_id = spark, job_id

    def __enter__(self):
        self.spark.sparkContext.setJobGroup(self.job_id, self.job_id, interruptOnCancel=True)
        return self

    def __exit__(self, *_):
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.job_id)


class Measured:
    """Counts what a job does while it runs: `of(rows, error)` passes rows on, `events()` after an action gives them as rows of the job log.

    Rows and errors are observed metrics of the action itself, so nothing is read twice and a failed action gives a failed event.
    """

    def __init__(self, spark: SparkSession, job_id: int):
        self.spark, self.job_id = spark, job_id
        self.seen = Observation(f"job-{job_id}-{uuid.uuid4().hex}")
        self.failure: str | None = None

    def of(self, rows: DataFrame, error: str) -> DataFrame:
        return rows.observe(self.seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(error)).alias("errors"))

    def run(self, action) -> None:
        """`action()`, which must run the observed rows to their end; its error becomes the job's."""
        try:
            action()
        except Exception as error:  # noqa: BLE001  whatever ends a job is its failure
            self.failure = str(error).splitlines()[0] if str(error) else type(error).__name__

    def events(self) -> DataFrame:
        """(job_id, seq, kind, done, errors, error): the progress that was measured, then the end."""
        schema = "job_id long, seq int, kind string, done long, errors long, error string"
        if self.failure is not None:
            return self.spark.createDataFrame([(self.job_id, 1, "failed", None, None, self.failure)], schema)
        got = self.seen.get
        return self.spark.createDataFrame([(self.job_id, 1, "progress", got["rows"], got["errors"], None), (self.job_id, 2, "completed", got["rows"], got["errors"], None)], schema)
