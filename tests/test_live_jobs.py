"""Job states from a stream: orders of batches, repeats, late ends, idle jobs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F
from tessella.operators import jobs
from tessella.streaming import jobs as streams

LOG = "job_id long, seq long, kind string, ts timestamp"


def written(spark, folder, batches):
    for i, rows in enumerate(batches):
        time.sleep(1.1)  # files are read in order of their times, which some systems keep in seconds
        spark.createDataFrame(rows, "job_id long, seq long, kind string, at long").select("job_id", "seq", "kind", F.timestamp_seconds(F.col("at") + 86400).alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


@pytest.mark.parametrize("seed", [0, 1])
def test_state_is_that_of_the_log_in_any_order(spark, tmp_path, seed):
    rng = random.Random(9)
    events = [(j, s, rng.choice(["progress"] * 5 + ["cancel", "failed", "completed"]), s) for j in range(12) for s in range(j * 100, j * 100 + 9)]
    events += [(20, 1, "progress", 1), (21, 5, "completed", 5), (21, 3, "cancel", 3), (22, 2, "cancel", 2)]
    random.Random(seed).shuffle(events)
    stream = written(spark, f"file://{tmp_path}", [events[::3], events[1::3], events[2::3]])
    got = sorted(map(tuple, streams.replayed(stream, f"file://{tmp_path}").collect()))
    log = spark.createDataFrame(events, "job_id long, seq long, kind string, at long")
    assert got == sorted(map(tuple, jobs.states(log).collect()))


def test_idle_jobs_stall_and_a_late_end_counts_what_went_before(spark, tmp_path):
    hour = 3600
    batches = [[(1, 1, "progress", 0), (2, 1, "progress", 0), (2, 4, "progress", 5)], [(3, 1, "progress", 9 * hour), (2, 3, "completed", 9 * hour)], [(3, 2, "progress", 9 * hour + 60)]]
    got = {r["job_id"]: (r["status"], r["done"]) for r in streams.replayed(written(spark, f"file://{tmp_path}", batches), f"file://{tmp_path}", idle_ms=2 * hour * 1000).collect()}
    assert got[2] == ("completed", 1) and got[1] == ("stalled", 1) and got[3] == ("running", 2)
