"""Streams: new files of a collection, and the running state of jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import IMAGE_SUFFIXES, suffix


def new_images(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of (path, size, modificationTime) of image files as they appear."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(directory)
    return found.filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select("path", F.col("length").alias("size"), "modificationTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobLog(StatefulProcessor):
    """Keeps for each job its first end, its first request to cancel, and the progress before the end, in whatever order events come.

    Progress is a map of sequence numbers in the state store, so that an end that comes late still counts only what went before it, and a repeated event
    counts once. With `idle_ms` a job that has neither ended nor had an event for so long, by the watermark, is reported as stalled.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "seq long, kind string")
        self.asked = handle.getValueState("asked", "seq long")
        self.progress = handle.getMapState("progress", "seq long", "n int")

    def _row(self, key, stalled: bool = False) -> pd.DataFrame:
        end, asked = (s.get() if s.exists() else None for s in (self.end, self.asked))
        if end is not None:
            status = end[1] if asked is None or end[0] < asked[0] else "cancelled"
        else:
            status = "cancelling" if asked is not None else "stalled" if stalled else "running"
        done = sum(1 for k in self.progress.keys() if end is None or k[0] < end[0])
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "done": [done]})

    def handleInputRows(self, key, rows, timerValues):
        latest = 0
        for pdf in rows:
            for seq, kind, at in zip(pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["ts"]):
                latest = max(latest, int(at.timestamp() * 1000))
                if kind == "progress":
                    self.progress.updateValue((seq,), (1,))
                elif kind == "cancel":
                    if not self.asked.exists() or seq < self.asked.get()[0]:
                        self.asked.update((seq,))
                elif not self.end.exists() or seq < self.end.get()[0]:
                    self.end.update((seq, kind))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not self.end.exists():
                self.handle.registerTimer(latest + self.idle_ms)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._row(key, stalled=True)

    def close(self) -> None:
        pass


def live_states(log: DataFrame, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of (job_id, status, done), a row for each job that a batch of the stream `log` (job_id, seq, kind, ts) concerns; see `jobs.states`.

    Needs the RocksDB state store (`ROCKS`). Events later than `late` behind the watermark are dropped only where idle jobs are timed.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = log if idle_ms is None else log.withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(JobLog(idle_ms), "job_id long, status string, done long", "update", "None" if idle_ms is None else "EventTime")


def replayed(log: DataFrame, folder: str, idle_ms: int | None = None) -> DataFrame:
    """(job_id, status, done) after the stream `log` has been read to its present end; what each batch says is kept below `folder`."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")

    stream = live_states(log, idle_ms).writeStream.foreachBatch(keep).outputMode("update")
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    said = log.sparkSession.read.schema("job_id long, status string, done long, batch long").option("basePath", f"{folder}/states").parquet(f"{folder}/states")
    return said.groupBy("job_id").agg(F.max_by(F.struct("status", "done"), "batch").alias("s")).select("job_id", "s.status", "s.done")
