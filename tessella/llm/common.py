"""Helpers shared by the training-data operators: staged tables, hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of a counted table that may be broadcast; beyond it every operator shuffles instead.
BROADCAST_BYTES = 32 << 20
#: Tasks for what is small enough to be broadcast.
SMALL_TASKS = 8
#: Rows that a task of a counted table gets at least.
TASK_ROWS = 50_000

#: Settings while a table is staged: what was shuffled for it goes once it is written, and Python gets texts in small batches.
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tasks_for(rows: int) -> int:
    """Tasks for a counted table: each gets some ten thousand rows, so that a small table is not written in as many files as a large one."""
    return max(SMALL_TASKS, rows // TASK_ROWS)


def stage(df: DataFrame, name: str, records: int = 500, tasks: int | None = None, **options: str) -> DataFrame:
    """Write `df` as Parquet, with the writer's options, to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    Python gets `records` rows at a time meanwhile. At most `tasks` tasks write, where they are given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    settings = _STAGING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        (df.coalesce(tasks) if tasks else df).write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a counted table whose rows, taken by the types of their columns, have at most `limit` bytes."""
    width = 16 + sum({"boolean": 1, "int": 4, "bigint": 8, "double": 8}.get(kind, 80) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= limit else df


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; null ids hash as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


#: What a Python worker keeps between its tasks: objects of one operator at a time, as workers outlive the stages that they serve.
_KEPT: dict = {"owner": None}


def worker_cache(owner: str) -> dict:
    """A dict that lives in this Python worker until another operator asks for one."""
    if _KEPT["owner"] != owner:
        _KEPT.clear()
        _KEPT.update(owner=owner, cache={})
    return _KEPT["cache"]


def _rest() -> None:
    """What a task has freed, and its word hashes, go back to the system, as a worker may idle while others need the memory."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over plain column dicts: `fn` gets {name: pyarrow array} and yields {name: values} per batch."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    owner = fn.__module__

    def run(batches):
        worker_cache(owner)
        columns = ({n: c for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for x in fn(columns):
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n).type) for n, v in ((n, x[n]) for n in names)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        _rest()

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, kept per worker and emptied when it holds `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a text of fewer words than
    `width` has one shingle, its whole sequence; a null text or one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * _POWERS[j]
    return np.unique(mix(total))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, component), component being the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); every round is a shuffle by key
    with map-side minima, staged in the shared folder, so no component is gathered in one task or on
    the driver. While the minima are few enough to be broadcast, they meet the edges so, in a few tasks. Nodes without an edge don't appear.
    Null ends and self-loops are ignored.
    """

    def staged(df, tasks=None):
        seen = Observation()
        out = stage(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges", tasks=tasks)
        return out, (seen.get["n"], seen.get["h"])

    work = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    work, before = staged(work.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        small_enough = 2 * before[0] * 32 <= BROADCAST_BYTES  # nodes of two numbers
        near = (lambda df: F.broadcast(df.coalesce(SMALL_TASKS))) if small_enough else (lambda df: df)
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = large.join(near(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        turned = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        last = work
        work, now = staged(turned, SMALL_TASKS if small_enough else None)
        unstage(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = work.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    return found.coalesce(tasks_for(before[0]))
