"""Substring search by an index of one-, two- and three-letter runs with delta-coded postings; every hit is verified on its text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, python_batches

#: Keys of a posting list: the list of a run is cut where keys pass a multiple of this, so that none grows with the table.
BLOCK_KEYS = 1 << 16
#: Texts or lists that Python gets at a time; postings and lists of a task that wait to be sent, and candidates.
RECORDS = 256
WAITING, WAITING_LISTS = 1 << 21, 1 << 18


def delta_code(ids: np.ndarray) -> bytes:
    """Sorted distinct whole numbers from 0 as gaps of seven bits a byte, the high bit saying that more bytes follow."""
    gaps = np.diff(ids, prepend=0).astype(np.uint64)
    n = np.maximum(1, -(-np.ceil(np.log2(gaps.astype(np.float64) + 1)).astype(np.int64) // 7))
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    for b in range(int(n.max(initial=0))):
        has = n > b
        out[(ends - n)[has] + b] = ((gaps[has] >> np.uint64(7 * b)) & np.uint64(127)).astype(np.uint8) | np.where(n[has] > b + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def delta_decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    number = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(raw) else np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.empty(0, np.int64)
    place = np.arange(len(raw)) - first[number] if len(raw) else number
    gaps = np.bincount(number, (raw & 127).astype(np.float64) * 128.0**place, int(last.sum())) if len(raw) else np.empty(0)
    return np.cumsum(gaps.astype(np.int64))


def runs(text: str) -> set[str]:
    """All runs of one to three characters of a text."""
    return {*text, *map("".join, zip(text, text[1:])), *map("".join, zip(text, text[1:], text[2:]))}


def needed(needle: str) -> set[str]:
    """The runs that every text with the needle has, the longest that there are."""
    return {needle} if len(needle) < 3 else {needle[i : i + 3] for i in range(len(needle) - 2)}


def build(rows: DataFrame, path: str, key: str, text: str = "text") -> None:
    """Write the index of `rows` (a whole `key` from 0 on and a text, lower-cased; nulls hold nothing) below `path`, in order of runs.

    Tasks send a partial list of each run and block of keys, not a row for each run of each text; a list is bounded by its block. What a task holds is
    bounded too: it sends its lists whenever so many postings wait, and lists are joined one at a time.
    """

    def coded(lists: dict[tuple[str, int], list[int]]) -> pd.DataFrame:
        return pd.DataFrame({"run": [r for r, _ in lists], "block": [b for _, b in lists], "ids": [delta_code(np.unique(v)) for v in lists.values()]})

    def partial(batches):
        lists: dict[tuple[str, int], list[int]] = {}
        waiting = 0
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"]):
                block, place = divmod(int(k), BLOCK_KEYS)
                found = runs(t)
                for run in found:
                    lists.setdefault((run, block), []).append(place)
                waiting += len(found)
                if waiting >= WAITING or len(lists) >= WAITING_LISTS:
                    yield coded(lists)
                    lists, waiting = {}, 0
        if lists:
            yield coded(lists)

    def join(batches):
        for pdf in batches:
            out = []
            for several in pdf["parts"]:
                ids = np.unique(np.concatenate([delta_decode(x) for x in several]))
                out.append((len(ids), delta_code(ids)))
            yield pd.DataFrame({"run": pdf["run"], "block": pdf["block"], "n": [n for n, _ in out], "ids": [x for _, x in out]})

    source = rows.select(F.col(key).cast("long").alias("key"), F.lower(text).alias("text")).filter("key >= 0 AND text IS NOT NULL")
    lists = source.mapInPandas(partial, "run string, block long, ids binary").groupBy("run", "block").agg(F.collect_list("ids").alias("parts"))
    index = lists.mapInPandas(join, "run string, block long, n int, ids binary")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with python_batches(rows.sparkSession, RECORDS):
        index.repartitionByRange(parts, "run", "block").sortWithinPartitions("run", "block").write.mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, needles: DataFrame) -> DataFrame:
    """(needle_id, key): the texts that hold all runs of a needle (needle_id, needle); null and empty needles have none.

    The lists of a needle and block meet one after another, the shortest first, so that a task holds what they share and no row for each key of each list.
    """

    def exploded(batches):
        for pdf in batches:
            out = [(i, r, n) for i, t in zip(pdf["needle_id"], pdf["needle"]) for found in [needed(t)] for n in [len(found)] for r in sorted(found)]
            yield pd.DataFrame(out, columns=["needle_id", "run", "wanted"])

    def shared(batches):
        group, met, left = None, 0, np.empty(0, np.int64)
        ready, size = [], 0
        for pdf in batches:
            for needle, block, wanted, data in zip(pdf["needle_id"], pdf["block"], pdf["wanted"], pdf["ids"]):
                if (needle, block) != group:
                    group, met, left = (needle, block), 0, delta_decode(data)
                elif len(left):
                    left = np.intersect1d(left, delta_decode(data), assume_unique=True)
                met += 1
                if met == wanted and len(left):
                    ready.append((needle, left + block * BLOCK_KEYS))
                    size += len(left)
                    if size >= WAITING_LISTS:
                        yield frame(ready)
                        ready, size = [], 0
        if ready:
            yield frame(ready)

    def frame(ready):
        return pd.DataFrame({"needle_id": np.repeat([n for n, _ in ready], [len(k) for _, k in ready]), "key": np.concatenate([k for _, k in ready])})

    asked = needles.select(F.col("needle_id").cast("long").alias("needle_id"), F.lower("needle").alias("needle")).filter("needle <> ''")
    asked = asked.mapInPandas(exploded, "needle_id long, run string, wanted int")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = spark.read.parquet(path).join(asked, "run").select("needle_id", "block", "wanted", "n", "ids").repartition(parts, "needle_id", "block")
    with python_batches(spark, RECORDS):
        return checkpointed(met.sortWithinPartitions("needle_id", "block", "n").mapInPandas(shared, "needle_id long, key long"))


def search(path: str, rows: DataFrame, needles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(needle_id, `key`): every row whose text has the needle, letter case aside; candidates of the index are verified on their texts."""
    found = candidates(rows.sparkSession, path, needles)
    texts = rows.select(F.col(key).cast("long").alias("key"), F.lower(text).alias("_text"))
    asked = needles.select(F.col("needle_id").cast("long").alias("needle_id"), F.lower("needle").alias("_needle"))
    return found.join(asked, "needle_id").join(texts, "key").filter(F.contains("_text", "_needle")).select("needle_id", F.col("key").alias(key))
