"""Queries on tables with more keys or other rows than the driver's small ones."""

from __future__ import annotations

import duckdb
import pytest
from parity import differences
from pyspark.sql import functions as F
from tessella.operators import neighbours, text_index
from tessella.plans import ORACLE_SQL, QUERIES
from tessella.sources import npy


def repeated(spark, sf_dir, tmp_path, table: str, key: str, times: int):
    """(folder, connection): the table `times` times, under keys of its own each time."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    step = rows.agg(F.max(key)).first()[0] + 1
    copies = rows.crossJoin(spark.range(times).select(F.col("id").alias("_copy")))
    copies.withColumn(key, F.col(key) + step * F.col("_copy")).drop("_copy").write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    return str(tmp_path), con


def test_resize_outcomes_of_pictures_without_a_height(spark, sf_dir, tmp_path):
    folder, con = repeated(spark, sf_dir, tmp_path, "part", "p_partkey", 4)
    assert differences(spark, con, QUERIES["resize_outcomes"], ORACLE_SQL["resize_outcomes"], folder) == ""


@pytest.mark.parametrize("rows", [3, 0])
def test_npy_files_of_tasks_without_rows(spark, tmp_path, rows):
    table = spark.range(0, rows, 1, 8).select("id", F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    npy.write_npy(table, f"file://{tmp_path}/few", "id")
    assert sorted((r["key"], *r["embedding"]) for r in npy.read_npy(spark, f"file://{tmp_path}/few").collect()) == [(i, i, 0.5) for i in range(rows)]
    with pytest.raises(Exception, match="several widths"):
        npy.write_npy(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>").coalesce(1), f"file://{tmp_path}/ragged", "id")


def test_encoded_batches_that_begin_at_any_key(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 100").orderBy("vec_id").withColumn("vec_id", F.col("vec_id") + 9).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert differences(spark, con, QUERIES["encode_with_retry"], ORACLE_SQL["encode_with_retry"], str(tmp_path)) == ""


def test_lists_of_a_needle_meet_without_a_row_for_each_key(spark, tmp_path):
    needle = "abcdefghijklmnopqrstuvwxyz0123456789"
    docs = spark.range(0, 6000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, needle).otherwise(needle[1:]).alias("text"))
    path, asked = f"file://{tmp_path}/index", spark.createDataFrame([(1, needle)], "needle_id long, needle string")
    text_index.build(docs, path, "doc_id")
    context = spark.sparkContext
    context.setJobGroup("lists of a needle", "")
    try:
        found = text_index.candidates(spark, path, asked).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["key"] for r in found) == list(range(0, 6000, 2))
    sent, tracker = [], context.statusTracker()
    for job in tracker.getJobIdsForGroup("lists of a needle"):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            if info is not None and info.numCompletedTasks:
                sent.append(context._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteRecords())
    assert 0 < max(sent) < 500


def test_neighbours_by_the_method_of_less_work(spark, monkeypatch):
    for name in ("knn_graph", "descent_graph"):
        monkeypatch.setattr(neighbours, name, lambda *_, name=name: name)
    assert [neighbours.neighbours(None, k, "vec_id", n) for k, n in ((15, 2048), (15, 10_000), (90, 12_000), (90, 1_000_000))] == ["knn_graph", "descent_graph", "knn_graph", "descent_graph"]


def test_a_round_of_descent_gets_few_nodes_at_a_time(spark, monkeypatch):
    held, real = [], neighbours.checkpointed

    def seen(df):
        held.append(("MapInPandas" in df._jdf.queryExecution().executedPlan().toString(), int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return real(df)

    monkeypatch.setattr(neighbours, "checkpointed", seen)
    table = spark.range(0, 200, 1, 2).select(F.col("id").alias("vec_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    assert neighbours.descent_graph(table, 5, rounds=2).count() == 1000
    rounds = [records for python, records in held if python][1:]  # the first is the start, pair by pair
    assert rounds and max(rounds) <= 64
