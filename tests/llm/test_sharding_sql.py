"""The shards of whole tables equal their SQL."""

from __future__ import annotations

from parity import TABLES, differences, duck
from tessella.llm.queries import ORACLE_SQL, QUERIES


def test_shards_equal_sql(spark, sf_dir):
    assert differences(spark, duck(sf_dir), QUERIES["op9_sharding"], ORACLE_SQL["op9_sharding"], sf_dir) == ""


def test_null_empty_and_long_texts_equal_sql(spark, tmp_path):
    rows = [(5, None), (1, ""), (2, "é" * 5000), (3, "same"), (4, "same"), (9, "x" * 40_000), (7, "\n\t€𝐦")]
    path = str(tmp_path)
    for name in TABLES:
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/{name}.parquet")
    assert differences(spark, duck(path), QUERIES["op9_sharding"], ORACLE_SQL["op9_sharding"], path) == ""
