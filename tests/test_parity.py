"""Every query that has SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest
from parity import differences, duck
from tessella.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir) == ""


def test_fingerprint_moves_with_any_file(spark):
    from pyspark.sql import functions as F
    from tessella.sources.collection import fingerprint

    rows = spark.createDataFrame([("a", "p", 1, 2), ("a", "q", 1, 2), ("b", "p", 1, 2)], "g string, path string, size long, mtime long")
    once = {r[0]: r[1] for r in fingerprint(rows, "g", F.lit("m"), "path", "size", "mtime").collect()}
    again = {r[0]: r[1] for r in fingerprint(rows.orderBy(F.desc("path")), "g", F.lit("m"), "path", "size", "mtime").collect()}
    moved = {r[0]: r[1] for r in fingerprint(rows.withColumn("size", F.when(F.col("path") == "q", 9).otherwise(F.col("size"))), "g", F.lit("m"), "path", "size", "mtime").collect()}
    assert once == again and all(len(x) == 16 for x in once.values())
    assert once["a"] != moved["a"] and once["b"] == moved["b"]
