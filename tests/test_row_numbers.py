"""Row numbers in order, over several ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from tessella.plans import queries


def test_projection_table_numbers_ids_with_gaps_and_repeats(spark, tmp_path):
    ids = [5, 900, 17, 17, 42, 17, *range(1000, 1400, 7)]
    rows = spark.createDataFrame([(i, [0.5, 1.5], 1) for i in ids], "vec_id long, embedding array<float>, label int")
    rows.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.projection_table(spark, str(tmp_path)).select(F.regexp_extract("filename", "[0-9]+", 0).cast("long"), "row_index").collect()
    assert [i for i, _ in sorted(got, key=lambda r: r[1])] == sorted(ids) and sorted(n for _, n in got) == list(range(1, len(ids) + 1))
    assert queries.projection_table(spark, str(tmp_path)).schema["row_index"].dataType.simpleString() == "bigint"
