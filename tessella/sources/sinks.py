"""Tables written as tab-separated values, JSON or Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from ..operators.shared import shared_root


def write_tsv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Tab-separated with header, quotes doubled, empty cells for nulls, CRLF ends; `files` limits the number of part files."""
    out = rows if files is None else rows.coalesce(files)
    out.write.mode("overwrite").option("sep", "\t").option("header", "true").option("escape", '"').option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def tsv_lines(rows: DataFrame) -> DataFrame:
    """(line): the cells of each row joined by tabs, tabs and line ends within them replaced by spaces, nulls empty."""
    cells = [F.coalesce(clean_cell(F.col(c).cast("string")), F.lit("")) for c in rows.columns]
    return rows.select(F.concat_ws("\t", *cells).alias("line"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below that of spark.checkpoint.dir, which all executors share."""
    return f"{shared_root(spark)}/export-{uuid.uuid4().hex}"


def projection_metadata(model_key: str, image_dir: str, count: Column, method: str | None = None, k: int | None = None, score: float | None = None, warning: str | None = None) -> Column:
    """The JSON that goes with a stored projection: what it was made from, and how it was clustered or why not."""
    clustering = F.struct(
        F.lit(method is not None).alias("enabled"), F.lit(method).cast("string").alias("method"), F.lit(k).cast("int").alias("k"), F.lit(score).cast("double").alias("score"),
        F.lit(method is not None and warning is None).alias("applied"), F.lit(warning).cast("string").alias("warning"),
    )
    return F.to_json(F.struct(F.lit(model_key).alias("model_key"), F.lit(image_dir).alias("image_dir"), count.alias("count"), clustering.alias("clustering")))


def search_log(query: str, model_key: Column, hits: Column, error: Column | None = None) -> Column:
    """The JSON row of a search in the log: its query, model, number of hits and error, if any."""
    error = F.lit(None).cast("string") if error is None else error
    return F.to_json(F.struct(F.lit(query).alias("query"), model_key.alias("model_key"), hits.alias("hits"), F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error")))


def write_manifests(rows: DataFrame, path: str) -> None:
    """A JSON file for each row."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Keyed vectors, a folder for each model."""
    rows.write.mode("append").partitionBy("model_key").parquet(path)


def missing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't stored yet under the same keys: the part of a collection that still has to be encoded."""
    return rows.join(stored.select(*keys), keys, "left_anti")
