"""Exact vector search: scores, thresholds, top-k, joined metadata."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cell, in_scope, norm_dir
from ..functions.vectors import cosine, dot


#: Queries that a task holds at once.
QUERY_BLOCK = 4096


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of a matrix, each of length 1; one of length 0 stays so."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for, checked before anything is planned."""

    query: str
    model_key: str = "openclip_vit_b_32"
    image_dir: str = "img"
    embedding_id: str | None = None
    top_k: int = 30
    threshold: float | None = None
    normalize: bool = True

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("query is empty")
        if not 1 <= self.top_k <= 500:
            raise ValueError("top_k must be 1..500")
        if self.threshold is not None and not -1 <= self.threshold <= 1:
            raise ValueError("threshold must be -1..1")


def score(vectors: DataFrame, query: DataFrame, vector: str = "embedding", normalized: bool = True) -> DataFrame:
    """`vectors` with score_raw against the one vector q of `query`; null vectors are left out."""
    how = cosine if normalized else dot
    one = query.select(F.col("q")).limit(1)
    return vectors.filter(F.col(vector).isNotNull()).join(F.broadcast(one)).withColumn("score_raw", how(F.col(vector), F.col("q"))).drop("q")


def top_k(scored: DataFrame, k: int, key: str, threshold: float | None = None) -> DataFrame:
    """The k best rows, at least `threshold` before the cut; NaN never passes a threshold and comes last; ties by key."""
    if threshold is not None:
        scored = scored.filter((F.col("score_raw") >= threshold) & ~F.isnan("score_raw"))
    return scored.orderBy(F.isnan("score_raw"), F.desc("score_raw"), key).limit(k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """Hits, of which there are at most k, with rank from 1 and score rounded to six places."""
    order = Window.orderBy(F.isnan("score_raw"), F.desc("score_raw"), key)
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("score", F.round("score_raw", 6))


def last_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rn = 1").drop("_rn")


def find_index(indexes: DataFrame, model_key: str, image_dir: str, embedding_id: str | None = None) -> DataFrame:
    """The newest index (embedding_id, model_key, image_dir, embedding_path, ts): by its id alone if one is given, else of a model and folder, with vectors."""
    if embedding_id:
        found = indexes.filter(F.col("embedding_id") == embedding_id)
    else:
        found = indexes.filter((F.col("model_key") == model_key) & (norm_dir(F.col("image_dir")) == norm_dir(F.lit(image_dir))) & F.col("embedding_path").isNotNull())
    return found.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


def with_projection(hits: DataFrame, rows: DataFrame, path: str, image_dir: str = "img") -> DataFrame:
    """`hits` with the stored row (relative_path, row_index, ...) of their path below a folder, the last one of a path that has several; nulls without any."""
    stored = rows.filter(in_scope(F.col("relative_path"), F.lit(image_dir)))
    others = [c for c in stored.columns if c != "relative_path"]
    last = stored.groupBy("relative_path").agg(F.max_by(F.struct(*others), "row_index").alias("last"))
    return hits.join(last, hits[path] == last["relative_path"], "left").select(*(hits[c] for c in hits.columns), *(F.col(f"last.{c}").alias(c) for c in others))


def search_with_metadata(vectors: DataFrame, query: DataFrame, metadata: DataFrame, key: str, metadata_key: str, k: int, threshold: float | None, normalized: bool = True) -> DataFrame:
    """The k best rows, cut before the left join with their metadata, of which a key that has several rows gives one, the greatest."""
    hits = top_k(score(vectors, query, normalized=normalized), k, key, threshold)
    others = [c for c in metadata.columns if c != metadata_key]
    metadata = metadata.join(F.broadcast(hits.select(F.col(key).alias(metadata_key))), metadata_key, "left_semi").groupBy(metadata_key).agg(F.max(F.struct(*others)).alias("m")).select(metadata_key, "m.*")
    return ranked(hits.join(metadata, hits[key] == metadata[metadata_key], "left"), key)


def batch_top_k(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """For a stated set of queries the k best rows each: (query_key, rank, key, score); null vectors are left out.

    Queries are broadcast in blocks of bounded size, each a pass over the vectors; a batch of rows is multiplied with a block at once and
    sends only its own k best rows of each query.
    """
    rows, asked = vectors.filter(F.col("embedding").isNotNull()).select(key, "embedding"), queries.filter(F.col("q").isNotNull()).select(query_key, "q")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    kinds = dict(rows.dtypes)[key], dict(asked.dtypes)[query_key]
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).toPandas()
        if not len(own):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((own[query_key].to_numpy(), unit_rows(own["q"])))

        def best_of(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if len(pdf):
                    pdf = pdf.sort_values(key)
                    s = q @ unit_rows(pdf["embedding"]).T
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(ids, best.shape[1]), key: pdf[key].to_numpy()[best].ravel(), "score_raw": np.take_along_axis(s, best, 1).ravel()})

        parts.append(rows.mapInPandas(best_of, f"{query_key} {kinds[1]}, {key} {kinds[0]}, score_raw double"))
    order = Window.partitionBy(query_key).orderBy(F.desc("score_raw"), key)
    pairs = reduce(DataFrame.unionByName, parts) if parts else rows.join(asked).select(query_key, key, F.lit(0.0).alias("score_raw")).limit(0)
    best = pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return best.select(query_key, "rank", key, F.round("score_raw", 6).alias("score"))


def export_rows(hits: DataFrame, query: str, model_key: str, embedding_id: str) -> DataFrame:
    """Ranked hits in the ten columns of a search export, tabs and line ends in cells replaced by spaces."""
    return hits.select(
        "rank", clean_cell(F.col("filename")).alias("filename"), clean_cell(F.col("relative_path")).alias("relative_path"), "score",
        F.lit(query).alias("query"), F.lit(model_key).alias("model_key"), F.lit(embedding_id).alias("embedding_id"), "x", "y", "cluster",
    )


def export_json(rows: DataFrame, created: str) -> DataFrame:
    """(json): the export of a search as one document, its results in order of rank; `rows` are the bounded rows of `export_rows`."""
    hit = F.struct("rank", "filename", "relative_path", "score", "x", "y", "cluster")
    whole = rows.groupBy("query", "model_key", "embedding_id").agg(F.sort_array(F.collect_list(hit)).alias("results"))
    return whole.select(F.to_json(F.struct(F.lit(created).alias("timestamp"), "query", "model_key", "embedding_id", F.size("results").alias("count"), "results")).alias("json"))
