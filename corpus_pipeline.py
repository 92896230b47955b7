"""A corpus-cleaning pipeline over the documents table: five stages, each writing what it keeps for the next."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from tessella.llm.common import doc_bucket, maybe_broadcast, stage, unstage
from tessella.llm.queries import tokenizer_path


#: The lists that runs under way collect their stages' tables in, the innermost last; a stage called by itself keeps its tables.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def _tables_deleted():
    """Within it the tables that stages make are collected; they are deleted at its end, when the stage's result is written."""
    _OPEN.append([])
    try:
        yield
    finally:
        unstage(*_OPEN.pop())


def _kept(df: DataFrame, name: str) -> DataFrame:
    """`df` staged; a run deletes it once the stage's result is written."""
    out = stage(df, name)
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs`, staged, with a column that tells rows apart whatever their doc_ids, and its name, which no other column has."""
    row = "row_of_stage"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    return _kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """`docs` without the rows whose number is in `dropped`, and without that number."""
    dropped = _kept(dropped.select(row).distinct(), "dropped")
    return docs.join(maybe_broadcast(dropped, dropped.count()), row, "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which no learned language is recognised: null and empty texts, those without letters or without any likeness to a profile.

    Rows are judged one by one: repeated rows share their fate, other columns stay as they are, and an empty table stays empty.
    """
    profiles = language_id.fit_language_profiles(docs.filter(doc_bucket(F.col("doc_id"), 4) != 2))
    known = language_id.language_column(profiles)("text")
    return docs.filter((known["lang_pred"] != "und") & (known["score"] > 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows with that doc_id one. A null text equals the empty one, a null doc_id is the smallest."""
    numbered, row = _numbered(docs)
    decided = exact_dedup.exact_dedup(numbered, row)
    return _without(numbered, decided.filter("NOT kept").select(F.col("row").alias(row)), row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays; a null doc_id counts as the largest.

    Rows are told apart by number, so that rows of one doc_id with different texts are judged each on its own; a
    text without words is linked with nothing and stays.
    """
    numbered, row = _numbered(docs)
    found = ngram_join.near_duplicate_components(numbered.select(F.col(row).alias("doc_id"), "text"))
    found = _kept(found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group_of_row")), "groups")
    several = found.groupBy("group_of_row").agg(F.count("*").alias("n")).filter("n > 1").select("group_of_row")
    members = _kept(found.join(several, "group_of_row"), "members")
    named = numbered.select(row, F.col("doc_id").cast("long").alias("doc_id")).join(maybe_broadcast(members, members.count()), row)
    least = named.groupBy("group_of_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", row))[row].alias("kept_row"))
    return _without(numbered, members.join(least, "group_of_row").filter(F.col(row) != F.col("kept_row")), row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text contains a benchmark item; of rows with one doc_id only those that do. Null and empty texts contain none."""
    numbered, row = _numbered(docs)
    found = decontaminate.find_benchmark_items(numbered.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(numbered, found.select(F.col("doc_id").alias(row)), row)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, packed into sequences; every row has pieces, null and empty texts one of one id."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]

#: SQL can express neither the language stage nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents of `sf_dir`; the result of each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[DataFrame] = []
    for name, step in STAGES[:-1]:
        with _tables_deleted():
            docs = stage(step(spark, docs, sf_dir), name)
        unstage(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
