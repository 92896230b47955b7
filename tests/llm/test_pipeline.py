"""The stages of the pipeline against brute force, each on its own input, and over an empty table."""

from __future__ import annotations

import itertools
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessella.llm import decontaminate

from test_llm_operators import edit_distance_within, expected_components, fold, sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(31)
    texts = [sentence(rng, rng.randrange(8, 60)) for _ in range(25)]
    a, b = texts[0], texts[1]
    out = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out += [(i + 40, t.upper(), "en", "s", 1) for i, t in enumerate(texts[:6])]
    out += [(60, a + " more", "en", "s", 1), (60, "quite another text that stands alone in here", "en", "s", 1), (61, b, None, None, None), (61, b, None, None, None)]
    out += [(70, None, "en", "s", 0), (71, "", "en", "s", 0), (72, "123 456", "en", "s", 1), (None, texts[2], "en", "s", 1), (None, sentence(rng, 30), "en", "s", 1), (80, sentence(rng, 2500), "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(32)
    folder = f"file://{tmp_path_factory.mktemp('pipeline')}"
    items = [(1, sentence(rng, 20)), (2, None), (3, "...")]
    spoiled = [(90, "see " + items[0][1].upper() + " there", "en", "s", 1), (90, "nothing of that kind in this one", "en", "s", 1)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    data = rows() + spoiled
    return folder, data, spark.createDataFrame(data, DOCS).withColumns({"row_of_stage": F.lit(1), "group_of_row": F.lit(2)}), items


def bag(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_language_stage(spark, table):
    folder, data, docs, _ = table
    assert bag(corpus_pipeline.language(spark, docs, folder)) == sorted(((i, t) for i, t, *_ in data if t and re.search(r"[^\W\d_]", t)), key=str)


def test_exact_stage(spark, table):
    folder, data, docs, _ = table
    best = {}
    for i, t, *_ in data:
        best[fold(t)] = max(best.get(fold(t), (False, -1)), (i is not None, -1 if i is None else i))
    got = corpus_pipeline.exact(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((fold(t), i is not None, -1 if i is None else i) for i, t in bag(got)) == sorted((t, *k) for t, k in best.items())


def test_near_stage_drops_rows_not_ids(spark, table):
    folder, data, docs, _ = table
    group, _ = expected_components([(k, t) for k, (_, t, *_) in enumerate(data)])
    keep = {}
    for k, (i, *_) in enumerate(data):
        keep.setdefault(group[k], []).append((i is None, -1 if i is None else i, k))
    kept = [min(v) for v in keep.values()]
    got = corpus_pipeline.near(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(str(data[k][0]) for _, _, k in kept) == sorted(str(i) for i, _ in bag(got))
    assert (60, "quite another text that stands alone in here") in bag(got)


def test_decontamination_stage(spark, table):
    folder, data, docs, items = table
    want = []
    for i, t, *_ in data:
        w = decontaminate.normalise(t)
        ps = [decontaminate.normalise(q) for _, q in items]
        if not any(p and w and edit_distance_within(p, w) <= int(decontaminate.ERROR_RATE * len(p)) for p in ps):
            want.append((i, t))
    got = bag(corpus_pipeline.decontaminated(spark, docs, folder))
    assert got == sorted(want, key=str) and len(want) == len(data) - 1


def test_every_stage_of_an_empty_table(spark, table):
    folder, _, docs, _ = table
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), folder).count() == 0


def test_whole_run_packs_what_the_stages_keep(spark, table):
    folder, data, docs, _ = table
    docs.drop("row_of_stage", "group_of_row").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(str(r["doc_id"]) for r in got.filter("piece = 0").collect()) == sorted(str(r["doc_id"]) for r in now.collect())
    assert all(sum(r["length"] for r in g) <= 1024 for _, g in itertools.groupby(sorted(got.collect(), key=lambda r: r["sequence_id"]), lambda r: r["sequence_id"]))
