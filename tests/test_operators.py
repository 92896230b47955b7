"""Small cases of the engine's operators."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessella.functions import text as T
from tessella.operators import catalog, cluster, encode, explore, images, jobs, reduce, search
from tessella.sources import collection, sinks


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_cosine_order_and_edges(spark):
    rows = vectors(spark, [(0, [1.0, 0.0]), (1, [0.7, 0.7]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 0.0])])
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    scored = search.score(rows, query)
    best = search.ranked(search.top_k(scored, 10, "vec_id"), "vec_id").collect()
    assert [r["vec_id"] for r in best] == [0, 6, 1, 2, 3, 5] and best[0]["score"] == 1.0
    assert [r["vec_id"] for r in search.top_k(scored, 10, "vec_id", 0.0).collect()] == [0, 6, 1, 2, 3]


def test_request_is_checked():
    assert search.SearchRequest("a").top_k == 30
    for bad in ({"query": " "}, {"query": "a", "top_k": 0}, {"query": "a", "threshold": 2}):
        with pytest.raises(ValueError):
            search.SearchRequest(**bad)


def test_last_row_wins(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "path string, at int")
    assert sorted(search.last_per_key(rows, "path", F.desc("at")).collect()) == [("p", 2), ("q", 1)]


def test_vision_only_model_has_no_text():
    with pytest.raises(ValueError, match="does not support text search"):
        catalog.require(catalog.model("dinov2_base"), text=True)
    with pytest.raises(ValueError):
        catalog.require(catalog.model("cloc_roadmap"))
    with pytest.raises(ValueError, match="unknown"):
        catalog.model("none")
    assert catalog.model(None)["key"] == "openclip_vit_b_32"
    assert catalog.model(None, "hf-hub:apple/MobileCLIP-X")["key"] == "mobileclip_b_openclip"
    assert catalog.model(None, "a/b", "c:d")["key"] == "legacy_openclip_a-b_c-d"


def test_catalogue_facts(spark):
    rows = catalog.models(spark)
    assert {r[0]: r[1] for r in rows.groupBy("status").count().collect()} == {"stable": 4, "experimental": 15, "planned": 5}
    assert rows.select("family").distinct().count() == 18


def test_own_models_beside_the_built_in_ones(spark):
    like = catalog.models(spark).filter("key = 'dinov2_base'")
    own = like.withColumn("status", F.lit("planned")).unionByName(like.withColumns({"key": F.lit("mine"), "family": F.lit("Mine"), "requires": F.array(F.lit("torch"), F.lit("mymodule"))}))
    rows = catalog.registry(spark, own)
    assert rows.count() == catalog.models(spark).count() + 1
    assert [r[0] for r in rows.filter("key = 'dinov2_base'").select("status").collect()] == ["planned"]
    assert catalog.registry(spark, own.limit(0)).count() == catalog.models(spark).count()
    needs = {r["module"]: (r["models"], r["required"], r["installed"]) for r in catalog.requirements(own, ["torch"]).collect()}
    assert needs == {"torch": (2, True, True), "transformers": (1, False, False), "mymodule": (1, True, False)}
    assert {tuple(r) for r in catalog.lacking_families(own, "status").collect()} == {("planned", 15), ("stable", 16)}


def test_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("a-b.jpg", "a/b.jpg", "A/c.JPG", "x.bmp", "y.txt", ".h/z.png", "a/.h/z.png")], "path string")
    assert [r[0] for r in collection.images(paths).collect()] == [".h/z.png", "A/c.JPG", "a/.h/z.png", "a/b.jpg", "a-b.jpg", "x.bmp"]
    assert [r[0] for r in collection.folders(paths).collect()] == [".", "A", "a", "a/.h"]
    with pytest.raises(ValueError):
        collection.within("/data", "../etc")


def test_numbers_from_text(spark):
    rows = spark.createDataFrame([(x,) for x in ("1.5", "", "null", "3.9", "abc", "inf", None)], "t string")
    got = rows.select(T.float_or_null(F.col("t")), T.int_or_null(F.col("t")), T.optional_number(F.col("t"))).collect()
    assert [tuple(r) for r in got[:5]] == [(1.5, 1, 1.5), (None, None, None), (None, None, None), (3.9, 3, 3.9), (None, None, None)]
    assert got[5][1] is None and got[5][2] is None and tuple(got[6]) == (None, None, None)


def test_clustering(spark):
    blobs = [(i, float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3) * -5 + (i % 5) * 0.1) for i in range(60)]
    points = spark.createDataFrame(blobs, "vec_id long, x double, y double")
    k, value, labelled = cluster.auto_k(points, "vec_id", 2, 5)
    assert k == 3 and value > 0.9
    assert labelled.groupBy(F.col("vec_id") % 3).agg(F.countDistinct("cluster").alias("n")).filter("n <> 1").count() == 0
    with pytest.raises(ValueError):
        cluster.auto_k(points.filter("vec_id < 2"), "vec_id")
    assert cluster.k_range(3, 2, 8) == [2] and cluster.k_range(10, 5, 3) == [5]
    flat = cluster.standardize(points.withColumn("y", F.lit(4.0))).agg(F.max("y"), F.min("y")).first()
    assert tuple(flat) == (0.0, 0.0)


def test_silhouette_blocks_agree(spark):
    points = spark.createDataFrame([(i, float(i % 11), float(i % 7), i % 3) for i in range(50)], "vec_id long, x double, y double, cluster int")
    from tessella.operators import blocks

    whole = cluster.silhouette(points, "vec_id").first()[0]
    blocks_of = blocks.block_pairs.__defaults__
    blocks.block_pairs.__defaults__ = (9,)
    try:
        assert abs(cluster.silhouette(points, "vec_id").first()[0] - whole) < 1e-9
    finally:
        blocks.block_pairs.__defaults__ = blocks_of


def test_layouts_are_finite_and_repeatable(spark):
    rows = vectors(spark, [(i, [float((i * j) % 7) - 3 for j in range(1, 9)]) for i in range(40)])
    for reducer, parameters in (("umap", {"epochs": 2, "n_neighbors": 5}), ("tsne", {"iterations": 2, "asked_perplexity": 5})):
        a, b = (sorted(map(tuple, reduce.reduce_vectors(rows, reducer, **parameters).collect())) for _ in range(2))
        assert len(a) == 40 and a == b and all(abs(x) < 1e6 and abs(y) < 1e6 for _, x, y in a)
    with pytest.raises(ValueError):
        reduce.reduce_vectors(rows, "other")
    assert reduce.neighbour_count(15, 3) == 2 and reduce.perplexity(30, 10) == 3


def test_encoder_retries_singly(spark):
    class Picky:
        dim = 2

        def encode(self, batch: pd.Series):
            if len(batch) > 1 or batch.iloc[0] == "bad":
                raise RuntimeError("out of memory")
            return [[3.0, 4.0]]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "id long, t string")
    got = {r["id"]: r for r in encode.encode_column(rows, "id", "t", Picky, 3).collect()}
    assert got[1]["embedding"] == pytest.approx([0.6, 0.8]) and got[2]["embedding"] is None and "memory" in got[2]["error"]
    assert got[3]["embedding"] is None and got[3]["error"] is None and len(got) == 4


def test_explore(spark):
    assert tuple(explore.bounds(spark.createDataFrame([], "x double, y double")).first()) == (-1.0, 1.0, -1.0, 1.0)
    one = explore.project(spark.createDataFrame([(1, 5.0, 5.0)], "id long, x double, y double"), explore.Viewport()).first()
    assert 0 <= one["px"] <= 800 and 0 <= one["py"] <= 600
    assert explore.shows_thumbnails(500, 1.0) and not explore.shows_thumbnails(501, 1.9)


def test_image_plans(spark):
    rows = spark.createDataFrame([(100, 50), (1000, 500), (3, 4000), (0, 0)], "w int, h int")
    assert [tuple(r[0]) for r in rows.select(images.new_size(F.col("w"), F.col("h"), 800)).collect()] == [(100, 50), (800, 400), (1, 800), (None, None)]


def test_tsv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', "x\ty", None, 1.5)], "p string, q string, r string, s double")
    sinks.write_tsv(rows, str(tmp_path / "t"), 1)
    data = next((tmp_path / "t").glob("part-*")).read_bytes()
    assert data == b'p\tq\tr\ts\r\n"a""b"\t"x\ty"\t\t1.5\r\n'
    header = "filename\trelative_path\tx\ty\nf\timg/f\t1.5\tbad\n"
    (tmp_path / "p.tsv").write_text(header)
    row = collection.projection_table(spark, str(tmp_path / "p.tsv")).first()
    assert row["x"] == 1.5 and row["y"] is None and row["cluster"] is None


def test_file_scan_and_stream(spark, tmp_path):
    (tmp_path / "in" / "b").mkdir(parents=True)
    (tmp_path / "in" / "b" / "x.PNG").write_bytes(b"1")
    (tmp_path / "in" / "y.txt").write_bytes(b"2")
    assert collection.files(spark, str(tmp_path / "in")).count() == 2
    from tessella.streaming.jobs import new_images

    found = new_images(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    found.awaitTermination(60)
    assert spark.sql("SELECT size FROM found").collect() == [(1,)]


def test_jobs(spark):
    assert spark.range(1).select(jobs.percent(F.lit(1), F.lit(0)), jobs.percent(F.lit(1), F.lit(3))).first() == (0.0, 33.0)
    with jobs.JobGroup(spark, "g"):
        assert spark.range(5).count() == 5
