"""Tiles, the substring index, snapshots, .npy files, measured jobs and pixels on small cases."""

from __future__ import annotations

import io
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F
from tessella.operators import explore, images, jobs, merkle, spatial, text_index
from tessella.sources import collection, npy


def scanned_files(df) -> int:
    """The number of files that the scan of an executed plan has opened."""
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return int(leaf.metrics().apply("numFiles").value())


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(3000, 2)))] + [(9000 + i, 0.25, 0.25) for i in range(1200)] + [(8000, float("nan"), 1.0)]
    points = spark.createDataFrame(at, "vec_id long, x double, y double")
    path = f"file://{tmp_path_factory.mktemp('tiles')}"
    spatial.write_tiles(points, path, tile_rows=64)
    return points, *spatial.open_tiles(spark, path)


@pytest.mark.parametrize("zoom", [1.0, 4.0, 40.0])
def test_tiles_give_the_points_of_a_view_from_some_files(tiles, zoom):
    points, stored, box = tiles
    view = explore.Viewport(zoom=zoom, pan_x=30.0, pan_y=-80.0)
    seen = spatial.cull(stored, box, view, thumbnails=False)
    want = explore.cull(explore.project(explore.finite_points(points), view), view, thumbnails=False)
    got = {r["vec_id"]: (r["px"], r["py"]) for r in seen.collect()}
    assert got == {r["vec_id"]: (pytest.approx(r["px"]), pytest.approx(r["py"])) for r in want.collect()}
    if zoom > 1:
        every = stored.select("vec_id")
        every.collect()
        narrow = seen.select("vec_id")
        narrow.collect()
        assert scanned_files(narrow) < scanned_files(every) * (0.5 if zoom > 10 else 0.9)
    a, b = spatial.hover(stored, box, 400, 300, view, "vec_id").collect(), explore.hover(explore.project(explore.finite_points(points), view), 400, 300, view, "vec_id").collect()
    assert [r["vec_id"] for r in a] == [r["vec_id"] for r in b]


def test_ranges_cover_a_rectangle():
    box, rng = spatial.Box(0.0, 1.0, 0.0, 1.0, 6), random.Random(2)
    for most in (4, 64):
        for _ in range(40):
            x, y = sorted(rng.random() for _ in range(2)), sorted(rng.random() for _ in range(2))
            ranges = spatial.code_ranges(box, *x, *y, most)
            assert 0 < len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
            for _ in range(20):
                code = spatial.interleave(box.place(rng.uniform(*x), "x"), box.place(rng.uniform(*y), "y"))
                assert any(a <= code <= b for a, b in ranges)
    assert spatial.code_ranges(box, 2, 3, 0, 1) == []


def test_tiles_of_one_place_and_of_nothing(spark, tmp_path):
    for name, rows in (("one", [(1, 2.0, 2.0), (2, 2.0, 2.0)]), ("none", [])):
        table = spark.createDataFrame(rows, "vec_id long, x double, y double")
        spatial.write_tiles(table, f"file://{tmp_path}/{name}")
        if rows:
            stored, box = spatial.open_tiles(spark, f"file://{tmp_path}/{name}")
            assert spatial.within(stored, box, 1, 3, 1, 3).count() == 2 and spatial.within(stored, box, 5, 6, 5, 6).count() == 0


def test_delta_code_round_trip():
    rng = np.random.default_rng(4)
    for ids in (np.empty(0, np.int64), np.array([0]), np.array([0, 1, 127, 128, 129, 16384, 2**40]), np.unique(rng.integers(0, 2**16, 5000))):
        assert (text_index.delta_decode(text_index.delta_code(ids)) == ids).all()
    assert len(text_index.delta_code(np.arange(1000))) == 1000


def test_substring_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abAé \n") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", "a", "x" * 20000 + "needle"]
    rows = [(i * 1000 if i % 2 else i, t) for i, t in enumerate(texts)]
    needles = [(0, "ab"), (1, "AÉ "), (2, "needle"), (3, ""), (4, None), (5, "aab"), (6, "é"), (7, "nowhere"), (8, "a b\n"), (9, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/index"
    text_index.build(docs, path, "doc_id")
    asked = spark.createDataFrame(needles, "needle_id long, needle string")
    got = sorted(map(tuple, text_index.search(path, docs, asked, "doc_id").collect()))
    want = sorted((n, k) for n, needle in needles if needle for k, t in rows if t is not None and needle.lower() in t.lower())
    assert got == want
    found = text_index.candidates(spark, path, asked)
    assert found.filter("needle_id = 7").count() == 0 and found.filter("needle_id = 2").count() == 1
    assert spark.read.parquet(path).agg(F.max("n")).first()[0] <= text_index.BLOCK_KEYS


def test_snapshots(spark):
    before = [(f"p{i}", i, "en" if i % 5 else None) for i in range(900)] + [("same", 1, "x"), ("same", 2, "x")]
    after = [(p, n + (p == "p7"), "" if p == "p10" else g) for p, n, g in before if p not in ("p3", "p4")] + [("new", 1, None), ("same", 2, "x")]
    a, b = (merkle.snapshot(spark.createDataFrame(r, "path string, n int, lang string").repartition(k), "path", ["n", "lang"], 2) for r, k in ((before, 3), (after, 2)))
    assert sorted(map(tuple, merkle.changes(a, b, 2).collect())) == [("new", "added"), ("p10", "changed"), ("p3", "removed"), ("p4", "removed"), ("p7", "changed"), ("same", "changed")]
    leaves = {r["leaf"] for r in merkle.differing_leaves(merkle.tree(a, 2), merkle.tree(b, 2), 2).collect()}
    assert 0 < len(leaves) <= 6 and merkle.changes(a, a.repartition(5), 2).count() == 0
    roots = [merkle.root(merkle.tree(x, 2)).first() for x in (a, a.repartition(7), b)]
    assert roots[0] == roots[1] != roots[2] and roots[0]["files"] == 902
    assert merkle.depth_for(10) == 1 and merkle.depth_for(10**6) == 3


def test_npy_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(1000, 7)).astype(np.float64)
    np.save(tmp_path / "plain.npy", matrix)
    got = npy.read_npy(spark, f"file://{tmp_path}/plain.npy", 3000)
    assert got.rdd.getNumPartitions() > 10
    rows = got.orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(1000)) and rows[0]["key"] is None
    assert np.allclose(np.array([r["embedding"] for r in rows]), matrix.astype(np.float32))
    table = spark.createDataFrame([(i * 3, [float(x) for x in m]) for i, m in enumerate(matrix)], "id long, embedding array<float>").repartition(4)
    for _ in range(2):  # written again, nothing of the first is left
        npy.write_npy(table, f"file://{tmp_path}/keyed", "id")
    back = npy.read_npy(spark, f"file://{tmp_path}/keyed", 4096).collect()
    assert {r["key"]: tuple(r["embedding"]) for r in back} == {r["id"]: tuple(r["embedding"]) for r in table.collect()} and sorted(r["row_index"] for r in back) == list(range(1000))
    assert len(list((tmp_path / "keyed").glob("part-*.npy"))) == 4 and not list((tmp_path / "keyed").glob("_part*"))
    with pytest.raises(Exception, match="without a vector"):
        npy.write_npy(spark.createDataFrame([(1, None)], "id long, embedding array<float>"), f"file://{tmp_path}/bad", "id")
    assert not list((tmp_path / "bad").glob("*.npy")) if (tmp_path / "bad").exists() else True
    data = io.BytesIO()
    np.save(data, np.asfortranarray(matrix))
    (tmp_path / "columns.npy").write_bytes(data.getvalue())
    with pytest.raises(Exception, match="columns"):
        npy.read_npy(spark, f"file://{tmp_path}/columns.npy").count()


def test_measured_jobs(spark):
    rows = spark.range(100).withColumn("error", F.when(F.col("id") % 10 == 0, "bad"))
    job = jobs.Measured(spark, 5)
    job.run(lambda: job.of(rows, "error").write.format("noop").mode("overwrite").save())
    assert [tuple(r) for r in job.events().collect()] == [(5, 1, "progress", 100, 10, None), (5, 2, "completed", 100, 10, None)]
    failed = jobs.Measured(spark, 6)
    failed.run(lambda: failed.of(rows.withColumn("x", F.raise_error(F.lit("it broke"))), "error").write.format("noop").mode("overwrite").save())
    got = failed.events().first()
    assert got["kind"] == "failed" and "it broke" in got["error"]


def test_images_that_cannot_be_decoded_have_an_error(spark, tmp_path):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = b"".join(b"\0" + bytes([x, y, 9]) * 3 for y in (1, 2) for x in (5,))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no picture")
    got = {r["path"].rsplit("/", 1)[1]: r for r in collection.decoded(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["channels"], got["a.png"]["error"]) == (3, 2, 3, None) and len(got["a.png"]["pixels"]) == 18
    assert got["b.png"]["width"] is None and got["b.png"]["pixels"] is None and "decoded" in got["b.png"]["error"]


def test_a_job_group_is_cancelled(spark):
    seen = []

    def work():
        with jobs.JobGroup(spark, "slow"):
            try:
                spark.range(4, numPartitions=4).mapInPandas(lambda batches: (time.sleep(60) or x for x in batches), "id long").count()
            except Exception as error:  # noqa: BLE001
                seen.append(str(error))

    thread = InheritableThread(target=work)
    thread.start()
    time.sleep(4)
    jobs.JobGroup(spark, "slow").cancel()
    thread.join(40)
    assert not thread.is_alive() and "cancel" in seen[0].lower() and spark.range(3).count() == 3


def test_resampling(spark):
    one = spark.createDataFrame([([float(i) for i in range(12)],)], "p array<double>")
    got = one.select(images.resampled(F.col("p"), 4, 3, 2, 3, "box").alias("box"), images.resampled(F.col("p"), 4, 3, 4, 3).alias("same"), images.resampled(F.col("p"), 4, 3, 2, 6).alias("other")).first()
    assert got["box"] == pytest.approx([0.5, 2.5, 4.5, 6.5, 8.5, 10.5]) and got["same"] == pytest.approx([float(i) for i in range(12)]) and len(got["other"]) == 12
    flat = one.select(images.resampled(F.transform("p", lambda v: F.lit(7.0)), 4, 3, 7, 5).alias("f")).first()["f"]
    assert flat == pytest.approx([7.0] * 35)
    for kernel in ("box", "lanczos"):
        assert all(abs(sum(w) - 1) < 1e-12 for w in images.kernel_weights(9, 4, kernel))
