"""Queries of indexes, snapshots and stored forms: what is written once and then read in part."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode, explore, images, jobs, merkle, search, spatial, text_index
from ..sources import npy, sinks
from ..streaming import jobs as streams
from . import collection_queries  # noqa: F401  its SQL is used here
from .queries import _PROJECTED, ORACLE_SQL, _points, _read, _vectors, query, search_export_rows

_CLOSE = explore.Viewport(zoom=6.0, pan_x=20.0, pan_y=-10.0)
_PROJECTED_CLOSE = _PROJECTED.replace("* 1.5", "* 6.0")


def _tiles(spark, sf_dir):
    path = f"{sinks.shared_folder(spark)}/tiles"
    spatial.write_tiles(_points(spark, sf_dir).select("vec_id", "x", "y"), path, tile_rows=64)
    return spatial.open_tiles(spark, path)


@query(_PROJECTED_CLOSE + " SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py FROM s WHERE px BETWEEN -36 AND 836 AND py BETWEEN -36 AND 636")
def viewport_tiles(spark, sf_dir):
    tiles, box = _tiles(spark, sf_dir)
    return spatial.cull(tiles, box, _CLOSE, thumbnails=False).select("vec_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(_PROJECTED_CLOSE + " SELECT vec_id, round(sqrt((px - 420) ** 2 + (py - 290) ** 2), 6) AS distance FROM s WHERE sqrt((px - 420) ** 2 + (py - 290) ** 2) < 44 ORDER BY distance, vec_id LIMIT 1")
def hover_tiles(spark, sf_dir):
    tiles, box = _tiles(spark, sf_dir)
    return spatial.hover(tiles, box, 420, 290, _CLOSE, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("""
    WITH n AS (SELECT item_id AS needle_id, substr(text, 1 + (item_id % 7)::INTEGER, CASE item_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 ELSE 24 END) AS needle FROM benchmark)
    SELECT needle_id, doc_id FROM documents JOIN n ON contains(lower(text), lower(needle)) WHERE needle <> ''""")
def substring_index(spark, sf_dir):
    """Texts that have parts of benchmark items, by an index of letter runs over all documents."""
    docs = _read(spark, sf_dir, "documents")
    part = F.expr("substring(text, 1 + CAST(item_id % 7 AS INT), CASE item_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 ELSE 24 END)")
    path = f"{sinks.shared_folder(spark)}/runs"
    text_index.build(docs, path, "doc_id")
    return text_index.search(path, docs, _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), part.alias("needle")), "doc_id")


_SNAPSHOTS = """
    a AS (SELECT source || '/' || doc_id AS path, n_chars, lang FROM documents),
    b AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 103 = 9 THEN 'x' ELSE '' END AS path, n_chars + CASE WHEN doc_id % 101 = 7 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 89 <> 3 THEN lang END AS lang
          FROM documents WHERE doc_id % 97 <> 5)"""


def _snapshots(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    before = docs.select(F.concat_ws("/", "source", "doc_id").alias("path"), "n_chars", "lang")
    k = F.col("doc_id")
    after = docs.filter(k % 97 != 5).select(F.concat(F.concat_ws("/", "source", "doc_id"), F.when(k % 103 == 9, "x").otherwise("")).alias("path"), (F.col("n_chars") + (k % 101 == 7).cast("int")).alias("n_chars"), F.when(k % 89 != 3, F.col("lang")).alias("lang"))
    levels = merkle.depth_for(docs.count())
    return merkle.snapshot(before, "path", ["n_chars", "lang"], levels), merkle.snapshot(after, "path", ["n_chars", "lang"], levels), levels


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.n_chars <> b.n_chars OR a.lang IS DISTINCT FROM b.lang")
def snapshot_changes(spark, sf_dir):
    """What a rebuild has to look at between two states of a collection."""
    before, after, levels = _snapshots(spark, sf_dir)
    return merkle.changes(before, after, levels)


_LIMBS = ", ".join(f"sum(('0x' || substr(d, {13 * i + 1}, 13))::UBIGINT)::HUGEINT::VARCHAR" for i in range(5))


@query(f"WITH f AS (SELECT sha256(concat_ws(chr(31), source || '/' || doc_id, '=' || n_chars, coalesce('=' || lang, '-'))) AS d FROM documents) SELECT count(*) AS files, substr(sha256(concat_ws('|', count(*)::VARCHAR, {_LIMBS})), 1, 16) AS dataset_hash FROM f")
def snapshot_root(spark, sf_dir):
    before, _, levels = _snapshots(spark, sf_dir)
    return merkle.root(merkle.tree(before, levels))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last, len(embedding) AS width FROM embeddings")
def npy_round_trip(spark, sf_dir):
    """Vectors stored as .npy files with their keys, and read back by ranges of rows."""
    path = f"{sinks.shared_folder(spark)}/vectors"
    npy.write_npy(_vectors(spark, sf_dir), path, "vec_id")
    rows = npy.read_npy(spark, path, 1 << 15)
    return rows.select(F.col("key").alias("vec_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"), F.size("embedding").cast("long").alias("width"))


def _resample_sql(size: int, to: int, kernel: str) -> str:
    weights = images.kernel_weights(size, to, kernel)
    cell = lambda y, x: " + ".join(f"p[{j * size + i + 1}] * {weights[y][j] * weights[x][i]!r}" for j in range(size) for i in range(size) if weights[y][j] * weights[x][i])
    return "[" + ", ".join(cell(y, x) for y in range(to) for x in range(to)) + "]"


@query(f"""
    WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: 255 * (v + 1) / 2) AS p, list_transform(embedding::DOUBLE[], lambda v: least(1.0, abs(v) * 4)) AS a FROM embeddings),
         f AS (SELECT vec_id, p, list_transform(list_zip(p, a), lambda z: z[1] * z[2] + 255 * (1 - z[2])) AS f FROM e),
         r AS (SELECT vec_id, {_resample_sql(8, 3, 'lanczos')} AS small, {_resample_sql(8, 4, 'box')} AS half, f FROM f)
    SELECT vec_id, round(small[1], 5) AS first, round(small[9], 5) AS last, round(half[6], 5) AS inner_box, round(list_sum(small), 4) AS total, round(f[3], 5) AS flat FROM r""")
def thumbnail_pixels(spark, sf_dir):
    """Each vector as a picture of 8 x 8: brought to 3 x 3 by Lanczos and 4 x 4 by boxes, and laid over white."""
    p = _vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda v: 255 * (v.cast("double") + 1) / 2).alias("p"), F.transform("embedding", lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) * 4)).alias("a"))
    r = p.select("vec_id", images.resampled(F.col("p"), 8, 8, 3, 3).alias("small"), images.resampled(F.col("p"), 8, 8, 4, 4, "box").alias("half"), images.flattened(F.col("p"), F.col("a")).alias("f"))
    total = F.aggregate("small", F.lit(0.0), lambda s, v: s + v)
    return r.select("vec_id", F.round(F.col("small")[0], 5).alias("first"), F.round(F.col("small")[8], 5).alias("last"), F.round(F.col("half")[5], 5).alias("inner_box"), F.round(total, 4).alias("total"), F.round(F.col("f")[2], 5).alias("flat"))


@query("""
    WITH k AS (SELECT doc_id, sha1(concat_ws('|', source || '/' || doc_id, '160', '1700000000', n_chars::VARCHAR)) AS thumb_key FROM documents)
    SELECT doc_id, thumb_key, doc_id % 3 = 0 AS cached, CASE WHEN doc_id % 3 = 0 THEN doc_id % 256 END AS pixel FROM k""")
def thumbnail_cache(spark, sf_dir):
    """A stored cache holds a third of the thumbnails: what it has and what is still to be made."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(1700000000).alias("mtime"), "n_chars")
    stored = docs.filter("doc_id % 3 = 0").select(images.thumb_key(F.col("path"), 160, F.col("mtime"), F.col("n_chars")).alias("thumb_key"), F.array((F.col("doc_id") % 256).cast("int")).alias("pixels"))
    path = f"{sinks.shared_folder(spark)}/thumbs"
    stored.write.parquet(path)
    hits, misses = images.thumbnails(docs, spark.read.parquet(path), "path", 160, "mtime", "n_chars")
    return hits.select("doc_id", "thumb_key", F.lit(True).alias("cached"), F.col("pixels")[0].cast("long").alias("pixel")).unionByName(misses.select("doc_id", "thumb_key", F.lit(False).alias("cached"), F.lit(None).cast("long").alias("pixel")))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'optimize=true,progressive=true,quality=' || (50 + p_size) WHEN 1 THEN 'compress_level=9,optimize=true' WHEN 2 THEN 'method=6,quality=' || (50 + p_size) WHEN 3 THEN 'compression=tiff_lzw' END AS options FROM part""")
def save_options(spark, sf_dir):
    k = F.col("p_partkey") % 5
    suffix = F.when(k == 0, ".jpg").when(k == 1, ".png").when(k == 2, ".webp").when(k == 3, ".tif").otherwise(".gif")
    options = images.save_options(images.image_format(suffix), 50 + F.col("p_size"))
    entries = F.array_sort(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _read(spark, sf_dir, "part").select("p_partkey", F.when(options.isNotNull(), F.array_join(entries, ",")).alias("options"))


@query("""
    SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '_' || substr(md5(user_id::VARCHAR), 1, 16) || '_open-clip-' || event_type || '_' || CASE WHEN event_id % 2 = 0 THEN 'umap' ELSE 'tsne' END
           || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_clusters-auto-2-' || (user_id % 7 + 3) ELSE '_clusters-k' || (user_id % 7 + 2) END || '_projection.tsv' AS name FROM events""")
def artifact_tags(spark, sf_dir):
    k, user = F.col("event_id"), F.col("user_id") % 7
    name = T.artifact_name(
        F.date_format("ts", "yyyyMMdd-HHmmss"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 16), F.concat(F.lit("open/clip "), F.col("event_type")), F.when(k % 2 == 0, "umap").otherwise("tsne"),
        k % 3 != 0, k % 3 == 1, user + 2, F.lit(2), user + 3,
    )
    return _read(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query("SELECT count(*)::BIGINT AS done, count(*) FILTER (doc_id % 50 = 7)::BIGINT AS errors, 'completed' AS status FROM documents WHERE text IS NOT NULL")
def encode_progress(spark, sf_dir):
    """Progress of a job that encodes every document, measured while it runs and read back from its log."""

    class Lengths:
        dim = 2

        def encode(self, batch):
            if any(int(x) % 50 == 7 for x in batch):
                raise RuntimeError("shape")
            return [[1.0, float(x)] for x in batch]

    docs = _read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("doc_id").alias("value"))
    job = jobs.Measured(spark, 1)
    path = f"{sinks.shared_folder(spark)}/encoded"
    job.run(lambda: job.of(encode.encode_column(docs, "doc_id", "value", Lengths), "error").write.parquet(path))
    return jobs.latest(job.events(), "job_id", "seq", "kind").select("done", "errors", F.col("kind").alias("status"))


@query("""
    WITH e AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN [3.0, 4.0] WHEN 1 THEN [0.0, 2.0] WHEN 2 THEN [1.0, 0.0] WHEN 3 THEN [6.0, 8.0] ELSE [5.0, 12.0] END AS v FROM embeddings)
    SELECT vec_id, round(v[1] / sqrt(v[1] ** 2 + v[2] ** 2), 5)::DOUBLE AS first, round(v[2] / sqrt(v[1] ** 2 + v[2] ** 2), 5)::DOUBLE AS second FROM e""")
def encode_outputs(spark, sf_dir):
    """Models that answer with a mapping, an object, the first token of each item, the last of several layers, or a plain array."""

    class Shapes:
        dim = 2

        def encode(self, batch):
            kind, n = int(batch.iloc[0]) % 5, len(batch)
            if any(int(x) % 5 != kind for x in batch):
                raise RuntimeError("cannot convert a mixed batch")  # tried again row by row
            if kind == 0:
                return {"image_embeds": None, "pooler_output": [[3.0, 4.0]] * n}
            if kind == 1:
                return SimpleNamespace(last_hidden_state=np.array([[[0.0, 2.0], [9.0, 9.0]]] * n))
            if kind == 2:
                return {"hidden_states": [np.array([[7.0, 7.0]] * n), np.array([[1.0, 0.0]] * n)]}
            return {"logits": [[6.0, 8.0]] * n} if kind == 3 else np.array([[5.0, 12.0]] * n)

    rows = encode.encode_column(_vectors(spark, sf_dir).select("vec_id", F.col("vec_id").alias("value")), "vec_id", "value", Shapes)
    return rows.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(F.col("embedding")[1].cast("double"), 5).alias("second"))


@query(f"SELECT rank::INTEGER AS rank, filename, score, cluster, 25 AS count, embedding_id FROM ({ORACLE_SQL['search_export_rows']})")
def search_export_json(spark, sf_dir):
    """The JSON half of a search export, read back."""
    document = search.export_json(search_export_rows(spark, sf_dir), "20240101-000000")
    kind = "timestamp string, query string, model_key string, embedding_id string, count int, results array<struct<rank: int, filename: string, relative_path: string, score: double, x: double, y: double, cluster: int>>"
    parsed: DataFrame = document.select(F.from_json("json", kind).alias("d")).select("d.*")
    return parsed.select("count", "embedding_id", F.explode("results").alias("r")).select("r.rank", "r.filename", "r.score", "r.cluster", "count", "embedding_id")


@query(ORACLE_SQL["job_log_states"])
def live_job_states(spark, sf_dir):
    """The states of `job_log_states`, from a stream of the same events in several batches."""
    kind = F.col("event_type")
    log = _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(kind.isin("click", "view"), "progress").when(kind == "signup", "cancel").when(kind == "error", "failed").otherwise("completed").alias("kind"), "ts")
    folder = sinks.shared_folder(spark)
    log.repartition(3, "seq").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema("job_id long, seq long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    return streams.replayed(stream, folder)
