"""Queries over stored collections: listings, indexes and their match, exports read back, jobs and the catalogue's text.

The driver's tables stand for entities as in `queries`; where an operator reads files, the query first writes them from a table
into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, cluster, encode, explore, images, jobs, neighbours, search
from ..sources import collection, sinks
from .queries import _POINTS, _REGISTRY, _Z, _lloyd_sql, _points, _read, _registry, _silhouette_sql, _vectors, query

_PATH = "source || '/' || lang || '/d' || doc_id || '.jpg'"


def _image_paths(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return _read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", name).alias("path"), "doc_id", "n_chars")


@query("SELECT 'd' || doc_id || '.jpg' AS filename, source || '/' || lang || '/d' || doc_id || '.jpg' AS relative_path, (SELECT count(*) FROM documents WHERE source || '/' || lang || '/d' || doc_id || '.jpg' IS NOT NULL) AS total FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def image_list(spark, sf_dir):
    return collection.listing(_image_paths(spark, sf_dir).filter("path RLIKE '/.+/'"))


_ENDED = "SELECT url || CASE page_id % 3 WHEN 1 THEN '.BMP' WHEN 2 THEN '.Jpeg' ELSE '.gif' END AS path FROM pages"
_OF_IMAGE = r"lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]+)$', 1))"


def _ended(spark, sf_dir) -> DataFrame:
    k = F.col("page_id") % 3
    return _read(spark, sf_dir, "pages").select(F.concat("url", F.when(k == 1, ".BMP").when(k == 2, ".Jpeg").otherwise(".gif")).alias("path"))


@query(f"SELECT path FROM ({_ENDED}) WHERE {_OF_IMAGE} IN ('.jpeg', '.bmp')")
def image_scan_with_bitmaps(spark, sf_dir):
    return collection.images(_ended(spark, sf_dir))


@query(f"SELECT path FROM ({_ENDED}) WHERE {_OF_IMAGE} = '.jpeg'")
def resize_scan(spark, sf_dir):
    return collection.images(_ended(spark, sf_dir), suffixes=collection.RESIZE_SUFFIXES)


@query(f"SELECT vec_id::INTEGER AS row_index, 'v' || vec_id || '.jpg' AS filename, round(x, 6) AS x, round(y, 6) AS y, cluster::INTEGER AS cluster, NULL::DOUBLE AS cluster_score FROM ({_POINTS})")
def projection_read_back(spark, sf_dir):
    rows = _points(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id"), F.lit(".jpg")).alias("filename"), F.concat(F.lit("img/v"), F.col("vec_id"), F.lit(".jpg")).alias("relative_path"), "x", "y", F.lit("umap").alias("reducer"), F.col("vec_id").alias("row_index"), "cluster")
    path = f"{sinks.shared_folder(spark)}/projection.tsv"
    sinks.write_tsv(rows, path)
    return collection.projection_table(spark, path).select("row_index", "filename", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster", "cluster_score")


@query("SELECT CASE part WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS place, 'p' || part AS part, rows FROM (SELECT vec_id % 3 AS part, count(*) AS rows FROM embeddings GROUP BY 1)")
def projection_listing(spark, sf_dir):
    """Stored projections, newest first, with their rows; their times are set so that neither names nor the order of writing give the order."""
    folder = sinks.shared_folder(spark)
    for k in range(3):
        sinks.write_tsv(_points(spark, sf_dir).filter(F.col("vec_id") % 3 == k), f"{folder}/p{k}", 1)
    named = F.regexp_extract("path", r"/(p\d)/[^/]*$", 1).alias("part")
    written = collection.files(spark, folder, "*.csv").select("path", named).collect()  # three
    for row in written:
        collection.set_time(spark, row["path"], 1_700_000_000 + {"p0": 20, "p1": 40, "p2": 0}[row["part"]])
    found = collection.newest_first(collection.files(spark, folder, "*.csv")).select(named, F.monotonically_increasing_id().alias("came"))
    placed = found.select("part", F.row_number().over(Window.orderBy("came")).alias("place"))  # of the few files of a folder
    lines = spark.read.option("sep", "\t").option("header", "true").csv([r["path"] for r in written]).select(F.col("_metadata.file_path").alias("path"))
    return placed.join(lines.groupBy(named).agg(F.count("*").alias("rows")), "part").select("place", "part", "rows")


@query("SELECT 'm' || s_nationkey AS model_key, s_name AS model_family, s_suppkey::INTEGER * 10 AS count, 'e' || s_suppkey AS embedding_id FROM supplier WHERE s_acctbal > 0")
def manifest_scan(spark, sf_dir):
    """Manifests of stored vectors, one of each supplier in credit, written as JSON files and read back."""
    folder = sinks.shared_folder(spark)
    rows = _read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.lit("h").alias("dataset_hash"), F.concat(F.lit("m"), F.col("s_nationkey")).alias("model_key"), F.col("s_name").alias("model_family"),
        F.concat(F.lit("e"), F.col("s_suppkey"), F.lit("_manifest.json")).alias("embedding_path"), (F.col("s_suppkey").cast("int") * 10).alias("count"),
    )
    sinks.write_manifests(rows, folder)
    return collection.manifests(spark, folder).select("model_key", "model_family", "count", T.without_ending(F.col("embedding_path"), "_manifest.json").alias("embedding_id"))


_INDEXES = """i AS (SELECT event_id, ts, 'e' || event_id AS embedding_id, event_type AS model_key, '/img\\' || (user_id % 5) || '/' AS image_dir, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'p' || event_id END AS embedding_path FROM events)"""


def _indexes(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("embedding_id"), F.col("event_type").alias("model_key"),
        F.concat(F.lit("/img\\"), (F.col("user_id") % 5).cast("string"), F.lit("/")).alias("image_dir"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("embedding_path"),
    )


@query(f"WITH {_INDEXES} SELECT embedding_id, model_key FROM i WHERE model_key = 'click' AND trim(replace(image_dir, '\\', '/'), '/') = 'img/2' AND embedding_path IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1")
def index_by_folder(spark, sf_dir):
    return search.find_index(_indexes(spark, sf_dir), "click", "img/2").select("embedding_id", "model_key")


@query(f"WITH {_INDEXES} SELECT embedding_id, model_key FROM i WHERE embedding_id = 'e7'")
def index_by_id(spark, sf_dir):
    return search.find_index(_indexes(spark, sf_dir), "none", "img", embedding_id="e7").select("embedding_id", "model_key")


@query("""
    WITH p AS (SELECT 'd' || (doc_id % 400) AS relative_path, doc_id AS row_index, n_chars::DOUBLE AS x FROM documents), l AS (SELECT relative_path, max_by(x, row_index) AS x FROM p GROUP BY 1)
    SELECT vec_id, x FROM embeddings LEFT JOIN l ON relative_path = 'd' || vec_id""")
def lookup_last_row_wins(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 400).cast("string")).alias("relative_path"), F.col("doc_id").alias("row_index"), F.col("n_chars").cast("double").alias("x"))
    hits = _vectors(spark, sf_dir).select("vec_id", F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("path"))
    return search.with_projection(hits, rows, "path").select("vec_id", "x")


@query(f"SELECT 'd' || vec_id AS path, round(x, 6) AS x, round(y, 6) AS y, n_chars FROM ({_POINTS}) JOIN documents ON vec_id = doc_id")
def paths_with_coordinates(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "n_chars")
    joined = docs.join(_points(spark, sf_dir), F.col("doc_id") == F.col("vec_id"))
    return joined.select("path", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n_chars")


@query(f"SELECT vec_id, cluster FROM ({_POINTS}) WHERE cluster = 4 AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def view_of_hits_in_cluster(spark, sf_dir):
    hits = _read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return explore.view(_points(spark, sf_dir), "vec_id", hits, "4").select("vec_id", "cluster")


@query(f"SELECT vec_id, cluster FROM ({_POINTS}) WHERE vec_id = 17")
def point_lookup(spark, sf_dir):
    return explore.point(_points(spark, sf_dir), "vec_id", 17).select("vec_id", "cluster")


@query(f"SELECT count(*) AS rows, count(cluster) AS labelled, count(DISTINCT cluster) AS groups FROM (SELECT CASE WHEN vec_id % 4 > 0 THEN cluster END AS cluster FROM ({_POINTS}))")
def labelled_counts(spark, sf_dir):
    return explore.labelled_counts(_points(spark, sf_dir).withColumn("cluster", F.when(F.col("vec_id") % 4 > 0, F.col("cluster"))))


@query(f"SELECT vec_id, cluster, (vec_id * 37 % 11) / 10.0::DOUBLE AS cluster_score, row_number() OVER (ORDER BY CASE WHEN vec_id % 5 = 0 THEN 0 ELSE (vec_id * 37 % 11) / 10.0 END DESC, vec_id) AS place FROM ({_POINTS}) WHERE cluster = 2".replace("(vec_id * 37 % 11) / 10.0::DOUBLE AS", "CASE WHEN vec_id % 5 > 0 THEN (vec_id * 37 % 11)::DOUBLE / 10 END AS"))
def gallery_order(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("cluster_score", F.when(F.col("vec_id") % 5 > 0, (F.col("vec_id") * 37 % 11).cast("double") / 10))
    shown = explore.gallery(rows, 2, "vec_id").select("vec_id", "cluster", "cluster_score")
    came = shown.withColumn("came", F.monotonically_increasing_id())  # the order in which the operator gives them
    return came.withColumn("place", F.row_number().over(Window.orderBy("came")).cast("bigint")).drop("came")


@query(f"WITH {_REGISTRY} SELECT key, CASE WHEN key = 'dinov2_base' THEN 'own' WHEN contains(lower(family), 'dino') THEN 'dino text' WHEN contains(lower(family), 'clip') THEN 'clip text' ELSE 'any text' END AS guidance FROM m")
def model_guidance(spark, sf_dir):
    own = spark.createDataFrame([("dinov2_base", "own")], "key string, guidance string")
    return catalog.with_guidance(_registry(spark, sf_dir), own, [("dino", "dino text"), ("clip", "clip text")], "any text").select("key", "guidance")


@query(f"WITH {_REGISTRY} SELECT key, concat_ws(' · ', family, nullif(concat_ws(' · ', CASE WHEN list_contains(recommended_for, 'fast') THEN 'Fast' END, CASE WHEN status = 'experimental' THEN 'Experimental' END, CASE WHEN hardware_tier IN ('gpu_recommended', 'large_gpu') THEN 'Requires GPU' END, CASE WHEN supports_text_search THEN 'Text search supported' ELSE 'Projection only' END), ''), 'provider ' || provider) AS label FROM m")
def model_labels(spark, sf_dir):
    return _registry(spark, sf_dir).select("key", catalog.label().alias("label"))


@query(f"WITH {_REGISTRY} SELECT batch_size, 16 - count(DISTINCT CASE WHEN list_contains({list(catalog.REQUIRED_FAMILIES)!r}, family) THEN family END) AS lacking FROM m GROUP BY 1")
def required_families(spark, sf_dir):
    """For each size of batch, how many of the families that a catalogue must have its models lack."""
    return catalog.lacking_families(_registry(spark, sf_dir), "batch_size")


@query("""
    WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ViT-B-32' WHEN 1 THEN 'hf-hub:apple/MobileCLIP-' || user_id ELSE 'a/b' || user_id END AS model, CASE event_id % 3 WHEN 0 THEN 'laion2b_s34b_b79k' ELSE 'c:d' END AS checkpoint FROM events)
    SELECT event_id, CASE WHEN model = 'ViT-B-32' AND checkpoint = 'laion2b_s34b_b79k' THEN 'openclip_vit_b_32' WHEN starts_with(model, 'hf-hub:apple/MobileCLIP') THEN 'mobileclip_b_openclip'
      ELSE translate('legacy_openclip_' || model || '_' || checkpoint, '/:', '--') END AS model_key FROM o""")
def legacy_model_keys(spark, sf_dir):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    old = _read(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "ViT-B-32").when(k % 4 == 1, F.concat(F.lit("hf-hub:apple/MobileCLIP-"), user)).otherwise(F.concat(F.lit("a/b"), user)).alias("model"), F.when(k % 3 == 0, "laion2b_s34b_b79k").otherwise("c:d").alias("checkpoint"))
    return old.select("event_id", catalog.legacy_key(F.col("model"), F.col("checkpoint")).alias("model_key"))


_REQUIRED = f"{_REGISTRY}, r AS (SELECT module, count(*) AS models, bool_or(status = 'stable') AS required, module IN ('torch', 'numpy') AS installed FROM (SELECT status, unnest(requires) AS module FROM m) GROUP BY 1)"


@query(f"WITH {_REQUIRED} SELECT * FROM r")
def dependency_report(spark, sf_dir):
    return catalog.requirements(_registry(spark, sf_dir), ["torch", "numpy"])


@query(f"WITH {_REQUIRED} SELECT count(*) FILTER (required AND NOT installed) = 0 AS ok, count(*) FILTER (required AND NOT installed) AS missing FROM r")
def dependency_summary(spark, sf_dir):
    return catalog.dependency_summary(dependency_report(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'cuda' WHEN event_id % 5 = 0 THEN 'mps' ELSE 'cpu' END AS device FROM events")
def device_choice(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", encode.device(F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0).alias("device"))


@query("SELECT doc_id, greatest(16, least(512, n_chars)) AS width, CASE WHEN length(source) > 0 THEN '…' || right(source, 4) END AS masked, regexp_replace(source || '/' || doc_id || '_manifest.json', '_manifest[.]json$', '') AS stem FROM documents")
def clamps_masks_and_stems(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_manifest.json"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.clamp(F.col("n_chars"), 16, 512).alias("width"), T.masked(F.col("source")).alias("masked"), T.without_ending(name, "_manifest.json").alias("stem"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'running' WHEN user_id % 3 = 0 THEN 'done' WHEN isfinite(value) AND value > 10 AND event_id % 5 = 0 THEN 'ready' WHEN isfinite(value) AND value > 10 THEN 'scanned' ELSE 'idle' END AS state FROM events")
def run_states(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", jobs.run_state(F.col("event_id") % 2 == 0, F.when(F.col("user_id") % 3 == 0, 1).otherwise(0), F.when(F.col("value") > 10, F.col("value")), F.col("event_id") % 5 == 0).alias("state"))


@query("""
    WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'progress' WHEN 'signup' THEN 'cancel' WHEN 'error' THEN 'failed' ELSE 'completed' END AS kind FROM events),
         t AS (SELECT *, min(CASE WHEN kind IN ('failed', 'completed') THEN seq END) OVER (PARTITION BY job_id) AS ended, min(CASE WHEN kind = 'cancel' THEN seq END) OVER (PARTITION BY job_id) AS asked FROM e)
    SELECT job_id, CASE WHEN ended IS NOT NULL AND (asked IS NULL OR ended < asked) THEN max(CASE WHEN seq = ended THEN kind END) WHEN asked IS NOT NULL AND ended IS NOT NULL THEN 'cancelled' WHEN asked IS NOT NULL THEN 'cancelling' ELSE 'running' END AS status,
           count(*) FILTER (kind = 'progress' AND seq < coalesce(ended, 9223372036854775807)) AS done FROM t GROUP BY job_id, ended, asked""")
def job_log_states(spark, sf_dir):
    kind = F.col("event_type")
    log = _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(kind.isin("click", "view"), "progress").when(kind == "signup", "cancel").when(kind == "error", "failed").otherwise("completed").alias("kind"))
    return jobs.states(log)


@query("""
    SELECT event_id, 'failed' AS status, CASE event_id % 2 WHEN 0 THEN 'out_of_memory' END AS hint, CASE event_id % 2 WHEN 0 THEN 'CUDA out of memory' ELSE 'other' END AS error, event_type AS stage FROM events WHERE event_type = 'error'""")
def failure_rows(spark, sf_dir):
    failed = _read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 2 == 0, "CUDA out of memory").otherwise("other").alias("error"), F.col("event_type").alias("stage"))
    rows = jobs.failures(failed, "event_id", "error", "stage")
    return rows.select("event_id", "status", "hint", F.get_json_object("report", "$.error").alias("error"), F.get_json_object("report", "$.stage").alias("stage"))


@query(f"SELECT vec_id, vec_id AS count, CASE WHEN cluster > 1 THEN 'kmeans' END AS method, cluster > 2 AS applied, CASE WHEN cluster > 1 THEN 4 END AS k, CASE WHEN cluster = 2 THEN 'too few points' END AS warning FROM ({_POINTS})")
def projection_metadata(spark, sf_dir):
    """Metadata of projections without clusters, of those that couldn't be clustered and of clustered ones."""
    make = lambda **more: sinks.projection_metadata("openclip_vit_b_32", "img", F.col("vec_id"), **more)
    cluster_of = F.col("cluster")
    made = F.when(cluster_of == 1, make()).when(cluster_of == 2, make(method="kmeans", k=4, warning="too few points")).otherwise(make(method="kmeans", k=4, score=0.25))
    parsed = F.from_json("json", "count long, clustering struct<method: string, applied: boolean, k: int, warning: string>")
    rows = _points(spark, sf_dir).select("vec_id", made.alias("json")).select("vec_id", parsed.alias("d"))
    return rows.select("vec_id", "d.count", "d.clustering.method", "d.clustering.applied", "d.clustering.k", "d.clustering.warning")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 > 0")
def embedding_cache(spark, sf_dir):
    """What is still to be encoded beside a stored third of the vectors, kept by model."""
    rows = _vectors(spark, sf_dir).withColumn("model_key", F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")))
    path = f"{sinks.shared_folder(spark)}/vectors"
    sinks.write_embeddings(rows.filter("vec_id % 3 = 0").select("vec_id", "embedding", "model_key"), path)
    return sinks.missing(rows.select("vec_id", "label", "model_key"), spark.read.parquet(path), ["vec_id", "model_key"]).select("vec_id", "label")


@query("SELECT vec_id, 'a query' AS query, CASE WHEN label > 0 THEN label + 1 END AS rank, CASE WHEN label = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN label = 0 THEN 'no index \"' || vec_id || '\"' END AS error FROM embeddings")
def search_log(spark, sf_dir):
    failed = F.col("label") == 0
    error = F.when(failed, F.concat(F.lit('no index "'), F.col("vec_id").cast("string"), F.lit('"')))
    rows = _vectors(spark, sf_dir).select("vec_id", sinks.search_log("a query", F.lit("openclip_vit_b_32"), F.when(~failed, F.col("label") + 1), error).alias("json"))
    parsed = F.from_json("json", "query string, hits int, status string, error string")
    return rows.select("vec_id", parsed["query"].alias("query"), parsed["hits"].alias("rank"), parsed["status"].alias("status"), parsed["error"].alias("error"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'skipped' WHEN w = 0 THEN 'error' WHEN greatest(w, h) <= 800 AND after >= before THEN 'skipped' ELSE 'processed' END AS status,
           CASE p_partkey % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' END AS format
    FROM (SELECT p_partkey, p_partkey * 37 % 3000 AS w, p_partkey * 91 % 2000 AS h, p_size * 100 AS before, p_partkey % 5000 AS after FROM part)""")
def resize_outcomes(spark, sf_dir):
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, ".jpeg").when(k % 4 == 1, ".png").when(k % 4 == 2, ".webp").otherwise(".gif")
    outcome = images.resize_outcome(k * 37 % 3000, k * 91 % 2000, 800, k % 9 == 0, F.col("p_size") * 100, k % 5000)
    return _read(spark, sf_dir, "part").select("p_partkey", outcome.alias("status"), images.image_format(suffix).alias("format"))


@query("SELECT key, provider IN ('openclip', 'openclip_hf_hub', 'transformers_clip', 'transformers_image_features', 'transformers_metaclip2', 'transformers_vision_pool', 'nomic_transformers', 'imagebind', 'sentence_transformers') AS runnable FROM m".replace("SELECT", f"WITH {_REGISTRY} SELECT", 1))
def encoder_dispatch(spark, sf_dir):
    return _registry(spark, sf_dir).select("key", encode.runnable(F.col("provider")).alias("runnable"))


@query("SELECT vec_id, vec_id % 50 = 7 AS failed, CASE WHEN vec_id % 50 = 7 THEN 0 ELSE 64 END AS dim, CASE WHEN vec_id % 50 <> 7 THEN vec_id % 16 + 1 END AS place FROM embeddings")
def encode_with_retry(spark, sf_dir):
    """Encodes with a plug-in that refuses one value in fifty as out of memory: the rest of its batch is encoded, one by one.

    Its output is a mapping, an object with a place for each token, or one with layers, as real models give; a vector's four entries of 1/2 tell whether the right part was taken.
    """

    class Output:
        def __init__(self, **fields):
            self.__dict__.update(fields)

    class Fussy:
        dim = 64

        def encode(self, batch):
            if any(x % 50 == 7 for x in batch):
                raise RuntimeError("out of memory")
            right, wrong = ([[float(d % 16 == (x + shift) % 16) for d in range(64)] for x in batch] for shift in (0, 5))
            tokens = [[r, w] for r, w in zip(right, wrong)]
            forms = ({"image_embeds": None, "pooler_output": right, "logits": wrong}, Output(last_hidden_state=tokens, embeds=wrong), Output(hidden_states=(wrong, tokens)), right)
            return forms[int(batch.iloc[0]) % 4]

    rows = encode.encode_column(_vectors(spark, sf_dir).select("vec_id", F.col("vec_id").alias("value")), "vec_id", "value", Fussy)
    return rows.select("vec_id", F.col("error").isNotNull().alias("failed"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"), F.array_position("embedding", F.lit(0.5).cast("float")).alias("place"))


@query(
    f"WITH {_Z}, {', '.join(_lloyd_sql(k, 10, f'{k}_') for k in range(2, 9))}, s AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, {_silhouette_sql(f'a{k}_9')} AS score" for k in range(2, 9))
    + "), b AS (SELECT k::INTEGER AS k, score FROM s ORDER BY s.score DESC, k LIMIT 1) SELECT vec_id, (cluster + 1)::INTEGER AS cluster, k AS cluster_k, round(score, 6) AS cluster_score, 'kmeans' AS cluster_method FROM ("
    + " UNION ALL ".join(f"SELECT vec_id, cluster, {k} AS of FROM a{k}_9" for k in range(2, 9))
    + ") JOIN b ON of = k"
)
def best_effort_clusters(spark, sf_dir):
    points = _points(spark, sf_dir).select("vec_id", "x", "y")
    return cluster.best_effort(points.select("vec_id"), points, "vec_id", iterations=10)[0]


@query(
    f"WITH {_Z}, {', '.join(_lloyd_sql(k, 10, f'{k}_') for k in range(2, 9))}, s AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, {_silhouette_sql(f'a{k}_9')} AS score" for k in range(2, 9))
    + ") SELECT k::INTEGER AS k, true AS within FROM s ORDER BY s.score DESC, k LIMIT 1"
)
def kmeans_certified_k(spark, sf_dir):
    """The k of the best silhouette by certified bounds, and whether its exact score lies within them."""
    z = cluster.standardize(_points(spark, sf_dir).select("vec_id", "x", "y"))
    k, low, high, labelled = cluster.bounded_choice(z, "vec_id", list(range(2, 9)), 10)
    exact = cluster.silhouette(labelled, "vec_id")
    return exact.select(F.lit(k).alias("k"), F.col("score").between(low - 1e-9, high + 1e-9).alias("within"))


@query()
def kmeans_seeded(spark, sf_dir):
    """Six clusters from k-means|| starts, run until the centres stand."""
    return cluster.kmeans(cluster.standardize(_points(spark, sf_dir)), 6, "vec_id").select("vec_id", (F.col("cluster") + 1).alias("cluster"))


@query()
def knn_descent_15(spark, sf_dir):
    """The neighbour graph by descent; recall is measured in the tests."""
    return neighbours.descent_graph(_vectors(spark, sf_dir), 15).select("i", "j", "rank", F.round("score_raw", 6).alias("score"))
