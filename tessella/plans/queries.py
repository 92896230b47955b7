"""Every query of the engine over the driver's tables, with its SQL where SQL can express it.

The tables stand for the engine's entities: `embeddings` for vectors (two of their entries for coordinates, their labels for
clusters), `labels` for stored metadata, `documents` for files, `pages` for paths, `events` for job events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, dot, norm, normalize
from ..operators import blocks, catalog, cluster, encode, explore, images, jobs, reduce, search
from ..sources import collection, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VIEW = explore.Viewport(zoom=1.5, pan_x=20.0, pan_y=-10.0)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings")


def _query_vector(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("vec_id = 0").select(F.col("embedding").alias("q"))


def _points(spark, sf_dir):
    """(vec_id, x, y, cluster, cluster_score): coordinates and clusters to explore."""
    return _vectors(spark, sf_dir).select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("label") + 1).alias("cluster"), F.lit(0.25).alias("cluster_score"))


_SCORES = """
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
         s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q)
                      / (greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS score_raw
               FROM embeddings, q)"""
_POINTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label + 1 AS cluster FROM embeddings"


@query(
    _SCORES
    + """
    SELECT row_number() OVER (ORDER BY score_raw DESC, vec_id) AS rank, vec_id, round(score_raw, 6) AS score, quality, toxic
    FROM (SELECT * FROM s WHERE score_raw >= 0.2 ORDER BY score_raw DESC, vec_id LIMIT 30) LEFT JOIN labels ON vec_id = doc_id"""
)
def cosine_topk_join(spark, sf_dir):
    hits = search.search_with_metadata(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), _read(spark, sf_dir, "labels"), "vec_id", "doc_id", 30, 0.2)
    return hits.select("rank", "vec_id", "score", "quality", "toxic")


@query(_SCORES + " SELECT vec_id, round(score_raw, 6) AS score FROM s")
def cosine_scores(spark, sf_dir):
    return search.score(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("vec_id", F.round("score_raw", 6).alias("score"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) AS d FROM embeddings, q)
    SELECT row_number() OVER (ORDER BY d DESC, vec_id) AS rank, vec_id, round(d, 6) AS score FROM (SELECT * FROM s ORDER BY d DESC, vec_id LIMIT 20)""")
def dot_topk_raw(spark, sf_dir):
    hits = search.top_k(search.score(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), normalized=False), 20, "vec_id")
    return search.ranked(hits, "vec_id").select("rank", "vec_id", "score")


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
         s AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], q) / (greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)
                      * greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS d FROM embeddings, q),
         r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rank, vec_id, round(d, 6) AS score FROM s)
    SELECT * FROM r WHERE rank <= 10""")
def search_batch_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return search.batch_top_k(vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "vec_id", "query_id", 10)


@query(
    _SCORES
    + """
    SELECT row_number() OVER (ORDER BY score_raw DESC, vec_id) AS rank, 'v' || vec_id || '.jpg' AS filename, 'img/v' || vec_id || '.jpg' AS relative_path, round(score_raw, 6) AS score,
           'a query' AS query, 'openclip_vit_b_32' AS model_key, 'e1' AS embedding_id, quality::DOUBLE AS x, toxic::DOUBLE AS y, label + 1 AS cluster
    FROM (SELECT * FROM s ORDER BY score_raw DESC, vec_id LIMIT 25) LEFT JOIN labels ON vec_id = doc_id"""
)
def search_export_rows(spark, sf_dir):
    hits = search.search_with_metadata(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), _read(spark, sf_dir, "labels"), "vec_id", "doc_id", 25, None)
    name = F.concat(F.lit("v"), F.col("vec_id"), F.lit(".jpg"))
    rows = hits.select("rank", name.alias("filename"), F.concat(F.lit("img/"), name).alias("relative_path"), "score", F.col("quality").cast("double").alias("x"), F.col("toxic").cast("double").alias("y"), (F.col("label") + 1).alias("cluster"))
    return search.export_rows(rows, "a query", "openclip_vit_b_32", "e1")


@query("SELECT vec_id, round(embedding[1] / greatest(n, 1e-12), 6) AS first, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: (v / greatest(n, 1e-12)) ** 2))), 6) AS length FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    unit = _vectors(spark, sf_dir).select("vec_id", normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(norm(F.col("u")), 6).alias("length"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


_KNN = """
    WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings),
         p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS d FROM u a, u b WHERE a.vec_id <> b.vec_id),
         k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d DESC, j) AS rank, d FROM p QUALIFY rank <= 15)"""


@query(_KNN + " SELECT i, j, rank, round(d, 6) AS score FROM k")
def knn_graph_15(spark, sf_dir):
    return reduce.knn_graph(_vectors(spark, sf_dir), 15).select("i", "j", "rank", F.round("score_raw", 6).alias("score"))


@query(
    _KNN
    + """, w AS (SELECT i, j, exp(-(1 - d)) AS w FROM k)
    SELECT i, j, round(coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0), 6) AS w
    FROM w a FULL JOIN (SELECT j AS i, i AS j, w FROM w) b USING (i, j)"""
)
def fuzzy_union(spark, sf_dir):
    graph = reduce.knn_graph(_vectors(spark, sf_dir), 15).select("i", "j", F.exp(-(1 - F.col("score_raw"))).alias("w"))
    return reduce.fuzzy_union(graph).select("i", "j", F.round("w", 6).alias("w"))


@query("SELECT label, (u.d - 1)::INTEGER AS d, round(avg(embedding[u.d]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS d) u GROUP BY 1, 2")
def label_centroids(spark, sf_dir):
    return _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


_Z = f"""
    p AS ({_POINTS}), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p),
    z AS (SELECT vec_id, (x - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END AS x, (y - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END AS y FROM p, m)"""


@query(f"WITH {_Z} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM z")
def standardize_xy(spark, sf_dir):
    return cluster.standardize(_points(spark, sf_dir)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _lloyd_sql(k: int, turns: int, tag: str = "") -> str:
    out = [f"c{tag}0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS k, x, y FROM z ORDER BY vec_id LIMIT {k})"]
    for t in range(turns):
        out.append(f"a{tag}{t} AS MATERIALIZED (SELECT vec_id, z.x, z.y, k AS cluster FROM z, c{tag}{t} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (z.x - c.x) * (z.x - c.x) + (z.y - c.y) * (z.y - c.y), k) = 1)")
        out.append(f"c{tag}{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{tag}{t} c LEFT JOIN (SELECT cluster, avg(x) AS x, avg(y) AS y FROM a{tag}{t} GROUP BY cluster) m ON m.cluster = c.k)")
    return ", ".join(out)


@query(f"WITH {_Z}, {_lloyd_sql(4, 8)} SELECT vec_id, cluster + 1 AS cluster FROM a7")
def kmeans_lloyd(spark, sf_dir):
    return cluster.lloyd(cluster.standardize(_points(spark, sf_dir)), 4, "vec_id", 8).select("vec_id", (F.col("cluster") + 1).alias("cluster"))


def _silhouette_sql(source: str) -> str:
    return f"""(
    WITH g AS (SELECT a.vec_id, a.cluster AS c, b.cluster AS c2, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS sd, count(*) AS n FROM {source} a, {source} b GROUP BY 1, 2, 3),
         h AS (SELECT vec_id, max(CASE WHEN c = c2 THEN n END) AS own, max(CASE WHEN c = c2 AND n > 1 THEN sd / (n - 1) END) AS a, min(CASE WHEN c <> c2 THEN sd / n END) AS b FROM g GROUP BY vec_id, c)
    SELECT avg(CASE WHEN own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) FROM h)"""


@query(f"WITH p AS ({_POINTS}) SELECT round({_silhouette_sql('p')}, 6) AS score")
def silhouette_exact(spark, sf_dir):
    return cluster.silhouette(_points(spark, sf_dir), "vec_id").select(F.round("score", 6).alias("score"))


@query(
    f"WITH {_Z}, {', '.join(_lloyd_sql(k, 10, f'{k}_') for k in range(2, 9))}, s AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, {_silhouette_sql(f'a{k}_9')} AS score" for k in range(2, 9))
    + ") SELECT k::INTEGER AS k, round(score, 6) AS score FROM s ORDER BY s.score DESC, k LIMIT 1"
)
def kmeans_auto_k(spark, sf_dir):
    k, value, _ = cluster.auto_k(_points(spark, sf_dir), "vec_id", iterations=10)
    return spark.range(1).select(F.lit(k).alias("k"), F.round(F.lit(value), 6).alias("score"))


@query("SELECT vec_id, NULL::INTEGER AS cluster, NULL::INTEGER AS cluster_k, NULL::DOUBLE AS cluster_score, NULL::VARCHAR AS cluster_method FROM embeddings")
def cluster_rows_with_nulls(spark, sf_dir):
    points = _points(spark, sf_dir)
    rows, _ = cluster.best_effort(points.select("vec_id"), points.filter("vec_id < 2"), "vec_id")
    return rows


_HASHED = """
    w AS (SELECT {key} AS id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM {table}),
    c AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 64)::INTEGER AS d, count(*) AS c FROM w GROUP BY 1, 2),
    n AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS norm FROM c GROUP BY 1),
    h AS (SELECT id, d, c / norm AS w FROM c JOIN n USING (id))"""


@query("WITH " + _HASHED.format(key="doc_id", table="documents") + " SELECT id AS doc_id, d, round(w, 6) AS w FROM h")
def hashed_text_vectors(spark, sf_dir):
    return encode.hashed_text_entries(_read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "d", F.round("w", 6).alias("w"))


@query(
    "WITH "
    + _HASHED.format(key="doc_id", table="documents")
    + ", "
    + _HASHED.format(key="item_id", table="(SELECT * FROM benchmark WHERE item_id = 0)").replace("w AS (SELECT", "w2 AS (SELECT").replace("c AS (SELECT id, ((", "c2 AS (SELECT id, ((").replace("FROM w GROUP", "FROM w2 GROUP").replace("n AS (SELECT id, sqrt", "n2 AS (SELECT id, sqrt").replace("FROM c GROUP BY 1)", "FROM c2 GROUP BY 1)").replace("h AS (SELECT id, d", "h2 AS (SELECT id, d").replace("FROM c JOIN n USING", "FROM c2 JOIN n2 USING")
    + """, s AS (SELECT h.id AS doc_id, sum(h.w * h2.w) AS s FROM h JOIN h2 USING (d) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, round(s, 6) AS score FROM (SELECT * FROM s ORDER BY round(s, 9) DESC, doc_id LIMIT 20)"""
)
def text_search_documents(spark, sf_dir):
    wanted = encode.hashed_text_entries(_read(spark, sf_dir, "benchmark").filter("item_id = 0"), "item_id")
    scored = encode.hashed_text_score(encode.hashed_text_entries(_read(spark, sf_dir, "documents"), "doc_id"), wanted, "doc_id")
    return search.ranked(search.top_k(scored.withColumn("score_raw", F.round("score_raw", 9)), 20, "doc_id"), "doc_id").select("rank", "doc_id", "score")


_SUFFIX = r"lower(regexp_extract(url, '[^/.][^/]*?(\.[^./]+)$', 1))"


@query(f"SELECT {_SUFFIX} AS ext, count(*) AS n FROM pages GROUP BY 1")
def suffix_histogram(spark, sf_dir):
    return collection.suffix_histogram(_read(spark, sf_dir, "pages"), "url")


@query("""
    WITH f AS (SELECT url || (CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '' END) AS path FROM pages)
    SELECT path, row_number() OVER (ORDER BY string_split(path, '/'), path) AS row_index FROM f
    WHERE lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff')""")
def image_scan_filter(spark, sf_dir):
    ending = F.when(F.col("page_id") % 4 == 0, ".JPG").when(F.col("page_id") % 4 == 1, ".png").when(F.col("page_id") % 4 == 2, ".txt").otherwise("")
    paths = collection.images(_read(spark, sf_dir, "pages").select(F.concat("url", ending).alias("path")))
    return blocks.numbered(paths, T.components(F.col("path")), "path")


@query("""
    SELECT folder FROM (SELECT '.' AS folder UNION SELECT DISTINCT source FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents)""")
def folder_list(spark, sf_dir):
    return collection.folders(_read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path")))


@query("""
    WITH e AS (SELECT source, doc_id, sha256(concat_ws('|', 'openclip', source || '/' || doc_id, n_chars::VARCHAR, '0')) AS digest FROM documents)
    SELECT source || '/' || doc_id AS path, digest FROM e""")
def file_digests(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "n_chars", F.lit(0).alias("mtime"))
    return collection.file_digests(docs, F.lit("openclip"), "path", "n_chars", "mtime")


@query("""
    WITH e AS (SELECT source, source || '/' || doc_id AS path, n_chars FROM documents),
         d AS (SELECT source, substr(md5(path), 1, 3) AS bucket, sha256(concat_ws('|', 'openclip', path, n_chars::VARCHAR, '0')) AS digest FROM e),
         b AS (SELECT source, bucket, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM d GROUP BY 1, 2)
    SELECT source, substr(sha256(string_agg(digest, '' ORDER BY bucket)), 1, 16) AS dataset_hash FROM b GROUP BY 1""")
def dataset_fingerprint(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("source", F.concat_ws("/", "source", "doc_id").alias("path"), "n_chars", F.lit(0).alias("mtime"))
    return collection.fingerprint(docs, "source", F.lit("openclip"), "path", "n_chars", "mtime")


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_.-]', '-', 'g') AS safe, regexp_replace(url, '[^\p{L}\p{N}_-]', '-', 'g') AS search_safe FROM pages")
def safe_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.search_name(F.col("url")).alias("search_safe"))


@query(r"SELECT page_id, trim(replace('\' || url || '/', '\', '/'), '/') AS dir FROM pages")
def norm_dir(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.norm_dir(F.concat(F.lit("\\"), "url", F.lit("/"))).alias("dir"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '_' || substr(md5(user_id::VARCHAR), 1, 16) || '_openclip_umap_clusters-k' || (user_id % 7 + 2) || '_projection.tsv' AS name FROM events")
def artifact_names(spark, sf_dir):
    stamp = F.date_format("ts", "yyyyMMdd-HHmmss")
    tag = F.concat(F.lit("umap_clusters-k"), (F.col("user_id") % 7 + 2).cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", F.concat_ws("_", stamp, F.substring(F.md5(F.col("user_id").cast("string")), 1, 16), F.lit("openclip"), tag, F.lit("projection.tsv")).alias("name"))


@query("SELECT user_id, ts, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return jobs.latest(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status")), "user_id", "ts", "event_id")


def _values(columns: list[int]) -> str:
    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'"

    names = [x.strip().split()[0] for x in catalog.SCHEMA.split(",")]
    rows = ", ".join("(" + ", ".join(one(r[i]) for i in columns) + ")" for r in catalog.model_rows())
    return f"(VALUES {rows}) AS m({', '.join(names[i] for i in columns)})"


_MODELS = f"m AS (SELECT * FROM {_values(list(range(15)))})"

# A registry that grows: the built-in models and one of the users' own for each row of `part`, under the same columns.
_REGISTRY = f"""m AS (SELECT * FROM {_values(list(range(15)))} UNION ALL
    SELECT (100 + p_partkey)::INTEGER, 'own_' || p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE {list(catalog.REQUIRED_FAMILIES)!r}[p_partkey % 16 + 1] END,
           CASE p_size % 5 WHEN 0 THEN 'openclip' WHEN 1 THEN 'transformers_clip' WHEN 2 THEN 'planned' WHEN 3 THEN 'imagebind' ELSE 'of_my_own' END, p_name,
           list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'torch' END, CASE WHEN p_partkey % 3 = 0 THEN 'open_clip' END, CASE WHEN p_partkey % 5 = 0 THEN 'einops' END], lambda x: x IS NOT NULL),
           CASE p_type WHEN 'ECONOMY' THEN ['fast', 'art_collection'] WHEN 'SMALL' THEN ['multilingual'] ELSE []::VARCHAR[] END, p_size::INTEGER,
           CASE p_size % 4 WHEN 0 THEN 'cpu_ok' WHEN 1 THEN 'gpu_recommended' ELSE 'large_gpu' END, CASE p_partkey % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'experimental' WHEN 2 THEN 'planned' ELSE 'unavailable' END,
           p_partkey % 7 <> 0, p_partkey % 5 <> 4, p_partkey % 5 > 2, p_partkey % 9 <> 0, p_partkey % 11 = 0 FROM part)"""


def _registry(spark, sf_dir) -> DataFrame:
    """The built-in models and the users' own, one for each row of `part`."""
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in pairs)))
    own = _read(spark, sf_dir, "part").select(
        (k + 100).alias("ordinal"), F.concat(F.lit("own_"), k).alias("key"),
        F.when(size % 3 == 0, F.col("p_brand")).otherwise(F.element_at(F.array(*map(F.lit, catalog.REQUIRED_FAMILIES)), (k % 16 + 1).cast("int"))).alias("family"),
        F.when(size % 5 == 0, "openclip").when(size % 5 == 1, "transformers_clip").when(size % 5 == 2, "planned").when(size % 5 == 3, "imagebind").otherwise("of_my_own").alias("provider"),
        F.col("p_name").alias("model_id"), some((k % 2 == 0, "torch"), (k % 3 == 0, "open_clip"), (k % 5 == 0, "einops")).alias("requires"),
        F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("fast"), F.lit("art_collection"))).when(F.col("p_type") == "SMALL", F.array(F.lit("multilingual"))).otherwise(F.array().cast("array<string>")).alias("recommended_for"),
        size.alias("batch_size"), F.when(size % 4 == 0, "cpu_ok").when(size % 4 == 1, "gpu_recommended").otherwise("large_gpu").alias("hardware_tier"),
        F.when(k % 4 == 0, "stable").when(k % 4 == 1, "experimental").when(k % 4 == 2, "planned").otherwise("unavailable").alias("status"),
        (k % 7 != 0).alias("supports_image_embedding"), (k % 5 != 4).alias("supports_text_embedding"), (k % 5 > 2).alias("supports_text_search"), (k % 9 != 0).alias("supports_projection"), (k % 11 == 0).alias("trust_remote_code"),
    )
    return catalog.registry(spark, own)


_CHIPS = """list_distinct(list_filter(list_concat([CASE WHEN supports_projection THEN 'projection' END, CASE WHEN supports_text_search THEN 'semantic search' END,
    CASE WHEN supports_text_embedding THEN 'text embedding' END, CASE WHEN NOT supports_image_embedding THEN 'image only' END,
    CASE hardware_tier WHEN 'cpu_ok' THEN 'CPU-friendly' WHEN 'gpu_recommended' THEN 'GPU recommended' WHEN 'large_gpu' THEN 'Large GPU' END],
    list_transform(recommended_for, lambda t: replace(t, '_', ' ')), [CASE WHEN trust_remote_code THEN 'remote code' END]), lambda c: c IS NOT NULL))"""
_INSTALLED = ["torch", "transformers", "open_clip"]


@query(f"""
    WITH {_MODELS}, e AS (SELECT event_id, ts, user_id, (SELECT list(key ORDER BY ordinal) FROM m)[user_id % 30 + 1] AS model_key FROM events),
         j AS (SELECT e.*, coalesce(m.status, 'unknown') AS status, coalesce(m.supports_text_search, false) AS text_search FROM e LEFT JOIN m ON m.key = e.model_key)
    SELECT model_key, event_id, ts, status, text_search FROM j WHERE text_search QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY ts DESC, event_id DESC) = 1""")
def index_match(spark, sf_dir):
    keys = F.array(*(F.lit(r[1]) for r in catalog.model_rows()))
    events = _read(spark, sf_dir, "events").select("event_id", "ts", F.get(keys, (F.col("user_id") % 30).cast("int")).alias("model_key"))
    known = catalog.models(spark).select("key", "status", "supports_text_search")
    joined = events.join(F.broadcast(known), events["model_key"] == known["key"], "left")
    rows = joined.select("model_key", "event_id", "ts", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("supports_text_search", F.lit(False)).alias("text_search"))
    return jobs.latest(rows.filter("text_search"), "model_key", "ts", "event_id")


@query(f"WITH p AS ({_POINTS}) SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p")
def bounds(spark, sf_dir):
    return explore.bounds(_points(spark, sf_dir))


_PROJECTED = f"""
    WITH p AS ({_POINTS}), b AS (SELECT min(x) AS x0, max(x) - min(x) AS rx, min(y) AS y0, max(y) - min(y) AS ry FROM p),
         f AS (SELECT vec_id, cluster, 72 + (x - x0 + rx * 0.08) / (rx * 1.16) * (800 - 144) AS bx, 600 - 62 - (y - y0 + ry * 0.08) / (ry * 1.16) * (600 - 122) AS sy FROM p, b),
         s AS (SELECT vec_id, cluster, 400 + (bx - 400) * 1.5 + 20 AS px, 300 + (sy - 300) * 1.5 - 10 AS py FROM f)"""


@query(_PROJECTED + " SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py FROM s WHERE px BETWEEN -36 AND 836 AND py BETWEEN -36 AND 636")
def project_cull(spark, sf_dir):
    seen = explore.cull(explore.project(_points(spark, sf_dir), VIEW), VIEW, thumbnails=False)
    return seen.select("vec_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(_PROJECTED + " SELECT vec_id, round(sqrt((px - 420) ** 2 + (py - 290) ** 2), 6) AS distance FROM s WHERE sqrt((px - 420) ** 2 + (py - 290) ** 2) < 44 ORDER BY distance, vec_id LIMIT 1")
def hover_nearest(spark, sf_dir):
    return explore.hover(explore.project(_points(spark, sf_dir), VIEW), 420, 290, VIEW, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT cluster, count(*) AS n FROM ({_POINTS}) GROUP BY 1")
def cluster_histogram(spark, sf_dir):
    return explore.cluster_histogram(_points(spark, sf_dir))


@query(f"SELECT cluster, count(*) AS n FROM ({_POINTS}) GROUP BY 1 ORDER BY 1 LIMIT 8")
def legend_top8(spark, sf_dir):
    return explore.cluster_histogram(_points(spark, sf_dir), 8)


@query(f"SELECT vec_id, x, y, cluster, 0.25::DOUBLE AS cluster_score FROM ({_POINTS}) WHERE cluster = 3")
def cluster_gallery(spark, sf_dir):
    return explore.gallery(_points(spark, sf_dir), 3, "vec_id")


@query(f"SELECT vec_id, ['#4C78A8', '#F58518', '#54A24B', '#E45756', '#B279A2', '#72B7B2'][greatest(0, cluster - 1) % 6 + 1] AS color FROM ({_POINTS})")
def palette_colors(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", explore.color(F.col("cluster")).alias("color"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def search_semi_join(spark, sf_dir):
    hits = _read(spark, sf_dir, "labels").filter("toxic = 1")
    vectors = _vectors(spark, sf_dir).select("vec_id", "label")
    return vectors.join(hits, vectors["vec_id"] == hits["doc_id"], "left_semi")


@query("SELECT vec_id AS id FROM embeddings INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def search_intersect(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("id")).intersect(_read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")))


@query("""
    SELECT vec_id, CASE WHEN label + 1 <> 3 THEN least(CASE WHEN t.doc_id IS NULL THEN 0.22 ELSE 1.0 END, 0.3) ELSE CASE WHEN t.doc_id IS NULL THEN 0.22 ELSE 1.0 END END::DOUBLE AS alpha
    FROM embeddings LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = vec_id""")
def emphasis_alpha(spark, sf_dir):
    hits = _read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    rows = _points(spark, sf_dir).join(hits, F.col("vec_id") == F.col("doc_id"), "left")
    return rows.select("vec_id", explore.alpha(F.col("doc_id").isNotNull(), F.col("cluster") == 3, only_cluster=False).alias("alpha"))


@query("SELECT count(*) AS rows, count(*) <= 500 AS thumbs_far, true AS thumbs_near FROM embeddings")
def lod_mode(spark, sf_dir):
    n = _vectors(spark, sf_dir).agg(F.count("*").alias("rows"))
    return n.select("rows", explore.shows_thumbnails(F.col("rows"), 1.0).alias("thumbs_far"), explore.shows_thumbnails(F.col("rows"), 2.0).alias("thumbs_near"))


_NUMBERS = "CASE event_id % 6 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN '3.9' WHEN 4 THEN 'abc' ELSE 'Infinity' END"


@query(f"""
    SELECT event_id, try_cast(t AS DOUBLE) AS as_float, CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(trunc(try_cast(t AS DOUBLE)) AS INTEGER) END AS as_int,
           CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(t AS DOUBLE) END AS optional
    FROM (SELECT event_id, {_NUMBERS} AS t FROM events)""")
def parse_numbers(spark, sf_dir):
    k = F.col("event_id") % 6
    t = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "null").when(k == 2, "").when(k == 3, "3.9").when(k == 4, "abc").otherwise("Infinity")
    return _read(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", T.float_or_null(F.col("t")).alias("as_float"), T.int_or_null(F.col("t")).alias("as_int"), T.optional_number(F.col("t")).alias("optional"))


@query("SELECT vec_id, x FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN vec_id % 5 = 1 THEN NULL WHEN vec_id % 5 = 2 THEN 'Infinity'::DOUBLE ELSE embedding[1]::DOUBLE END AS x FROM embeddings) WHERE isfinite(x)")
def finite_filter(spark, sf_dir):
    k = F.col("vec_id") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, None).when(k == 2, F.lit(float("inf"))).otherwise(F.col("x"))
    return explore.finite_points(_points(spark, sf_dir).select("vec_id", x.alias("x"), "y")).select("vec_id", "x")


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def props_json_sum(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(f"""
    WITH {_REGISTRY}, a AS (SELECT key, status, list_filter(requires, lambda r: NOT list_contains({_INSTALLED!r}, r)) AS missing FROM m)
    SELECT key, array_to_string(missing, ',') AS missing_requirements, len(missing) = 0 AND status NOT IN ('planned', 'unavailable') AS available FROM a""")
def model_availability(spark, sf_dir):
    return catalog.availability(_registry(spark, sf_dir), _INSTALLED).select("key", F.array_join("missing_requirements", ",").alias("missing_requirements"), "available")


@query(f"WITH {_REGISTRY} SELECT key, array_to_string(list_sort({_CHIPS}), '|') AS chips FROM m")
def model_chips(spark, sf_dir):
    return _registry(spark, sf_dir).select("key", F.array_join(F.array_sort(catalog.chips()), "|").alias("chips"))


@query(f"WITH {_REGISTRY} SELECT DISTINCT unnest({_CHIPS}) AS chip FROM m")
def chip_facets(spark, sf_dir):
    return _registry(spark, sf_dir).select(F.explode(catalog.chips()).alias("chip")).distinct().orderBy("chip")


@query(f"""
    WITH {_REGISTRY}, c AS (SELECT *, {_CHIPS} AS chips FROM m)
    SELECT key, status FROM c WHERE status = 'experimental' AND list_contains(list_transform(chips, lambda x: lower(x)), 'multilingual')
      AND contains(lower(concat_ws(' ', family, key, model_id, provider, status, array_to_string(chips, ' '))), 'clip')""")
def model_filter(spark, sf_dir):
    return catalog.filter_models(_registry(spark, sf_dir), "experimental", "Multilingual", "CLIP").select("key", "status")


@query(f"WITH {_REGISTRY} SELECT status, count(*) AS n FROM m GROUP BY 1")
def model_status_counts(spark, sf_dir):
    return _registry(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_REGISTRY} SELECT count(*) FILTER (supports_projection AND NOT supports_image_embedding) AS projection_without_image,
      count(*) FILTER (supports_text_search AND NOT supports_text_embedding) AS search_without_text, count(*) FILTER (status = 'planned' AND len(requires) > 0) AS planned_with_requirements, count(DISTINCT family) AS families FROM m""")
def registry_constraints(spark, sf_dir):
    return _registry(spark, sf_dir).agg(
        F.count_if(F.col("supports_projection") & ~F.col("supports_image_embedding")).alias("projection_without_image"),
        F.count_if(F.col("supports_text_search") & ~F.col("supports_text_embedding")).alias("search_without_text"),
        F.count_if((F.col("status") == "planned") & (F.size("requires") > 0)).alias("planned_with_requirements"),
        F.countDistinct("family").alias("families"),
    )


@query(f"""
    WITH {_REGISTRY}, a AS (SELECT *, len(list_filter(requires, lambda r: NOT list_contains({_INSTALLED!r}, r))) = 0 AND status NOT IN ('planned', 'unavailable') AS available FROM m)
    SELECT ordinal, key, status = 'unavailable' OR status <> 'planned' AND NOT (available AND supports_image_embedding AND supports_projection) AS disabled FROM a
    WHERE (supports_image_embedding AND supports_projection AND status <> 'planned') OR status = 'planned'""")
def selectable_models(spark, sf_dir):
    rows = catalog.availability(_registry(spark, sf_dir), _INSTALLED).filter(catalog.selectable(include_planned=True))
    return rows.select("ordinal", "key", catalog.option_disabled().alias("disabled")).orderBy("ordinal")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total, round(count(*) FILTER (event_type = 'purchase') / count(*) * 100) AS percent FROM events GROUP BY 1")
def job_progress(spark, sf_dir):
    counts = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count("*").alias("total"))
    return counts.withColumn("percent", jobs.percent(F.col("done"), F.col("total")))


@query("SELECT user_id, max(ts) AS updated_at, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def jobs_newest_first(spark, sf_dir):
    newest = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "user_id").limit(50)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "user_id")).cast("bigint"))


@query("""
    WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CUDA error: memory exhausted' WHEN 1 THEN 'No images found in img' WHEN 2 THEN 'set trust_remote_code=True' WHEN 3 THEN 'BaseModelOutputWithPooling has no norm' ELSE event_type END AS m FROM events)
    SELECT event_id, CASE WHEN contains(lower(m), 'basemodeloutputwithpooling') AND contains(lower(m), 'norm') THEN 'structured_output' WHEN contains(lower(m), 'out of memory') OR (contains(lower(m), 'cuda') AND contains(lower(m), 'memory')) THEN 'out_of_memory'
      WHEN contains(lower(m), 'no images found') THEN 'no_images' WHEN contains(lower(m), 'trust_remote_code') THEN 'remote_code' END AS class FROM e""")
def error_classification(spark, sf_dir):
    k = F.col("event_id") % 5
    m = F.when(k == 0, "CUDA error: memory exhausted").when(k == 1, "No images found in img").when(k == 2, "set trust_remote_code=True").when(k == 3, "BaseModelOutputWithPooling has no norm").otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", jobs.friendly_error(m).alias("class"))


@query("""
    WITH d AS (SELECT p_partkey, (p_partkey * 37 % 3000 + 1)::INTEGER AS w, (p_partkey * 91 % 2000 + 1)::INTEGER AS h FROM part), s AS (SELECT *, 800.0::DOUBLE / greatest(w, h) AS f FROM d)
    SELECT p_partkey, CASE WHEN greatest(w, h) <= 800 THEN w ELSE greatest(1, round_even(w * f, 0)::INTEGER) END AS new_width, CASE WHEN greatest(w, h) <= 800 THEN h ELSE greatest(1, round_even(h * f, 0)::INTEGER) END AS new_height FROM s""")
def resize_plan(spark, sf_dir):
    side = lambda m, n: (F.col("p_partkey") * m % n + 1).cast("int")
    size = images.new_size(side(37, 3000), side(91, 2000), 800)
    return _read(spark, sf_dir, "part").select("p_partkey", size["width"].alias("new_width"), size["height"].alias("new_height"))


@query("SELECT CASE WHEN n_chars > 2000 THEN 'processed' WHEN n_chars > 100 THEN 'skipped' ELSE 'error' END AS status, count(*) AS n, sum(n_chars)::BIGINT AS before, sum(n_chars // 2)::BIGINT AS after, round((sum(n_chars) - sum(n_chars // 2)) / 1048576.0, 6)::DOUBLE AS saved_mb FROM documents GROUP BY 1")
def resize_totals(spark, sf_dir):
    status = F.when(F.col("n_chars") > 2000, "processed").when(F.col("n_chars") > 100, "skipped").otherwise("error")
    return images.resize_totals(_read(spark, sf_dir, "documents").select(status.alias("status"), F.col("n_chars").alias("before"), F.floor(F.col("n_chars") / 2).alias("after")))


@query("SELECT doc_id, sha1(concat_ws('|', source || '/' || doc_id, '160', '1700000000', n_chars::VARCHAR)) AS thumb_key FROM documents")
def thumb_keys(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", images.thumb_key(F.concat_ws("/", "source", "doc_id"), 160, F.lit(1700000000), F.col("n_chars")).alias("thumb_key"))


@query("SELECT doc_id, source FROM documents WHERE starts_with(source || '/' || doc_id, 'src1/')")
def dir_scope_filter(spark, sf_dir):
    return _read(spark, sf_dir, "documents").filter(T.in_scope(F.concat_ws("/", "source", "doc_id"), F.lit("src1"))).select("doc_id", "source")


@query("SELECT conv_id, turn, regexp_replace(text, '\\t|\\r?\\n', ' ', 'g') AS cell FROM conversations")
def clean_cells(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_cell(F.col("text")).alias("cell"))


@query("SELECT p_partkey || chr(9) || p_name || chr(9) || p_size AS line FROM part")
def tsv_lines(spark, sf_dir):
    return sinks.tsv_lines(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_embeddings(spark, sf_dir):
    return sinks.missing(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), ["doc_id"])


@query(f"""
    SELECT 'v' || vec_id || '.jpg' AS filename, 'img/v' || vec_id || '.jpg' AS relative_path, round(x, 6) AS x, round(y, 6) AS y, 'openclip_vit_b_32' AS model_key, 'umap' AS reducer,
           row_number() OVER (ORDER BY vec_id) AS row_index, cluster FROM ({_POINTS})""")
def projection_table(spark, sf_dir):
    name = F.concat(F.lit("v"), F.col("vec_id"), F.lit(".jpg"))
    return blocks.numbered(_points(spark, sf_dir), "vec_id").select(
        name.alias("filename"), F.concat(F.lit("img/"), name).alias("relative_path"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
        F.lit("openclip_vit_b_32").alias("model_key"), F.lit("umap").alias("reducer"), "row_index", "cluster",
    )


@query()
def umap_2d(spark, sf_dir):
    return reduce.neighbour_layout(_vectors(spark, sf_dir))


@query()
def tsne_2d(spark, sf_dir):
    return reduce.tsne_layout(_vectors(spark, sf_dir))
