"""Collections of files: scans, folders, histograms, fingerprints, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IMAGE_SUFFIXES, basename, components, suffix

# Suffixes of the images that are resized in place.
RESIZE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")
PROJECTION_SCHEMA = (
    "filename string, relative_path string, x double, y double, model_key string, model_family string, embedding_model string, model_id string, pretrained string, "
    "provider string, reducer string, row_index int, cluster int, cluster_k int, cluster_score double, cluster_method string"
)
MANIFEST_SCHEMA = "dataset_hash string, model_key string, model_family string, model_label string, model string, pretrained string, provider string, image_dir string, count int, embedding_path string, created_at double, _corrupt_record string"


def files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of every file below a folder that `glob` names; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory)
    return found.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def set_time(spark: SparkSession, path: str, mtime: int) -> None:
    """Set the time of a file, in seconds."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(file, mtime * 1000, -1)


def newest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("mtime"), "path")


def images(paths: DataFrame, path: str = "path", suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Rows whose suffix is one of an image, ordered by path components."""
    return paths.filter(suffix(F.col(path)).isin(*suffixes)).orderBy(components(F.col(path)))


def decoded(spark: SparkSession, directory: str) -> DataFrame:
    """(path, width, height, channels, pixels, error): images below a folder; one that can't be decoded has its path and an error."""
    image = F.col("image")
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(directory)
    fine = image["height"] > 0
    one = lambda name: F.when(fine, image[name])
    return rows.select(image["origin"].alias("path"), one("width").alias("width"), one("height").alias("height"), one("nChannels").alias("channels"), one("data").alias("pixels"), F.when(~fine, "cannot be decoded").alias("error"))


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder) of every folder on the way to a file, '.' first; those that begin with a full stop are left out."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.filter(F.size(parts) > 1).select(F.explode(above).alias("folder")).filter(~F.col("folder").startswith(".")).distinct()
    root = paths.sparkSession.range(1).select(F.lit(".").alias("folder"))
    return root.unionByName(found).orderBy(F.col("folder") != ".", components(F.col("folder")))


def suffix_histogram(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.groupBy(suffix(F.col(path)).alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")


def file_digests(rows: DataFrame, model: Column, path: str, size: str, mtime: str) -> DataFrame:
    return rows.select(path, F.sha2(F.concat_ws("|", model, F.col(path), F.col(size).cast("string"), F.col(mtime).cast("string")), 256).alias("digest"))


def fingerprint(rows: DataFrame, group: str, model: Column, path: str, size: str, mtime: str) -> DataFrame:
    """(group, dataset_hash): 16 hex digits that change with the model or any file's path, size or time.

    Files are digested where they are, then the sorted digests of each of 4096 buckets of paths, then the buckets in order: two levels instead of one
    fold over all files in order, so that no task gathers a collection.
    """
    each = rows.select(group, F.substring(F.md5(F.col(path).cast("binary")), 1, 3).alias("bucket"), F.sha2(F.concat_ws("|", model, F.col(path), F.col(size).cast("string"), F.col(mtime).cast("string")), 256).alias("digest"))
    part = each.groupBy(group, "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("digest"))
    whole = part.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "").alias("all"))
    return whole.select(group, F.substring(F.sha2("all", 256), 1, 16).alias("dataset_hash"))


def projection_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored projection; the cluster columns are null where a file has none."""
    header = spark.read.option("sep", "\t").option("header", "true").csv(path).columns
    text = spark.read.option("sep", "\t").option("header", "true").option("escape", '"').schema(", ".join(f"`{h}` string" for h in header)).csv(path)
    wanted = [x.strip().split() for x in PROJECTION_SCHEMA.split(",")]
    cast = {"int": lambda c: c.try_cast("double").try_cast("int"), "double": lambda c: c.try_cast("double"), "string": lambda c: c}
    return text.select(*((cast[t](F.col(n)) if n in header else F.lit(None).cast(t)).alias(n) for n, t in wanted))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Readable manifests, newest first."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("mtime", F.col("_metadata.file_modification_time"))
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record").orderBy(F.desc("mtime"))


def listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """(filename, relative_path, total) of each path, total being the number of all."""
    total = paths.agg(F.count("*").alias("total"))  # one row
    return paths.select(basename(F.col(path)).alias("filename"), F.col(path).alias("relative_path")).join(F.broadcast(total))


def within(root: str, path: str) -> str:
    """`path` if it stays below `root`, else an error."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != root.rstrip("/") and not whole.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} leaves {root}")
    return whole
