"""Snapshots of a collection as trees of digests: two are compared from the root down, and only parts that differ are read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node, and files of a leaf, about.
FAN_OUT, LEAF_FILES = 16, 256


def _limbs(digest: Column) -> list[Column]:
    """A SHA-256 (hex) as five whole numbers of 52 bits, the last of 48."""
    return [F.conv(F.substring(digest, 13 * i + 1, 13), 16, 10).cast("decimal(20,0)") for i in range(5)]


def depth_for(n: int) -> int:
    """Levels below the root so that a leaf has some `LEAF_FILES` of n files."""
    return max(1, math.ceil(math.log(max(n, 1) / LEAF_FILES, FAN_OUT))) if n > LEAF_FILES else 1


def snapshot(rows: DataFrame, path: str, facts: list[str], levels: int) -> DataFrame:
    """(path, leaf, digest): the leaf of a file by the hash of its path, and a digest of the path and its facts; a null fact differs from an empty one."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in facts]
    return rows.select(F.col(path).alias("path"), F.substring(F.md5(F.col(path).cast("binary")), 1, levels).alias("leaf"), F.sha2(F.concat_ws("\x1f", F.col(path), *cells), 256).alias("digest"))


def tree(files: DataFrame, levels: int) -> DataFrame:
    """(level, node, n, s0..s4): for each node the number of files below it and the sums of their digests' parts.

    A sum doesn't depend on the order of files and that of a node is the sum of its children's, so tasks combine sums and no node gathers a list,
    however many files share a path. Level 0 is the root, with the empty name.
    """
    sums = [F.sum(limb).cast("decimal(38,0)").alias(f"s{i}") for i, limb in enumerate(_limbs(F.col("digest")))]
    leaves = files.groupBy("leaf").agg(F.count("*").alias("n"), *sums)
    above = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "*").withColumn("node", F.substring("leaf", F.lit(1), F.col("level")))
    return above.groupBy("level", "node").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(5)))


def root(nodes: DataFrame) -> DataFrame:
    """(files, dataset_hash): 16 hex digits that change with any file's path or facts."""
    return nodes.filter("level = 0").select(F.col("n").alias("files"), F.substring(F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(5))), 256), 1, 16).alias("dataset_hash"))


def differing_leaves(before: DataFrame, after: DataFrame, levels: int) -> DataFrame:
    """(leaf): the leaves in which two trees of the same depth differ; a level's nodes are compared only below nodes that differ."""
    open_nodes = None
    for level in range(levels + 1):
        a, b = (t.filter(F.col("level") == level).select("node", F.concat_ws("|", "n", *(f"s{i}" for i in range(5))).alias(name)) for t, name in ((before, "a"), (after, "b")))
        if open_nodes is not None:
            above = open_nodes.withColumnRenamed("node", "above")
            a, b = (t.join(above, F.substring("node", 1, level - 1) == F.col("above"), "left_semi") for t in (a, b))
        open_nodes = a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return open_nodes.withColumnRenamed("node", "leaf")


def changes(before: DataFrame, after: DataFrame, levels: int) -> DataFrame:
    """(path, change) between two snapshots: added, removed or changed. Of several files with one path, the path counts once, as changed if their digests differ."""
    leaves = differing_leaves(tree(before, levels), tree(after, levels), levels)
    one = lambda files, name: files.join(leaves, "leaf", "left_semi").groupBy("path").agg(*(F.sum(x).alias(f"{name}{i}") for i, x in enumerate(_limbs(F.col("digest")))), F.count("*").alias(f"{name}n"))
    a, b = one(before, "a"), one(after, "b")
    same = (F.col("an") == F.col("bn")) & (F.array(*(f"a{i}" for i in range(5))) == F.array(*(f"b{i}" for i in range(5))))
    kind = F.when(F.col("an").isNull(), "added").when(F.col("bn").isNull(), "removed").when(~same, "changed")
    return a.join(b, "path", "full").select("path", kind.alias("change")).filter("change IS NOT NULL")
