"""Exploring a stored projection: bounds, screen positions, culling, hover, clusters, galleries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite

# Colours of clusters, and the margins of the plot.
PALETTE = ("#4C78A8", "#F58518", "#54A24B", "#E45756", "#B279A2", "#72B7B2")
LEFT, BOTTOM, PAD = 72.0, 62.0, 0.08


@dataclass(frozen=True)
class Viewport:
    width: float = 800.0
    height: float = 600.0
    zoom: float = 1.0
    pan_x: float = 0.0
    pan_y: float = 0.0
    thumb_size: float = 80.0
    point_size: float = 6.0


def finite_points(rows: DataFrame) -> DataFrame:
    return rows.filter(finite(F.col("x")) & finite(F.col("y")))


def bounds(rows: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y of the finite coordinates; -1 and 1 where there are none."""
    x, y = (F.when(finite(F.col(c)), F.col(c)) for c in "xy")
    pick = lambda f, c, d: F.coalesce(f(c), F.lit(d))
    return rows.agg(pick(F.min, x, -1.0).alias("min_x"), pick(F.max, x, 1.0).alias("max_x"), pick(F.min, y, -1.0).alias("min_y"), pick(F.max, y, 1.0).alias("max_y"))


def _screen(out: DataFrame, view: Viewport, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    span = lambda c: F.when(high[c] == low[c], 1.0).otherwise(high[c] - low[c])
    share = lambda c: (F.col(c) - low[c] + span(c) * PAD) / (span(c) * (1 + 2 * PAD))
    x = LEFT + share("x") * (view.width - 2 * LEFT)
    y = view.height - BOTTOM - share("y") * (view.height - 2 * BOTTOM + 2)
    cx, cy = view.width / 2, view.height / 2
    return out.withColumn("px", cx + (x - cx) * view.zoom + view.pan_x).withColumn("py", cy + (y - cy) * view.zoom + view.pan_y)


def project(rows: DataFrame, view: Viewport) -> DataFrame:
    """`rows` with screen positions px, py: padded bounds fitted to the plot, then zoomed about its centre and moved."""
    out = rows.join(F.broadcast(bounds(rows)))
    out = _screen(out, view, {c: F.col(f"min_{c}") for c in "xy"}, {c: F.col(f"max_{c}") for c in "xy"})
    return out.drop("min_x", "max_x", "min_y", "max_y")


def project_within(rows: DataFrame, view: Viewport, min_x: float, max_x: float, min_y: float, max_y: float) -> DataFrame:
    """`project` of some rows of a layout whose bounds are known."""
    return _screen(rows, view, {"x": F.lit(min_x), "y": F.lit(min_y)}, {"x": F.lit(max_x), "y": F.lit(max_y)})


def shows_thumbnails(rows: int | Column, zoom: float, images: bool = True):
    """Whether thumbnails are drawn: always for up to 500 rows, beyond it only from zoom 2 on."""
    return images and (rows <= 500 or zoom >= 2.0) if isinstance(rows, int) else F.lit(images) & ((rows <= 500) | F.lit(zoom >= 2.0))


def cull(projected: DataFrame, view: Viewport, thumbnails: bool) -> DataFrame:
    m = (view.thumb_size if thumbnails else 2 * view.point_size) + 24
    return projected.filter(F.col("px").between(-m, view.width + m) & F.col("py").between(-m, view.height + m))


def hover(projected: DataFrame, x: float, y: float, view: Viewport, key: str) -> DataFrame:
    """The nearest point strictly within the radius, ties by key; no row if there is none."""
    d = F.sqrt((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y))
    return projected.withColumn("distance", d).filter(F.col("distance") < max(22.0, 0.55 * view.thumb_size)).orderBy("distance", key).limit(1)


def cluster_histogram(rows: DataFrame, first: int | None = None) -> DataFrame:
    """(cluster, n) in order of cluster; rows without one are left out."""
    out = rows.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster")
    return out if first is None else out.limit(first)


def gallery(rows: DataFrame, cluster: int, key: str) -> DataFrame:
    """The rows of one cluster, highest cluster_score first (null counts 0), then by name."""
    return rows.filter(F.col("cluster") == cluster).orderBy(F.desc(F.coalesce("cluster_score", F.lit(0.0))), key)


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def view(rows: DataFrame, key: str, hits: DataFrame | None = None, cluster: str | None = None) -> DataFrame:
    """The rows that are shown: those of a search, if one is given, and of them those of a cluster, compared as text."""
    out = rows if hits is None else rows.join(hits.select(key), key, "left_semi")
    return out if cluster is None else out.filter(F.col("cluster").cast("string") == cluster)


def labelled_counts(rows: DataFrame) -> DataFrame:
    """(rows, labelled, groups): all rows, those with a cluster, and the number of clusters."""
    return rows.agg(F.count("*").alias("rows"), F.count("cluster").alias("labelled"), F.countDistinct("cluster").alias("groups"))


def color(cluster: Column) -> Column:
    return F.when(cluster.isNotNull(), F.element_at(F.array(*map(F.lit, PALETTE)), (F.greatest(F.lit(0), cluster - 1) % len(PALETTE) + 1).cast("int")))


def alpha(is_hit: Column, is_selected: Column, only_cluster: bool, highlight: bool = True, selecting: bool = True) -> Column:
    base = F.when(~is_hit, 0.22).otherwise(1.0) if highlight else F.lit(1.0)
    return F.when(~is_selected, F.least(base, F.lit(0.12 if only_cluster else 0.30))).otherwise(base) if selecting else base
