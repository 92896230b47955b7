"""Path, name and number functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes of images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of the last component with its dot, '' if none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def components(path: Column) -> Column:
    """Sort key that orders paths component by component."""
    return F.split(path, "/")


def safe_name(text: Column) -> Column:
    """Everything but letters, digits, hyphen, underscore and full stop becomes a hyphen."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "-")


def search_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-")


def norm_dir(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def in_scope(path: Column, directory: Column, root: str = "img") -> Column:
    return (directory == root) | path.startswith(F.concat(directory, F.lit("/")))


def clean_cell(text: Column) -> Column:
    return F.regexp_replace(text, "\t|\r?\n", " ")


def float_or_null(text: Column) -> Column:
    return text.try_cast("double")


def int_or_null(text: Column) -> Column:
    """Truncated towards zero; null for what isn't a finite number."""
    return text.try_cast("double").try_cast("int")


def optional_number(text: Column) -> Column:
    x = F.when(~text.isin("", "null"), text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def without_ending(text: Column, ending: str) -> Column:
    """`text` without that ending where it has it."""
    return F.when(text.endswith(ending), F.left(text, F.length(text) - len(ending))).otherwise(text)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def masked(token: Column) -> Column:
    return F.when(F.length(token) > 0, F.concat(F.lit("…"), F.right(token, F.lit(4))))


def artifact_name(stamp: Column, dataset: Column, model: Column, reducer: Column, clustered: Column, auto: Column, k: Column, min_k: Column, max_k: Column) -> Column:
    """The name of a stored projection; it tells how its clusters were chosen: not at all, by a fixed k, or as the best of a range."""
    between = F.concat(F.lit("_clusters-auto-"), min_k.cast("string"), F.lit("-"), max_k.cast("string"))
    tag = F.when(~clustered, "").when(auto, between).otherwise(F.concat(F.lit("_clusters-k"), k.cast("string")))
    return F.concat(F.concat_ws("_", stamp, dataset, safe_name(model), reducer), tag, F.lit("_projection.tsv"))
