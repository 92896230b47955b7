"""The model catalogue: availability, capability chips, facets and filters."""

from __future__ import annotations

import importlib.util
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The models that can be chosen, in order.
# key | family | provider | model_id | requires | recommended_for | batch size | tier | status | what it can do: image, text, search, projection; remote: runs code of its own
_MODELS = """
openclip_vit_b_32 | OpenCLIP | openclip | ViT-B-32 | torch,open_clip | general,art_collection | 32 | cpu_ok | stable | image,text,search,projection
openai_clip_vit_b_32 | CLIP | transformers_clip | openai/clip-vit-base-patch32 | torch,transformers | general,art_collection | 32 | cpu_ok | stable | image,text,search,projection
siglip_base_patch16_224 | SigLIP | transformers_image_features | google/siglip-base-patch16-224 | torch,transformers | general,art_collection | 16 | cpu_ok | stable | image,text,search,projection
siglip2_base_patch16_224 | SigLIP 2 | transformers_image_features | google/siglip2-base-patch16-224 | torch,transformers | general,art_collection,multilingual | 8 | gpu_recommended | experimental | image,text,search,projection
mobileclip_b_openclip | MobileCLIP | openclip_hf_hub | hf-hub:apple/MobileCLIP-B-OpenCLIP | torch,open_clip | general,fast,local | 32 | cpu_ok | experimental | image,text,search,projection
dinov2_base | DINOv2 | transformers_vision_pool | facebook/dinov2-base | torch,transformers | visual_similarity,formal_analysis | 16 | cpu_ok | stable | image,projection
nomic_embed_vision_v1_5 | Nomic Embed Vision | nomic_transformers | nomic-ai/nomic-embed-vision-v1.5 | torch,transformers,einops | visual_similarity | 16 | gpu_recommended | experimental | image,projection,remote
imagebind_huge | ImageBind | imagebind | imagebind_huge | torch,imagebind | advanced_multimodal | 8 | large_gpu | experimental | image,projection
metaclip_b32 | MetaCLIP | openclip | ViT-B-32 | torch,open_clip | general,art_collection,multilingual | 32 | cpu_ok | experimental | image,text,search,projection
metaclip_l14 | MetaCLIP | openclip | ViT-L-14 | torch,open_clip | art_collection,multilingual | 8 | gpu_recommended | experimental | image,text,search,projection
metaclip2_worldwide_h14 | MetaCLIP 2 | transformers_metaclip2 | facebook/metaclip-2-worldwide-huge-quickgelu | torch,transformers | art_collection,multilingual | 4 | large_gpu | experimental | image,text,search,projection
metaclip2_worldwide_b32 | MetaCLIP 2 | transformers_metaclip2 | facebook/metaclip-2-worldwide-b32 | torch,transformers | art_collection,multilingual | 8 | gpu_recommended | experimental | image,text,search,projection
metaclip2_2b_worldwide | MetaCLIP 2 | planned | | | art_collection,multilingual | 2 | large_gpu | planned | 
mobileclip2_s2 | MobileCLIP2 | openclip_hf_hub | hf-hub:timm/MobileCLIP2-S2-OpenCLIP | torch,open_clip | fast,local | 32 | cpu_ok | experimental | image,text,search,projection
mobileclip2_b | MobileCLIP2 | openclip_hf_hub | hf-hub:timm/MobileCLIP2-B-OpenCLIP | torch,open_clip | fast,local | 24 | cpu_ok | experimental | image,text,search,projection
mobileclip2_s4 | MobileCLIP2 | openclip_hf_hub | hf-hub:timm/MobileCLIP2-S4-OpenCLIP | torch,open_clip | fast,local | 16 | gpu_recommended | experimental | image,text,search,projection
hq_clip_b16 | HQ-CLIP | planned | | | art_collection | 16 | gpu_recommended | planned | 
long_clip_b32 | Long-CLIP | planned | | | art_collection,long_queries | 16 | gpu_recommended | planned | 
eva_clip_l14 | EVA-CLIP | openclip | EVA02-L-14 | torch,open_clip | visual_similarity,art_collection | 8 | gpu_recommended | experimental | image,text,search,projection
eva_clip_bigE14 | EVA-CLIP | openclip | EVA02-E-14 | torch,open_clip | visual_similarity,art_collection | 2 | large_gpu | experimental | image,text,search,projection
cloc_roadmap | CLOC | planned | | | local_alignment,art_collection | 16 | gpu_recommended | planned | 
laclip_roadmap | LACLIP | planned | | | local_alignment,art_collection | 16 | gpu_recommended | planned | 
qwen3_vl_embedding_2b | Qwen3-VL | sentence_transformers | Qwen/Qwen3-VL-Embedding-2B | torch,transformers,sentence_transformers,qwen_vl_utils | general,art_collection,multilingual | 4 | large_gpu | experimental | image,text,search,projection,remote
jina_v5_omni_small | Jina v5 Omni | sentence_transformers | jinaai/jina-embeddings-v5-omni-small | torch,transformers,sentence_transformers,peft | general,art_collection,multilingual | 8 | gpu_recommended | experimental | image,text,search,projection,remote
"""

# What "name checkpoint" of an older version stands for, as patterns.
LEGACY = ((r"^ViT-B-32 laion2b_s34b_b79k$", "openclip_vit_b_32"), (r"^hf-hub:apple/MobileCLIP", "mobileclip_b_openclip"))
# Families that a catalogue must have.
REQUIRED_FAMILIES = ("OpenCLIP", "CLIP", "SigLIP", "SigLIP 2", "MobileCLIP", "MobileCLIP2", "DINOv2", "Nomic Embed Vision", "ImageBind", "MetaCLIP", "MetaCLIP 2", "HQ-CLIP", "Long-CLIP", "EVA-CLIP", "CLOC", "LACLIP")

SCHEMA = (
    "ordinal int, key string, family string, provider string, model_id string, requires array<string>, recommended_for array<string>, batch_size int, hardware_tier string, status string, "
    "supports_image_embedding boolean, supports_text_embedding boolean, supports_text_search boolean, supports_projection boolean, trust_remote_code boolean"
)


def model_rows() -> list[tuple]:
    rows = []
    for i, line in enumerate(_MODELS.strip().split("\n"), 1):
        key, family, provider, model_id, requires, tags, batch, tier, status, flags = (x.strip() for x in line.split("|"))
        split = lambda s: [x for x in s.split(",") if x]
        rows.append((i, key, family, provider, model_id, split(requires), split(tags), int(batch), tier, status, *(f in split(flags) for f in ("image", "text", "search", "projection", "remote"))))
    return rows


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(model_rows(), SCHEMA)


def registry(spark: SparkSession, own: DataFrame) -> DataFrame:
    """The built-in models and a table of the users' own, whose columns are brought to the catalogue's types; an own model replaces the built-in one of its key."""
    fields = [x.strip().split() for x in SCHEMA.split(",")]
    rows = own.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields))
    taken = rows.filter(F.col("key").isin(*(r[1] for r in model_rows()))).select("key")
    return models(spark).join(taken, "key", "left_anti").select(*rows.columns).unionByName(rows)


def lacking_families(rows: DataFrame, group: str) -> DataFrame:
    """(group, lacking): how many of the required families no model of a group has."""
    wanted = F.when(F.col("family").isin(*REQUIRED_FAMILIES), F.col("family"))
    return rows.groupBy(group).agg((F.lit(len(REQUIRED_FAMILIES)) - F.count_distinct(wanted)).alias("lacking"))


def requirements(rows: DataFrame, installed: list[str]) -> DataFrame:
    """(module, models, required, installed) of the modules that models need: how many need each, and whether a stable one does."""
    found = rows.select("status", F.explode("requires").alias("module")).groupBy("module").agg(F.count("*").alias("models"), F.bool_or(F.col("status") == "stable").alias("required"))
    return found.withColumn("installed", F.col("module").isin(*installed))


def legacy_key(name: Column, checkpoint: Column) -> Column:
    """The key that an old model name and checkpoint stand for, or one made of both."""
    both = F.concat_ws(" ", name, checkpoint)
    known = F.coalesce(*(F.when(both.rlike(pattern), key) for pattern, key in LEGACY))
    return F.coalesce(known, F.concat_ws("_", F.lit("legacy_openclip"), F.translate(name, "/:", "--"), F.translate(checkpoint, "/:", "--")))


def model(key: str | None, name: str = "ViT-B-32", checkpoint: str = "laion2b_s34b_b79k") -> dict:
    """One model by key; without a key the one that an old name and checkpoint stand for, without text search if the catalogue hasn't got it."""
    fields = [x.strip().split()[0] for x in SCHEMA.split(",")]
    known = {r[1]: dict(zip(fields, r)) for r in model_rows()}
    if key and key not in known:
        raise ValueError(f"unknown model {key!r}; known: {', '.join(sorted(known))}")
    key = key or next((k for pattern, k in LEGACY if re.match(pattern, f"{name} {checkpoint}")), None)
    if key:
        return known[key]
    like = known["openclip_vit_b_32"]
    return {**like, "ordinal": None, "key": "_".join(["legacy_openclip", re.sub("[/:]", "-", f"{name}_{checkpoint}")]), "model_id": name, "recommended_for": [], "supports_text_embedding": False, "supports_text_search": False}


def with_guidance(rows: DataFrame, own: DataFrame, by_family: list[tuple[str, str]], other: str) -> DataFrame:
    """`rows` with guidance: the text of `own` (key, guidance), else that of the first part of a family's name that fits, else `other`."""
    family = F.lower("family")
    text = F.lit(None).cast("string")
    for part, words in reversed(by_family):
        text = F.when(F.contains(family, F.lit(part)), words).otherwise(text)
    return rows.join(F.broadcast(own.select("key", F.col("guidance").alias("_own"))), "key", "left").withColumn("guidance", F.coalesce("_own", text, F.lit(other))).drop("_own")


def label() -> Column:
    """What a chosen model shows beside its name: its family, what it is good for and needs, its provider."""
    marks = F.concat_ws(
        " · ", F.when(F.array_contains("recommended_for", "fast"), "Fast"), F.when(F.col("status") == "experimental", "Experimental"),
        F.when(F.col("hardware_tier").isin("gpu_recommended", "large_gpu"), "Requires GPU"), F.when(F.col("supports_text_search"), "Text search supported").otherwise("Projection only"),
    )
    return F.concat_ws(" · ", "family", F.when(marks != "", marks), F.concat(F.lit("provider "), F.col("provider")))


def dependencies(spark: SparkSession, modules: dict[str, bool], installed: list[str] | None = None) -> DataFrame:
    """(module, required, installed) of modules given with whether they are required; without a list, what this Python can import."""
    found = set(installed_modules(list(modules)) if installed is None else installed)
    return spark.createDataFrame([(m, r, m in found) for m, r in modules.items()], "module string, required boolean, installed boolean")


def dependency_summary(report: DataFrame) -> DataFrame:
    """(ok, missing): whether all required modules are installed, and how many are not."""
    lacking = F.col("required") & ~F.col("installed")
    return report.agg(F.bool_and(~lacking).alias("ok"), F.count_if(lacking).alias("missing"))


def installed_modules(names: list[str]) -> list[str]:
    return [n for n in names if importlib.util.find_spec(n) is not None]


def require(spec: dict, *, text: bool = False) -> None:
    """Raises unless a model can embed images and project them, or embed and search text."""
    if spec["status"] in ("planned", "unavailable"):
        raise ValueError(f"{spec['key']} is {spec['status']}")
    if text and not (spec["supports_text_embedding"] and spec["supports_text_search"]):
        raise ValueError(f"{spec['key']} does not support text search")
    if not text and not (spec["supports_image_embedding"] and spec["supports_projection"]):
        raise ValueError(f"{spec['key']} does not support image projection")


def availability(rows: DataFrame, installed: list[str]) -> DataFrame:
    """`rows` with missing_requirements and available."""
    missing = F.array_except("requires", F.array(*map(F.lit, installed)).cast("array<string>"))
    return rows.withColumn("missing_requirements", missing).withColumn("available", (F.size(missing) == 0) & ~F.col("status").isin("planned", "unavailable"))


def chips() -> Column:
    """The capabilities shown for a model. 'image only' stands, as users know it, for a model without image embedding."""
    when = lambda c, name: F.when(c, F.lit(name))
    flags = F.array(
        when(F.col("supports_projection"), "projection"),
        when(F.col("supports_text_search"), "semantic search"),
        when(F.col("supports_text_embedding"), "text embedding"),
        when(~F.col("supports_image_embedding"), "image only"),
        when(F.col("hardware_tier") == "cpu_ok", "CPU-friendly"),
        when(F.col("hardware_tier") == "gpu_recommended", "GPU recommended"),
        when(F.col("hardware_tier") == "large_gpu", "Large GPU"),
    )
    tags = F.transform("recommended_for", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    return F.array_distinct(F.array_compact(F.concat(flags, tags, F.array(when(F.col("trust_remote_code"), "remote code")))))


def filter_models(rows: DataFrame, status: str = "all", capability: str = "all", query: str = "") -> DataFrame:
    out = rows.withColumn("chips", chips())
    if status != "all":
        out = out.filter(F.col("status") == status)
    if capability != "all":
        out = out.filter(F.exists("chips", lambda c: F.lower(c) == capability.lower()))
    if query:
        haystack = F.lower(F.concat_ws(" ", "family", "key", "model_id", "provider", "status", "chips"))
        out = out.filter(F.instr(haystack, query.lower()) > 0)
    return out


def selectable(include_planned: bool = False) -> Column:
    able = F.col("supports_image_embedding") & F.col("supports_projection") & (F.col("status") != "planned")
    return able | (F.col("status") == "planned") if include_planned else able


def option_disabled() -> Column:
    return (F.col("status") == "unavailable") | ((F.col("status") != "planned") & ~(F.col("available") & F.col("supports_image_embedding") & F.col("supports_projection")))
