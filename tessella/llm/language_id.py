"""Language ID: hyperdimensional letter n-gram profiles compared by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_bucket, mix, worker_cache

DIMENSIONS = 1024
#: Letter symbols: 0 stands between words, 1-26 are a-z, other letters fall by hash onto the rest.
SYMBOLS = 64
_TABLES: dict = {}


def _symbols() -> np.ndarray:
    """Symbol of each code point, after lower-casing."""
    if "symbols" not in _TABLES:
        table = np.zeros(0x110000, np.uint8)
        letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.uint64)
        table[letters.astype(np.int64)] = 27 + (mix(letters) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
        table[97:123] = np.arange(1, 27)
        table[65:91] = np.arange(1, 27)
        _TABLES["symbols"] = table
    return _TABLES["symbols"]


def _letters(dimensions: int) -> np.ndarray:
    """For each place of a trigram, the random +-1 letter vectors permuted by that place: places x symbols x dimensions."""
    if dimensions not in _TABLES:
        base = np.random.default_rng(20_240).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        _TABLES[dimensions] = np.stack([np.roll(base, 2 - place, axis=1) for place in range(3)])
    return _TABLES[dimensions]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letter trigrams of a whole text, runs of other characters being one break."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = _symbols()[points]
    if not s.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    s = s[keep].astype(np.int64)
    s = np.concatenate([[0], s, [0, 0]])
    codes = s[:-2] * SYMBOLS * SYMBOLS + s[1:-1] * SYMBOLS + s[2:]
    codes = codes[s[1:-1] > 0]  # the middle is a letter
    if len(codes) < 20_000:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes)
    found = np.flatnonzero(counts)
    return found, counts[found]


def bundle(codes: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of the bound trigram vectors, each weighted by its count."""
    first, second, third = _letters(dimensions)
    total = np.zeros(dimensions, np.float32)
    for i in range(0, len(codes), 4096):
        c = codes[i : i + 4096]
        bound = first[c // (SYMBOLS * SYMBOLS)] * second[c // SYMBOLS % SYMBOLS] * third[c % SYMBOLS]
        total += counts[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
    return total


def fit_language_profiles(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """{lang: unit prototype} bundled from every trigram of every labelled text.

    `labelled` needs text and lang; rows whose text or lang is null are left out. Tasks add up trigram counts, so
    they return one vector for each language they met; the result is a vector for each language.
    """

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                codes, counts = trigram_counts(text)
                if lang not in found:
                    found[lang] = np.zeros(SYMBOLS**3, np.int64)
                found[lang][codes] += counts
        for lang, total in found.items():
            codes = np.flatnonzero(total)
            first, second, third = _letters(dimensions)
            vector = np.zeros(dimensions)
            for i in range(0, len(codes), 4096):
                c = codes[i : i + 4096]
                vector += total[c].astype(np.float64) @ (first[c // (SYMBOLS * SYMBOLS)] * second[c // SYMBOLS % SYMBOLS] * third[c % SYMBOLS]).astype(np.float64)
            yield {"lang": [lang] * dimensions, "d": np.arange(dimensions, dtype=np.int32), "value": vector}

    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = arrow_map(rows, count, "lang string, d int, value double").groupBy("lang", "d").agg(F.sum("value").alias("value"))
    table = sums.toPandas()  # languages x dimensions
    profiles = {}
    for lang, part in sorted(table.groupby("lang"), key=lambda x: x[0]):
        v = part.sort_values("d")["value"].to_numpy()
        norm = np.linalg.norm(v)
        if norm > 0:
            profiles[str(lang)] = v / norm
    return profiles


def language_column(profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
    """A pandas UDF text -> struct(lang_pred, score) for fitted profiles."""
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        worker_cache(__name__)  # lets what other operators kept go
        langs, scores = [], []
        for t in texts:
            codes, counts = trigram_counts(t)
            if not len(codes) or not names:
                langs.append("und"), scores.append(0.0)
                continue
            v = bundle(codes, counts, dimensions)
            norm = float(np.linalg.norm(v))
            cos = matrix @ v / max(norm, 1e-12)
            best = int(np.argmax(cos))
            langs.append(names[best]), scores.append(float(np.clip(cos[best], 0, 1)))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify_languages(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of `docs`.

    Profiles are learned from text and non-null lang of the rows whose crc32(doc_id as text) modulo `modulus` isn't
    `held_out`; neither lang, source nor doc_id reach a prediction. score is the cosine with the best profile,
    cut to 0..1. A text that is null or has no letters is `und` with score 0, as is every text if nothing
    was learned. Ties go to the first name in order. Other columns are ignored; an empty table gives an empty result.
    """
    bucket = doc_bucket(F.col("doc_id"), modulus)
    profiles = fit_language_profiles(docs.filter(bucket != held_out))
    predict = language_column(profiles)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket == held_out).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
