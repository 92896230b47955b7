"""Encoders: a plug-in protocol, batches with a retry one by one, and a hashed bag of words as a test double."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Providers that have an encoder, words in an error after which a batch is tried again row by row, and outputs of a model in order of choice.
PROVIDERS = ("openclip", "openclip_hf_hub", "transformers_clip", "transformers_image_features", "transformers_metaclip2", "transformers_vision_pool", "nomic_transformers", "imagebind", "sentence_transformers")
RETRIED = ("out of memory", "cannot convert", "shape")
OUTPUTS = ("image_embeds", "pooler_output", "last_hidden_state", "hidden_states", "embeds", "logits")


def runnable(provider: Column) -> Column:
    return provider.isin(*PROVIDERS)


def device(cuda: Column, mps: Column) -> Column:
    """The device to encode on: cuda before mps before cpu."""
    return F.when(cuda, "cuda").when(mps, "mps").otherwise("cpu")


def as_matrix(output) -> np.ndarray:
    """The vectors in a model's output: an array, or the first present field of a mapping or object; of one with a place for each token, the first token.

    Of a list of layers, which only `hidden_states` can be, the last one counts.
    """
    given = output.get if isinstance(output, dict) else lambda n: getattr(output, n, None)
    if not isinstance(output, (np.ndarray, list, tuple)):
        name, found = next(((n, given(n)) for n in OUTPUTS if given(n) is not None), (None, None))
        if found is None:
            raise RuntimeError(f"{type(output).__name__} has no field that holds vectors")
        output = found[-1] if name == "hidden_states" and isinstance(found, (list, tuple)) and np.ndim(found[-1]) >= 2 else found
    matrix = np.asarray(output, np.float64)
    return matrix[:, 0] if matrix.ndim == 3 else matrix


class Encoder(Protocol):
    """What a model plug-in provides; it is built once for each Python worker."""

    dim: int

    def encode(self, batch: pd.Series) -> list[list[float]]: ...


def encode_column(rows: DataFrame, key: str, column: str, build, batch_size: int = 16) -> DataFrame:
    """(key, embedding, error): unit vectors of `column` by the encoder that `build()` makes.

    A batch that fails for want of memory or for the form of a row is tried again row by row, and a row that fails so has a null vector and its error;
    any other error ends the job. Null inputs are null.
    """

    def run(batches: Iterator[pd.DataFrame]):
        encoder = build()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                vectors, errors = [], []
                given = part[column].notna()
                try:
                    found = iter(as_matrix(encoder.encode(part.loc[given, column])) if given.any() else ())
                    vectors = [next(found) if g else None for g in given]
                    errors = [None] * len(part)
                except RuntimeError as error:
                    if not any(w in str(error).lower() for w in RETRIED):
                        raise
                    vectors, errors = [], []
                    for g, x in zip(given, part[column]):
                        try:
                            vectors.append(as_matrix(encoder.encode(pd.Series([x])))[0] if g else None)
                            errors.append(None)
                        except RuntimeError as error:
                            vectors.append(None)
                            errors.append(str(error))
                norms = [None if v is None else max(sum(float(y) ** 2 for y in v) ** 0.5, 1e-12) for v in vectors]
                unit = [None if v is None else [float(x) / norm for x in v] for v, norm in zip(vectors, norms)]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": unit, "error": errors})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, embedding array<float>, error string")


def hashed_text_entries(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """(key, d, w): a hashed bag of words, its entries unit-normed; a deterministic stand-in, not a semantic model.

    A text is counted where it is read, nothing is shuffled. Null texts and those without words have no entries.
    """

    class Places(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= 500_000:
                self.clear()
            place = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            return place

    def run(batches: Iterator[pd.DataFrame]):
        places, words = Places(), re.compile("[a-z]+")
        for pdf in batches:
            keys, entries, weights = [], [], []
            for k, t in zip(pdf["key"], pdf["text"]):
                found = words.findall(t)
                if found:
                    counts = np.bincount(np.fromiter(map(places.__getitem__, found), np.int64, len(found)), minlength=dim)
                    some = np.flatnonzero(counts)
                    keys.append(np.repeat(k, len(some)))
                    entries.append(some)
                    weights.append(counts[some] / math.sqrt(float((counts * counts).sum())))
            join = lambda x: np.concatenate(x) if x else []
            yield pd.DataFrame({key: join(keys), "d": join(entries), "w": join(weights)})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter("text IS NOT NULL").mapInPandas(run, f"{key} {kind}, d int, w double")


def hashed_text_score(entries: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """(key, score_raw) of hashed texts against one hashed query (d, w)."""
    return entries.join(F.broadcast(query.select("d", F.col("w").alias("qw"))), "d").groupBy(key).agg(F.sum(F.col("w") * F.col("qw")).alias("score_raw"))

