"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, arrow_map, maybe_broadcast, stage

#: Fingerprints that one merge task holds, about; the number of segments follows from the row count.
SEGMENT_ROWS = 131_072


class CountingQuotientFilter:
    """A counting quotient filter over 64-bit fingerprints within one segment of the quotient space.

    The quotient is the upper 32 bits; each occupied quotient has a run of sorted 32-bit remainders, each with
    a counter. Being kept as sorted runs, two filters merge without loss: equal (quotient, remainder)
    slots add their counters, all others keep their order.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        if not filters:
            return cls(np.empty(0, np.uint64), np.empty(0, np.int64))
        slots = np.concatenate([f.fingerprints for f in filters])
        order = np.argsort(slots, kind="stable")  # merges the sorted runs
        slots, counts = slots[order], np.concatenate([f.counts for f in filters])[order]
        if not len(slots):
            return cls(slots, counts)
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        return cls(slots[starts], np.add.reduceat(counts, starts))

    def to_bytes(self) -> bytes:
        quotient, remainder = (self.fingerprints >> np.uint64(32)).astype("<u4"), self.fingerprints.astype("<u4")
        occupied, run = np.unique(quotient, return_counts=True)
        head = np.array([len(occupied), len(remainder)], "<u8")
        return b"".join(x.tobytes() for x in (head, occupied, run.astype("<u4"), remainder, self.counts.astype("<u8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        n, m = (int(x) for x in np.frombuffer(data, "<u8", 2))
        occupied = np.frombuffer(data, "<u4", n, 16)
        run = np.frombuffer(data, "<u4", n, 16 + 4 * n)
        remainder = np.frombuffer(data, "<u4", m, 16 + 8 * n)
        counts = np.frombuffer(data, "<u8", m, 16 + 8 * n + 4 * m)
        return cls((np.repeat(occupied, run).astype(np.uint64) << np.uint64(32)) | remainder.astype(np.uint64), counts.astype(np.int64))


def _digests(docs: DataFrame, with_text: bool, row: str | None = None) -> DataFrame:
    """(row, doc_id, fp, text_sha256[, text]) with the text lower-cased in A-Z only; null counts as empty."""

    def digest(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in b["text"].to_pylist()]
            shas = [hashlib.sha256(t) for t in texts]
            out = {"fp": np.array([int.from_bytes(s.digest()[:8], "big", signed=True) for s in shas], np.int64), "text_sha256": [s.hexdigest() for s in shas]}
            yield out | ({"text": texts} if with_text else {"row": b["row"], "doc_id": b["doc_id"]})

    if with_text:
        return arrow_map(docs.select("text"), digest, "fp long, text_sha256 string, text binary")
    return arrow_map(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), digest, "row long, doc_id long, fp long, text_sha256 string")


def repeated_fingerprints(digests: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that the merged filters count more than once."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / SEGMENT_ROWS + 1)))

    def build(batches):
        parts = [b["fp"].to_numpy().view(np.uint64) for b in batches]
        own = CountingQuotientFilter.build(np.concatenate(parts) if parts else np.empty(0, np.uint64))
        segment = (own.fingerprints >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(segment, np.arange(2**bits + 1))
        for s in np.unique(segment):
            x, y = cuts[s], cuts[s + 1]
            yield {"segment": [int(s)], "slots": [CountingQuotientFilter(own.fingerprints[x:y], own.counts[x:y]).to_bytes()]}

    def merge(key, pdf):
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["slots"]])
        twice = merged.counts > 1
        return pd.DataFrame({"fp": merged.fingerprints[twice].view(np.int64), "n": merged.counts[twice]})

    return arrow_map(digests.select("fp"), build, "segment long, slots binary").groupBy("segment").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    `docs` needs doc_id and text; other columns, whatever their names, are ignored. Texts are equal when
    identical after lower-casing A-Z; a null text equals the empty one. Of equal texts the row with the largest
    doc_id stays (a null doc_id is the smallest); of repeated rows with one doc_id, exactly one. An
    empty table gives an empty result. `row` names a column that tells rows apart; without it they are numbered.

    Fingerprints counted once by the merged filters are unique without reading their bytes; the others
    go to byte verification, which groups whole texts and stops the job if one SHA-256 has two texts.
    """
    base = stage(_digests(docs, False, row), "digests")
    rows = base.count()
    repeated = stage(repeated_fingerprints(base, rows), "repeated")
    n = repeated.count()
    hot = maybe_broadcast(repeated.select("fp"), n)
    texts = _digests(docs, True).join(hot, "fp", "left_semi").groupBy("text_sha256", "text").agg(F.count("*").alias("n"))
    verified = texts.groupBy("text_sha256").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    groups = base.join(hot, "fp", "left_semi").groupBy("text_sha256").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    checked = groups.join(verified, "text_sha256").select(
        "text_sha256", "keep", F.when(F.assert_true((F.col("texts") == 1) & (F.col("n") == F.col("group_size")), F.lit("one SHA-256 stands for two texts")).isNull(), F.col("group_size")).alias("group_size")
    )
    groups_at_most = n  # each repeated fingerprint is one group, but for a collision
    out = base.join(maybe_broadcast(checked, groups_at_most), "text_sha256", "left")
    return out.select(
        "row",
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
