"""Substring dedup: paragraph MinHash banding with exact verification, removals clustered by components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _POWERS, _WORDS, arrow_map, components, maybe_broadcast, mix, stage, tasks_for, unstage
from .ngram_join import COSTLY, Scheme, comparable_sets, paired_links, shared_tokens, signature_links

#: Words on either side that decide whether a piece ends at a word, and of the longest piece.
REACH = 4
MAX_UNIT_WORDS = 40
#: Words of the shortest passage that is reported, and of the shortest paragraph that is compared.
MIN_PASSAGE_WORDS = 16


def tune_bands(similarity: float, recall: float, values: int = 64) -> tuple[int, int]:
    """(bands, rows) with the most rows, for the fewest false collisions, that find a pair of that similarity with that probability within so many hash values."""
    for rows in range(values, 0, -1):
        for bands in range(1, values // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no bands within the limit reach that recall")


def _pieces(hashes: np.ndarray) -> np.ndarray:
    """Where content-defined pieces begin: where the hash of three words is the least of all within `REACH` places, and after 40 words.

    Where pieces begin depends on the words near it alone, so that a passage copied into other text falls into the same
    pieces there, but for a few words at its ends.
    """
    n = len(hashes)
    m = n - 2
    cuts = np.zeros(1, np.int64)
    if m > 2 * REACH:
        three = mix(hashes[:m] * _POWERS[0] + hashes[1 : m + 1] * _POWERS[1] + hashes[2:] * _POWERS[2])
        middle = three[REACH : m - REACH]
        least = np.ones(len(middle), bool)
        for shift in range(-REACH, REACH + 1):
            if shift:
                least &= middle < three[REACH + shift : m - REACH + shift]
        cuts = np.r_[cuts, np.flatnonzero(least) + REACH]
    parts = -(-np.diff(np.r_[cuts, n]) // MAX_UNIT_WORDS)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(cuts, parts) + within * MAX_UNIT_WORDS


def _contents(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes, as signed 64-bit numbers, of the sequences of words that begin at `starts` and end where the next begins."""
    sizes = np.diff(np.r_[starts, len(hashes)])
    places = np.arange(len(hashes)) - np.repeat(starts, sizes) + 1
    total = np.add.reduceat(mix(hashes) * mix(places.astype(np.uint64)), starts)
    return mix(total + sizes.astype(np.uint64)).view(np.int64)


class Words:
    """The words of a text: their hashes, lower-cased in A-Z, their places in the UTF-8 bytes, and where lines end there."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.hashes = np.fromiter(map(_WORDS.__getitem__, raw.translate(_LOWER).split()), np.uint64)
        data = np.frombuffer(raw, np.uint8)
        space = np.r_[True, (data == 32) | ((data >= 9) & (data <= 13)), True]
        self.starts, self.ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        self.breaks = np.flatnonzero(data == 10)

    def shingles(self, width: int = 5) -> np.ndarray:
        """Hashes of the shingles at each word but the last few, equal to those of `shingle_hashes`."""
        n = len(self.hashes) - width + 1
        total = np.full(max(n, 0), np.uint64(width), np.uint64)
        for j in range(width if n > 0 else 0):
            total += self.hashes[j : n + j] * _POWERS[j]
        return mix(total)

    def long_lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last + 1, content) of the lines that are compared, of a text with words."""
        line = np.searchsorted(self.breaks, self.starts)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        stop = np.r_[first[1:], len(self.hashes)]
        keep = stop - first >= MIN_PASSAGE_WORDS
        return first[keep], stop[keep], _contents(self.hashes, first)[keep]


def _units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """The pieces and paragraphs of every text: (doc_id, kind, start, end, at, words, content, keys).

    start and end are byte places in the UTF-8 text, at is the place of the first word among the words; keys, of paragraphs only, are the band keys of its
    MinHash values, 64 bits each.
    """
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    keyed = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def band_keys(shingles, cuts):
        """Keys of the paragraphs of a whole batch: its shingles one after the other, and where those of each paragraph begin and end."""
        s, cuts = np.concatenate([*shingles, np.zeros(1, np.uint64)]), np.concatenate(cuts)
        least = np.stack([np.minimum.reduceat((s ^ (seed >> np.uint64(7))) * seed, cuts)[::2] for seed in seeds], axis=1).reshape(len(cuts) // 2, bands, rows)
        return mix(least.sum(axis=2, dtype=np.uint64) + keyed).astype("<u8")

    def batch(kind, ids, starts, ends, at, words, contents, keys):
        sizes = [len(x) for x in starts]
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        count = sum(sizes)
        return {
            "doc_id": np.repeat(np.array(ids, np.int64), sizes), "kind": [kind] * count, "start": join(starts, np.int32), "end": join(ends, np.int32),
            "at": join(at, np.int32), "words": join(words, np.int32), "content": join(contents, np.int64), "keys": [None] * count if keys is None else [x.tobytes() for x in keys],
        }

    def cut(batches):
        for b in batches:
            pieces, lines = [[] for _ in range(6)], [[] for _ in range(6)]
            shingles, cuts, done = [], [], 0
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                w = Words(t)
                if not len(w.hashes):
                    continue
                first = _pieces(w.hashes)
                for to, x in zip(pieces, (d, w.starts[first], np.r_[w.starts[first[1:]], w.ends[-1]], first, np.diff(np.r_[first, len(w.hashes)]), _contents(w.hashes, first))):
                    to.append(x)
                x, y, content = w.long_lines()
                if len(x):
                    shingles.append(w.shingles())
                    cuts.append(np.stack([x, y - 4], axis=1).ravel() + done)
                    done += len(shingles[-1])
                    for to, v in zip(lines, (d, w.starts[x], w.ends[y - 1], x, y - x, content)):
                        to.append(v)
            yield batch("piece", *pieces, None)
            yield batch("paragraph", *lines, band_keys(shingles, cuts) if cuts else [])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return arrow_map(source, cut, "doc_id long, kind string, start int, end int, at int, words int, content long, keys binary")


def _paragraph_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(id, n, tokens) of the wanted paragraphs, given as (doc_id, content): their shingles, read again where they stand."""
    own = wanted.groupBy("doc_id").agg(F.collect_set("content").alias("contents"))  # of one document

    def cut(batches):
        for b in batches:
            ids, tokens = [], []  # a paragraph that stands twice in its document counts once
            for t, contents in zip(b["text"].to_pylist(), b["contents"].to_pylist()):
                left, w = set(contents), Words(t or "")
                shingles = w.shingles()
                for x, y, c in zip(*(v.tolist() for v in w.long_lines())) if len(w.hashes) else ():
                    if c in left:
                        left.discard(c)
                        ids.append(c), tokens.append(np.unique(shingles[x : y - 4]).astype("<u8").tobytes())
            yield {"id": ids, "n": [len(x) // 8 for x in tokens], "tokens": tokens}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(own, n_wanted), "doc_id").select("text", "contents")
    return arrow_map(rows, cut, "id long, n long, tokens binary")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, edge, on_right, hashes, places) of places given as (doc_id, edge, on_right): the hashes of the words before word `edge`, or from there on if on_right,
    outwards, and how many bytes from the start of word `edge` each ends; 16 bits a place where that is enough.

    A side has at most `MAX_UNIT_WORDS` words, the most that a piece has: were more of a side repeated, it would hold a whole repeated piece.
    """
    own = wanted.groupBy("doc_id").agg(F.collect_list(F.when(F.col("on_right"), F.col("edge")).otherwise(-1 - F.col("edge"))).alias("asked"))  # of one document

    def read(batches):
        for b in batches:
            out = {n: [] for n in ("doc_id", "edge", "on_right", "hashes", "places")}
            for d, t, asked in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["asked"].to_pylist()):
                w = Words(t or "")
                for x in asked:
                    right, edge = x >= 0, x if x >= 0 else -1 - x
                    if edge + (not right) > len(w.hashes):  # another row of this doc_id
                        continue
                    if right:
                        hashes, places = w.hashes[edge : edge + MAX_UNIT_WORDS], w.ends[edge : edge + MAX_UNIT_WORDS] - w.starts[edge : edge + 1]
                    else:
                        before = slice(max(0, edge - MAX_UNIT_WORDS), edge)
                        hashes, places = w.hashes[before][::-1], w.starts[edge] - w.starts[before][::-1]
                    if not len(hashes):
                        continue
                    row = (d, edge, right, hashes.tobytes(), places.astype("<u2" if places[-1] < 1 << 16 else "<u4").tobytes())
                    for column, v in zip(out.values(), row):
                        column.append(v)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id").select("doc_id", "text", "asked")
    return arrow_map(rows, read, "doc_id long, edge int, on_right boolean, hashes binary, places binary")


def _extensions(docs: DataFrame, same: DataFrame) -> DataFrame:
    """Marks of the words on both sides of repeated pieces that are repeated too, up to the first that differs from those in the document that stays, staged.

    `same` has the repeated pieces (doc_id, start, end, at, words, keep, component). Only the ends of runs of pieces are looked at, each on its own.
    """
    most = tasks_for(same.count())
    order = Window.partitionBy("doc_id").orderBy("at", "words")
    ends = same.filter("doc_id <> keep").withColumns({"on_left": F.lag(F.col("at") + F.col("words")).over(order), "on_right": F.lead("at").over(order)})
    ends = ends.withColumns({"on_left": F.coalesce(F.col("on_left") < F.col("at"), F.lit(True)), "on_right": F.coalesce(F.col("on_right") > F.col("at") + F.col("words"), F.lit(True))})
    ends = ends.withColumn("on_right", F.explode(F.expr("filter(array(false, true), x -> if(x, on_right, on_left))")))
    edge, byte = F.when(F.col("on_right"), F.col("at") + F.col("words")).otherwise(F.col("at")).alias("edge"), F.when(F.col("on_right"), F.col("end")).otherwise(F.col("start")).alias("byte")
    ends = ends.select("doc_id", edge, "on_right", byte, "keep", "component").distinct()
    kept = same.filter("doc_id = keep").withColumn("on_right", F.explode(F.array(F.lit(False), F.lit(True))))
    kept = kept.select("component", edge.alias("kept_edge"), "on_right", byte.alias("kept_byte")).distinct()
    pairs = stage(ends.join(kept, ["component", "on_right"]), "ends", tasks=most)
    wanted = stage(pairs.select("doc_id", "edge", "on_right").unionByName(pairs.select(F.col("keep").alias("doc_id"), F.col("kept_edge").alias("edge"), "on_right")).distinct(), "asked", tasks=most)
    around = stage(_surroundings(docs, wanted), "around", tasks=2 * most, compression="zstd")
    there = around.select(F.col("doc_id").alias("keep"), F.col("edge").alias("kept_edge"), "on_right", F.col("hashes").alias("kept_hashes"), F.col("places").alias("kept_places"))
    whole = pairs.join(around, ["doc_id", "edge", "on_right"]).join(there, ["keep", "kept_edge", "on_right"])
    names = ("doc_id", "edge", "byte", "hashes", "places")

    def compare(batches):
        for b in batches:
            out = {n: [] for n in ("doc_id", "start", "end", "at", "words", "keep", "component")}
            values = (b[x].to_pylist() for x in ("keep", "component", "on_right", *names, "kept_edge", "kept_byte", "kept_hashes", "kept_places"))
            for keep, component, right, doc, edge, byte, own, places, kept_edge, kept_byte, other, kept_places in zip(*values):
                if own[:8] != other[:8]:
                    continue
                n = min(len(own), len(other)) // 8
                differ = np.flatnonzero(np.frombuffer(own, np.uint64, n) != np.frombuffer(other, np.uint64, n))
                n = int(differ[0]) if len(differ) else n
                for d, e, at_byte, far, count in ((doc, edge, byte, places, len(own) // 8), (keep, kept_edge, kept_byte, kept_places, len(other) // 8)):
                    far = int(np.frombuffer(far, f"<u{len(far) // count}")[n - 1])
                    row = (d, at_byte, at_byte + far, e, n, keep, component) if right else (d, at_byte - far, at_byte, e - n, n, keep, component)
                    for column, v in zip(out.values(), row):
                        column.append(v)
            yield out

    marks = arrow_map(whole.select("keep", "component", "on_right", *names, "kept_edge", "kept_byte", "kept_hashes", "kept_places"), compare, "doc_id long, start int, end int, at int, words int, keep long, component long")
    marks = stage(marks, "extensions", tasks=2 * most)
    unstage(pairs, wanted, around)
    return marks


def _colliding(firsts: DataFrame) -> DataFrame:
    """(sig, id): the band keys that several of the paragraphs (content, keys), each given once, have in common."""

    def part(batches):
        for b in batches:
            keys = [np.frombuffer(b"".join(x), "<u8").view(np.int64) for x in b["parts"].to_pylist()]
            yield {"sig": np.concatenate([*keys, np.empty(0, np.int64)]), "id": np.repeat(b["id"].to_numpy(), [len(x) for x in keys])}

    return arrow_map(shared_tokens(firsts.select(F.col("content").alias("id"), F.col("keys").alias("tokens"))), part, "sig long, id long")


def repeated_passages(docs: DataFrame, similarity: tuple[int, int] = (75, 100), recall: float = 0.995, min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, component, keep_doc_id, removed): passages that stand in several documents.

    Paragraphs (lines) of at least 16 words collide when a band of their MinHash values is equal, the bands being tuned to find a
    pair of the given Jaccard similarity of five-word shingles with probability `recall`. Collisions are verified exactly
    and connected paragraphs form components; those in bands that many share find each other by exact signatures instead of pair by pair. Content-defined pieces of about nine words are compared
    as wholes, so that a passage inside longer lines or across lines is found too, and runs of them are extended word by word, to the left and right,
    as far as the text that stays says the same. What stands in two or more documents is kept
    in that with the smallest doc_id and removed in the others. Repeated units that touch form a passage; those of
    fewer than `min_words` words, such as licence lines, are left alone.

    start and end are byte places in the UTF-8 text. Null texts, texts without words and rows with a null doc_id have no passages.
    Rows with equal doc_ids count as one document and report each passage once. Other columns are ignored; an
    empty table gives an empty result.
    """
    bands, rows = tune_bands(similarity[0] / similarity[1], recall)
    units = stage(_units(docs, bands, rows), "units")
    most = tasks_for(units.count())
    pieces = units.filter("kind = 'piece'").select("doc_id", "start", "end", "at", "words", "content")
    lines = units.filter("kind = 'paragraph'")

    spread = pieces.groupBy("content").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).filter("keep < last").select("content", "keep")
    spread = stage(spread, "spread", tasks=most)
    same = stage(pieces.join(spread, "content").select("doc_id", "start", "end", "at", "words", "keep", F.col("content").alias("component")), "same", tasks=most)
    unstage(spread)
    longer = _extensions(docs, same)

    # Paragraphs that collide in a band; of these, those that have enough shingles in common with others to link at all.
    firsts = stage(lines.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.min("keys").alias("keys")), "firsts", tasks=most)
    colliding = stage(_colliding(firsts), "colliding", tasks=most)
    wanted = stage(colliding.select(F.col("id").alias("content")).distinct().join(firsts.select("content", "doc_id"), "content").select("doc_id", "content"), "wanted", tasks=most)
    unstage(firsts)
    scheme = Scheme(*similarity)
    sets = stage(_paragraph_sets(docs, wanted, wanted.count()), "tokens", tasks=most)
    tokens = comparable_sets(sets, scheme, most)
    unstage(wanted, sets)

    # Bands that few paragraphs share are joined pair by pair; paragraphs in others find each other by exact signatures.
    banded = stage(colliding.join(maybe_broadcast(tokens.select("id", "n", "u", "x", "y"), tokens.count()), "id"), "left", tasks=most)
    many = banded.groupBy("sig").agg(F.count("*").alias("many")).filter("many > 1")
    left = stage(banded.join(many, "sig"), "bands", tasks=most)
    unstage(colliding, banded)
    crowded = stage(tokens.join(left.filter(F.col("many") > COSTLY).select("id").distinct(), "id", "left_semi"), "crowded", tasks=most)
    links = [stage(paired_links(left.filter(F.col("many") <= COSTLY), tokens, scheme), "links", tasks=most), *signature_links(crowded, scheme)]
    unstage(tokens, left, crowded)
    label = stage(components(reduce(DataFrame.unionByName, links)), "label")
    labelled = lines.select("doc_id", "start", "end", "at", "words", "content").join(maybe_broadcast(label.withColumnRenamed("node", "content"), label.count()), "content", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "content"))
    groups = labelled.groupBy("component").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).filter("keep < last").select("component", "keep")
    near = labelled.join(groups, "component").select("doc_id", "start", "end", "at", "words", "keep", "component")

    marks = same.unionByName(longer).unionByName(near).withColumn("removed", F.col("doc_id") != F.col("keep")).distinct()
    order = Window.partitionBy("doc_id", "removed").orderBy("at", "words")
    before = F.max(F.col("at") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("at") <= before, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    passages = marks.withColumn("island", island).groupBy("doc_id", "removed", "island").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("n_words"),
        F.min("component").alias("component"),
        F.min("keep").alias("keep_doc_id"),
    )
    passages = stage(passages.filter(F.col("n_words") >= min_words).select("doc_id", "start", "end", "n_words", "component", "keep_doc_id", "removed"), "passages", tasks=most)
    unstage(units, label, same, longer, *links)
    return passages


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """`docs` with a column text_kept: the text without its removed passages; null texts stay null."""
    spans = passages.filter("removed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one document

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None:
                raw, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
                for x in s:
                    kept.append(raw[at : max(at, x["start"])])
                    at = max(at, x["end"])
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            out.append(t)
        return pd.Series(out, dtype="object")

    joined = docs.join(spans.withColumnRenamed("doc_id", "passage_doc_id").withColumnRenamed("spans", "passage_spans"), F.col("doc_id") == F.col("passage_doc_id"), "left")
    return joined.withColumn("text_kept", cut("text", "passage_spans")).drop("passage_doc_id", "passage_spans")
