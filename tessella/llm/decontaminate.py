"""Benchmark decontamination: pigeonhole piece hits verified by Myers' bit-parallel distance."""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, worker_cache

#: Edits allowed, as a share of an item's normalised length.
ERROR_RATE = 0.08
#: Characters of items that one automaton holds; a larger benchmark is searched for in several blocks.
BLOCK_CHARS = 4_000_000
_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Case-folded letters and digits, every run of anything else being one space."""
    return _NOT_WORD.sub(" ", (text or "").casefold()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, end of the first such substring).

    Myers 1999: the column of differences is kept in two bit vectors, a text character a step.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = full & (up << 1), full & (down << 1)
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class ItemIndex:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(error_rate * len(t))) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            cuts = [len(t) * j // (errors + 1) for j in range(errors + 2)]
            for x, y in zip(cuts, cuts[1:]):
                pieces.setdefault(t[x:y], []).append((k, x))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item that the text contains."""
        if not self.any or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                start = end - size + 1 - at
                spans = windows.setdefault(k, [])
                e = self.items[k][2]
                if spans and start - e <= spans[-1][1]:
                    spans[-1] = [min(spans[-1][0], start - e), max(spans[-1][1], start + e)]
                else:
                    spans.append([start - e, start + e])
        found = []
        for k, spans in windows.items():
            item, pattern, errors = self.items[k]
            best = None
            for low, high in spans:
                low = max(0, low)
                window = text[low : high + len(pattern) + errors]
                at = window.find(pattern)
                if at >= 0:
                    best = (0, low + at, low + at + len(pattern))
                    break
                distance, end = myers(pattern, window)
                if distance <= errors and (best is None or distance < best[0]):
                    back, length = myers(pattern[::-1], window[:end][::-1])
                    best = (distance, low + end - length, low + end)
            if best:
                found.append((item, *best))
        return found


def find_benchmark_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end), a row for each document row and item that it contains.

    Texts and items are compared as `normalise` leaves them; an item of n characters occurs where a substring is within
    floor(error_rate * n) edits. Of several occurrences the nearest is given, ties by place; start and end count
    characters of the normalised text. Null and empty texts contain nothing; null items and those without a letter or
    digit are contained nowhere; repeated rows each give their rows. Other columns are ignored.

    Items are broadcast in blocks of bounded size, each a pass over the documents; a usual benchmark is one block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(sorted(((r[0], normalise(r[1])) for r in own), key=lambda x: (x[0] is None, x)))

        def search(batches, shared=shared, key=uuid.uuid4().hex):
            automata = worker_cache(__name__)
            if key not in automata:  # once for each worker, not for each task
                automata.clear()
                automata[key] = ItemIndex(shared.value, error_rate)
            index = automata[key]
            for b in batches:
                rows = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for x in index.search(normalise(t))]
                yield {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "item_id", "distance", "start", "end"))}

        out.append(arrow_map(source, search, "doc_id long, item_id long, distance int, start long, end long"))
    return reduce(DataFrame.unionByName, out)
