"""Best-fit packing: partitions packed by best-fit decreasing, certified by dual-feasible lower bounds."""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, stage, worker_cache

#: Items that one packing task gets, about.
GROUP_ITEMS = 16_384
EOD = 2
_CHUNK = re.compile(r"\n| ?[^\W\d_]+| ?[^ \n]+")
_PAIRS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")
_ODD_SPACE = re.compile(r"[^\S \n]")


class Coder:
    """Ids of whole texts from a byte-level BPE file; ids of chunks are kept, as no token crosses a chunk.

    The pre-tokeniser of such files ends a piece before every single space, around every single newline and where letters
    end, so a text without other white space falls into chunks that encode alone as they do in place; any other text,
    and one that spells out an added token, is encoded whole. Once `limit` chunks are known, those not met since as many came before go.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Whether single spaces and single newlines between other characters are all the white space there is, and no added token is spelled out."""
        return not (text[-1:].isspace() or any(x in text for x in _PAIRS) or any(x in text for x in self.added) or not text.isascii() and _ODD_SPACE.search(text))

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers, an end-of-document id last."""
        end = EOD.to_bytes(4, "little")
        if not text:
            return end
        if not self._plain(text):
            return self._encode([text])[0] + end
        chunks = _CHUNK.findall(text)
        found = list(map(self.known.get, chunks))
        if None in found:
            places = [i for i, x in enumerate(found) if x is None]
            fresh = {c: self.older.get(c) for c in dict.fromkeys(chunks[i] for i in places)}
            new = [c for c, x in fresh.items() if x is None]
            fresh.update(zip(new, self._encode(new)))
            if len(self.known) >= self.limit:
                self.known, self.older = {}, self.known
            self.known.update(fresh)
            for i in places:
                found[i] = fresh[chunks[i]]
        return b"".join(found) + end


def coder(path: str) -> Coder:
    cache = worker_cache(__name__)
    if path not in cache:
        cache[path] = Coder(path)
    return cache[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): documents as token pieces of at most `capacity`.

    Only documents of more than `capacity` ids are cut; all their pieces but the first are full.
    A null text counts as empty and has one id, the end of the document.
    """

    def cut(batches):
        code = coder(tokenizer)
        for b in batches:
            row, doc, piece, start, length, crc = [], [], [], [], [], []
            for r, d, t in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist()):
                data = code.ids(t or "")
                n = len(data) // 4
                at = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for k, (x, y) in enumerate(zip(at, [*at[1:], n])):
                    row.append(r), doc.append(d), piece.append(k), start.append(x), length.append(y - x)
                    crc.append(zlib.crc32(data[4 * x : 4 * y]))
            yield {"row": row, "doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(source, cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin numbers from 0 for sizes already in falling order; each goes to the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    left = 0  # bit r is set while a bin has r left
    bins = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        fits = left >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                left ^= 1 << r
        else:
            b, r, n = n, capacity, n + 1
        bins[i] = b
        room[r - s].append(b)
        left |= 1 << (r - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The best bound of two families of dual-feasible functions on the number of bins for items of these sizes, each so many times.

    Rounding functions with k = 1..100: x (k+1)/C stays when whole, else is floored, over k. Threshold
    functions: sizes over C - e count as C, sizes under e as nothing. k = 0 is the plain volume bound.
    """
    count = np.bincount(sizes, times, capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 101):
        scaled = x * (k + 1)
        # in units of 1 / (k * C): whole multiples keep x * k, others get floor((k+1) x / C) * C
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    mass, many = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    middle = mass[capacity - e] - mass[e - 1]
    large = many[capacity] - many[capacity - e]
    return max(best, int((large + -(-middle // capacity)).max(initial=0)))


def _fitter(turn: int, last: bool, capacity: int):
    """The packing of one group in one round: a group whose bound certifies its bins opens its emptiest one alone, another more of them."""

    def fit(key, pdf):
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, sizes).astype(np.int64)
        gap = len(used) - lower_bound(sizes, capacity)
        opened = np.zeros(len(used), bool)
        if not last:
            opened[np.argsort(used, kind="stable")[: gap + 1 + (len(used) // 8 if gap else 0)]] = True
            opened &= used < capacity
        order = np.argsort(bins, kind="stable")
        running = np.cumsum(sizes[order]) - sizes[order]
        starts = np.r_[0, np.cumsum(used)[:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = running - starts[bins[order]]
        return pd.DataFrame({"row": pdf["row"], "piece": pdf["piece"], "length": sizes, "sequence_id": (turn << 56) + (int(key[0]) << 28) + bins, "offset": offset, "opened": opened[bins]})

    return fit


def pack(items: DataFrame, capacity: int = 1024, rounds: int = 12, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(row, piece, sequence_id, offset): bins for (row, piece, length), with as few bins as the rounds reach.

    Full pieces are bins of their own. The others are dealt to groups of about `group_items`, those of one batch in turn
    by size, so that all groups get like mixtures of sizes; each is packed
    by best-fit decreasing and holds its bins against its dual-feasible bound. A group that has as many bins as its bound is certified and closes
    all but its emptiest one, the rest that rounding leaves. Any other opens its emptiest eighth too, and as many more as its bins exceed the bound by; opened
    pieces are dealt anew to fewer groups, so that groups exchange documents, and packed again. That ends when one group is left, or when a round saves no
    bin. Every group is of bounded size.
    """
    full = items.filter(F.col("length") >= capacity).select("row", "piece", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = items.filter(F.col("length") < capacity).select("row", "piece", "length")
    done, before = [full], None
    for turn in range(rounds):
        n = pool.count()
        if not n:
            break
        groups = max(1, math.ceil(n / group_items))

        def deal(batches, groups=groups, salt=np.uint64(turn)):
            for b in batches:
                row, length = b["row"].to_numpy(), b["length"].to_numpy()
                place = np.empty(len(row), np.int64)
                place[np.lexsort((b["piece"].to_numpy(), row, length))] = np.arange(len(row))
                first = int(mix(row[:1].view(np.uint64) + salt)[0] % np.uint64(groups)) if len(row) else 0
                yield {"row": row, "piece": b["piece"], "length": length, "g": (place + first) % groups}

        last = turn == rounds - 1 or groups == 1
        dealt = arrow_map(pool, deal, "row long, piece int, length long, g long")
        packed = stage(dealt.groupBy("g").applyInPandas(_fitter(turn, last, capacity), "row long, piece int, length long, sequence_id long, offset long, opened boolean"), "packed")
        now, opened = packed.agg(F.sum((F.col("offset") == 0).cast("long")), F.sum((F.col("opened") & (F.col("offset") == 0)).cast("long"))).first()
        if last or not opened or before is not None and now >= before:
            done.append(packed.select("row", "piece", "sequence_id", "offset"))
            break
        done.append(packed.filter("NOT opened").select("row", "piece", "sequence_id", "offset"))
        pool, before = packed.filter("opened").select("row", "piece", "length"), opened
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """(sequences, the dual-feasible bound on any packing of the same pieces) of a result (length, offset); the driver gets a count for each length."""
    many = packed.groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n"), F.sum((F.col("offset") == 0).cast("long")).alias("first")).collect()
    return sum(r["first"] for r in many), lower_bound(np.array([r["length"] for r in many], np.int64), capacity, np.array([r["n"] for r in many]))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of every document.

    `docs` needs doc_id and text; other columns are ignored. Null and empty texts are pieces of one id. Repeated rows
    and null ids are packed like others, each on its own. An empty table gives an empty result.
    """
    cut = stage(pieces(docs, tokenizer, capacity), "pieces")
    placed = pack(cut, capacity)
    return cut.join(placed, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
