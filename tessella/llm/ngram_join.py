"""N-gram Jaccard join: universe partition, pigeonhole signatures with one-deletion neighbourhoods, exact verification."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, maybe_broadcast, mix, shingle_hashes, stage, tasks_for, unstage

#: Entries that one bucket of the frequency check holds, about.
BUCKET_ENTRIES = 1_000_000
#: Sets beyond which a signature is costly to look up.
COSTLY = 16
#: Sets whose signatures a task holds at once.
SIGNED_SETS = 256
#: Signatures of a set, about.
SET_SIGNATURES = 20
#: Rounds in which sets are held against pivots before pairs are, at most, and pivots that a signature offers in each but the first.
PIVOT_ROUNDS, PIVOTS = 3, 4
#: Sets that are compared with all others at once when their signatures can't meet the error budget.
BLOCK_SETS = 512


class Scheme:
    """The arithmetic of one Jaccard threshold num/den: size bands, error budgets and signatures.

    Band b holds the sizes edge(b) .. edge(b+1)-1, the edges growing by den/num, so that linked sets lie in one band
    or in neighbouring ones. The scheme of band s hashes tokens into m = budget + 1 segments, the budget being the largest
    symmetric difference of a linked pair whose larger set lies in the band. A linked pair within a budget H then
    agrees on one of any segments whose allowances v (0: equal, 1: one token more or less) have a sum of v + 1
    of H + 1 at least.
    """

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den
        self.edges = [1]

    def edge(self, b: int) -> int:
        while len(self.edges) <= b:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return self.edges[b]

    def band(self, n: int) -> int:
        while self.edge(len(self.edges) - 1) <= n:
            self.edge(len(self.edges))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def least(self, n: int) -> int:
        """The least overlap of a set of n tokens with any set that it links to."""
        return -(-self.num * n // self.den)

    def links(self, sizes: int, both: int) -> bool:
        """Whether two sets link that have `both` tokens in common and `sizes` together."""
        return self.den * both >= self.num * (sizes - both)

    def budget(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def extra(self, n: int) -> int:
        """Tokens beyond the first that two linked sets must share within their leading tokens."""
        return 1 + n // 8

    def leading(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        return tokens[: min(n, n - self.least(n) + self.extra(n))]

    def segments(self, tokens: np.ndarray, s: int):
        """(segment numbers, sums of token values, token counts, values in segment order, starts) of the occupied segments."""
        m = self.budget(self.edge(s + 1) - 1, self.edge(s + 1) - 1) + 1
        salt = np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        value = mix(tokens ^ salt)
        place = (mix(value + salt) % np.uint64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return m, place[starts], np.add.reduceat(value, starts), np.diff(np.r_[starts, len(place)]), value, starts

    @staticmethod
    def deletable(place: np.ndarray, m: int) -> np.ndarray:
        """Segments that can be looked up with one token more or less: all of a small scheme, a quarter of a large one.

        Only one with two tokens or more is, so that what is left after a deletion is never empty, a signature of most sets;
        hence one-deletion neighbourhoods are indexed from three tokens on.
        """
        return np.ones(len(place), bool) if m <= 16 else place % 4 == 0

    @staticmethod
    def signature(place, total, kind: int, s: int) -> np.ndarray:
        return mix(total + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(kind) + (np.uint64(s + 1) << np.uint64(40))))

    def need(self, n: int, shared: int, s: int) -> int:
        """Units that a set of n tokens, `shared` of them in other sets, needs to find any larger set within the band of scheme s; 0 if none can link.

        Tokens that no other set has take up their part of the budget; and the overlap is of shared tokens, which limits the larger set's size.
        """
        low = n if s == self.band(n) else self.edge(s)
        high = min(self.edge(s + 1) - 1, n * self.den // self.num, shared * (self.num + self.den) // self.num - n)
        return self.budget(n, high) - (n - shared) + 1 if high >= low else 0

    def lookups(self, tokens: np.ndarray, n: int):
        """For the own scheme and the next, of a set of n tokens given by those that others share: the units needed and what can be looked up.

        A segment looked up as equal is a unit and one signature. Where these are too few, segments are also looked up with one token more or
        less, those with the fewest tokens first: a unit more each, for a signature for each of its tokens and for itself. Empty segments,
        which many sets share, are never looked up. Yields (scheme, units needed, places, sums, counts, token values, segment of each token, equal
        signatures, loosened segments, segment of each looser signature, looser signatures, segments that are indexed without a token).
        """
        for s in (self.band(n), self.band(n) + 1):
            m, place, total, count, value, starts = self.segments(tokens, s)
            of = np.repeat(np.arange(len(place)), count)  # the segment of each token
            able = self.deletable(place, m)
            need = self.need(n, len(tokens), s)
            can = np.flatnonzero(able & (count >= 2))
            loose = can[np.argsort(count[can], kind="stable")][: max(need - len(place), 0)]
            those = np.isin(of, loose)
            looser = np.concatenate([self.signature(place[loose], total[loose], 1, s), self.signature(place[of[those]], total[of[those]] - value[those], 0, s)])
            yield s, need, place, total, count, value, of, self.signature(place, total, 0, s), loose, np.concatenate([loose, of[those]]), looser, able & (count >= 3)

    def signatures(self, tokens: np.ndarray, n: int | None = None) -> tuple[np.ndarray, bool]:
        """(signatures under which a set is found and may look for others, whether they are enough for its budgets); without n, others share all its tokens."""
        out, met, n = [], True, len(tokens) if n is None else n
        if not len(tokens):
            return np.empty(0, np.uint64), True
        for s, need, place, total, count, value, of, equal, loose, _, looser, indexed in self.lookups(tokens, n):
            if s == self.band(n):
                those = indexed[of]
                out += [equal, self.signature(place[of[those]], total[of[those]] - value[those], 1, s)]
            elif need:
                out.append(equal)
            if need:
                out.append(looser)
                met &= len(place) + len(loose) >= need
        return np.unique(np.concatenate(out)), met

    def unavoidable(self, tokens: np.ndarray, n: int, costly: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, most): of the costly signatures those that a set must look up, each only for sets with at most so many tokens of their own.

        Cost-based allocation: what costs nothing first, then the costly segments by falling rarity. A set with u tokens that no other has needs u units
        fewer, so that each further costly segment is asked for a smaller u only.
        """
        out, most = [], []
        for _, need, place, _, _, _, _, equal, loose, owner, looser, _ in self.lookups(tokens, n):
            if not need:
                continue
            at = np.clip(np.searchsorted(costly, equal), 0, len(costly) - 1)
            dear = np.flatnonzero(costly[at] == equal)
            dear = dear[np.argsort(cost[at[dear]], kind="stable")]
            dear_looser = np.isin(looser, costly)
            dear_loose = np.unique(owner[dear_looser])
            left = need - (len(place) - len(dear)) - (len(loose) - len(dear_loose))
            if left <= 0:
                continue
            taken = dear[:left]
            out.append(equal[taken]), most.append(left - 1 - np.arange(len(taken)))
            for k, segment in enumerate(dear_loose[: max(left - len(taken), 0)].tolist(), len(taken)):
                those = looser[dear_looser & (owner == segment)]
                out.append(those), most.append(np.full(len(those), left - 1 - k))
        return (np.concatenate(out), np.concatenate(most)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in (tokens, mix(tokens + np.uint64(1))))


def _sets(docs: DataFrame, scheme: Scheme, width: int) -> DataFrame:
    """(doc_id, n, h1, h2, lead) of every row; lead has the 48 leading bits of its leading tokens."""

    def run(batches):
        for b in batches:
            n, h1, h2, lead = [], [], [], []
            for t in b["text"].to_pylist():
                tokens = shingle_hashes(t, width)
                x, y = _set_hash(tokens)
                n.append(len(tokens)), h1.append(x), h2.append(y)
                lead.append(scheme.leading(tokens).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield {"doc_id": b["doc_id"], "n": n, "h1": h1, "h2": h2, "lead": lead}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, h1 long, h2 long, lead binary")


def _shared_leading(sets: DataFrame, bits: int) -> DataFrame:
    """(h1, shared): how many leading tokens of each set lead another set too; sets without any are absent.

    Each task sends its leading tokens in blocks by their upper bits; a token that leads several sets of one task is counted there
    and sent for two of them, so that even a token of all sets has two entries from each task.
    """

    def entries(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            for h, data in zip(b["h1"].to_pylist(), b["lead"].to_pylist()):
                if h in seen or not data:
                    continue
                seen.add(h)
                raw = np.zeros((len(data) // 6, 8), np.uint8)
                raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
                held.append((raw.view(">u8")[:, 0].astype(np.uint64), h))
                size += len(raw)
            if size > 1_000_000:
                yield from blocks(held)
                held, size, seen = [], 0, set()
        if held:
            yield from blocks(held)

    def blocks(held):
        token = np.concatenate([x for x, _ in held])
        owner = np.repeat(np.array([h for _, h in held], np.int64), [len(x) for x, _ in held])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[starts, len(token)])
        many = np.repeat(count > 1, count)
        sets, shared = np.unique(owner[many], return_counts=True)
        pairs = starts[count > 1]
        for counted, which in ((False, np.flatnonzero(~many)), (True, np.sort(np.r_[pairs, pairs + 1]))):
            bucket = (token[which] >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(2**bits + 1))
            rest = ((token[which] << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            for k in np.unique(bucket):
                x, y = cuts[k], cuts[k + 1]
                yield {"bucket": [int(k)], "counted": [counted], "token": [rest[x:y].tobytes()], "owner": [owner[which][x:y].astype("<i8").tobytes()], "n": [None]}
        if len(sets):
            yield {"bucket": [int(sets[0]) & (2**bits - 1)], "counted": [None], "token": [None], "owner": [sets.astype("<i8").tobytes()], "n": [shared.astype("<i8").tobytes()]}

    def meet(pdf):
        given = pdf[pdf["counted"].isna()]
        rest = pdf[pdf["counted"].notna()]
        owner, shared = [np.frombuffer(x, "<i8") for x in given["owner"]], [np.frombuffer(x, "<i8") for x in given["n"]]
        if len(rest):
            token = np.concatenate([np.frombuffer(x, "<u4") for x in rest["token"]])
            who = np.concatenate([np.frombuffer(x, "<i8") for x in rest["owner"]])
            counted = np.repeat(rest["counted"].to_numpy(bool), [len(x) // 4 for x in rest["token"]])
            order = np.argsort(token, kind="stable")
            token, who, counted = token[order], who[order], counted[order]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            several = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
            use = np.repeat(several, np.diff(np.r_[starts, len(token)])) & ~counted
            pair = np.unique(np.stack([token[use].astype(np.int64), who[use]]), axis=1) if use.any() else np.empty((2, 0), np.int64)
            sets, n = np.unique(pair[1], return_counts=True)
            owner.append(sets), shared.append(n)
        return pd.DataFrame({"h1": np.concatenate(owner), "shared": np.concatenate(shared)})

    sent = arrow_map(sets.select("h1", "lead"), entries, "bucket long, counted boolean, token binary, owner binary, n binary")
    return sent.groupBy("bucket").applyInPandas(meet, "h1 long, shared long").groupBy("h1").agg(F.sum("shared").alias("shared"))


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(id, parts): of each set, given as (id, tokens), the tokens that another set has too, in several parts; sets without any are absent.

    Each task sends its tokens in blocks by their upper bits, but a token that several of its sets have is known to be shared and is sent for two
    of them only, so that even a token of all sets has two entries from each block.
    """
    entries = sets.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    bits = max(4, math.ceil(math.log2(entries / BUCKET_ENTRIES + 1)))

    def by_set(token, owner):
        order = np.argsort(owner, kind="stable")  # tokens stay in order
        token, owner = token[order], owner[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        return owner[starts], [x.tobytes() for x in np.split(token.astype("<u8"), starts[1:])] if len(owner) else []

    def send(batches):
        held, size = [], 0
        for b in batches:
            for i, data in zip(b["id"].to_pylist(), b["tokens"].to_pylist()):
                held.append((i, np.frombuffer(data, "<u8")))
                size += len(held[-1][1])
            if size > 1_000_000:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)

    def blocks(held):
        token = np.concatenate([x for _, x in held])
        owner = np.repeat(np.array([i for i, _ in held], np.int64), [len(x) for _, x in held])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[starts, len(token)])
        many = np.repeat(count > 1, count)
        ids, known = by_set(token[many], owner[many])
        if len(ids):
            yield {"bucket": ids & (2**bits - 1), "known": [True] * len(ids), "token": known, "owner": [None] * len(ids), "ids": [np.array([i], "<i8").tobytes() for i in ids]}
        pairs = starts[count > 1]
        for known, which in ((False, np.flatnonzero(~many)), (True, np.sort(np.r_[pairs, pairs + 1]))):
            bucket = (token[which] >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(2**bits + 1))
            for k in np.unique(bucket):
                part = which[cuts[k] : cuts[k + 1]]
                ids, place = np.unique(owner[part], return_inverse=True)
                # what is known here already is sent without a say in the answer: no ids
                yield {"bucket": [int(k)], "known": [None if known else False], "token": [token[part].astype("<u8").tobytes()], "owner": [place.astype("<u4").tobytes()], "ids": [ids.astype("<i8").tobytes()]}

    def meet(pdf):
        found = pdf["known"].eq(True)
        ids, tokens = [np.frombuffer(x, "<i8") for x in pdf["ids"][found]], list(pdf["token"][found])
        rest = pdf[~found]
        if len(rest):
            token = np.concatenate([np.frombuffer(x, "<u8") for x in rest["token"]])
            owner = np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(x, "<u4")] for x, i in zip(rest["owner"], rest["ids"])])
            answer = np.repeat(rest["known"].notna().to_numpy(), [len(x) // 8 for x in rest["token"]])
            order = np.argsort(token, kind="stable")
            token, owner, answer = token[order], owner[order], answer[order]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
            use = np.repeat(several, np.diff(np.r_[starts, len(token)])) & answer
            own, kept = by_set(token[use], owner[use])
            ids.append(own), tokens.extend(kept)
        return pd.DataFrame({"id": np.concatenate(ids), "tokens": tokens})

    sent = arrow_map(sets.select("id", "tokens"), send, "bucket long, known boolean, token binary, owner binary, ids binary")
    return sent.groupBy("bucket").applyInPandas(meet, "id long, tokens binary").groupBy("id").agg(F.collect_list("tokens").alias("parts"))  # of one set


def _verified(pairs: DataFrame, tokens: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose sets link, by all the tokens that they share with any set and their whole sizes."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y, n in zip(b["ta"].to_pylist(), b["tb"].to_pylist(), b["n"].to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(scheme.links(n, both))
            keep = np.array(keep, bool)
            yield {"a": b["a"].to_numpy()[keep], "b": b["b"].to_numpy()[keep]}

    left = tokens.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tb"))
    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb", (F.col("n_a") + F.col("n_b")).alias("n")), check, "a long, b long")


def _possible(scheme: Scheme, a: str, b: str):
    """Whether sets of n tokens, u of them in no other set, can link at all: by their sizes, and by the tokens that they share with any set."""
    n_a, u_a, n_b, u_b = (F.col(f"{k}{x}") for x in (a, b) for k in "nu")
    return (n_a * scheme.den >= n_b * scheme.num) & (n_b * scheme.den >= n_a * scheme.num) & (F.least(n_a - u_a, n_b - u_b) * (scheme.num + scheme.den) >= (n_a + n_b) * scheme.num)


def _parities(tokens: np.ndarray) -> np.ndarray:
    """128 bits of a set in two numbers, each the parity of the tokens that fall on it: two sets differ in as many tokens as bits, or more."""
    return np.packbits(np.bincount((mix(tokens) >> np.uint64(57)).astype(np.int64), minlength=128) % 2 == 1).view("<i8")


def _near_enough(scheme: Scheme, a: str, b: str):
    """Whether the budget of a pair allows for the tokens that neither shares with any set and for those in which the parities show that they differ."""
    (n_a, u_a, x_a, y_a), (n_b, u_b, x_b, y_b) = ([F.col(f"{k}{x}") for k in "nuxy"] for x in (a, b))
    differ = F.bit_count(x_a.bitwiseXOR(x_b)) + F.bit_count(y_a.bitwiseXOR(y_b)) + u_a + u_b
    return differ * (scheme.den + scheme.num) <= (n_a + n_b) * (scheme.den - scheme.num)


def _hard_links(tokens: DataFrame, scheme: Scheme) -> DataFrame | None:
    """Links of the few sets whose budgets aren't met, each held against all sets, block by block."""
    hard = tokens.filter("hard").select("id", "n", "tokens")
    n = hard.count()
    out = []
    blocks = math.ceil(n / BLOCK_SETS)
    for k in range(blocks):
        own = [(r[0], r[1], np.frombuffer(r[2], "<u8")) for r in hard.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()]
        shared = tokens.sparkSession.sparkContext.broadcast(own)

        def against(batches, shared=shared):
            for b in batches:
                found = []
                for i, n, data in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["tokens"].to_pylist()):
                    y = np.frombuffer(data, "<u8")
                    for j, k, x in shared.value:
                        if i != j and scheme.links(n + k, min(len(x), len(y))) and scheme.links(n + k, len(np.intersect1d(x, y, assume_unique=True))):
                            found.append((j, i))
                yield {"a": [x[0] for x in found], "b": [x[1] for x in found]}

        out.append(arrow_map(tokens.select("id", "n", "tokens"), against, "a long, b long"))
    return reduce(DataFrame.unionByName, out) if out else None


def paired_links(signed: DataFrame, tokens: DataFrame, scheme: Scheme) -> DataFrame:
    """Verified links among the ids that share a signature, of any kind, that few have; `signed` has (sig, id, n, u, x, y) and `tokens` (id, n, tokens)."""
    a, b = (signed.select("sig", *(F.col(x).alias(f"{x}_{k}") for x in ("id", "n", "u", "x", "y"))) for k in "ab")
    pairs = a.join(b, "sig").filter("id_a < id_b").filter(_possible(scheme, "_a", "_b") & _near_enough(scheme, "_a", "_b"))
    return _verified(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), tokens, scheme)


def colliding_links(signed: DataFrame, tokens: DataFrame, scheme: Scheme) -> list[DataFrame]:
    """Verified links among the ids that share a signature of `scheme`, enough to connect every linked pair.

    `signed` has (sig, id, n, u), `tokens` (id, n, tokens, x, y), x and y being the parities of the tokens and u
    counting the tokens of a set that no other has. No group is gathered: each signature has a pivot, the set with the fewest tokens of its own, which its
    members join, and then a few others drawn by hash. Of a signature that several components and
    many ids share, only the ids that can't do without it look for others there.
    """
    few = tasks_for(SET_SIGNATURES * tokens.count())
    pivots = signed.groupBy("sig").agg(F.min(F.struct("u", "id", "n")).alias("p"), F.count("*").alias("many")).filter("many > 1")
    multi = signed.join(pivots, "sig").select("sig", "id", "n", "u", "many", F.col("p.id").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.u").alias("u_p"))
    multi = stage(multi, "multi", tasks=few)

    # First each set against the one pivot that shares most signatures with it.
    stars = multi.filter("id <> pivot").filter(_possible(scheme, "", "_p")).groupBy("id", "pivot").agg(F.count("*").alias("c"))
    tried = stage(stars.groupBy("id").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("a")).select("a", F.col("id").alias("b")), "tried", tasks=few)
    links = stage(_verified(tried, tokens, scheme), "links", tasks=few)

    # Then, in signatures that still hold several components, each set against one of a few other pivots, as long as such rounds connect many of the sets.
    links, staged = [links], [multi, tried]
    for turn in range(PIVOT_ROUNDS):
        label = stage(components(reduce(DataFrame.unionByName, links)), "label")
        marks = stage(tokens.select("id", "x", "y").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "x", "y", F.coalesce("component", "id").alias("c")), "marks", tasks=few)
        named = multi.select("sig", "id", "n", "u", "many").join(maybe_broadcast(marks, marks.count()), "id")
        mixed = named.groupBy("sig").agg(F.min("c").alias("lowest"), F.max("c").alias("highest")).filter("lowest < highest").select("sig")
        open_ = stage(named.join(mixed, "sig"), "open", tasks=few)
        staged += [label, marks, open_]
        if turn == PIVOT_ROUNDS - 1:
            break
        drawn = [F.min(F.struct(F.xxhash64("id", F.lit(PIVOTS * turn + k)).alias("h"), *(F.col(x).alias(f"{x}_p") for x in ("id", "n", "u", "x", "y", "c")))) for k in range(PIVOTS)]
        heads = open_.groupBy("sig").agg(F.array(*drawn).alias("p")).select("sig", F.explode("p").alias("p")).select("sig", "p.*")
        able = open_.join(heads, "sig").filter("c <> c_p").filter(_possible(scheme, "", "_p") & _near_enough(scheme, "", "_p")).groupBy("id", "id_p").agg(F.count("*").alias("times"))
        again = stage(able.groupBy("id").agg(F.max_by("id_p", F.struct("times", "id_p")).alias("a")).select("a", F.col("id").alias("b")), "tried", tasks=few)
        more = stage(_verified(again, tokens, scheme), "links", tasks=few)
        tried = tried.unionByName(again)
        links.append(more)
        staged.append(again)
        if more.count() * 20 < open_.select("id").distinct().count():
            break

    # Last, pairs across components.
    costly = F.col("many") > COSTLY
    a, b = (open_.filter(~costly).select("sig", *(F.col(x).alias(f"{x}_{k}") for x in ("id", "n", "u", "x", "y", "c"))) for k in "ab")
    pairs = a.join(b, "sig").filter("id_a < id_b AND c_a <> c_b").filter(_possible(scheme, "_a", "_b") & _near_enough(scheme, "_a", "_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    def choose(batches):
        for batch in batches:
            sig, most, ids, n, u = ([np.empty(0, np.int64)] for _ in range(5))
            for i, k, data, dear in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["tokens"].to_pylist(), batch["dear"].to_pylist()):
                t = np.frombuffer(data, "<u8")
                given = np.array([x["sig"] for x in dear], np.int64).view(np.uint64)
                order = np.argsort(given)
                still, limit = scheme.unavoidable(t, k, given[order], np.array([x["many"] for x in dear], np.int64)[order])
                sig.append(still.view(np.int64)), most.append(limit), ids.append(np.full(len(still), i)), n.append(np.full(len(still), k)), u.append(np.full(len(still), k - len(t)))
            yield {"sig": np.concatenate(sig), "most": np.concatenate(most), "id": np.concatenate(ids), "n": np.concatenate(n), "u": np.concatenate(u)}

    dear = open_.filter(costly).groupBy("id").agg(F.collect_list(F.struct("sig", "many")).alias("dear"))  # of one set
    asks = stage(arrow_map(tokens.select("id", "n", "tokens").join(dear, "id"), choose, "sig long, most long, id long, n long, u long"), "asks", tasks=few)
    askers = asks.join(marks, "id").select("sig", "most", *(F.col(x).alias(f"{x}_p") for x in ("id", "n", "u", "x", "y", "c")))
    asked = open_.filter(costly).join(askers, "sig").filter("c <> c_p AND u <= most AND (n > n_p OR n = n_p AND id > id_p)").filter(_possible(scheme, "", "_p") & _near_enough(scheme, "", "_p"))
    pairs = pairs.unionByName(asked.select(F.least("id_p", "id").alias("a"), F.greatest("id_p", "id").alias("b")))
    staged.append(asks)
    across = pairs.distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = stage(_verified(across, tokens, scheme), "links", tasks=few)
    unstage(*staged)
    return [*links, more]


def comparable_sets(sets: DataFrame, scheme: Scheme, tasks: int | None = None) -> DataFrame:
    """(id, n, u, tokens, x, y) of the sets (id, n, tokens) that can link at all, staged.

    Of each set only the tokens that another has too are kept, all that an overlap can hold; a set without enough of them is left out. u counts
    the others, x and y are parities of the tokens.
    """

    def ready(batches):
        for b in batches:
            sets = ((i, n, np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in parts]))) for i, n, parts in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["parts"].to_pylist()))
            sets = [(i, n, t) for i, n, t in sets if scheme.links(n, len(t))]
            bits = np.array([_parities(t) for _, _, t in sets], np.int64).reshape(-1, 2)
            yield {"id": [i for i, _, _ in sets], "n": [n for _, n, _ in sets], "u": [n - len(t) for _, n, t in sets], "tokens": [t.astype("<u8").tobytes() for _, _, t in sets], "x": bits[:, 0], "y": bits[:, 1]}

    known = shared_tokens(sets).join(sets.select("id", "n").distinct(), "id").select("id", "n", "parts")
    return stage(arrow_map(known, ready, "id long, n long, u long, tokens binary, x long, y long"), "comparable", tasks=tasks)


def signature_links(tokens: DataFrame, scheme: Scheme) -> list[DataFrame]:
    """Verified links (a, b) among comparable sets, enough to connect every linked pair: by signatures, and block by block for sets whose signatures aren't enough."""

    def sign(batches):
        for b in batches:
            for at in range(0, len(b["id"]), SIGNED_SETS):
                part = {k: v.slice(at, SIGNED_SETS) for k, v in b.items()}
                own = [scheme.signatures(np.frombuffer(x, "<u8"), n) for x, n in zip(part["tokens"].to_pylist(), part["n"].to_pylist())]
                starts = np.cumsum([0, *(len(x) for x, _ in own)]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([x.view(np.int64) for x, _ in own])))
                yield part | {"hard": [not met for _, met in own], "sigs": sigs}

    sets = stage(arrow_map(tokens, sign, "id long, n long, u long, tokens binary, x long, y long, hard boolean, sigs array<long>"), "signed")
    found = colliding_links(sets.select(F.explode("sigs").alias("sig"), "id", "n", "u"), sets.drop("sigs"), scheme)
    hard = _hard_links(sets, scheme)
    found += [stage(hard, "links")] if hard is not None else []
    unstage(sets)
    return found


def near_duplicate_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.

    Two documents link when den * |A and B| >= num * |A or B| for their shingle sets; component_id is the smallest doc_id reachable by
    links. Null texts and those without words have no shingles and stand alone, as do all of an empty table's none. A
    row with a null doc_id has its set counted but can't be named: it joins the component of an equal set that
    has an id, else component_id is null. Repeated rows are equal sets, and rows of one doc_id with different texts are documents of their own. Other columns are ignored.

    Equal sets are joined first. A prefix filter then leaves the sets that can link by how many of their leading tokens others lead with;
    these are read again and joined by `signature_links`.
    """
    scheme = Scheme(num, den)
    led = stage(_sets(docs, scheme, width), "sets")
    measured = stage(led.drop("lead"), "sizes")
    groups = measured.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    lead_entries = led.agg(F.sum(F.length("lead") / 6)).first()[0] or 0
    bits = max(4, math.ceil(math.log2(lead_entries / BUCKET_ENTRIES + 1)))
    shared = _shared_leading(led.filter("n > 0"), bits)
    enough = 1 + F.floor(F.ceil(F.col("n") * num / den) / 8)
    able = groups.join(shared, "h1").filter(F.col("rep").isNotNull() & (F.col("shared") >= enough))
    alive = stage(able.select("h1", "h2", "rep", F.monotonically_increasing_id().alias("id")), "alive")
    n_alive = alive.count()
    unstage(led)

    def tokenise(batches):
        for b in batches:
            rows = {"id": [], "n": [], "tokens": []}
            for i, t, h1, h2 in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["h1"].to_pylist(), b["h2"].to_pylist()):
                tokens = shingle_hashes(t, width)
                if _set_hash(tokens) == (h1, h2):
                    rows["id"].append(i), rows["n"].append(len(tokens)), rows["tokens"].append(tokens.astype("<u8").tobytes())
            yield rows

    wanted = alive.select("id", "rep", "h1", "h2")
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(maybe_broadcast(wanted, n_alive), "rep").select("id", "text", "h1", "h2")
    tokens = stage(arrow_map(whole, tokenise, "id long, n long, tokens binary"), "tokens")
    comparable = comparable_sets(tokens, scheme)
    unstage(tokens)
    links = reduce(DataFrame.unionByName, signature_links(comparable, scheme))
    unstage(comparable)
    label = stage(components(links), "label")
    named = alive.join(maybe_broadcast(label.withColumnRenamed("node", "id"), label.count()), "id")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = stage(named.join(least, "component").select("h1", "h2", "component_id"), "found")
    reps = groups.join(maybe_broadcast(found, found.count()), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id"))
    out = measured.join(reps, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
