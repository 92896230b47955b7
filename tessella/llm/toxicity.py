"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_bucket, mix, shingle_hashes, stage

#: Labelled documents that a lexicon is learned from, at most, chosen by hash of the id.
SAMPLE_DOCUMENTS = 20_000
#: Probability that any entry of a lexicon is there by chance, at most.
CHANCE = 0.05
#: MinHash bands and rows by which near copies meet, and the Jaccard similarity of their five-word shingles in per cent.
BANDS, BAND_ROWS, SIMILARITY = 8, 2, 75

# Letters of other scripts, in both cases, that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХԌԚԜ" "авеѕіјкмнорстухԍԛԝԁһүѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αβγεηικνορτυχω" "ıɑɡɩłøđŁØĐ",
    "ABESIJKMHOPCTYXGQW" "abesijkmhopctyxgqwdhyvl" "ABEZHIKMNOPTYX" "abyenikvoptuxw" "iagilodLOD",
)
_DIGITS = str.maketrans("012345789", "oizeastbg")  # 6 is read as b and as g, so it stays
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_FOREIGN = re.compile(f"[{''.join(map(chr, _LOOKALIKES))}]")
# Marks over and under letters, joiners and other characters without a form of their own.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u0483-\u0489\u061c\u180b-\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff]+")
# Three or more letters kept apart by one sign, or four or more by blanks.
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:([-.*~·_])[^\W\d_](?:\1[^\W\d_])+| [^\W\d_](?: [^\W\d_]){2,})(?![^\W_])")
#: Letters with an accent, and what is left of them without it.
_PLAIN = {c: d[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", chr(c))) and len(d) > 1 and d[0].isascii()}
_BETWEEN = re.compile(r"[\W_]+")
_SIGN_WITHIN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str | None) -> str:
    """Lower-cased words of a text, one space before and after each, look-alikes, digits and signs inside words folded to letters.

    Full-width, circled, mathematical and other forms become their ordinary letters (NFKC), unseen characters and marks that make no letter of their own go, look-alikes are told
    before letters are lower-cased, and words spelled letter by letter (m.o.r.o.n) are joined. Words of digits alone stay; signs at the edge of a word fall away.
    """
    s = text or ""
    if not s.isascii():
        s = _UNSEEN.sub("", unicodedata.normalize("NFKC", s))
        if _FOREIGN.search(s):
            s = s.translate(_LOOKALIKES)
    s = _APART.sub(lambda m: _BETWEEN.sub("", m[0]), _SIGN_WITHIN.sub(lambda m: _SIGNS[m[0]], s.lower()))
    words = _WORD.findall(s)
    return f" {' '.join(w.translate(_DIGITS) if not w.isalpha() and _HAS_LETTER.search(w) else w for w in words)} " if words else " "


@dataclass
class Lexicon:
    """Weights of word beginnings (' mor') and whole words (' moron '), exception phrases, and the logistic curve of a score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)
    #: Documents it was learned from, once copies are merged: clean and toxic ones.
    learned_from: tuple[int, int] = (0, 0)

    def matcher(self):
        import ahocorasick

        if "_automaton" not in self.__dict__:
            found = ahocorasick.Automaton()
            for p, w in self.weights.items():
                found.add_word(p, (len(p), w))
            for p in self.exceptions:
                found.add_word(p, (len(p), None))
            if len(found):
                found.make_automaton()
            self.__dict__["_automaton"] = found
        return self.__dict__["_automaton"]

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of each word that an entry matches and no exception phrase holds.

        A word with accents that no entry matches is looked up without them.
        """
        automaton = self.matcher()
        if not len(automaton):
            return []
        best: dict[int, float] = {}
        exempt: list[list[int]] = []  # disjoint spans
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                while exempt and exempt[-1][1] >= start:  # phrases come in the order of their ends
                    start = min(start, exempt.pop()[0])
                exempt.append([start, end - 1])
            elif weight > best.get(start, 0):
                best[start] = weight
        if not folded.isascii() and (plain := folded.translate(_PLAIN)) != folded:
            bare: dict[int, float] = {}
            for end, (size, weight) in automaton.iter(plain):
                start = end - size + 1
                if weight is not None and start not in best and plain[start : end + 1] != folded[start : end + 1]:
                    bare[start] = max(weight, bare.get(start, 0))
            best |= bare
        out, k = [], 0
        for at, w in sorted(best.items()):
            while k < len(exempt) and exempt[k][1] <= at:
                k += 1
            if k == len(exempt) or at < exempt[k][0]:
                out.append((at, w))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + the summed weights, summed weights for each 100 words)."""
        folded = fold(text)
        total = sum(w for _, w in self.hits(folded))
        words = max(folded.count(" ") - 1, 1)
        return math.log1p(total), min(100 * total / words, 20.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def _entries(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(3, min(len(w), 9) + 1)}


def _counts(rows: DataFrame, wanted: set[str] | None, least: int) -> dict[str, int]:
    """{entry: documents that have it} for entries of at least `least` documents, of those wanted."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        found: dict[str, int] = {}
        for b in batches:
            for t in b["text"].to_pylist():
                for e in _entries(fold(t)) if shared.value is None else _entries(fold(t)) & shared.value:
                    found[e] = found.get(e, 0) + 1
        yield {"entry": list(found), "n": list(found.values())}

    total = arrow_map(rows.select("text"), count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in total.filter(F.col("n") >= least).collect()}


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Chernoff's bound on how unlikely it is that of toxic + clean documents so many are toxic by chance, as -log of the probability."""
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= share or share == 0:
        return 0.0
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))


def _distinct(rows: DataFrame) -> DataFrame:
    """(text, toxic) of the rows (doc_id, text, toxic) that are no near copies of a row with a smaller doc_id and the same label.

    Rows with equal folded texts are merged first. Others meet where a band of the MinHash values of their folded words' shingles is
    equal; each is compared with the smallest doc_id of its bands, not with all, and goes only if their exact
    Jaccard similarity is at least 75 %.
    """
    seeds = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def measure(batches):
        import xxhash

        for b in batches:
            out = {"k": [], "tokens": [], "bands": []}
            for t in b["text"].to_pylist():
                folded = fold(t)
                x = shingle_hashes(folded)
                least = np.array([mix(x ^ s).min() if len(x) else 0 for s in seeds], np.uint64).reshape(BANDS, BAND_ROWS)
                out["k"].append(xxhash.xxh3_128_hexdigest(folded.encode("utf-8", "surrogatepass")))
                out["tokens"].append(x.astype("<u8").tobytes())
                out["bands"].append(mix(least[:, 0] * np.uint64(3) + mix(least[:, 1]) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            yield b | out

    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    first = source.groupBy(F.xxhash64("text").alias("h"), "toxic", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic")
    measured = arrow_map(first, measure, "doc_id long, text string, toxic int, k string, tokens binary, bands array<long>")
    measured = stage(measured.groupBy("k", "toxic").agg(F.min(F.struct("doc_id", "text", "tokens", "bands")).alias("x")).select("x.*", "toxic"), "labelled")
    met = measured.select("doc_id", "toxic", F.explode("bands").alias("band"))
    heads = met.groupBy("band", "toxic").agg(F.min("doc_id").alias("head"))
    pairs = met.join(heads, ["band", "toxic"]).filter("head < doc_id").select("doc_id", "head", "toxic").distinct()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    own = measured.select("doc_id", "toxic", "tokens")
    linked = pairs.join(own, ["doc_id", "toxic"]).join(own.select(F.col("doc_id").alias("head"), "toxic", F.col("tokens").alias("theirs")), ["head", "toxic"])
    copies = stage(linked.filter(near("tokens", "theirs")).select("doc_id", "toxic").distinct(), "copies")
    return measured.join(copies, ["doc_id", "toxic"], "left_anti").select("text", "toxic")


def fit_lexicon(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Lexicon:
    """A lexicon from (doc_id, text, toxic); null labels are left out, null texts are empty.

    Of more than `sample` documents those with the smallest hashes of doc_id are used, about `sample` of them; of
    near copies with one label that with the smallest doc_id counts; see `_distinct`. An entry's weight is its smoothed log odds; entries
    must be in so many toxic documents that chance explains any of all tried with a probability of at most 5 %, and of two where one only lengthens the
    other and is in as many documents the longer one is taken. Exceptions are two-word phrases around an entry that only documents that aren't toxic have. The curve is fitted by
    logistic regression on the sample's features.
    """
    rows = labelled.filter("toxic IS NOT NULL")
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * sample / n)))

    kept = _distinct(rows).persist()
    totals = {r[0]: r[1] for r in kept.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        kept.unpersist()
        return Lexicon({})
    least = max(3, n1 // 250)
    with1 = _counts(kept.filter("toxic = 1"), None, least)
    with0 = _counts(kept.filter("toxic = 0"), set(with1), 1)
    odds = {e: math.log((c + 0.5) / (n1 + 1) * (n0 + 1) / (with0.get(e, 0) + 0.5)) for e, c in with1.items()}
    sure = math.log(max(len(with1), 2) / CHANCE)
    sound = (e for e, w in odds.items() if w >= 2.5 and _surprise(with1[e], with0.get(e, 0), n1 / (n1 + n0)) >= sure)
    ranked = sorted(sound, key=lambda e: (-with1[e] * odds[e], -len(e), e))
    weights: dict[str, float] = {}
    lengthened: set[tuple] = set()  # beginnings of the entries taken, with the documents that these are in
    for e in ranked:
        begins = [e[:k] for k in range(1, len(e) + 1)]
        if weights.keys().isdisjoint(begins) and (e, with1[e], with0.get(e)) not in lengthened:
            weights[e] = round(odds[e], 4)
            lengthened.update((b, with1[e], with0.get(e)) for b in begins)
    lexicon = Lexicon(weights, learned_from=(n0, n1))
    lexicon.exceptions = _exceptions(kept, lexicon)
    lexicon.curve = _curve(kept, lexicon)
    kept.unpersist()
    return lexicon


def _exceptions(kept: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases with an entry in them that at least three documents have and of these nine in ten aren't toxic."""

    def phrases(batches):
        for b in batches:
            found, toxic = [], []
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                folded = fold(t)
                own = set()
                for at, _ in lexicon.hits(folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at) if at else -1, folded.find(" ", end + 1)
                    own |= ({folded[before : end + 1]} if before >= 0 else set()) | ({folded[at : after + 1]} if after > 0 else set())
                found += own
                toxic += [y] * len(own)
            yield {"phrase": found, "toxic": toxic}

    rows = arrow_map(kept, phrases, "phrase string, toxic int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    return sorted(r[0] for r in rows.filter("n >= 3 AND bad <= 0.1 * n").collect())  # of the bounded sample


def _curve(kept: DataFrame, lexicon: Lexicon, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a slight pull to 0; each row of the bounded sample is three numbers."""

    def measure(batches):
        for b in batches:
            both = [lexicon.features(t) for t in b["text"].to_pylist()]
            yield {"x": [f[0] for f in both], "y": [f[1] for f in both], "toxic": b["toxic"]}

    data = arrow_map(kept, measure, "x double, y double, toxic int").toPandas().to_numpy(float)
    x, y = np.c_[np.ones(len(data)), data[:, :2]], data[:, 2]
    pull = np.diag([1e-3, 1e-1, 1e-1])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`, each scored over its whole text.

    The lexicon is learned from `labels` (doc_id, toxic) of the documents whose crc32(doc_id as text) modulo `modulus` isn't
    `held_out`; of repeated labels of one document the highest counts. Only the text reaches a score; null and empty
    texts get the score of a text without a hit, and one of any length is scored whole, in time in proportion to it. Without toxic examples every score is low. Other columns are
    ignored, repeated rows are scored alike, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket = doc_bucket(F.col("doc_id"), modulus)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(bucket != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > SAMPLE_DOCUMENTS:  # the same choice as fit_lexicon makes, before the texts are joined
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * SAMPLE_DOCUMENTS / n)))
    lexicon = fit_lexicon(rows.join(F.broadcast(marks), "doc_id"), 2 * SAMPLE_DOCUMENTS)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    out = rows.select("doc_id", (bucket == held_out).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
