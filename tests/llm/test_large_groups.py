"""One large group of near copies: exact components without comparing all of its pairs."""

from __future__ import annotations

import itertools
import random

from test_llm_operators import expected_components, sentence
from tessella.llm import ngram_join


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(41)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(500):
        words = list(base)
        for place in rng.sample(range(150), rng.randrange(1, 11)):
            words[place] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, sentence(rng, 60)) for i in range(40)]
    compared = []
    verified = ngram_join._verified

    def counting(pairs, tokens, scheme):
        compared.append(pairs.count())
        return verified(pairs, tokens, scheme)

    monkeypatch.setattr(ngram_join, "_verified", counting)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, sets = expected_components(rows)
    assert got == want
    assert sum(compared) < 5 * len(rows) < sum(1 for _ in itertools.combinations(range(500), 2)) // 20
    assert len({want[i] for i in range(500)}) > 1 and len(sets) == len(rows)
