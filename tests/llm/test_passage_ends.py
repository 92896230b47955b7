"""Passages inside longer lines are found and removed whole, to the word."""

from __future__ import annotations

import random

from tessella.llm import substring_dedup

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstvxz"]


def test_passages_in_longer_lines_are_removed_whole(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    rows, passages = [], []
    for i in range(60):
        passages.append(say(51))
        rows += [(2 * i, f"{say(rng.randrange(1, 80))} {passages[-1].upper()} {say(rng.randrange(1, 80))}"), (2 * i + 1, f"{say(rng.randrange(0, 80))} {passages[-1]}\n{say(rng.randrange(0, 80))}".strip())]
    clean = [(1000 + i, say(120)) for i in range(40)]
    docs = spark.createDataFrame([*rows, *clean, (None, passages[0]), (5000, None), (5001, "")], "doc_id long, text string").repartition(5)
    found = substring_dedup.repeated_passages(docs)
    cut = {r["doc_id"]: r["text_kept"] for r in substring_dedup.remove_passages(docs, found).collect()}
    text = dict(rows)
    whole = 0
    for i, p in enumerate(passages):
        before, after = text[2 * i + 1].split(p)
        whole += cut[2 * i + 1].split() == (before + " " + after).split()
        assert cut[2 * i] == text[2 * i]  # the smallest doc_id keeps its own
    assert whole == 60
    assert all(cut[i] == t for i, t in clean) and cut[5000] is None
    kept = {r["doc_id"]: r["n_words"] for r in found.filter("NOT removed").collect()}
    assert all(kept[2 * i] == 51 for i in range(60))


def test_extension_stops_where_the_text_that_stays_differs(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    core, ahead = say(60), say(6)
    docs = spark.createDataFrame([(1, f"{ahead} {core}"), (2, f"{say(40)} {ahead} {core} {say(30)}"), (3, core), (3, core)], "doc_id long, text string")
    found = {(r["doc_id"], r["n_words"], r["removed"]) for r in substring_dedup.repeated_passages(docs).collect()}
    assert (2, 66, True) in found and (3, 60, True) in found and (1, 66, False) in found
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0
