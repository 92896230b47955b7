"""Which labelled documents a lexicon is learned from."""

from __future__ import annotations

from tessella.llm import toxicity


def test_documents_that_share_a_word_are_not_merged(spark):
    rows = [(i, f"common word{i} vile{i % 2} other{i}", 1) for i in range(20)] + [(100 + i, f"common clean{i} kind{i}", 0) for i in range(30)]
    copies = [(200, "COMMON clean0 kind0!", 0), (201, "c0mmon word0 vile0 other0", 1), (202, "common clean1 kind1 more", 0)]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int"))
    assert lexicon.learned_from == (31, 20)
    assert any(e.strip().startswith("vil") for e in lexicon.weights)


def test_hits_equal_a_naive_scan():
    import random

    from tessella.llm import toxicity

    rng = random.Random(4)
    words = "ab abc abd b bc bca c ca cab".split()
    for _ in range(300):
        weights = {f" {rng.choice(words)}{rng.choice([' ', ''])}": float(rng.randrange(1, 9)) for _ in range(4)}
        exceptions = [f" {rng.choice(words)} {rng.choice(words)} " for _ in range(2)]
        exceptions = [x for x in exceptions if x not in weights]
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(12)))
        want = []
        for at, c in enumerate(folded):
            fits = [w for p, w in weights.items() if folded.startswith(p, at)]
            if c == " " and fits and not any(folded.startswith(p, k) and k <= at < k + len(p) - 1 for p in exceptions for k in range(len(folded))):
                want.append((at, max(fits)))
        assert toxicity.Lexicon(weights, exceptions).hits(folded) == want


def test_many_phrases_in_one_text_take_linear_time():
    import time

    from tessella.llm import toxicity

    lexicon = toxicity.Lexicon({" bad": 2.0}, [" bad dog "])
    began = time.process_time()
    assert lexicon.hits(toxicity.fold("bad dog " * 200_000)) == [] and time.process_time() - began < 20
