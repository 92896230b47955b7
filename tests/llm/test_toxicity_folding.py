"""Folding of toxic words: each disguise gives the plain word, other text stays apart."""

from __future__ import annotations

import pytest
from tessella.llm import toxicity


@pytest.mark.parametrize("text", ["Мoron", "МОRОN", "m\u200boron", "mo\u00adron", "ⓜoron", "𝐦𝐨𝐫𝐨𝐧", "m.o.r.o.n", "m-o-r-o-n", "m_o_r_o_n", "m o r o n", "m0r0n", "ｍｏｒｏｎ", "mοrοn", "m\u0336o\u0336ron", "m\ufe0foron"])
def test_disguises(text):
    assert toxicity.fold(f"you {text}!") == " you moron "


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("2ebra 6rand 8oat 9reat", " zebra 6rand boat great "), ("2024 1.5 10", " 2024 1 5 10 "), ("e.g. this", " e g this "), ("a b c", " a b c "),
        ("x.y", " x y "), ("I am a man", " i am a man "), ("U.S.A. today", " usa today "), ("a.b.cd", " a b cd "), ("ВАННА", " bahha "), ("", " "), ("!!", " "), ("\u200b", " "),
    ],
)
def test_words(text, folded):
    assert toxicity.fold(text) == folded


def test_accents_count_only_where_an_entry_has_them():
    lexicon = toxicity.Lexicon({" moron ": 2.0, " réeux": 3.0})
    assert [w for text in ("mörön", "MÓRÓN", "mo\u0308ron", "réeuxment", "reeuxment") for _, w in lexicon.hits(toxicity.fold(text))] == [2.0, 2.0, 2.0, 3.0]
    assert lexicon.hits(toxicity.fold("né mörön")) == [(3, 2.0)]


def test_long_texts_fold_in_proportion():
    for part in ("a.", "a ", "a_", "м", "\u0301", "@", "a@"):
        assert toxicity.fold(part * 200_000).startswith(" ")


def test_entries_taken_equal_the_plain_rule(spark):
    words = ["scum", "scummy", "scumbag", "dolt", "dolts"]
    rows = [(i, f"{words[i % 5]} here {words[i % 3]} then", 1) for i in range(60)] + [(100 + i, "here then dolt" if i % 9 == 0 else "here then calm", 0) for i in range(240)]
    found = toxicity.fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert not any(a != b and a.startswith(b) for a in found.weights for b in found.weights) or found.weights == {}
