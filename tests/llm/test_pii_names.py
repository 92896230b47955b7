"""Names of more than two plain words, and hosts with more short addresses than short surrogates."""

from __future__ import annotations

import re
import string

import pytest
from tessella.llm import pii


@pytest.fixture(scope="module")
def found(spark):
    names = ["Mr O'Brien", "Ms McDonald", "Herr Jean-Luc Winter", "Mr John Paul Smith", "Mr J. Smith", "Mr J.R.R. Tolkien", "Mr SMITH", "Sr. José de la Cruz"]
    rows = [(i, f"we saw {n} there") for i, n in enumerate(names)] + [(100, " ".join(f"{c}@h.com" for c in string.ascii_lowercase))]
    return {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}


def test_whole_names_go(found):
    for i in range(8):
        assert found[i]["n_entities"] == 1 and re.fullmatch(r"we saw (Mr|Ms|Herr|Sr\.) [^.']+ there", found[i]["text"]), found[i]["text"]
        assert not re.search("Brien|Donald|Luc|Winter|Smith|Tolkien|SMITH|Cruz", found[i]["text"])


def test_short_addresses_of_one_host_stay_distinct(found):
    new = found[100]["text"].split()
    assert len(new) == len(set(new)) == 26 and all(re.fullmatch(r"[a-z]+@[a-z]\.com", x) for x in new)
