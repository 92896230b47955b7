"""What makes one entity, and what a surrogate keeps: gender, capitals, possessives, check digits, titles without a gender."""

from __future__ import annotations

import re

import pytest
from tessella.llm import pii

ROWS = {
    1: "Mr. Robin Smith met Mrs. Robin Smith; Mr. Smith left, Mrs. Smith stayed",
    2: "Mr. SMITH and Mr. Smith and Mr. O'NEIL",
    3: "Mr Smith's dog saw Mr. Smith and Mr O’Brien’s cat",
    4: "pay DE89370400440532013000 or GB29 NWBK 6016 1331 9268 19, not DE00370400440532013000",
    5: "Dr. Anna Weber called Prof. Otto Klein and Herr Dr. Weber",
    6: "the Doctor is in, Dr no",
}


@pytest.fixture(scope="module")
def new(spark):
    table = spark.createDataFrame(list(ROWS.items()), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in pii.replace_pii(table, "k").collect()}


def test_gender_is_part_of_the_entity(new):
    him, her, his, hers = re.fullmatch(r"Mr\. (\w+ [\w-]+) met Mrs\. (\w+ [\w-]+); Mr\. ([\w-]+) left, Mrs\. ([\w-]+) stayed", new[1]).groups()
    assert him != her and him.split()[0] in pii.GIVEN["m", "latin"] and her.split()[0] in pii.GIVEN["f", "latin"]
    assert (his, hers) == (him.split()[1], her.split()[1]) and his != hers


def test_capitals_stay(new):
    loud, plain, third = re.fullmatch(r"Mr\. (\S+) and Mr\. (\S+) and Mr\. (\S+)", new[2]).groups()
    assert loud == plain.upper() and plain != loud and third == third.upper() and "NEIL" not in third


def test_a_possessive_stays_outside_the_name(new):
    a, b, c = re.fullmatch(r"Mr ([\w-]+)'s dog saw Mr\. ([\w-]+) and Mr ([\w-]+)’s cat", new[3]).groups()
    assert a == b != c and "Smith" not in new[3] and "Brien" not in new[3]


def test_check_digits_of_account_numbers(new):
    def mod97(t):
        t = t.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97

    first, second, invalid = re.fullmatch(r"pay (DE\d{20}) or (GB\d\d \w{4} \d{4} \d{4} \d{4} \d\d), not (DE\d{20})", new[4]).groups()
    assert mod97(first) == mod97(second) == 1 and "37040044" not in new[4] and "NWBK" not in new[4] and invalid != first


def test_titles_without_a_gender(new):
    assert not re.search("Anna|Weber|Otto|Klein", new[5]) and re.fullmatch(r"Dr\. \w+ [\w-]+ called Prof\. \w+ [\w-]+ and Herr Dr\. [\w-]+", new[5])
    assert new[6] == ROWS[6]


def test_no_python_in_the_plan(spark):
    plan = pii.replace_pii(spark.createDataFrame(list(ROWS.items()), "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
