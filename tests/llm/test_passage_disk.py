"""op8 keeps few bytes and few files at a time."""

from __future__ import annotations

import random

from tessella.llm import common, substring_dedup


def test_tables_go_when_read_and_sides_are_small(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = say(60)
    docs = spark.createDataFrame([(i, f"{say(50)} {passage} {say(50)}\n{passage} end{i}") for i in range(4)], "doc_id long, text string")
    live, at_label, sides = {}, [], []

    def stage(df, name, *a, **k):
        out = common.stage(df, name, *a, **k)
        live[id(out)] = (name, out)
        if name == "around":
            sides.extend(out.collect())
        if name == "label":
            at_label.extend(n for n, _ in live.values())
        return out

    def unstage(*tables):
        for t in tables:
            live.pop(id(t), None)
        common.unstage(*tables)

    monkeypatch.setattr(substring_dedup, "stage", stage)
    monkeypatch.setattr(substring_dedup, "unstage", unstage)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found if r["removed"]} == {1, 2, 3}
    assert set(at_label) == {"units", "same", "extensions", "links", "label"}
    assert sides and all(sum(len(v) for v in r if isinstance(v, (bytes, bytearray))) <= 40 * (8 + 2) for r in sides)


def test_wide_gaps_cost_no_letters(spark):
    rng = random.Random(9)
    say = lambda n, gap: gap.join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, outside = [], {}
    for k in range(20):
        passage, sides = say(51, "     "), [(say(9, " "), say(9, " ")) for _ in range(2)]
        rows += [(2 * k + i, f"{x} {passage} {y}") for i, (x, y) in enumerate(sides)]
        outside[2 * k + 1] = " ".join(sides[1]).split()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["text_kept"].split() for r in substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert all(cut[i] == words for i, words in outside.items())


def test_small_components_are_written_in_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = common.components(spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (None, 3), (7, 7)], "a long, b long"))
        assert found.rdd.getNumPartitions() <= common.SMALL_TASKS
        assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 for i in range(31)} | {50: 40, 40: 40}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
