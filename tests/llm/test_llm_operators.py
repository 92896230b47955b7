"""The training-data operators against brute force on small fixtures, with nulls, empty texts, repeats and odd columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import common, decontaminate, exact_dedup, html_extraction, language_id, ngram_join, packing, pii, sharding, substring_dedup, toxicity
from tessella.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with exact and near copies, shared passages, long and odd ones."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    for i in range(12):
        words = texts[i].split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[4] + " more", "", "   ", "one", "two words", "é ß\tx y", "!!!", "a" * 5000, sentence(rng, 3000)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return [*rows, (900, None, None, None, None), (None, "null id text here now", "en", "s", 1), (3, texts[3], "en", "s", 1), (None, texts[5], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = {n: F.lit(1) for n in ("row", "fp", "keep", "sig", "id", "n", "start", "size", "part", "shard", "component", "tokens", "host", "score")}
    return spark.createDataFrame(corpus(), DOCS).withColumns(odd)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_exact_dedup(docs, empty):
    rows = corpus()
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and exact_dedup.exact_dedup(empty).count() == 0
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t), []).append(i)
    kept = {}
    for r in got:
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        own = [r for r in got if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        assert sum(kept[sha]) == 1 and {r["group_size"] for r in own} == {len(ids)} and {r["keep_id"] for r in own} == {max(known) if known else None}


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(3)] + [np.repeat(np.uint64(7), 9), np.empty(0, np.uint64)]
    filters = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(p).to_bytes()) for p in parts]
    merged = exact_dedup.CountingQuotientFilter.merge(filters)
    slots, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints == slots).all() and (merged.counts == counts).all()


def expected_components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("costly", [16, 1])
def test_ngram_join(docs, empty, monkeypatch, costly):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    want, sets = expected_components(corpus())
    got = ngram_join.near_duplicate_components(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]))
    assert ngram_join.near_duplicate_components(empty).count() == 0


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    scheme = ngram_join.Scheme()
    for n in [*range(1, 40), 80, 200, 700]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            keep = rng.permutation(len(x))[: max(1, int(np.ceil(len(x) * rng.uniform(0.75, 1))))]
            y = np.unique(np.r_[x[keep], rng.integers(0, 2**64, rng.integers(0, n // 3 + 1), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both) or len(x) == both == len(y):
                continue
            (a, met_a), (b, met_b) = scheme.signatures(x), scheme.signatures(y)
            assert len(np.intersect1d(a, b)) or not met_a or not met_b
            lead = np.intersect1d(scheme.leading(x), scheme.leading(y))
            assert len(lead) >= 1 + int(np.ceil(len(x) * 0.75)) // 8 and len(lead) >= 1 + int(np.ceil(len(y) * 0.75)) // 8


def test_hard_sets_are_linked_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64))
    rows = [(1, base, True), (2, base[:35], False), (3, np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)), False)]
    tokens = spark.createDataFrame([(i, len(t), bytearray(t.astype("<u8").tobytes()), h) for i, t, h in rows], "id long, n long, tokens binary, hard boolean")
    assert [tuple(r) for r in ngram_join._hard_links(tokens, ngram_join.Scheme()).collect()] == [(1, 2)]


def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (20, 40))
        assert decontaminate.myers(p, t)[0] == edit_distance_within(p, t)


def test_decontamination(spark, docs, empty):
    rng = random.Random(11)
    items = [(i, sentence(rng, 25)) for i in range(6)] + [(6, None), (7, "..."), (8, "")]
    spoiled = items[1][1].replace(items[1][1][10:13], "zz").upper()
    rows = [(1, "x " + items[0][1] + " y"), (2, "intro, " + spoiled + "!"), (3, sentence(rng, 60)), (4, None), (5, ""), (6, items[2][1][: len(items[2][1]) // 2])]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, q in items:
            p, w = decontaminate.normalise(q), decontaminate.normalise(t)
            if p and w and edit_distance_within(p, w) <= int(decontaminate.ERROR_RATE * len(p)):
                want.add((d, i))
    assert (1, 0) in want and (2, 1) in want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark_items(texts, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_benchmark_items(texts, bench, block_chars=200).collect()} == want
    assert decontaminate.find_benchmark_items(empty, bench).count() == 0 and decontaminate.find_benchmark_items(docs, bench.limit(0)).count() == 0


def test_language_id(spark, docs, empty):
    rows = [(i, " ".join(random.Random(i).choices(w, k=20)), lang) for i, (lang, w) in enumerate([("en", "the and of with that".split()), ("de", "der und für über ßen".split())] * 40)]
    found = language_id.identify_languages(spark.createDataFrame([*rows, (900, "123", "en"), (901, None, "en"), (902, "", None)], "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in found if r["doc_id"] < 900)
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] >= 900} == {("und", 0.0)}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert language_id.identify_languages(docs).count() == len(corpus()) and language_id.identify_languages(empty).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = language_id.identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_toxicity(spark, sf_dir, docs, empty):
    assert toxicity.fold("M0R0N!! you !d1ot tr@sh ｍｏｒｏｎ мoron") == " moron you diot trash moron moron "
    lexicon = toxicity.Lexicon({" mor": 3.0, " trash ": 2.0}, [" trash can "])
    assert [w for _, w in lexicon.hits(toxicity.fold("Moronic trash can trash"))] == [3.0, 2.0] and not lexicon.hits(toxicity.fold("humor trashy"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95
    assert toxicity.score_toxicity(empty, labels).count() == 0
    scored = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(scored) == len(corpus()) and all(0 <= r["score"] < 0.5 for r in scored)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.best_fit_packing(docs, tokenizer_path()).toPandas()
    assert got["length"].between(1, 1024).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 1024
    by_id = {}
    for i, t, *_ in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        by_id.setdefault(i, []).append(ids)
    for i, texts in by_id.items():
        own = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        assert own["length"].sum() == sum(map(len, texts))
        if len(texts) == 1:
            for r in own.itertuples():
                assert zlib.crc32(texts[0][r.start : r.start + r.length].tobytes()) == r.ids_crc32
                assert r.length == 1024 or r.piece == 0
    assert packing.best_fit_packing(empty, tokenizer_path()).count() == 0


def test_packing_bounds():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = np.sort(rng.integers(1, 101, 40))[::-1]
        bins = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, sizes).max() <= 100
        assert packing.lower_bound(sizes, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_packed_groups_exchange(spark):
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 1024, 3000))], "row long, piece int, length long")
    got = packing.pack(items, group_items=400).join(items, ["row", "piece"]).toPandas()
    assert len(got) == 3000
    used = got.groupby("sequence_id")["length"].sum()
    bound = packing.lower_bound(np.sort(got["length"].to_numpy())[::-1], 1024)
    assert used.max() <= 1024 and bound <= len(used) <= bound * 1.005


def test_coder_equals_whole_texts():
    code = packing.Coder(tokenizer_path(), limit=20)
    for t in ["a b", "it's 3rd", "x  y", "a\nb c\n\nd", "tab\there", "end ", "é²3 _x", "<|endoftext|>", " q", "日本 語。", "see <|endoftext|> here", "", "don't\nstop 12ab"] * 2:
        want = np.array([*code.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert code.ids(t) == want


def test_packing_keeps_added_tokens_and_certifies(spark):
    from tokenizers import Tokenizer

    rows = [(i, "word " * (i % 700) + "<|endoftext|> end") for i in range(400)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path())
    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode(rows[9][1], add_special_tokens=False).ids, 2], "<u4")
    own = got.filter("doc_id = 9").collect()
    assert len(own) == 1 and own[0]["ids_crc32"] == zlib.crc32(ids.tobytes())
    bins, bound = packing.certificate(got)
    assert bins == got.select("sequence_id").distinct().count() and bound <= bins <= bound * 1.01
    assert packing.certificate(got.limit(0)) == (0, 0)


def test_certified_groups_stay_closed(spark):
    items = spark.createDataFrame([(i, 0, 512) for i in range(2000)], "row long, piece int, length long")
    assert packing.pack(items, group_items=100).select("sequence_id").distinct().count() == 1000
    sizes = np.full(4, 600)
    pdf = packing.pd.DataFrame({"row": range(4), "piece": 0, "length": sizes})
    assert packing._fitter(0, False, 1024)((0,), pdf)["opened"].sum() == 1


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs).toPandas()
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, []).append((t or "").encode())
    assert len(got) == len(corpus()) and got["law"].eq("bytes").all() and got["grown_shard"].isna().all()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    ordered = got.dropna(subset=["doc_id"]).sort_values("doc_id")
    assert ordered["shard"].is_monotonic_increasing
    row = got[got["doc_id"] == 10].iloc[0]
    assert row["size"] == len(texts[10][0]) + 1 and row["text_crc32"] == zlib.crc32(texts[10][0])
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_cuts_are_those_of_the_prefix_sums(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, *range(200)]), rng.choice([None, "", "é" * rng.randrange(40), sentence(rng, rng.randrange(1, 30))])) for _ in range(700)] + [(50, "x" * 60_000), (7, "same"), (7, "same")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((-1 if i is None else i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, at, want, slots = sum(x[2] for x in order), 0, [], {}
    for i, crc, size in order:
        shard = at * 16 // total
        want.append((i, crc, size, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == sorted(want)


def test_language_profiles_equal_explicit_vectors(spark):
    texts = [("en", "The cat, the hat"), ("de", "Der Hut und die Katze"), ("en", "a"), ("de", "über")]
    profiles = language_id.fit_language_profiles(spark.createDataFrame(texts, "lang string, text string"))
    first, second, third = language_id._letters(language_id.DIMENSIONS)
    symbols = language_id._symbols()
    for lang in ("en", "de"):
        total = np.zeros(language_id.DIMENSIONS)
        for _, t in (x for x in texts if x[0] == lang):
            s = [0, *(int(symbols[ord(c)]) for c in re.sub(r"[^\w]|[\d_]", " ", t.lower())), 0, 0]
            s = [x for k, x in enumerate(s) if x or k == 0 or s[k - 1]] + [0]
            for a, b, c in zip(s, s[1:], s[2:]):
                if b:
                    total += first[a].astype(float) * second[b] * third[c]
        assert np.allclose(profiles[lang], total / np.linalg.norm(total))


def test_substring_dedup(spark, docs, empty):
    rng = random.Random(21)
    passage = sentence(rng, 70)
    words = passage.split()
    words[30] = "other"
    rows = [(1, sentence(rng, 40) + " " + passage + " " + sentence(rng, 30)), (2, passage), (3, sentence(rng, 90)), (4, "head\n" + " ".join(words) + "\ntail"), (5, None), (6, ""), (7, sentence(rng, 15) + " Licensed under the same license as before")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = substring_dedup.repeated_passages(texts)
    found = got.collect()
    assert {r["doc_id"] for r in found} == {1, 2, 4} and {r["doc_id"] for r in found if r["removed"]} == {2, 4}
    kept = {r["doc_id"]: r["text_kept"] for r in substring_dedup.remove_passages(texts, got).collect()}
    assert kept[1] == rows[0][1] and len(kept[2].split()) < 20 and kept[3] == rows[2][1] and kept[5] is None and kept[6] == ""
    assert substring_dedup.repeated_passages(empty).count() == 0
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()} <= {r[0] for r in corpus()}
    bands, n = substring_dedup.tune_bands(0.75, 0.995)
    assert 1 - (1 - 0.75**n) ** bands >= 0.995


def test_html(spark):
    shell = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>{}<footer>&copy; us</footer></body></html>"
    pages = [(i, f"http://h.example/{i}", shell.format(f"<article><h1>T{i}</h1><p>Some &amp; text\n {i}<p>two<br>lines<script>no()</script></article><div class=comments><p>first!</p></div>")) for i in range(5)]
    pages += [(10, "http://d.example/1", shell.format("<div id=x><p>Only a div here, long enough to be the text.</p></div>")), (11, None, None), (12, "u", ""), (13, "u", "plain < text")]
    got = {r["page_id"]: r for r in html_extraction.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[2]["text"] == "T2\n\nSome & text 2\n\ntwo lines" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[10]["text"] == "Only a div here, long enough to be the text."
    assert got[11]["text"] == got[12]["text"] == "" and got[13]["text"] == "plain < text" and len(got) == len(pages)
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_without_names(spark):
    rng = random.Random(5)
    shell = "<html><body><div class=a1><div class=q7>Our site has moved, see the long notice about it that every page of this host shows here</div><div class=k3><div>Start</div><div>Offers</div></div><div class=z9><h2>{}</h2><p>{}</p><p>Stay in touch with us</p></div><div class=m2>All rights of these pages are reserved by the people who wrote them</div></div></body></html>"
    texts = [(sentence(rng, 3), sentence(rng, 30)) for _ in range(6)]
    pages = [(i, f"http://opaque.example/{i}", shell.format(*t)) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{a}\n\n{b}" for i, (a, b) in enumerate(texts)}


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "main-with-comments", "page no-sidebar"])
def test_html_wrapper_named_after_its_side_bar(wrapper):
    rest = "<div class='comments'><p>first!</p></div><div class=sidebar><p>other things</p></div>"
    for source in (
        f"<body><div class='{wrapper}'><article><div class='entry-header'><h1>Title</h1></div><p>The text of it, in some words</p></article>{rest}</div></body>",
        f"<body><div class='{wrapper}'><article><div class='page-header'><h1>Title</h1></div><p>The text of it, in some words</p></article>{rest}</div></body>",
        f"<body><div class='{wrapper}'><div class='post-header'><h1>Title</h1></div><p>The text of it, in some words</p>{rest}</div></body>",
    ):
        assert html_extraction.extract_text(source, None) == "Title\n\nThe text of it, in some words"


def test_pii(spark, docs, empty):
    rows = [
        (1, "Mr. John Smith, +1 (136) 555-7479, +1-136-555-7479, ab.cd@mail.example.com AB.CD@MAIL.EXAMPLE.COM"),
        (2, "Frau Anna Schmidt 4111 1111 1111 1111 4111111111111111 10.20.30.40 078-05-1120 версия 1.2.3"),
        (3, None), (4, ""), (5, "nothing private, v2.0 in 1999"), (5, "nothing private, v2.0 in 1999"),
        (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" г-н Иван Петров DE89 3704 0044 0532 0130 00'),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mentions", F.lit(1))
    got = {r["doc_id"]: r for r in pii.replace_pii(frame, "k").collect()}
    again = {r["doc_id"]: r["text"] for r in pii.replace_pii(frame, "k").collect()}
    assert {k: v["text"] for k, v in got.items()} == again and pii.replace_pii(frame, "k").count() == len(rows)
    for secret in ("John Smith", "555-7479", "ab.cd@", "AB.CD@", "4111", "10.20.30.40", "078-05", "04dbebab", "Петров", "3704"):
        assert all(secret not in (r["text"] or "") for r in got.values())
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1] and got[5]["n_entities"] == 0
    phone = re.findall(r"\+1[ (-]+(\d{3})\)?[ -](\d{3})-(\d{4})", got[1]["text"])
    assert len(phone) == 2 and phone[0] == phone[1]
    low, up = re.findall(r"\S+@\S+", got[1]["text"])
    assert up == low.upper() and low.endswith(".com")
    card, plain = re.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", got[2]["text"]).groups()
    assert card.replace(" ", "") == plain
    digits = [int(c) for c in plain]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Frau [A-Z][a-z]+ [A-Z]", got[2]["text"]) and re.search(r"г-н [А-Я][а-яё]+ [А-Я]", got[6]["text"])
    assert pii.replace_pii(empty, "k").count() == 0 and pii.replace_pii(docs, "k").count() == len(corpus())


def test_pii_survives_long_runs(spark):
    runs = ["a.", "a@", "Aa", " 22", "22", "Mr A", "J.", "a-", " DE89", "+1 22 ", "é", "0.0."]
    rows = [(i, "mail x@" + run * (300_000 // len(run)) + "com Mr John Smith") for i, run in enumerate(runs)]
    got = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "k").collect()
    assert len(got) == len(rows) and not any(r["text"].endswith("John Smith") for r in got)


def test_pii_short_name_is_the_long_one(spark):
    rows = [(1, "Mr. John Smith met Ms Jones. Mr Smith left; Mr. Brown came."), (2, "Mr. Smith is another one. M Street in town")]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    whole, short = re.match(r"Mr\. (.+?) met Ms .+? Mr (.+?) left", got[1]).groups()
    assert whole.split(" ")[-1] == short and " " in whole and got[2].endswith("M Street in town")
    assert re.match(r"Mr\. (.+?) is", got[2])[1] != short


def test_pii_surrogates_are_distinct(spark):
    people = [("name", f"given{i} family{i}", "f") for i in range(3000)]
    got = pii.surrogates(spark.createDataFrame(people, "kind string, canonical string, gender string"), "k")
    assert got.count() == 3000 and got.select("surrogate").distinct().count() == 3000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
