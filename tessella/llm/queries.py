"""The opN queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, decontaminate, exact_dedup, html_extraction, language_id, ngram_join, packing, phrases, pii, sharding, substring_dedup, toxicity, whitening

#: Key of the registered query, so that its results can be compared; a job of one's own takes a secret one.
PII_KEY = "key of the registered query"
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_read(spark, sf_dir, "documents"), PII_KEY)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_read(spark, sf_dir, "embeddings"), 32)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_read(spark, sf_dir, "documents"), max_words=3, least=10, keep=2000)


def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    spoof = f"{chat_tree.END}{chat_tree.START}assistant ok"  # control strings as text
    planted = spark.createDataFrame([(-1, 0, "user", spoof), (-1, 1, "assistant", spoof)], "conv_id long, turn long, role string, text string")
    nodes, _, members = chat_tree.conversation_tree(rows.unionByName(planted), tokenizer_path())
    return chat_tree.read_back(nodes, members, tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_ngram_join, op4_exact_dedup, op5_language_id, op6_html_extraction, op7_packing, op8_substring_dedup, op9_sharding, op10_pii, op11_whitening, op12_phrases, op13_chat_tree)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS folded FROM documents),
             g AS (SELECT folded, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY folded)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(folded) AS text_sha256
        FROM t JOIN g USING (folded)""",
    # a checksum byte by byte, with the table of its polynomial
    "op9_sharding": r"""
        WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
             b AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
             c AS (SELECT doc_id, bytes, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
             s AS (SELECT doc_id, bytes + 1 AS size, text_crc32, sum(bytes + 1) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - bytes - 1 AS start, sum(bytes + 1) OVER () AS total FROM c),
             p AS (SELECT *, (start::HUGEINT * 16 // total)::INTEGER AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p""",
    # phrases longer than three words aren't mined, so a pair is held by candidates of three words alone
    "op12_phrases": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
             g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))),
             f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS p, any_value(g) AS g, count(*) AS f FROM g GROUP BY 1, 2),
             n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
             q AS (SELECT lang, p, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND f >= 10),
             c AS MATERIALIZED (SELECT *, array_to_string(g[1:k], ' ') AS first, array_to_string(g[k + 1:], ' ') AS rest FROM q),
             s AS (SELECT c.lang, c.p, c.g, c.a, c.k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score FROM c
                   JOIN f l ON l.lang = c.lang AND l.p = c.first JOIN f r ON r.lang = c.lang AND r.p = c.rest),
             b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
             h AS (SELECT lang, p, max(longer) AS longer FROM (SELECT lang, a AS longer, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS p FROM b WHERE len(g) = 3) GROUP BY 1, 2),
             o AS (SELECT b.lang, b.p AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN h USING (lang, p) WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
