"""The numbered queries: each operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import (
    bpe,
    collocations,
    conversations,
    decontaminate,
    licenses,
    linededup,
    lm,
    sentencepieces,
    simhash,
    substrings,
    tokencount,
    topk,
    toxicity,
)
from basketlens.llm.tables import given, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: DuckDB statements of those that SQL can express.
ORACLE: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(given(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(given(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    trip = bpe.round_trip(
        given(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return trip.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = given(spark, sf_dir, "documents")
    labels = toxicity.learning(given(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 3 = 1"), F.lit(False))
    scored = toxicity.toxicity(documents.select("doc_id", "text"), documents, labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(given(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_top_k")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(given(spark, sf_dir, "embeddings"))


ORACLE["op8_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(given(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_lm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 7 = 2"), F.lit(False))
    documents = given(spark, sf_dir, "documents")
    scores = lm.score(documents, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(given(spark, sf_dir, "documents"), licenses.default_templates(spark))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"))


@query("op11_collocations")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(given(spark, sf_dir, "documents"))


ORACLE["op11_collocations"] = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents)
), phrases AS (
    SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f
    FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
          FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
    GROUP BY ALL
), often AS (
    SELECT * FROM phrases WHERE f >= 10
), cuts AS (
    SELECT o.lang, o.k, o.p, o.f AS a, x.k AS cut, x.f AS l, y.f AS r,
        CAST((1000000::HUGEINT * o.f * o.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM often o, often x, often y
    WHERE o.k > 1 AND x.lang = o.lang AND y.lang = o.lang AND x.k < o.k
      AND x.p = list_slice(o.p, 1, x.k) AND y.p = list_slice(o.p, x.k + 1, o.k)
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
    SELECT lang, q, max(f) AS f FROM (
        SELECT lang, list_slice(p, 1, 2) AS q, f FROM often WHERE k = 3
        UNION ALL SELECT lang, list_slice(p, 2, 3), f FROM often WHERE k = 3)
    GROUP BY lang, q
), ranked AS (
    SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score,
        row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, array_to_string(s.p, ' ')) AS rank
    FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.q = s.p
    WHERE i.f IS NULL OR 100 * i.f < 50 * s.a
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
    CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM phrases WHERE k = 1 GROUP BY lang) t ON t.lang = ranked.lang
WHERE rank <= 2000
"""


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = given(spark, sf_dir, "conversations")
    rows = conversations.damaged(table)
    found = stored(conversations.reports(rows))
    hashes = conversations.digests(conversations.repaired(rows, found)).withColumnRenamed("conv_id", "_hashed")
    reported = found.withColumnRenamed("conv_id", "_reported")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        table.select("conv_id")
        .distinct()
        .join(reported, F.col("conv_id").eqNullSafe(F.col("_reported")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
        .select(
            "conv_id",
            *(F.coalesce(x, F.lit(0)).alias(x) for x in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


@query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    trip = sentencepieces.round_trip(given(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
