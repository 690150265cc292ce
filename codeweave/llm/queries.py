"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, knn, langid, licenses, mixing, ordinal, packing, perplexity, simhash, tokencount
from ._util import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, max_bits=2, blocks=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.classify(docs, model)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.format_windows(turns))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_voronoi_top_k": op2_voronoi_top_k,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_windows": op4_chat_windows,
    "op5_license_scan": op5_license_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_language_mixture": op9_language_mixture,
    "op10_quality_rules": op10_quality_rules,
}
SQL: dict[str, str] = {
    "op2_voronoi_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
    """,
    "op4_chat_windows": r"""
        WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
             b AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') || ': '
                          || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10) AS block FROM t),
             n AS (SELECT *, len(regexp_extract_all(block, '\w+|[^\w\s]')) AS k, ROW_NUMBER() OVER o AS n FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             y AS (SELECT *, n = 1 AND role = 'system' AS sys, CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE k END AS own FROM n),
             u AS (SELECT *, SUM(own) OVER (PARTITION BY conv_id ORDER BY n) AS upto, MAX(CASE WHEN sys THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS st FROM y),
             p AS (SELECT *, upto - own AS start, GREATEST(1024 - 192 - st, 256) AS room FROM u),
             f AS (SELECT *, start // room AS a, (GREATEST(upto, start + 1) - 1) // room AS z FROM p),
             w AS (SELECT *, COALESCE(n > 1 AND (a <> LAG(a) OVER c OR z <> LAG(z) OVER c) AND NOT LAG(sys) OVER c, false) AS opens FROM f WINDOW c AS (PARTITION BY conv_id ORDER BY n)),
             m AS (SELECT *, 1 + CASE WHEN sys THEN SUM(opens::BIGINT) OVER (PARTITION BY conv_id) ELSE 0 END
                          + CASE WHEN LEAD(opens, 1) OVER c AND NOT sys AND LEAD(start, 1) OVER c - start <= 192 THEN 1 ELSE 0 END
                          + CASE WHEN LEAD(opens, 2) OVER c AND NOT sys AND LEAD(start, 2) OVER c - start <= 192 THEN 1 ELSE 0 END AS times FROM w WINDOW c AS (PARTITION BY conv_id ORDER BY n))
        SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(COALESCE(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(SUM(length(block) * times) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op6_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, text, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
             t AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
             r AS (SELECT *, [3, 1, 2][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2::DOUBLE AS cap FROM t),
             f AS (SELECT *, SUM(source_size) OVER () * 1.5::DOUBLE AS total, COALESCE(SUM(cap) OVER e, 0) AS held, SUM(w) OVER () - COALESCE(SUM(w) OVER e, 0) AS open_w
                   FROM r WINDOW e AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             g AS (SELECT *, (total - held) / open_w AS level FROM f),
             h AS (SELECT *, MAX(CASE WHEN cap >= level * w THEN level END) OVER () AS shared FROM g),
             s AS (SELECT source, source_size, COALESCE(LEAST(cap, shared * w), cap) AS target FROM h),
             j AS (SELECT d.doc_id, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
                          CAST('0x' || substr(md5('6:' || COALESCE(CAST(d.doc_id AS VARCHAR), md5(COALESCE(d.text, '')))), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE AS draw
                   FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + (draw < rate - floor(rate))::INT) AS BIGINT) AS taken FROM j
    """,
}
