"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, exact_dedup, langid, licenses, mixing, pii, ranked, secret_scan, simhash, substring, token_alignment
from .common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.get("found", F.lit(0))
    each = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), F.size(F.array_distinct(F.transform("found", lambda x: x["license"]))).alias("n_licenses"), F.array_join(each, ",").alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b).documents


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_mixing": op2_mixing,
        "op3_nearest": op3_nearest,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_repeats": op5_repeats,
        "op6_licenses": op6_licenses,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_secrets": op8_secrets,
        "op9_language_id": op9_language_id,
        "op10_simhash": op10_simhash,
        "op11_ranked_search": op11_ranked_search,
        "op12_token_alignment": op12_token_alignment,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": r"""
            WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
            d AS (
              SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                -ln((('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 13))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
                / (0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(text, '[^A-Za-z ]+', '', 'g')) / greatest(length(text), 1)) AS key FROM t),
            s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
            o AS (
              SELECT *, (sum(n) OVER ())::DOUBLE - 3 * coalesce(sum(n) OVER before, 0)::DOUBLE AS rest, (sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER before, 0)::DOUBLE AS weight
              FROM s WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            c AS (SELECT *, bool_and(3 * n <= rest * w / weight) OVER (ORDER BY n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS capped FROM o),
            l AS (SELECT source, n, CASE WHEN capped THEN (3 * n)::DOUBLE ELSE
                ((sum(n) OVER ())::DOUBLE - 3 * coalesce(sum(n) FILTER (capped) OVER (), 0)::DOUBLE) * w / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) FILTER (capped) OVER (), 0)::DOUBLE) END AS target FROM c),
            e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs FROM l),
            p AS (
              SELECT d.*, n, target, epochs, target - epochs * n AS remainder, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
            SELECT doc_id, size, n AS source_size, target, size * (epochs + CASE WHEN size > 0 AND (upto <= remainder OR (remainder - (upto - size) > 0 AND upto - remainder < remainder - (upto - size))) THEN 1 ELSE 0 END)::BIGINT AS taken FROM p
        """,
        "op5_repeats": r"""
            WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
            h AS (SELECT doc_id, i, word, md5(string_agg(word, ' ') OVER near) AS digest, count(*) OVER near AS k FROM w WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
            r AS (SELECT *, k = 35 AND count(*) OVER (PARTITION BY digest, k) > 1 AS again FROM h),
            g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
            a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id)
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
        """,
        "op7_exact_dedup": r"""
            WITH d AS (
              SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
            g AS (
              SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
        """,
        "op11_ranked_search": r"""
            WITH w AS (SELECT doc_id, row_number() OVER () AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
            p AS (SELECT k, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM w GROUP BY k, term),
            d AS (SELECT k, sum(tf)::BIGINT AS n FROM p GROUP BY k),
            s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
            f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
            i AS (SELECT item_id, row_number() OVER () AS q, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
            r AS (
              SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
                sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
              FROM i JOIN f USING (term) JOIN p USING (term) JOIN d USING (k) CROSS JOIN s GROUP BY q, k),
            o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
            SELECT * FROM o WHERE rank <= 10
        """,
        "op13_embedding_dedup": """
            WITH RECURSIVE r AS (
              SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
            c AS (SELECT u, w FROM l UNION SELECT c.u, l.w FROM c JOIN l ON c.w = l.u),
            n AS (SELECT u, count(*) AS n FROM l GROUP BY u), m AS (SELECT u, min(w) AS low FROM c GROUP BY u)
            SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.low, e.vec_id) AS kept
            FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN m ON m.u = e.vec_id
        """,
    }
