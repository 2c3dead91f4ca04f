"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, fingerprints, jaccard_join, language, packing, pieces, pii, quality, repeats, resampling, runs, token_counts, url_filter
from .shared import table


def op1_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark, sf_dir):
    return pieces.digested(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.digested(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return language.identified(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.maintained(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("bucket")


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_runs(spark, sf_dir):
    return runs.digested(table(spark, sf_dir, "documents"), exercise=True)


def op12_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repeats(spark, sf_dir):
    return repeats.digested(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_pii, op4_language_id, op5_token_counts, op6_url_filter, op7_exact_dedup, op8_fingerprints, op9_jaccard_join, op10_quality, op11_runs, op12_resampling, op13_repeats)}

ORACLES = {
    "op5_token_counts": r"""
        WITH n AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
                          len(regexp_extract_all(coalesce(text, ''), '[0-9]+|[^\x20\x09-\x0D!-/0-9:-@\[-`{-~]+|[!-/:-@\[-`{-~]')) AS p FROM documents),
             s AS (SELECT source, lang, 'words-1' AS version, 1 AS d, w AS t FROM n
                   UNION ALL SELECT source, lang, 'words-1', -1, -w FROM n WHERE doc_id % 2 = 0
                   UNION ALL SELECT source, lang, 'pieces-2', 1, p FROM n WHERE doc_id % 2 = 0
                   UNION ALL SELECT source, lang, 'words-1', -1, -w FROM n WHERE doc_id % 2 <> 0 AND doc_id % 5 = 0
                   UNION ALL SELECT source, lang, 'pieces-2', -1, -p FROM n WHERE doc_id % 2 = 0 AND doc_id % 5 = 0)
        SELECT source, lang, version, CAST(sum(d) AS BIGINT) AS documents, CAST(sum(t) AS BIGINT) AS tokens
        FROM s GROUP BY source, lang, version HAVING sum(d) <> 0 OR sum(t) <> 0""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
             r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS k FROM n)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY k) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size, k = 1 AS kept, text_sha256
        FROM r""",
}
