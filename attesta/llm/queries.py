"""The queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, filter_audit, pii, quality_rules, sort_means, toxicity, url_filter
from attesta.llm.common import table
from attesta.llm.decontaminate import decontaminate
from attesta.llm.fingerprint_log import remove_repeats
from attesta.llm.matroska import media_columns, media_digests
from attesta.llm.near_dedup import near_duplicates
from attesta.llm.packing import pack_documents
from attesta.llm.suffix_dedup import remove_passages


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, num=4, den=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score_quality(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"), window=50)


def op5_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.span_digest(pii.find_spans(docs, pii.train(docs)))


def op6_fingerprint_log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=20).drop("spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    judged = url_filter.filter_urls(pages, url_filter.document_outcomes(pages, labels), url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media_digests(media_columns(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), file="byte_bpe_50k.json")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.sort_means(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_sparse_suffix_dedup": op3_sparse_suffix_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_pii_lstm_crf": op5_pii_lstm_crf,
        "op6_fingerprint_log_dedup": op6_fingerprint_log_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_url_reputation": op8_url_reputation,
        "op9_matroska_media": op9_matroska_media,
        "op10_toxicity": op10_toxicity,
        "op11_bpe_transducer": op11_bpe_transducer,
        "op12_filter_audit": op12_filter_audit,
        "op13_sort_means": op13_sort_means,
    }


def _removal_sql(window: int, spans: bool) -> str:
    """Words covered by a window of `window` words that also starts earlier go."""
    edges = """,
e AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
sp AS (SELECT doc_id, string_agg((a - 1)::VARCHAR || ':' || b::VARCHAR, ',' ORDER BY a) AS spans
       FROM (SELECT doc_id, min(p) AS a, max(p) AS b FROM e GROUP BY doc_id, run) GROUP BY doc_id)"""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM d),
x AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + {window - 1}], ' ') ORDER BY doc_id, s) AS r FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS p FROM x WHERE r > 1),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id){edges if spans else ""}
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256{", coalesce(spans, '') AS spans" if spans else ""}
FROM d LEFT JOIN t ON d.doc_id = t.doc_id{" LEFT JOIN sp ON d.doc_id = sp.doc_id" if spans else ""}
"""


NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": NEAR_SQL,
        "op3_sparse_suffix_dedup": _removal_sql(50, True),
        "op6_fingerprint_log_dedup": _removal_sql(20, False),
        "op8_url_reputation": url_filter.SQL,
        "op12_filter_audit": filter_audit.SQL,
        "op13_sort_means": sort_means.oracle(),
    }
