"""Queries p8 to p10 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.llm import leaks, mixing, spans
from tempestry.session import table


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    m = leaks.template_matches(table(spark, root, "documents"), table(spark, root, "eval_items"))
    kind = F.when(F.col("verbatim") > 0, F.when(F.col("verbatim") == F.col("item_windows"), "whole").otherwise("part")).when(F.col("consistent") > 0, "reparameterised").otherwise("inconsistent")
    return m.withColumn("kind", kind)


def p8_verbatim(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).where("verbatim > 0").select("doc_id", "item_id", "verbatim", "item_windows")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).where("verbatim > 0").select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(*mixing.mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets")))


def p9_supply(spark: SparkSession, root: str) -> DataFrame:
    """What each source of the mix offers: its documents, and how often one may be used."""
    _, plan = mixing.mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))
    return plan.select("source", "target_share", "documents", "max_repeats")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_pairs(spans.shared_spans(table(spark, root, "documents"), "doc_id", "text"))


def p10_shared(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return spans.shared_shares(docs, "doc_id", "text", spans.shared_spans(docs, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p8_leaks, p8_verbatim, p8_found, p9_mix, p9_shares, p9_supply, p10_found, p10_shared)}

_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
"""

ORACLE = {
    "p8_found": _WINDOWS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)",
    "p8_verbatim": _WINDOWS.replace("SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s", "SELECT item_id, k, array_to_string(w[k:k + 11], ' ') AS s")
    + "SELECT doc_id, item_id, count(DISTINCT k)::INTEGER AS verbatim, any_value(greatest(len(w) - 11, 0))::INTEGER AS item_windows FROM dw JOIN iw USING (s) JOIN i USING (item_id) GROUP BY 1, 2",
    "p9_supply": "SELECT t.source, max(t.target_share) AS target_share, count(d.doc_id)::BIGINT AS documents, max(t.max_repeats)::INTEGER AS max_repeats FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' WHERE t.source IS NOT NULL GROUP BY 1",
    "p10_found": """
WITH g AS (SELECT doc_id, md5_number(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents)),
s AS (SELECT DISTINCT doc_id, h FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shared": """
WITH g AS (SELECT doc_id, k, md5_number(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents)),
s AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id))),
c AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 300 ELSE least(300, k - p) END)::BIGINT AS shared_chars, count_if(p IS NULL OR k > p + 300)::BIGINT AS stretches FROM s GROUP BY 1),
t AS (SELECT md5_number(text) AS h, min(doc_id) AS class_id, count(*) - 1 AS copies FROM documents WHERE length(text) >= 300 GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(length(text), 0)::INTEGER AS n_chars, coalesce(copies, 0)::BIGINT AS copies, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
  coalesce(shared_chars / nullif(length(text), 0)::DOUBLE, 0.0)::DOUBLE AS share, coalesce(stretches, 0)::BIGINT AS stretches
FROM documents d LEFT JOIN t ON length(text) >= 300 AND t.h = md5_number(text) LEFT JOIN c USING (doc_id)""",
}
