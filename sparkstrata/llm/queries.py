"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, decontam, langid, paragraphs, pieces, pii, secrets, syncmers, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(_table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"))[0])


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_table(spark, sf_dir, "documents"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontamination, op3_toxicity, op4_language, op5_pieces, op6_token_counts, op7_syncmers, op8_secrets, op9_near_duplicates, op10_paragraphs)}


def _span_sql() -> str:
    """Spans of every rule of the secret scan: plain patterns, the text between matches gives their places."""
    plain = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "pem": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "ghp": "gh[pousr]_[A-Za-z0-9]{36,}"}
    keep = {"assign": "length(g) >= 6", "access": "length(w) >= 20", "hex": "length(w) >= 24"}
    parts = []
    for i, rule in enumerate(secrets.RULES):
        pattern = "(?i)" + secrets.ASSIGN if rule.kind == "assign" else plain[rule.kind]
        pattern = pattern.replace("'", "''")
        parts.append(
            f"SELECT rn, {i} AS ord, '{rule.kind}' AS kind, w, g, sum(length(gap)) OVER (PARTITION BY rn ORDER BY k) + coalesce(sum(length(w)) OVER (PARTITION BY rn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, {keep.get(rule.kind, 'TRUE')} AS fine "
            f"FROM (SELECT rn, unnest(regexp_extract_all(t, '{pattern}')) AS w, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS gap, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS k FROM d)"
        )
    return " UNION ALL ".join(parts)


def _op8_sql() -> str:
    text = "string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + length(w) AS BIGINT), ',' ORDER BY b, ord)"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT * FROM ({_span_sql()}) x WHERE fine), "
        f"s AS (SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {text} FILTER (ord < 3) AS base, {text} AS spans FROM m GROUP BY rn) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN s ON s.rn = d.rn"
    )


def oracle_sql() -> dict[str, str]:
    """Learned weights, tokenizers and signatures are beyond SQL; the secret scan's rows aren't."""
    return {"op8_secrets": _op8_sql()}
