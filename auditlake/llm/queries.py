"""Queries and comparison SQL of this subpackage; the entry module adds them where it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import credentials, history, packing, provenance, sentences, terms, tokens
from auditlake.session import table, work_folder

Query = Callable[[SparkSession, str], DataFrame]


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = credentials.locate(table(spark, sf_dir, "files"), "file_id", "content", "relative_path").withColumn("src", F.lit("files"))
    findings = credentials.locate(table(spark, sf_dir, "findings"), "finding_id", "snippet").withColumn("src", F.lit("findings"))
    return files.unionByName(findings)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row's places leave one task in order, so lines of one row are told apart without a shuffle of texts.
    return _places(spark, sf_dir).select("src", "row_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every file with its credentials masked."""
    files = table(spark, sf_dir, "files").select("file_id", "relative_path", "content")
    return credentials.redacted(files, "content", "relative_path").select("file_id", "relative_path", "redacted")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded deliveries, checked as they came against an index of all before them."""
    return history.replay(table(spark, sf_dir, "findings"), work_folder(spark, "history"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = terms.term_stats(table(spark, sf_dir, "findings"), ["rule_id", "category"], ["tags"])
    return stats.withColumnRenamed("records", "findings")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classify(table(spark, sf_dir, "files")).where("not_by_hand").select("file_id")


def p5_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain as hand-written source, with their language and size."""
    files = table(spark, sf_dir, "files").where(F.length("content") > 0)
    judged = provenance.classify(files, ("file_id", "project", "relative_path", "language", "size"))
    return judged.where("NOT not_by_hand").drop("not_by_hand")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p4_found, p4_terms, p5_found, p5_hand_written, p6_ids, p7_containers, p8_found)}


#: White space as the term rule strips it, for engines whose own class is ASCII only.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_TERMS = f"""
WITH v AS (
  SELECT finding_id, 'rule_id' AS field_name, rule_id AS raw FROM findings
  UNION ALL SELECT finding_id, 'category', category FROM findings
  UNION ALL SELECT finding_id, 'tags', unnest(tags) FROM findings
), t AS (
  SELECT finding_id, field_name, nfc_normalize(lower(regexp_replace(raw, '^{_SPACE}|{_SPACE}$', '', 'g'))) AS term FROM v WHERE raw IS NOT NULL
), s AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT finding_id) AS findings FROM t WHERE term <> '' GROUP BY 1, 2
)
SELECT field_name, term, occurrences, findings,
  CASE WHEN findings < 5 THEN 'rare' WHEN findings > 0.2 * (SELECT count(*) FROM findings) THEN 'common' END AS mark
FROM s"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_terms": _TERMS,
        "p4_found": f"SELECT field_name, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    }
