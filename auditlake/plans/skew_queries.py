"""Queries on keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import normal_path
from auditlake.operators import skew
from auditlake.plans.dialect import norm
from auditlake.session import table

#: A key is heavy above this share of all findings.
HEAVY_SHARE = 0.03
FIELDS = ("rule_id", "file")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "findings"), FIELDS, HEAVY_SHARE).select("key_field", "key_value")


def p3_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_profile(table(spark, sf_dir, "findings"), FIELDS, "received_at", "batch_id")


def p3_rule_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings joined to rules by rule: rows and summed lines per catalogue category and reported severity."""
    findings, rules = table(spark, sf_dir, "findings"), table(spark, sf_dir, "rules")
    catalogue = rules.select("rule_id", F.col("category").alias("rule_category"))
    return skew.eager_join_aggregate(findings, catalogue, ["rule_id"], ["severity"], ["rule_category"], {"sum_line": F.col("line").cast("long")}, rows_as="n_findings")


def p3_file_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings joined to every capture of their file however spelled (many to many): pairs and captured bytes per severity and language."""
    findings = table(spark, sf_dir, "findings").select(normal_path(F.col("file")).alias("file"), "severity")
    captures = table(spark, sf_dir, "files").select(normal_path(F.concat_ws("/", "project", "relative_path")).alias("file"), "language", "size")
    return skew.eager_join_aggregate(findings, captures, ["file"], ["severity"], ["language"], sum_right={"sum_bytes": F.col("size")}, rows_as="n_pairs")


def queries():
    return {f.__name__: f for f in (p3_found, p3_key_profile, p3_rule_platform, p3_file_captures)}


_KEYS = """SELECT 'rule_id' AS key_field, rule_id AS key_value, received_at, batch_id FROM findings WHERE rule_id IS NOT NULL
  UNION ALL SELECT 'file', file, received_at, batch_id FROM findings WHERE file IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"SELECT key_field, key_value FROM ({_KEYS}) GROUP BY 1, 2 HAVING count(*) > 0.03 * (SELECT count(*) FROM findings)",
        "p3_key_profile": f"""SELECT key_field, key_value, count(*) AS n_rows, min(received_at) AS first_seen, max(received_at) AS last_seen,
            count(DISTINCT batch_id) AS n_batches FROM ({_KEYS}) GROUP BY 1, 2""",
        "p3_rule_platform": """SELECT f.severity, r.category AS rule_category, count(*) AS n_findings, CAST(sum(f.line) AS BIGINT) AS sum_line
            FROM findings f JOIN rules r ON f.rule_id = r.rule_id GROUP BY 1, 2""",
        "p3_file_captures": f"""SELECT f.severity, c.language, count(*) AS n_pairs, CAST(sum(c.size) AS BIGINT) AS sum_bytes
            FROM (SELECT severity, {norm('file')} AS file FROM findings) f JOIN (SELECT language, size, {norm("project || '/' || relative_path")} AS file FROM files) c ON f.file = c.file GROUP BY 1, 2""",
    }
