"""The findings relation and the small dimensions it is joined with."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.config import CATEGORIES, EFFORTS, SEVERITIES

FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)
COLUMNS = tuple(f.name for f in FINDING.fields)


def rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 5 for anything else."""
    return reduce(lambda c, x: c.when(severity == x[1], F.lit(x[0])), list(enumerate(SEVERITIES))[1:], F.when(severity == "critical", F.lit(0))).otherwise(F.lit(5))


def severity_of(rank_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.least(F.greatest(rank_, F.lit(0)), F.lit(4)) + 1).cast("int"))


def weight(severity: Column) -> Column:
    """The penalty weight of a severity; 0 for anything else."""
    names = list(SEVERITIES)
    return reduce(lambda c, s: c.when(severity == s, F.lit(SEVERITIES[s])), names[1:], F.when(severity == names[0], F.lit(SEVERITIES[names[0]]))).otherwise(F.lit(0.0))


def effort_rank(effort: Column) -> Column:
    names = list(EFFORTS)
    return reduce(lambda c, s: c.when(effort == s, F.lit(EFFORTS[s])), names[1:], F.when(effort == names[0], F.lit(EFFORTS[names[0]]))).otherwise(F.lit(EFFORTS["moyen"]))


def category_weights(spark: SparkSession) -> DataFrame:
    """(category, weight, position): eight rows, safe to broadcast."""
    return spark.createDataFrame([(c, w, i) for i, (c, w) in enumerate(CATEGORIES.items())], "category string, weight double, position int")


def fingerprint(rule: str = "rule_id", file: str = "file", snippet: str = "snippet") -> Column:
    """Identity of a finding across runs: rule, file and statement, not its line."""
    clean = F.regexp_replace(F.trim(F.coalesce(F.col(snippet), F.lit(""))), r"\s+", " ")
    return F.substring(F.sha1(F.concat_ws("\u0001", F.coalesce(F.col(rule), F.lit("")), F.coalesce(F.col(file), F.lit("")), clean)), 1, 16)


def as_findings(df: DataFrame, **constants) -> DataFrame:
    """The finding columns of ``df``, given constants first, then its own columns, null for the rest."""
    have = set(df.columns)
    columns = []
    for f in FINDING.fields:
        if f.name in constants:
            value = constants[f.name]
            c = value if isinstance(value, Column) else F.array(*[F.lit(x) for x in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        elif f.name in have:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def union(parts: Iterable[DataFrame]) -> DataFrame:
    """All findings of all rules, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def check(rule_id: str, severity: str | Column, when: Column, message: str | Column, title: str | None = None, confidence: str = "firm", effort: str = "moyen") -> Column:
    """One rule as a nullable struct: set where its condition holds."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = lit(message).cast("string")
    return F.when(
        when,
        F.struct(
            F.lit(rule_id).alias("rule_id"), lit(severity).alias("severity"), (F.lit(title) if title else text).alias("title"), text.alias("message"), F.lit(confidence).alias("confidence"), F.lit(effort).alias("effort")
        ),
    )


def emit(df: DataFrame, checks: list[Column], category: str, **constants) -> DataFrame:
    """Findings of many rules from one projection: each row gives those whose condition holds, without a branch per rule."""
    held = df.withColumn("_f", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())))
    flat = held.select(*[c for c in df.columns if c not in ("rule_id", "severity", "title", "message", "confidence", "effort")], "_f.*")
    return as_findings(flat, category=category, **constants)
