"""Scores of projects, the action plan, history and trend."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.config import CATEGORIES, GRADES, SEVERITIES
from auditlake.schema import category_weights, effort_rank, rank, weight


def grade(score: Column) -> Column:
    return reduce(lambda c, g: c.when(score >= g[0], g[1]), GRADES[1:], F.when(score >= GRADES[0][0], GRADES[0][1])).otherwise("F")


def confidence_factor(confidence: Column) -> Column:
    return F.when(confidence == "tentative", 0.5).when(confidence == "certain", 1.2).otherwise(1.0)


def category_score(severe: Column, minor: Column, files: Column) -> Column:
    """100 less the penalties: severe ones eased by the project's size up to four times, minor ones by files over ten."""
    n = F.greatest(files.cast("double"), F.lit(1.0))
    eased = F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.sqrt(n) / 3))
    spread = F.greatest(F.lit(10.0), files.cast("double")) / 10
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(100 - severe / eased - minor / spread + 0.5)))


def category_scores(findings: DataFrame, files: DataFrame, by: Sequence[str] = (), categories: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """(*by, category, score, grade, total, counts a severity): every enabled category of every group, 100 where nothing was found.

    ``files`` has (*by, n_files), a row a group. Findings of other categories are left out.
    """
    w = weight(F.col("severity")) * confidence_factor(F.col("confidence"))
    severe = F.col("severity").isin("critical", "high")
    sums = findings.groupBy(*by, "category").agg(
        F.sum(F.when(severe, w).otherwise(0.0)).alias("_severe"),
        F.sum(F.when(severe, 0.0).otherwise(w)).alias("_minor"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )
    enabled = category_weights(findings.sparkSession).where(F.col("category").isin(*categories))
    frame = files.crossJoin(F.broadcast(enabled)).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("category").alias("_c"), "weight", "position", "n_files")
    cond = F.col("category") == F.col("_c")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_{b}"))
    joined = frame.join(sums, cond, "left")
    score = category_score(F.coalesce("_severe", F.lit(0.0)), F.coalesce("_minor", F.lit(0.0)), F.col("n_files")).cast("int")
    return joined.select(
        *[F.col(f"_{b}").alias(b) for b in by], F.col("_c").alias("category"), "weight", score.alias("score"), grade(score).alias("grade"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in SEVERITIES]
    )


def global_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, score, grade, total): the mean of the categories, weighted, halves upwards."""
    mean = F.floor(F.sum(F.col("score") * F.col("weight")) / F.sum("weight") + 0.5).cast("int")
    return scores.groupBy(*by).agg(mean.alias("score"), F.sum("total").alias("total")).withColumn("grade", grade(F.col("score")))


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A column a severity, zero where there is none."""
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def severity_grains(findings: DataFrame) -> DataFrame:
    """Counts per category and severity, per category, per severity and in all, from one pass."""
    return findings.groupingSets([["category", "severity"], ["category"], ["severity"], []], "category", "severity").agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("n"))


def impact(severity: Column, n: Column) -> Column:
    """Weight times the logarithm of the count, one decimal, halves upwards."""
    return F.floor(weight(severity) * F.log2(n + 1) * 10 + 0.5) / 10


def rule_groups(findings: DataFrame, order_by: str, by: Sequence[str] = ()) -> DataFrame:
    """One row a rule: worst place first, number, files, and what the plan ranks by.

    The severity, category, title and effort are those of the rule's first finding by ``order_by``;
    a title shared by all its findings stays, else the part before the colon.
    """
    first = F.min_by(F.struct("severity", "category", "title", "effort"), F.col(order_by))
    groups = findings.groupBy(*by, "rule_id").agg(first.alias("_f"), F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"), F.min("title").alias("_t1"), F.max("title").alias("_t2"), F.min(order_by).alias("first_seen"))
    title = F.when(F.col("_t1") == F.col("_t2"), F.col("_t1")).otherwise(F.trim(F.substring_index("_f.title", ":", 1)))
    return groups.select(*by, "rule_id", "_f.category", "_f.severity", title.alias("title"), "_f.effort", "n", "n_files", "first_seen", impact(F.col("_f.severity"), F.col("n")).alias("impact"))


def action_plan(findings: DataFrame, order_by: str, top: int = 12) -> DataFrame:
    """The ``top`` rules by impact, then least effort, then first appearance, numbered from 1."""
    groups = rule_groups(findings, order_by)
    best = groups.orderBy(F.desc("impact"), effort_rank(F.col("effort")), "first_seen").limit(top)
    # at most ``top`` rows are numbered here, so one partition holds them
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("impact"), effort_rank(F.col("effort")), "first_seen")
    return best.withColumn("priority", F.row_number().over(place)).drop("first_seen")


def samples(findings: DataFrame, order_by: str, most: int = 5) -> DataFrame:
    """The first places of each rule. ``most`` is the feature: a bounded list of examples a rule."""
    place = Window.partitionBy("rule_id").orderBy(order_by)
    return findings.select("rule_id", "file", "line", order_by).withColumn("sample", F.row_number().over(place)).where(F.col("sample") <= most).drop(order_by)


def history_delta(history: DataFrame, by: Sequence[str], time_col: str, value_col: str) -> DataFrame:
    """Each entry with the value before it and the difference; the first of a group has neither."""
    order = Window.partitionBy(*by).orderBy(time_col)
    before = F.lag(value_col).over(order)
    return history.withColumn("previous", before).withColumn("delta", F.col(value_col) - before)


def compare_counts(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of two runs, keys of either kept, missing ones zero."""
    a = before.select(F.col(key).alias("_a"), F.col(value).alias("_va"))
    b = after.select(F.col(key).alias("_b"), F.col(value).alias("_vb"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return joined.select(F.coalesce("_a", "_b").alias(key), zero("_va").alias("before"), zero("_vb").alias("after"), (zero("_vb") - zero("_va")).alias("delta"))


def last_entries(history: DataFrame, by: Sequence[str], time_col: str, most: int = 200) -> DataFrame:
    """The latest entries of each group; the bound is the feature (a capped history)."""
    place = Window.partitionBy(*by).orderBy(F.desc(time_col))
    return history.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= most).drop("_p")


def exit_code(findings: DataFrame, score: int, fail_on: str = "high", fail_under: int = 0) -> int:
    """1 if the score is below the limit or a finding is at least as severe as ``fail_on``, else 0."""
    if score < fail_under:
        return 1
    limit = list(SEVERITIES).index(fail_on)
    return int(not findings.where(rank(F.col("severity")) <= limit).isEmpty())
