"""Reports: rows of text or JSON that a writer can put down in parallel, and whole documents where a format asks for one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.schema import COLUMNS, rank
from auditlake.session import checkpointed

SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORE = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}


def json_rows(findings: DataFrame) -> DataFrame:
    """A JSON text a finding."""
    return findings.select(F.to_json(F.struct(*[c for c in COLUMNS if c in findings.columns])).alias("value"))


def compact_rows(findings: DataFrame) -> DataFrame:
    """``file:line: [severity] rule title``."""
    place = F.concat_ws(":", F.coalesce("file", F.lit("-")), F.coalesce(F.col("line").cast("string"), F.lit("0")))
    return findings.select(F.concat(place, F.lit(": ["), F.col("severity"), F.lit("] "), F.col("rule_id"), F.lit(" "), F.coalesce("title", F.lit(""))).alias("value"))


def _escaped(text):
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotation_rows(findings: DataFrame) -> DataFrame:
    """Annotation lines of a hosted build; findings without a file have none."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    line = F.concat(F.lit("::"), level, F.lit(" file="), F.col("file"), F.lit(",line="), F.coalesce(F.col("line").cast("string"), F.lit("1")), F.lit(",title="), F.col("rule_id"), F.lit("::"), _escaped(F.coalesce("message", "title", F.lit(""))))
    return findings.where(F.col("file").isNotNull()).select(line.alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result object a finding, as JSON text."""
    level = F.create_map(*[F.lit(x) for kv in SARIF_LEVEL.items() for x in kv])
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    location = F.when(F.col("file").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), F.element_at(level, F.col("severity")).alias("level"), F.struct(F.coalesce("message", "title").alias("text")).alias("message"), location.alias("locations"))).alias("value"))


def sarif(findings: DataFrame, rules: DataFrame) -> str:
    """One SARIF 2.1.0 document. A document is one value, so its results pass through the driver: for reports, not for exports; those write :func:`sarif_results`."""
    described = [{"id": r["rule_id"], "shortDescription": {"text": r["title"] or r["rule_id"]}, "properties": {"security-severity": SARIF_SCORE.get(r["severity"], "1.0")}} for r in rules.select("rule_id", "title", "severity").distinct().toLocalIterator()]
    results = [json.loads(r["value"]) for r in sarif_results(findings).toLocalIterator()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "auditlake", "rules": described}}, "results": results}]})


def sarif_lines(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(part, n, value): the lines of one SARIF 2.1.0 document, in the order of part and n; nothing passes through the driver.

    Sorted by (part, n) and written as text, the files put together in the order of their names
    are the document. Every result but the first begins with its comma.
    """
    described = rules.select("rule_id", "title", "severity").groupBy("rule_id").agg(F.min("title").alias("title"), F.min_by("severity", rank(F.col("severity"))).alias("severity"))
    scores = F.create_map(*[F.lit(x) for kv in SARIF_SCORE.items() for x in kv])
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.coalesce("title", "rule_id").alias("text")).alias("shortDescription"), F.create_map(F.lit("security-severity"), F.coalesce(F.element_at(scores, F.col("severity")), F.lit("1.0"))).alias("properties")))
    head = '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "auditlake", "rules": ['
    bodies = described.select(F.lit(1).alias("part"), F.xxhash64("rule_id").alias("n"), rule.alias("value")).unionByName(sarif_results(findings).select(F.lit(3).alias("part"), F.monotonically_increasing_id().alias("n"), "value"))
    bodies = checkpointed(bodies)  # numbered once
    first = bodies.groupBy(F.col("part").alias("_p")).agg(F.min("n").alias("_first"))
    joined = bodies.join(F.broadcast(first), F.col("part") == F.col("_p")).select("part", "n", F.when(F.col("n") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    frame = findings.sparkSession.createDataFrame([(0, 0, head), (2, 0, ']}}, "results": ['), (4, 0, "]}]}")], "part int, n bigint, value string")
    return joined.unionByName(frame)


def terminal_rows(findings: DataFrame, per_rule: int = 3, most: int = 60) -> DataFrame:
    """(n, value): what a terminal shows: a few findings a rule, worst first, up to a number in all; critical ones are always shown.

    The bounds are the report's: a last line tells how many findings are left out.
    """
    order = (rank(F.col("severity")), F.col("category"), F.col("rule_id"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)))
    critical = F.col("severity") == "critical"
    few = findings.withColumn("_k", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).where(critical | (F.col("_k") <= per_rule))
    # at most per_rule rows a rule are left besides the critical ones
    shown = few.where(~critical).orderBy(*order).limit(most).unionByName(few.where(critical))
    place = F.concat_ws(":", F.coalesce("file", F.lit("-")), F.coalesce(F.col("line").cast("string"), F.lit("0")))
    lines = shown.select(rank(F.col("severity")).alias("n"), F.format_string("%-8s %-32s %s  %s", F.col("severity"), F.col("rule_id"), place, F.coalesce("title", F.lit(""))).alias("value"))
    total, seen = findings.agg(F.count(F.lit(1)).alias("t")), shown.agg(F.count(F.lit(1)).alias("s"))
    rest = total.crossJoin(seen).where("t > s").select(F.lit(9).alias("n"), F.format_string("%d more", F.col("t") - F.col("s")).alias("value"))
    return lines.unionByName(rest)


def job_log_rows(findings: DataFrame) -> DataFrame:
    """A line a category for the log of a build, most findings first."""
    counts = findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))
    return counts.orderBy(F.desc("n"), "category").select(F.format_string("%s: %d findings, %d severe", F.col("category"), F.col("n"), F.col("severe")).alias("value"))


def review_text(findings: DataFrame, before: int) -> str | None:
    """The comment of a change: its findings; that all are resolved if there were some before; else nothing."""
    return review(findings) or (REVIEW_RESOLVED if before else None)


def markdown(scores: DataFrame, plan: DataFrame, findings: DataFrame, per_category: int = 100) -> str:
    """Scores, plan and the first findings of each category; the bound is the format's."""
    cell = lambda v: str(v if v is not None else "").replace("|", "\\|").replace("\n", " ")
    out = ["# Audit", "", "| Category | Score | Grade | Findings |", "|-|-|-|-|"]
    out += [f"| {r['category']} | {r['score']} | {r['grade']} | {r['total']} |" for r in scores.orderBy("category").collect()]
    out += ["", "## Plan", "", "| # | Rule | Title | Findings | Impact |", "|-|-|-|-|-|"]
    out += [f"| {r['priority']} | {r['rule_id']} | {cell(r['title'])} | {r['n']} | {r['impact']} |" for r in plan.orderBy("priority").collect()]
    place = Window.partitionBy("category").orderBy(rank(F.col("severity")), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)))
    shown = findings.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= per_category).orderBy("category", "_n")
    category = None
    for r in shown.toLocalIterator():
        if r["category"] != category:
            category = r["category"]
            out += ["", f"## {category}", ""]
        out.append(f"- **{r['severity']}** {r['rule_id']} {cell(r['title'])} ({r['file'] or '-'}:{r['line'] or 0})")
    return "\n".join(out) + "\n"


def summary_rows(scores: DataFrame) -> DataFrame:
    """A line a category with its score and counts."""
    return scores.select(F.format_string("%-14s %3d %-2s %d findings", F.col("category"), F.col("score"), F.col("grade"), F.col("total")).alias("value"))


def review(findings: DataFrame, files: int = 15, per_file: int = 8) -> str | None:
    """The comment of a review: the worst files first, a few findings each; null if there is nothing to say."""
    order = Window.partitionBy("file").orderBy(rank(F.col("severity")), F.coalesce("line", F.lit(0)))
    placed = findings.where(F.col("file").isNotNull()).withColumn("_n", F.row_number().over(order))
    worst = placed.groupBy("file").agg(F.min(rank(F.col("severity"))).alias("_w"), F.count(F.lit(1)).alias("_k")).orderBy("_w", F.desc("_k"), "file").limit(files)
    rows = placed.where(F.col("_n") <= per_file).join(F.broadcast(worst), "file").orderBy("_w", F.desc("_k"), "file", "_n").collect()
    if not rows:
        return None
    out, file = ["## Findings in this change", ""], None
    for r in rows:
        if r["file"] != file:
            file = r["file"]
            out += ["", f"### {file}"]
        out.append(f"- {r['severity']}: {r['title']} (line {r['line'] or 0}, {r['rule_id']})")
    return "\n".join(out) + "\n"


REVIEW_RESOLVED = "All findings of this change are resolved.\n"


def html(scores: DataFrame, plan: DataFrame) -> str:
    """A page of its own with scores and plan; no scripts, no other files."""
    esc = lambda v: str(v if v is not None else "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = "".join(f"<tr><td>{esc(r['category'])}</td><td>{r['score']}</td><td>{r['grade']}</td><td>{r['total']}</td></tr>" for r in scores.orderBy("category").collect())
    items = "".join(f"<li>{esc(r['rule_id'])}: {esc(r['title'])} ({r['n']})</li>" for r in plan.orderBy("priority").collect())
    return f"<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Audit</title></head><body><main><h1>Audit</h1><table><tr><th>Category</th><th>Score</th><th>Grade</th><th>Findings</th></tr>{rows}</table><h2>Plan</h2><ol>{items}</ol></main></body></html>"
