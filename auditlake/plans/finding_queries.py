"""Queries over delivered findings: identity, silencing, scores, plan, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.config import CATEGORIES, Config
from auditlake.functions.paths import normal_path
from auditlake.operators import post, score
from auditlake.plans.dialect import norm
from auditlake.schema import fingerprint, rank
from auditlake.session import table, work_folder
from auditlake.sources import histories


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the category spelled as the catalogue spells it."""
    return table(spark, sf_dir, "findings").withColumn("category", F.lower(F.trim("category")))


def _project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").groupBy("project").agg(F.count_distinct("relative_path").alias("n_files"))


def scores_by_category(spark, sf_dir):
    got = score.category_scores(_findings(spark, sf_dir), _project_files(spark, sf_dir), ["project"])
    return got.select("project", "category", "score", "grade", "total", "critical", "high", "medium", "low", "info")


def scores_global(spark, sf_dir):
    got = score.category_scores(_findings(spark, sf_dir), _project_files(spark, sf_dir), ["project"])
    return score.global_scores(got, ["project"]).select("project", "score", "grade", "total")


def action_plan(spark, sf_dir):
    return score.action_plan(_findings(spark, sf_dir), "finding_id").select("priority", "rule_id", "category", "severity", "title", "effort", "n", "n_files", "impact")


def rule_samples(spark, sf_dir):
    return score.samples(_findings(spark, sf_dir), "finding_id").select("rule_id", "sample", "file", "line")


def severity_grains(spark, sf_dir):
    return score.severity_grains(_findings(spark, sf_dir)).select("grain", "category", "severity", "n")


def severity_counts(spark, sf_dir):
    return score.severity_counts(_findings(spark, sf_dir), ["project"]).select("project", "total", "critical", "high", "medium", "low", "info")


def fingerprint_dedupe(spark, sf_dir):
    rows = _findings(spark, sf_dir).select("finding_id", "rule_id", "severity", "file", "line", "snippet")
    return post.dedupe(rows, "finding_id").select("finding_id", "fingerprint", "rule_id", "severity", "file", "line")


CHAIN = Config(
    categories=tuple(c for c in CATEGORIES if c != "seo"),
    min_severity="low",
    disabled_rules=("DEAD-M", "ROUTE-LADDER-LEMON"),
    suppressions=(("SEC-LOBBY-PULLEY", None, None), ("QUAL-CYCLE-TOWER", "tallow-shop/public/styles/site.css", None)),
    rule_severity={"QUAL-DRUM-FILTER": "info", "DESIGN-SHADOW-STAPLE": "high"},
)


def filter_chain(spark, sf_dir):
    """Why each finding of the later batches is kept or not, against a baseline of the first three."""
    rows = _findings(spark, sf_dir)
    baseline = rows.where("batch_id <= 3").select(fingerprint().alias("fingerprint"))
    later = rows.where("batch_id > 3").select("finding_id", "project", "rule_id", "category", "severity", "file", "line", "snippet")
    platforms = table(spark, sf_dir, "projects").select("project", "platform")
    # directives: every line of a file that a finding of the first batch names with a low severity silences its rule there
    silenced = rows.where("batch_id = 1 AND severity = 'low' AND line IS NOT NULL").select("project", "file", "line", F.col("rule_id").alias("rules"))
    judged = post.filter_chain(later, CHAIN, platforms, silenced, baseline)
    return judged.groupBy("severity", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def baseline_antijoin(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    baseline = rows.where("batch_id <= 6").select(fingerprint().alias("fingerprint"))
    return post.new_findings(rows.where("batch_id > 6"), baseline).select("finding_id", "fingerprint", "rule_id")


def baseline_write(spark, sf_dir):
    """The sorted distinct fingerprints of a baseline, written to its file and read from there."""
    place = work_folder(spark, "baseline")
    histories.write_baseline(_findings(spark, sf_dir).select(fingerprint().alias("fingerprint")), place)
    return histories.read_baseline(spark, place)


def diff_semijoin(spark, sf_dir):
    changed = table(spark, sf_dir, "files").where(F.col("mtime") >= F.lit("2024-08-01").cast("timestamp")).select(normal_path(F.concat_ws("/", "project", "relative_path")).alias("file"))
    return post.only_changed(_findings(spark, sf_dir).withColumn("file", normal_path(F.col("file"))), changed).groupBy("project", "severity").agg(F.count(F.lit(1)).alias("n"))


def catalogue_severity(spark, sf_dir):
    """Findings whose severity is not that of their rule, and rules that the catalogue doesn't know."""
    rows = _findings(spark, sf_dir)
    rules = table(spark, sf_dir, "rules").select(F.col("rule_id").alias("_r"), F.col("severity").alias("rule_severity"))
    known = rows.join(rules, F.col("rule_id") == F.col("_r"), "left")
    kind = F.when(F.col("_r").isNull(), "unknown rule").when(rank(F.col("severity")) < rank(F.col("rule_severity")), "raised").when(rank(F.col("severity")) > rank(F.col("rule_severity")), "lowered").otherwise("equal")
    return known.groupBy(kind.alias("kind"), "severity").agg(F.count(F.lit(1)).alias("n"))


def rules_never_fired(spark, sf_dir):
    return table(spark, sf_dir, "rules").join(_findings(spark, sf_dir).select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "category")


def history_delta(spark, sf_dir):
    """Findings of each batch per project and the change to the batch before."""
    counts = _findings(spark, sf_dir).groupBy("project", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    return score.history_delta(counts, ["project"], "batch_id", "n").select("project", "batch_id", "n", "previous", "delta")


def severity_deltas(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    count = lambda b: rows.where(F.col("batch_id") == b).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return score.compare_counts(count(1), count(2), "rule_id", "n")


def leaks_by_fingerprint(spark, sf_dir):
    """Security statements over all batches: first and last sighting and how many files held them."""
    rows = _findings(spark, sf_dir).where("category = 'security' AND snippet IS NOT NULL")
    added = rows.select(F.substring(F.sha1(F.trim("snippet")), 1, 12).alias("fingerprint"), F.lit("statement").alias("kind"), F.col("batch_id").alias("commit"), F.col("finding_id").alias("date"), "file", "severity", F.lit(None).cast("string").alias("redacted"))
    return histories.leaks(added).select("fingerprint", F.col("first_commit").alias("first_batch"), F.col("last_commit").alias("last_batch"), F.col("commits").alias("batches"), "n", "n_files", "first_file")


def longest_prefix(spark, sf_dir):
    """Each finding's file in the deepest directory that is a perimeter: paths explode into ancestors, an equi join finds the longest."""
    rows = _findings(spark, sf_dir).where("file IS NOT NULL").groupBy(normal_path(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    depth2 = F.regexp_extract(F.concat_ws("/", "project", "relative_path"), r"^([^/]+/[^/]+)/", 1)
    files = table(spark, sf_dir, "files")
    perimeters = files.select(F.col("project").alias("path")).union(files.select(depth2)).where("path <> ''").distinct()
    # one space of paths holds all projects here
    from auditlake.audit import attributed

    best = attributed(rows.select(F.lit("").alias("project"), "file"), perimeters.select(F.lit("").alias("project"), "path"))
    return rows.join(best, "file").groupBy(F.col("path").alias("perimeter")).agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("files"))


def path_normalise(spark, sf_dir):
    return _findings(spark, sf_dir).where("file IS NOT NULL").groupBy(normal_path(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("n"))


def compact_report(spark, sf_dir):
    rows = _findings(spark, sf_dir).where("batch_id = 24 AND severity IN ('critical', 'high')")
    line = F.concat(F.coalesce("file", F.lit("-")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.lit(": ["), F.col("severity"), F.lit("] "), F.col("rule_id"), F.lit(" "), F.col("title"))
    return rows.select("finding_id", line.alias("text"))


def queries():
    names = (
        scores_by_category, scores_global, action_plan, rule_samples, severity_grains, severity_counts, fingerprint_dedupe, filter_chain, baseline_antijoin, baseline_write, diff_semijoin, catalogue_severity, rules_never_fired, history_delta, severity_deltas, leaks_by_fingerprint, longest_prefix, path_normalise, compact_report,
    )
    return {f.__name__: f for f in names}


_F = "f AS (SELECT * REPLACE (lower(trim(category, ' ')) AS category) FROM findings)"
_FP = r"substr(sha1(coalesce(rule_id, '') || chr(1) || coalesce(file, '') || chr(1) || regexp_replace(trim(coalesce(snippet, ''), ' '), '\s+', ' ', 'g')), 1, 16)"
_SEV = "CASE severity WHEN 'critical' THEN 40.0 WHEN 'high' THEN 18.0 WHEN 'medium' THEN 7.0 WHEN 'low' THEN 2.5 WHEN 'info' THEN 0.5 ELSE 0 END"
_RANK = "CASE {} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
_CONF = "CASE confidence WHEN 'tentative' THEN 0.5 WHEN 'certain' THEN 1.2 ELSE 1.0 END"
_GRADE = "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 55 THEN 'D' WHEN score >= 40 THEN 'E' ELSE 'F' END"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
_CATS = "(VALUES ('security', 3.0), ('routes', 2.0), ('deadcode', 1.5), ('seo', 2.5), ('design', 2.0), ('performance', 2.0), ('quality', 1.5), ('dependencies', 2.0)) c(cat, weight)"
_SCORES = f"""WITH {_F}, n AS (SELECT project, count(DISTINCT relative_path) AS n FROM files GROUP BY 1),
 s AS (SELECT project, category, sum(CASE WHEN severity IN ('critical', 'high') THEN {_SEV} * {_CONF} ELSE 0 END) AS severe,
   sum(CASE WHEN severity IN ('critical', 'high') THEN 0 ELSE {_SEV} * {_CONF} END) AS minor, count(*) AS total, {_COUNTS} FROM f GROUP BY 1, 2),
 j AS (SELECT n.project, c.cat AS category, c.weight,
   CAST(greatest(0, least(100, floor(100 - coalesce(severe, 0) / least(4, greatest(1, sqrt(greatest(n.n, 1)) / 3)) - coalesce(minor, 0) / (greatest(10, n.n) / 10.0) + 0.5))) AS INT) AS score,
   coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info
   FROM n CROSS JOIN {_CATS} LEFT JOIN s ON s.project = n.project AND s.category = c.cat)"""
_PLAN = f"""WITH {_F}, g AS (SELECT rule_id, arg_min_null(severity, finding_id) AS severity, arg_min_null(category, finding_id) AS category, arg_min_null(title, finding_id) AS t0, arg_min_null(effort, finding_id) AS effort,
   count(*) AS n, count(DISTINCT file) AS n_files, min(title) AS t1, max(title) AS t2, min(finding_id) AS first_seen FROM f GROUP BY 1),
 i AS (SELECT *, floor({_SEV} * log2(n + 1) * 10 + 0.5) / 10 AS impact FROM g),
 p AS (SELECT *, row_number() OVER (ORDER BY impact DESC, CASE effort WHEN 'rapide' THEN 0 WHEN 'important' THEN 2 WHEN 'long' THEN 3 ELSE 1 END, first_seen) AS priority FROM i)
 SELECT CAST(priority AS INT) AS priority, rule_id, category, severity, CASE WHEN t1 = t2 THEN t1 ELSE trim(split_part(t0, ':', 1), ' ') END AS title, effort, n, n_files, impact FROM p WHERE priority <= 12"""
_NORM = norm("file")
_CHAIN = f"""WITH {_F}, b AS (SELECT DISTINCT {_FP} AS fp FROM f WHERE batch_id <= 3),
 r AS (SELECT *, {_FP} AS fp FROM f WHERE batch_id > 3),
 o AS (SELECT * REPLACE (CASE rule_id WHEN 'QUAL-DRUM-FILTER' THEN 'info' WHEN 'DESIGN-SHADOW-STAPLE' THEN 'high' ELSE severity END AS severity) FROM r),
 s AS (SELECT DISTINCT project, file, line, rule_id FROM f WHERE batch_id = 1 AND severity = 'low' AND line IS NOT NULL),
 p AS (SELECT project, max(CASE WHEN platform = 'web' THEN 1 ELSE 0 END) AS web FROM projects WHERE platform IS NOT NULL GROUP BY 1),
 j AS (SELECT o.*, CASE
   WHEN EXISTS (SELECT 1 FROM s WHERE s.project = o.project AND s.file = o.file AND s.line = o.line AND starts_with(o.rule_id, s.rule_id)) THEN 'comment'
   WHEN category NOT IN ('security', 'routes', 'deadcode', 'design', 'performance', 'quality', 'dependencies') THEN 'category'
   WHEN p.web = 0 AND ({" OR ".join(f"starts_with(rule_id, '{w}')" for w in post.WEB_ONLY)}) THEN 'domain'
   WHEN starts_with(rule_id, 'DEAD-M') OR starts_with(rule_id, 'ROUTE-LADDER-LEMON') THEN 'disabled'
   WHEN rule_id = 'SEC-LOBBY-PULLEY' OR coalesce(rule_id = 'QUAL-CYCLE-TOWER' AND file = 'tallow-shop/public/styles/site.css', false) THEN 'configured'
   WHEN {_RANK.format("severity")} > 3 THEN 'severity' WHEN b.fp IS NOT NULL THEN 'baseline' END AS reason FROM o LEFT JOIN b ON o.fp = b.fp LEFT JOIN p ON o.project = p.project),
 d AS (SELECT severity, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY fp, line, reason IS NULL ORDER BY finding_id) > 1 THEN 'duplicate' ELSE coalesce(reason, 'kept') END AS reason FROM j)
 SELECT severity, reason, count(*) AS n FROM d GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {
        "scores_by_category": f"{_SCORES} SELECT project, category, score, {_GRADE} AS grade, total, critical, high, medium, low, info FROM j",
        "scores_global": f"{_SCORES}, g AS (SELECT project, CAST(floor(sum(score * weight) / sum(weight) + 0.5) AS INT) AS score, CAST(sum(total) AS BIGINT) AS total FROM j GROUP BY 1) SELECT project, score, {_GRADE} AS grade, total FROM g",
        "action_plan": _PLAN,
        "rule_samples": "SELECT rule_id, CAST(s AS INT) AS sample, file, line FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finding_id) AS s FROM findings) WHERE s <= 5",
        "severity_grains": f"WITH {_F} SELECT CAST(grouping(category, severity) AS BIGINT) AS grain, category, severity, count(*) AS n FROM f GROUP BY GROUPING SETS ((category, severity), (category), (severity), ())",
        "severity_counts": f"SELECT project, count(*) AS total, {_COUNTS} FROM findings GROUP BY 1",
        "fingerprint_dedupe": f"SELECT finding_id, fp AS fingerprint, rule_id, severity, file, line FROM (SELECT *, {_FP} AS fp, row_number() OVER (PARTITION BY {_FP}, line ORDER BY finding_id) AS k FROM findings) WHERE k = 1",
        "filter_chain": _CHAIN,
        "baseline_antijoin": f"SELECT finding_id, {_FP} AS fingerprint, rule_id FROM findings WHERE batch_id > 6 AND {_FP} NOT IN (SELECT {_FP} FROM findings WHERE batch_id <= 6)",
        "baseline_write": f"SELECT DISTINCT {_FP} AS fingerprint FROM findings ORDER BY 1",
        "diff_semijoin": f"SELECT project, severity, count(*) AS n FROM findings WHERE {_NORM} IN (SELECT {norm("project || '/' || relative_path")} FROM files WHERE mtime >= TIMESTAMP '2024-08-01') GROUP BY 1, 2",
        "catalogue_severity": f"""SELECT CASE WHEN r.rule_id IS NULL THEN 'unknown rule' WHEN {_RANK.format("f.severity")} < {_RANK.format("r.severity")} THEN 'raised' WHEN {_RANK.format("f.severity")} > {_RANK.format("r.severity")} THEN 'lowered' ELSE 'equal' END AS kind,
            f.severity, count(*) AS n FROM findings f LEFT JOIN rules r ON f.rule_id = r.rule_id GROUP BY 1, 2""",
        "rules_never_fired": "SELECT rule_id, category FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM findings WHERE rule_id IS NOT NULL)",
        "history_delta": "WITH c AS (SELECT project, batch_id, count(*) AS n FROM findings GROUP BY 1, 2) SELECT *, lag(n) OVER (PARTITION BY project ORDER BY batch_id) AS previous, n - lag(n) OVER (PARTITION BY project ORDER BY batch_id) AS delta FROM c",
        "severity_deltas": """WITH a AS (SELECT rule_id, count(*) AS n FROM findings WHERE batch_id = 1 GROUP BY 1), b AS (SELECT rule_id, count(*) AS n FROM findings WHERE batch_id = 2 GROUP BY 1)
            SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.rule_id = b.rule_id""",
        "leaks_by_fingerprint": f"""WITH {_F} SELECT substr(sha1(trim(snippet, ' ')), 1, 12) AS fingerprint, arg_min(batch_id, finding_id) AS first_batch, arg_max(batch_id, finding_id) AS last_batch, count(DISTINCT batch_id) AS batches, count(*) AS n,
            count(DISTINCT file) AS n_files, min(file) AS first_file FROM f WHERE category = 'security' AND snippet IS NOT NULL GROUP BY 1""",
        "longest_prefix": f"""WITH r AS (SELECT {_NORM} AS file, count(*) AS n FROM findings WHERE file IS NOT NULL GROUP BY 1),
            p AS (SELECT DISTINCT project AS perimeter FROM files UNION SELECT DISTINCT regexp_extract(project || '/' || relative_path, '^([^/]+/[^/]+)/', 1) FROM files),
            m AS (SELECT r.file, r.n, arg_max(perimeter, length(perimeter)) AS perimeter FROM r JOIN p ON perimeter <> '' AND starts_with(r.file, perimeter || '/') GROUP BY 1, 2)
            SELECT perimeter, CAST(sum(n) AS BIGINT) AS findings, count(*) AS files FROM m GROUP BY 1""",
        "path_normalise": f"SELECT {_NORM} AS file, count(*) AS n FROM findings WHERE file IS NOT NULL GROUP BY 1",
        "compact_report": "SELECT finding_id, coalesce(file, '-') || ':' || coalesce(CAST(line AS VARCHAR), '0') || ': [' || severity || '] ' || rule_id || ' ' || title AS text FROM findings WHERE batch_id = 24 AND severity IN ('critical', 'high')",
    }
