"""What happens to findings after the rules: silencing, restriction, identity, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.schema import fingerprint, rank, severity_of
from auditlake.session import checkpointed

#: Rules that make sense on the web only, by prefix; kept where platforms are unknown.
WEB_ONLY = ("SEO-", "CRAWL-", "A11Y-NO-SKIP-LINK", "ROUTE-UPPERCASE", "ROUTE-UNDERSCORE", "ROUTE-TOO-DEEP", "PERF-BLOCKING-SCRIPT", "PERF-TOO-MANY-CSS", "PERF-NO-PRECONNECT", "PERF-FONT", "UX-NO-AUTOCOMPLETE", "DESIGN-NO-BREAKPOINTS", "DESIGN-FIXED-WIDTH")
REASONS = ("comment", "category", "domain", "disabled", "configured", "severity", "baseline")


def starts_with_any(column: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.startswith(p) for p in prefixes], F.lit(False))


def comment_silence(lines: DataFrame, word: str = "audit-ignore") -> DataFrame:
    """(project, file, line, rules) that directives silence: their own line and, from a block of comment lines, the first line below it.

    ``lines`` has project, file, line, text. A directive may name a rule or the beginning of one
    behind a colon; without a name it silences all. ``-next-line`` spares its own line.
    """
    comment = F.col("text").rlike(r"^\s*(//|#|/?\*|<!--|--|;)")
    order = Window.partitionBy("project", "file").orderBy("line")
    # islands of comment lines: the next line that is no comment closes one
    closing = F.min(F.when(~comment, F.col("line"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = lines.withColumn("_below", closing).where(F.col("text").contains(word))
    name = F.regexp_extract("text", word + r"(?:-next-line)?:\s*([\w-]+)", 1)
    next_only = F.col("text").contains(word + "-next-line")
    own = F.when(~next_only, F.array(F.col("line"))).otherwise(F.array().cast("array<int>"))
    below = F.when(comment, F.array(F.col("_below"))).when(next_only, F.array(F.col("line") + 1)).otherwise(F.array().cast("array<int>"))
    targets = F.filter(F.array_distinct(F.concat(own, below)), lambda n: n.isNotNull())
    return marked.select("project", "file", F.explode(targets).alias("line"), name.alias("rules"))


def filter_chain(findings: DataFrame, config: Config, platforms: DataFrame | None = None, silenced: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """All findings with ``reason``: null for those kept, else the first reason of the chain, in its fixed order.

    Order: directive in the source, category, domain, severity override (no reason of its own),
    disabled rules (by prefix), configured triples, least severity (it sees the overridden one),
    baseline. Copies of a kept finding (same fingerprint and line) get the reason 'duplicate'.
    ``platforms``: (project, platform); ``silenced``: see :func:`comment_silence`; ``baseline``:
    (fingerprint). Empty inputs are fine.
    """
    # numbered and written once: the number tells copies apart in both reads below
    rows = checkpointed(findings.withColumn("fingerprint", fingerprint()).withColumn("_n", F.monotonically_increasing_id()))
    if silenced is not None:
        # one row a line with all that its directives name; they are the few a programmer writes there
        s = silenced.groupBy(F.col("project").alias("_sp"), F.col("file").alias("_sf"), F.col("line").alias("_sl")).agg(F.collect_set("rules").alias("_sr"))
        rows = rows.join(s, (F.col("project") == F.col("_sp")) & (F.col("file") == F.col("_sf")) & (F.col("line") == F.col("_sl")), "left")
        rows = rows.withColumn("_hit", F.when(F.exists("_sr", lambda r: F.col("rule_id").startswith(r)), F.lit(True))).drop("_sp", "_sf", "_sl", "_sr")
    else:
        rows = rows.withColumn("_hit", F.lit(None).cast("boolean"))
    if platforms is not None:
        # one row a project, so the join keeps the number of findings
        p = platforms.where(F.col("platform").isNotNull()).groupBy(F.col("project").alias("_pp")).agg(F.max((F.col("platform") == "web").cast("int")).alias("_web"))
        rows = rows.join(p, F.col("project") == F.col("_pp"), "left").drop("_pp")
    else:
        rows = rows.withColumn("_web", F.lit(None).cast("int"))
    if baseline is not None:
        known = baseline.select(F.col("fingerprint").alias("_known")).distinct()
        rows = rows.join(known, F.col("fingerprint") == F.col("_known"), "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    overrides = config.rule_severity
    severity = reduce(lambda c, kv: F.when(F.col("rule_id") == kv[0], F.lit(kv[1])).otherwise(c), overrides.items(), F.col("severity"))
    rows = rows.withColumn("severity", severity)
    triples = F.lit(False)
    for rule, file, line in config.suppressions:
        one = F.col("rule_id") == rule
        one = one & (F.col("file") == file) if file is not None else one
        one = one & (F.col("line") == line) if line is not None else one
        triples = triples | F.coalesce(one, F.lit(False))
    least = list(("critical", "high", "medium", "low", "info")).index(config.min_severity)
    reason = (
        F.when(F.col("_hit").isNotNull() | (F.col("data")["suppressed"] == "true" if "data" in findings.columns else F.lit(False)), "comment")
        .when(~F.lower(F.trim("category")).isin(*config.categories), "category")
        .when((F.col("_web") == 0) & starts_with_any(F.col("rule_id"), WEB_ONLY), "domain")
        .when(starts_with_any(F.col("rule_id"), config.disabled_rules), "disabled")
        .when(triples, "configured")
        .when(rank(F.col("severity")) > least, "severity")
        .when(F.col("_known").isNotNull(), "baseline")
    )
    judged = rows.withColumn("reason", reason)
    # copies: the first of each identity stays; firsts are combined before the shuffle, so no identity fills a task
    first = judged.where(F.col("reason").isNull()).groupBy(F.col("fingerprint").alias("_fp"), F.col("line").alias("_ln")).agg(F.min("_n").alias("_first"))
    told = judged.join(first, (F.col("fingerprint") == F.col("_fp")) & F.col("line").eqNullSafe(F.col("_ln")), "left")
    return told.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > F.col("_first")), "duplicate").otherwise(F.col("reason"))).drop("_n", "_hit", "_web", "_known", "_fp", "_ln", "_first")


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("reason")


def dedupe(findings: DataFrame, order_by: str) -> DataFrame:
    """The first finding of each fingerprint and line, by a given order; combined before the shuffle."""
    columns = [c for c in findings.columns if c != order_by]
    marked = findings.withColumn("_fp", fingerprint())
    return marked.groupBy("_fp", "line").agg(F.min(F.struct(order_by, *[c for c in columns if c != "line"])).alias("_x")).select(F.col("_fp").alias("fingerprint"), "line", "_x.*")


def only_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings of changed files; those without a file are dropped."""
    return findings.join(changed.select("file").distinct(), "file", "left_semi")


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline doesn't hold."""
    return findings.withColumn("fingerprint", fingerprint()).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def ordered(findings: DataFrame) -> DataFrame:
    """Severity, category, file, line: the order of every report."""
    return findings.orderBy(rank(F.col("severity")), F.col("category"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "rule_id")


def downgraded(severity: Column, is_test: Column, is_example: Column) -> Column:
    """Two steps down in tests, one in examples, never below info."""
    return severity_of(rank(severity) + F.when(is_test, 2).otherwise(0) + F.when(is_example, 1).otherwise(0))


def translated(findings: DataFrame, messages: DataFrame) -> DataFrame:
    """Titles and messages of another language where one is known: ``messages`` has (rule_id, title, message), a catalogue of fixed size."""
    m = messages.select(F.col("rule_id").alias("_r"), F.col("title").alias("_t"), F.col("message").alias("_m"))
    joined = findings.join(F.broadcast(m), F.col("rule_id") == F.col("_r"), "left")
    return joined.withColumn("title", F.coalesce("_t", "title")).withColumn("message", F.coalesce("_m", "message")).drop("_r", "_t", "_m")
