"""python -m auditlake COMMAND: scan, rules, baseline, fix, leaks. Exit codes: 0 clean, 1 limits broken, 2 wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from auditlake import audit as audits
from auditlake.config import load_config
from auditlake.operators import fixes, score
from auditlake.rules.catalogue import RULES
from auditlake.schema import fingerprint
from auditlake.session import local_session
from auditlake.sources import histories, lockfiles, reports, trees


def _tables(spark, args):
    config = load_config(args.folder, **{k: v for k, v in (("min_severity", args.min_severity), ("fail_on", args.fail_on), ("fail_under", args.fail_under)) if v is not None})
    files = trees.read_tree(spark, args.folder, args.project, config)
    tables = audits.Tables(files, config)
    locked = lockfiles.installed(tables.described)
    tables.installed = locked.select("project", "name", "version", "ecosystem", "exact", F.lit(None).cast("boolean").alias("direct"), F.lit(None).cast("timestamp").alias("recorded_at"))
    if getattr(args, "advisories", None):
        tables.advisories = histories.read_advisories(spark, args.advisories)
    return tables


def scan(spark, args) -> int:
    tables = _tables(spark, args)
    known = histories.read_baseline(spark, args.baseline) if args.baseline else None
    changed = spark.read.text(args.changed).toDF("file") if args.changed else None
    result = audits.audit(tables, known, changed)
    kept = result.kept.persist()
    if args.format in ("json", "compact", "annotations"):
        rows = {"json": reports.json_rows, "compact": reports.compact_rows, "annotations": reports.annotation_rows}[args.format](result.ordered())
        if args.out:
            rows.write.mode("overwrite").text(args.out)
        else:
            for r in rows.toLocalIterator():
                print(r["value"])
    elif args.format == "sarif":
        print(reports.sarif(kept, kept))
    elif args.format == "markdown":
        print(reports.markdown(result.scores, result.plan(), kept))
    elif args.format == "html":
        print(reports.html(result.scores, result.plan()))
    else:
        for r in reports.summary_rows(result.scores).toLocalIterator():
            print(r["value"])
    total = result.totals.agg(F.min("score")).first()[0]
    return score.exit_code(kept, 100 if total is None else total, tables.config.fail_on, tables.config.fail_under)


def rules(_spark, _args) -> int:
    for r in sorted(RULES, key=lambda r: r.id):
        print(f"{r.id}\t{r.severity}\t{r.category}\t{r.title}")
    return 0


def baseline(spark, args) -> int:
    histories.write_baseline(audits.findings(_tables(spark, args)).select(fingerprint().alias("fingerprint")), args.out or "baseline")
    return 0


def fix(spark, args) -> int:
    tables = _tables(spark, args)
    changed = fixes.fixed_files(tables.described, fixes.plan(tables.described))
    for r in changed.select("file", fixes.diff(F.col("before"), F.col("after")).alias("diff")).toLocalIterator():
        print(f"# {r['file']}\n{r['diff']}")
    return 0


def leaks(spark, args) -> int:
    logs = spark.read.text(args.folder, wholetext=True)
    for r in histories.leaks(histories.leaks_in_logs(logs)).orderBy("test_data", "first_date").toLocalIterator():
        print(f"{r['kind']}\t{r['redacted']}\t{r['first_commit']}\t{r['first_date']}\t{','.join(r['files'])}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="auditlake")
    parser.add_argument("command", choices=("scan", "rules", "baseline", "fix", "leaks"))
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--project", default="project")
    parser.add_argument("--format", default="summary", choices=("summary", "json", "compact", "annotations", "sarif", "markdown", "html"))
    parser.add_argument("--out")
    parser.add_argument("--baseline")
    parser.add_argument("--changed", help="a file with a changed path a line")
    parser.add_argument("--advisories")
    parser.add_argument("--min-severity")
    parser.add_argument("--fail-on")
    parser.add_argument("--fail-under", type=int)
    args = parser.parse_args(argv)
    spark = local_session() if args.command != "rules" else None
    return {"scan": scan, "rules": rules, "baseline": baseline, "fix": fix, "leaks": leaks}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
