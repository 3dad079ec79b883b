import pytest

from auditlake import audit as audits
from auditlake.__main__ import main
from auditlake.config import Config
from auditlake.schema import as_findings

FILES = "file_id long, project string, relative_path string, content string, size long"
SITE = [
    ("index.html", '<!doctype html><html><head><title>Hi</title></head><body><h1>A</h1><a href="/gone">x</a></body></html>'),
    ("src/app.js", "import { a } from './lib';\nfunction f(v) { el.innerHTML = v; }\nf(a);\neval(a); // audit-ignore\n"),
    ("src/lib.js", "export const a = 1;\n"),
    ("api/requirements.txt", "flask==1.0\n"), ("web/package.json", '{"dependencies": {"react": "^18.0.0"}}'), ("styles.css", "a{color:#999;background:#fff}"),
]


def tables(spark, config=None, rows=SITE):
    return audits.Tables(spark.createDataFrame([(i, "p", p, t, len(t)) for i, (p, t) in enumerate(rows)], FILES), config or Config())


def test_whole_audit(spark):
    result = audits.audit(tables(spark))
    judged = {(r.rule_id, r.reason) for r in result.judged.select("rule_id", "reason").collect()}
    assert {("SEC-INNERHTML", None), ("SEC-EVAL", "comment"), ("A11Y-CONTRAST", None), ("SEO-TITLE-SHORT", None), ("ROUTE-BROKEN-LINK", None), ("QUAL-NO-README", None)} - judged <= {("QUAL-NO-README", None)}
    rows = {r.category: r.score for r in result.scores.collect()}
    assert len(rows) == 8 and rows["security"] < 100
    assert 0 < result.totals.first().score < 100
    plan = result.plan().orderBy("priority").collect()
    assert [r.priority for r in plan] == list(range(1, len(plan) + 1)) and plan == sorted(plan, key=lambda r: -r.impact)
    first = result.ordered().first()
    assert first.severity in ("critical", "high")


def test_only_enabled_categories_are_planned(spark):
    only = audits.findings(tables(spark, Config(categories=("design",))))
    assert {r.category for r in only.select("category").distinct().collect()} <= {"design", "seo", "performance", "routes"}


def test_failing_and_registered_analyzers(spark):
    def broken(_):
        raise RuntimeError("boom")

    own = audits.Analyzer("own", ("quality",), 1, lambda t: as_findings(t.described.select("project", "file"), rule_id="OWN-1", category="quality", severity="low"))
    got = audits.findings(tables(spark), [audits.Analyzer("bad", ("quality",), 5, broken), own]).collect()
    assert sum(r.rule_id == "OWN-1" for r in got) == len(SITE) and [r.message for r in got if r.rule_id == "AUDIT-ANALYZER-FAILED"] == ["RuntimeError: boom"]


def test_change_only(spark):
    result = audits.audit(tables(spark, Config(categories=("design",))), changed=spark.createDataFrame([("styles.css",)], "file string"))
    assert {r.file for r in result.judged.collect()} == {"styles.css"} and result.n_files.first().n_files == 1


def test_perimeters(spark):
    described = tables(spark).described
    found = audits.perimeters(described)
    assert sorted(r.path for r in found.collect()) == ["api"] or sorted(r.path for r in found.collect()) == ["api", "web"]
    files = {r.file: r.path for r in audits.attributed(described, found).collect()}
    assert files["api/requirements.txt"] == "api" and "src/app.js" not in files


def test_command_line(spark, tmp_path, capsys):
    for path, text in SITE:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "auditlake.json").write_text('{"categories": ["security"]}')
    assert main(["rules"]) == 0 and "SEC-EVAL" in capsys.readouterr().out
    assert main(["scan", str(tmp_path), "--format", "compact"]) == 1
    assert "SEC-INNERHTML" in capsys.readouterr().out
    assert main(["fix", str(tmp_path)]) == 0 and "charset" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nope"])
