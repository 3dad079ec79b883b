import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from auditlake import streaming
from auditlake.config import Config, load_config, merged, strip_json_comments
from auditlake.operators import post, score
from auditlake.schema import FINDING, as_findings, fingerprint
from auditlake.sources import histories, lockfiles, reports, trees


def finding(rule="R-A", category="quality", severity="low", file="a.js", line=1, snippet="x", confidence="firm", project="p", title="t", effort="moyen"):
    return (rule, category, severity, title, title, project, file, line, snippet, confidence, effort, [], {})


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def reasons(judged):
    return sorted((r.rule_id, r.reason or "kept") for r in judged.collect())


def test_fingerprint_knows_the_file_not_the_line(spark):
    rows = frame(spark, finding(line=1), finding(line=9), finding(file="b.js"), finding(snippet=" x  "), finding(snippet=None, file=None))
    fp = [r.f for r in rows.select(fingerprint().alias("f")).collect()]
    assert fp[0] == fp[1] == fp[3] and fp[0] != fp[2] and len(set(fp)) == 3


def test_chain_in_its_order(spark):
    config = Config(categories=("quality", "seo"), min_severity="medium", disabled_rules=("OFF",), suppressions=(("CONF", "c.js", None),), rule_severity={"UP": "high", "DOWN": "info"})
    base = frame(spark, finding("BASE", severity="high")).select(fingerprint().alias("fingerprint"))
    platforms = spark.createDataFrame([("p", "mobile"), ("w", "web"), ("w", "mobile"), ("n", None)], "project string, platform string")
    silenced = spark.createDataFrame([("p", "s.js", 3, ""), ("p", "s.js", 4, "OTHER")], "project string, file string, line int, rules string")
    rows = frame(
        spark,
        finding("CAT", category="security", severity="high"), finding("SEO-X", category="seo", severity="high"), finding("SEO-X", category="seo", severity="high", project="w"), finding("SEO-X", category="seo", severity="high", project="n", file="n.js"),
        finding("OFF-1", severity="high"), finding("CONF", severity="high", file="c.js"), finding("CONF", severity="high", file="d.js"), finding("UP"), finding("DOWN", severity="high"), finding("LOW"), finding("BASE", severity="high"),
        finding("DUP", severity="high"), finding("DUP", severity="high"), finding("DUP", severity="high", line=2), finding("SIL", severity="high", file="s.js", line=3), finding("SIL", severity="high", file="s.js", line=4),
    )
    got = reasons(post.filter_chain(rows, config, platforms, silenced, base))
    assert got == sorted(
        [("CAT", "category"), ("SEO-X", "domain"), ("SEO-X", "kept"), ("SEO-X", "kept"), ("OFF-1", "disabled"), ("CONF", "configured"), ("CONF", "kept"), ("UP", "kept"), ("DOWN", "severity"), ("LOW", "severity"), ("BASE", "baseline"), ("DUP", "kept"), ("DUP", "duplicate"), ("DUP", "kept"), ("SIL", "comment"), ("SIL", "kept")]
    )
    assert post.filter_chain(rows.limit(0), config).count() == 0


def test_directives_reach_below_their_comment_block(spark):
    lines = ["a();", "// why", "// audit-ignore: SEC", "b();", "c(); // audit-ignore", "# audit-ignore-next-line", "d();"]
    df = spark.createDataFrame([("p", "f", i + 1, t) for i, t in enumerate(lines)], "project string, file string, line int, text string")
    assert sorted((r.line, r.rules) for r in post.comment_silence(df).collect()) == [(3, "SEC"), (4, "SEC"), (5, ""), (7, "")]


def test_restrictions_and_order(spark):
    rows = frame(spark, finding("B", file="b.js", severity="low"), finding("A", file=None, severity="critical"), finding("C", file="a.js", severity="low"))
    changed = spark.createDataFrame([("b.js",), ("b.js",)], "file string")
    assert [r.rule_id for r in post.only_changed(rows, changed).collect()] == ["B"]
    assert [r.rule_id for r in post.ordered(rows).collect()] == ["A", "C", "B"]
    base = rows.where("rule_id = 'B'").select(fingerprint().alias("fingerprint"))
    assert sorted(r.rule_id for r in post.new_findings(rows, base).collect()) == ["A", "C"]


def scores(spark, rows, n_files):
    files = spark.createDataFrame([(n_files,)], "n_files long")
    return {r.category: r for r in score.category_scores(frame(spark, *rows), files).collect()}


def test_scores_by_hand(spark):
    got = scores(spark, [finding(category="security", severity="critical", confidence="certain"), finding(category="security", severity="low")], 9)
    assert got["security"].score == math.floor(100 - 40 * 1.2 / 1 - 2.5 / 1 + 0.5) and got["seo"].score == 100 and got["seo"].grade == "A+" and got["security"].critical == 1
    assert score.global_scores(score.category_scores(frame(spark), spark.createDataFrame([(1,)], "n_files long"))).first().score == 100


@pytest.mark.parametrize("n", [1, 50, 5000, 100_000])
def test_a_critical_finding_costs_at_any_size(spark, n):
    assert scores(spark, [finding(category="security", severity="critical")], n)["security"].score <= 91


def test_equal_density_of_minor_findings_gives_equal_scores(spark):
    a = scores(spark, [finding(severity="low", line=i) for i in range(10)], 100)["quality"].score
    b = scores(spark, [finding(severity="low", line=i) for i in range(100)], 1000)["quality"].score
    assert a == b


def test_plan(spark):
    rows = [finding("MANY", severity="low", line=i) for i in range(30)] + [finding("ONE", severity="critical", title="Leak: a"), finding("EASY", severity="medium", effort="rapide"), finding("HARD", severity="medium", effort="important")]
    df = frame(spark, *rows).withColumn("seq", F.monotonically_increasing_id())
    plan = score.action_plan(df, "seq").orderBy("priority").collect()
    assert [r.rule_id for r in plan] == ["ONE", "MANY", "EASY", "HARD"] and plan[1].n == 30 and plan[1].impact == math.floor(2.5 * math.log2(31) * 10 + 0.5) / 10
    assert score.action_plan(df, "seq", top=2).count() == 2
    assert {r.sample for r in score.samples(df, "seq", 3).where("rule_id = 'MANY'").collect()} == {1, 2, 3}


def test_counts_deltas_exit(spark):
    rows = frame(spark, finding(severity="low"), finding(severity="high", category="seo"))
    grains = {(r.grain, r.category, r.severity): r.n for r in score.severity_grains(rows).collect()}
    assert grains[(3, None, None)] == 2 and grains[(1, "seo", None)] == 1 and grains[(0, "quality", "low")] == 1
    assert score.exit_code(rows, 80) == 1 and score.exit_code(rows, 80, "critical") == 0 and score.exit_code(rows, 80, "critical", 90) == 1
    before, after = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("b", 5), ("c", 1)], "k string, n int")
    assert {(r.k, r.delta) for r in score.compare_counts(before, after, "k", "n").collect()} == {("a", -1), ("b", 3), ("c", 1)}
    hist = spark.createDataFrame([("p", i, 10 * i) for i in range(5)], "project string, at int, score int")
    assert [r.delta for r in score.history_delta(hist, ["project"], "at", "score").orderBy("at").collect()] == [None, 10, 10, 10, 10]
    assert score.last_entries(hist, ["project"], "at", 2).count() == 2


def test_reports(spark):
    rows = frame(spark, finding("R-1", severity="high", title="a|b\nc"), finding("R-2", file=None, line=None))
    assert [r.value for r in reports.compact_rows(rows).collect()] == ["a.js:1: [high] R-1 a|b\nc", "-:0: [low] R-2 t"]
    assert [r.value for r in reports.annotation_rows(rows).collect()] == ["::error file=a.js,line=1,title=R-1::a|b%0Ac"]
    doc = json.loads(reports.sarif(rows, rows))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 2 and doc["runs"][0]["results"][0]["level"] == "error"
    assert json.loads(reports.json_rows(rows).first().value)["rule_id"] == "R-1"
    table = score.category_scores(rows, spark.createDataFrame([(3,)], "n_files long"))
    plan = score.action_plan(rows.withColumn("seq", F.monotonically_increasing_id()), "seq")
    text = reports.markdown(table, plan, rows)
    assert "## Plan" in text and "a\\|b c" in text and "<h1>" in reports.html(table, plan)
    assert reports.summary_rows(table).count() == 8 and reports.review(rows.limit(0)) is None and "### a.js" in reports.review(rows)
    messages = spark.createDataFrame([("R-1", "titre", None)], "rule_id string, title string, message string")
    assert {r.title for r in post.translated(rows, messages).collect()} == {"titre", "t"}


def test_globs(spark):
    globs = ("node_modules/", "*.min.js", "/build", "!build/keep/", "src/**/gen-?.[jt]s", "*.{png,gif}")
    cases = {"a/node_modules/x.js": True, "x.min.js": True, "build/a": True, "build/keep/a": False, "a/build/x": False, "src/a/b/gen-1.ts": True, "src/gen-1.js": True, "src/gen-12.js": False, "i/x.gif": True, "x.js": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", trees.ignored(F.col("p"), globs).alias("out"))
    assert {r.p: r.out for r in df.collect()} == cases


def test_tree(spark, tmp_path):
    for path, text in (("a.js", "x"), ("node_modules/b.js", "y"), ("sub/c.py", "é"), ("bin.png", "z")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.relative_path: r.content for r in trees.read_tree(spark, str(tmp_path), "p").collect()}
    assert got == {"a.js": "x", "sub/c.py": "é", "bin.png": None}


def test_small_formats():
    assert trees.parse_yaml("a:\n  b: 1\n  c: 'x' # y\nd: 2") == {"a.b": "1", "a.c": "x", "d": "2"}
    assert trees.parse_toml('[tool.x]\nname = "n"\n[y]\nv = 1') == {"tool.x.name": "n", "y.v": "1"}
    assert json.loads(strip_json_comments('{"a": "//x", // c\n "b": [1,2,], /* d */}')) == {"a": "//x", "b": [1, 2]}


def test_settings(tmp_path):
    (tmp_path / "auditlake.json").write_text('{"min_severity": "low", "quality": {"max_params": 3}, /* x */}')
    got = load_config(str(tmp_path), fail_under=50)
    assert (got.min_severity, got.quality.max_params, got.quality.max_complexity, got.fail_under) == ("low", 3, 15, 50)
    with pytest.raises(ValueError):
        merged(Config(), {"nope": 1})


def test_lock_files():
    v3 = json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}})
    v1 = json.dumps({"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}}}}})
    assert sorted(lockfiles.package_lock(v3)) == [("@s/b", "2.0.0"), ("a", "1.0.0")] and sorted(lockfiles.package_lock(v1)) == [("a", "1.0.0"), ("b", "2.0.0")]
    assert list(lockfiles.package_lock("{")) == []
    assert list(lockfiles.yarn_lock('"@s/a@^1.0", "@s/a@^1.1":\n  version "1.2.0"\n\nb@npm:2:\n  version: 2.0.0\n')) == [("@s/a", "1.2.0"), ("b", "2.0.0")]
    assert list(lockfiles.pnpm_lock("packages:\n  /a@1.0.0:\n  '@s/b@2.0.0(x)':\n")) == [("a", "1.0.0"), ("@s/b", "2.0.0")]
    assert list(lockfiles.composer_lock('{"packages": [{"name": "a/b", "version": "v1.0"}]}')) == [("a/b", "1.0")]
    assert list(lockfiles.toml_lock('[[package]]\nname = "a"\nversion = "1.0"\n')) == [("a", "1.0")]
    assert list(lockfiles.pubspec_lock('packages:\n  a:\n    dependency: x\n    version: "1.0.0"\n')) == [("a", "1.0.0")]
    assert list(lockfiles.requirements("A==1.0\nb>=2\n")) == [("a", "1.0")]


def test_leaks_in_history(spark):
    token = "ghp_" + "lC2nMTe0T2SWH2YniMNqEKG0nzrfv9AwJXW8"
    log = f"commit aaaaaaa\nDate:   2024-01-02\n+++ b/src/a.js\n+x = '{token}'\n-y = '{token}'\ncommit bbbbbbb\nDate:   2024-01-01\n+++ b/tests/b.js\n+z = '{token}'\n"
    added = histories.leaks_in_logs(spark.createDataFrame([(log,)], "value string"))
    row = histories.leaks(added).first()
    assert (row.kind, row.first_commit, row.last_commit, row.commits, row.n_files, row.first_file, row.test_data) == ("github-token", "bbbbbbb", "aaaaaaa", 2, 2, "src/a.js", 0) and token not in row.redacted
    assert sorted(r.file for r in histories.leak_files(added).collect()) == ["src/a.js", "tests/b.js"]


def test_copies_of_one_finding_and_directives(spark):
    rows = frame(spark, *[finding("A") for _ in range(50)], finding("B"))
    judged = post.filter_chain(rows, Config())
    assert {(r.rule_id, r.reason): r["count"] for r in judged.groupBy("rule_id", "reason").count().collect()} == {("A", None): 1, ("A", "duplicate"): 49, ("B", None): 1}


def test_history_keeps_the_latest_runs_and_backups(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in (1, 2, 3):
        kept = histories.append_history(spark.createDataFrame([(f"2024-01-0{day} 00:00:00", day)], "t string, score int").selectExpr("cast(t as timestamp) AS run_at", "score"), path, 2)
    assert sorted(r.score for r in kept.collect()) == [2, 3]
    files = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "project string, file string, content string")
    histories.backup(files, files.where("file = 'a'"), str(tmp_path / "backup"))
    assert [r.content for r in spark.read.parquet(str(tmp_path / "backup")).collect()] == ["x"]


def test_baseline_round_trip(spark, tmp_path):
    rows = frame(spark, finding(), finding(), finding("B"))
    histories.write_baseline(rows.withColumn("fingerprint", fingerprint()), str(tmp_path / "b"))
    assert histories.read_baseline(spark, str(tmp_path / "b")).count() == 2


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "rule_id string, file string, line int, snippet string, received_at timestamp"
    source = str(tmp_path / "in")
    for day in (1, 2):
        spark.createDataFrame([("A", "f", 1, "x", at(day)), ("B", "f", day, "y", at(day))], schema).coalesce(1).write.mode("append").parquet(source)
    stream = streaming.findings_stream(spark, source, schema, 1)
    assert run(streaming.new_once(stream), "once").count() == 3
    assert sorted(r.n for r in run(streaming.windowed_counts(stream, "received_at", "rule_id"), "win", "complete").collect()) == [1, 1, 1, 1]
    assert run(streaming.sessions(stream, "received_at", "rule_id", "36 hours"), "sess", "complete").where("n = 2").count() == 2
    q = streaming.per_batch(stream, lambda df: as_findings(df, category="x"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_trend_keeps_the_last_score(spark, tmp_path):
    source = str(tmp_path / "s")
    schema = "project string, at timestamp, score long"
    for day, value in ((1, 80), (2, 70), (3, 90)):
        spark.createDataFrame([("p", datetime(2024, 1, day), value)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = run(streaming.score_trend(stream), "trend").collect()
    assert len(got) == 3 and sum(r.delta is None for r in got) == 1
