"""Queries over captured sources, packages, documents and events."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import color, paths, text, versions
from auditlake.operators import code, files, fixes, markup
from auditlake.operators import imports as imports_of
from auditlake.operators.ranking import upper_median
from auditlake.rules import dependencies, pages, scan, structure, styles
from auditlake.schema import union
from auditlake.session import table
from auditlake.sources import lockfiles
from auditlake.sources.trees import glob_regex, ignored


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.describe(table(spark, sf_dir, "files"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lines(table(spark, sf_dir, "files"))


def file_stack(spark, sf_dir):
    """Files, lines and bytes per project and extension."""
    rows = table(spark, sf_dir, "files").where("relative_path IS NOT NULL").withColumn("language", paths.extension(F.col("relative_path")))
    return files.stack(rows, "project")


def language_stack(spark, sf_dir):
    return files.stack(_files(spark, sf_dir), "family")


def source_lines(spark, sf_dir):
    """Lines, blank lines, widest line and deepest indentation of every captured file."""
    rows = _lines(spark, sf_dir)
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("text") == "").alias("blank"), F.max(F.length("text")).alias("widest"), F.max("indent").alias("deepest"))


def debt_markers(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    kinds = F.regexp_extract_all("text", F.lit(r"\b(FIXME|XXX|HACK|BUG|TODO)\b"), F.lit(1))
    return rows.select("file_id", "line", F.explode(kinds).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def nesting_depth(spark, sf_dir):
    return code.nesting(_lines(spark, sf_dir)).select("file_id", "depth", "line")


def duplicate_blocks(spark, sf_dir):
    blocks = code.duplicate_blocks(_lines(spark, sf_dir))
    return blocks.select("hash", "n_files", "n_places", "first.file_id", "first.line")


def commented_code(spark, sf_dir):
    return code.comment_runs(_lines(spark, sf_dir))


def unreachable_code(spark, sf_dir):
    return code.unreachable(_lines(spark, sf_dir))


def identifier_index(spark, sf_dir):
    return code.identifiers(_files(spark, sf_dir))


def http_urls(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"(https?)://([A-Za-z0-9.-]+)"), F.lit(0))
    urls = _lines(spark, sf_dir).select("file_id", F.explode(found).alias("url"))
    return urls.groupBy(F.substring_index("url", "://", 1).alias("scheme"), F.lower(F.substring_index("url", "://", -1)).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def routes(spark, sf_dir):
    return code.routes(_files(spark, sf_dir)).select("project", "file", "framework", "kind", "method", "pattern", "regex", "line")


def route_match(spark, sf_dir):
    """Links of pages against routes with parameters: an equi join on project and steps, then the expression."""
    r = code.routes(_files(spark, sf_dir)).where("dynamic").select("project", "pattern", "regex", "segments").distinct()
    described = _files(spark, sf_dir)
    page = pages.pages_of(described)
    nodes = markup.nodes(page, "file_id", "content").join(page.select(F.col("file_id").alias("_p"), "project", "file"), F.col("file_id") == F.col("_p"))
    links = code.resolve_links(code.links(nodes, described)).withColumn("_n", F.size(F.filter(F.split("path", "/"), lambda s: s != ""))).withColumnRenamed("project", "_q")
    return links.join(r, (F.col("_q") == F.col("project")) & (F.col("_n") == F.col("segments")) & F.regexp_like("path", F.col("regex"))).groupBy("project", "pattern").agg(F.count(F.lit(1)).alias("links"))


def imports(spark, sf_dir):
    return code.imports(_files(spark, sf_dir))


def import_edges(spark, sf_dir):
    described = _files(spark, sf_dir)
    return imports_of.edges(code.imports(described), described)


def declarations(spark, sf_dir):
    return code.declarations(_files(spark, sf_dir))


def function_units(spark, sf_dir):
    return code.functions(_files(spark, sf_dir))


def html_elements(spark, sf_dir):
    """Images and links of markup files with what they point to."""
    rows = table(spark, sf_dir, "files").where(F.col("relative_path").endswith(".html") & F.col("content").isNotNull())
    nodes = markup.nodes(rows, "file_id", "content")
    target = F.coalesce(F.element_at("attrs", F.lit("src")), F.element_at("attrs", F.lit("href")))
    return nodes.where(F.col("tag").isin("img", "a") & target.isNotNull()).groupBy("tag", target.alias("target")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def visible_words(spark, sf_dir):
    rows = table(spark, sf_dir, "files").where(F.col("relative_path").endswith(".html") & F.col("content").isNotNull())
    return rows.select("file_id", text.visible_words(text.strip_tags(F.col("content"))).alias("words"))


def page_rules(spark, sf_dir):
    return pages.page_findings(_files(spark, sf_dir).persist()).select("rule_id", "severity", "project", "file", "line")


def style_rules(spark, sf_dir):
    return styles.style_findings(_files(spark, sf_dir)).select("rule_id", "severity", "project", "file", "line", "message")


def pattern_rules(spark, sf_dir):
    return scan.pattern_findings(_files(spark, sf_dir)).select("rule_id", "severity", "project", "file", "line", "confidence")


def secret_scan(spark, sf_dir):
    return scan.secret_findings(_files(spark, sf_dir)).select("rule_id", "severity", "project", "file", "line", "snippet")


def quality_rules(spark, sf_dir):
    return structure.quality_findings(_files(spark, sf_dir).persist()).select("rule_id", "severity", "project", "file", "line")


def deadcode_rules(spark, sf_dir):
    return structure.deadcode_findings(_files(spark, sf_dir).persist()).select("rule_id", "project", "file", "line", "snippet")


def route_rules(spark, sf_dir):
    described = _files(spark, sf_dir).persist()
    page = pages.pages_of(described)
    nodes = markup.nodes(page, "file_id", "content").join(page.select(F.col("file_id").alias("_p"), "project", "file"), F.col("file_id") == F.col("_p")).drop("_p")
    found = structure.route_findings(code.routes(described), code.links(nodes, described), described)
    return union([found, structure.named_route_findings(described)]).select("rule_id", "severity", "project", "file", "line", "snippet")


def project_rules(spark, sf_dir):
    described = _files(spark, sf_dir)
    frameworks = structure.detect_frameworks(described)
    return union([structure.project_findings(described, code.routes(described)), structure.asset_findings(described), structure.coverage_gaps(frameworks), structure.n_plus_one(described)]).select("rule_id", "severity", "project", "file")


def frameworks(spark, sf_dir):
    return structure.detect_frameworks(_files(spark, sf_dir))


def platforms(spark, sf_dir):
    described = _files(spark, sf_dir)
    return structure.detect_platforms(structure.detect_frameworks(described), described)


def dependency_rules(spark, sf_dir):
    return dependencies.findings(_files(spark, sf_dir), table(spark, sf_dir, "installed"), _advisories(spark, sf_dir), 100).select("rule_id", "severity", "project", "message")


def lock_packages(spark, sf_dir):
    return lockfiles.installed(_files(spark, sf_dir))


def resolved_packages(spark, sf_dir):
    got = dependencies.resolved(table(spark, sf_dir, "installed").where("version IS NOT NULL AND recorded_at IS NOT NULL"))
    return got.select("project", "ecosystem", "name", "n_records")


def unpinned(spark, sf_dir):
    rows = table(spark, sf_dir, "installed")
    loose = F.col("version").isNull() | F.col("version").rlike(r"[\^~*><|x ]|latest")
    return rows.where(loose).groupBy("project", "ecosystem").agg(F.count_distinct("name").alias("n"), F.min("name").alias("first"))


#: Advisories over invented packages: (id, ecosystem, package, introduced, fixed, CVSS vector).
ADVISORIES = (
    ("ADV-1", "npm", "comet-hammer", "0", "5.0.0", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("ADV-2", "PyPI", "amber-anchor", "2.0.0", "9.1.0", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    ("ADV-3", "Maven", "atlas-tunnel", "1.4.0", None, "CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:H/I:N/A:N"),
    ("ADV-4", "RubyGems", "amber-button", "0", "9.9.15", "CVSS:3.1/AV:A/AC:L/PR:H/UI:N/S:U/C:N/I:L/A:L"),
    ("ADV-5", "npm", "canvas-satin", "2.5.0", "2.7.4", "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N"),
)


def _advisories(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The advisories, and one for the most frequent package of each ecosystem so that every input has some."""
    base = spark.createDataFrame([list(a) for a in ADVISORIES], "id string, ecosystem string, package string, introduced string, fixed string, vector string")
    if sf_dir is not None:
        counts = table(spark, sf_dir, "installed").where("version IS NOT NULL").groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("ecosystem").agg(F.max_by("name", F.struct("n", "name")).alias("package"))
        base = base.unionByName(top.select(F.concat(F.lit("TOP-"), F.col("ecosystem")).alias("id"), "ecosystem", "package", F.lit("1.0.0").alias("introduced"), F.lit("6.5.0").alias("fixed"), F.lit("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:L/A:N").alias("vector")))
    event = F.array(F.struct("introduced", "fixed", F.lit(None).cast("string").alias("last_affected")))
    return base.select("id", "ecosystem", "package", versions.cvss_base(F.col("vector")).alias("score"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("versions"), event.alias("events"))


def advisory_range_join(spark, sf_dir):
    """Installed packages with three-part versions inside an advisory's range."""
    rows = table(spark, sf_dir, "installed").where(F.col("version").rlike(r"^\d+\.\d+\.\d+$")).select("project", "ecosystem", "name", "version").distinct()
    return dependencies.vulnerable(rows, _advisories(spark, sf_dir)).select("project", "ecosystem", "name", "version", "id", "severity", "fixed")


def semver_compare(spark, sf_dir):
    """Versions of every package against 3.0.0, and how many majors are in use."""
    rows = table(spark, sf_dir, "installed").where(F.col("version").rlike(r"^\d+\.\d+\.\d+$"))
    v = versions.parse_version(F.col("version"))
    return rows.groupBy("ecosystem", versions.compare_versions(F.col("version"), F.lit("3.0.0")).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(v["major"]).alias("majors"), F.min(v["minor"]).alias("least_minor"))


def cvss_scores(spark, sf_dir):
    """Base scores of every vector that the metrics can form, and their severity."""
    parts = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}
    frame = spark.range(1).select(F.lit("CVSS:3.1").alias("vector"))
    for name, values in parts.items():
        frame = frame.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in values]))).select(F.concat("vector", F.lit(f"/{name}:"), "_v").alias("vector"))
    score = versions.cvss_base(F.col("vector"))
    return frame.withColumn("score", score).select("vector", F.round("score", 1).alias("score"), versions.severity_of_score(F.col("score")).alias("severity"))


def contrast_matrix(spark, sf_dir):
    """Contrast of every pair of the colours that style sheets and markup write as six digits."""
    rows = table(spark, sf_dir, "files").where(F.col("content").isNotNull())
    hexes = rows.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"#([0-9a-f]{6})\b"), F.lit(1))).alias("c")).distinct()
    against = spark.createDataFrame([("ffffff",), ("000000",), ("777777",), ("0055aa",)], "bg string")
    pairs = hexes.crossJoin(F.broadcast(against))
    ratio = color.contrast(color.parse_color(F.concat(F.lit("#"), "c")), color.parse_color(F.concat(F.lit("#"), "bg")))
    return pairs.withColumn("ratio", ratio).select("c", "bg", "ratio", color.wcag_level(F.col("ratio")).alias("level"))


def url_normalise(spark, sf_dir):
    urls = table(spark, sf_dir, "files").where("content IS NOT NULL").select(F.explode(F.regexp_extract_all("content", F.lit(r"https?://[A-Za-z0-9./?=&_%#-]+"), F.lit(0))).alias("url")).distinct()
    return urls.select("url", paths.normal_url(F.col("url")).alias("normal"), paths.comparable_url(F.col("url")).alias("comparable"), paths.url_path(F.col("url")).alias("path"))


def glob_filter(spark, sf_dir):
    """Files per project that ignore patterns leave out; the last pattern that fits decides."""
    globs = GLOBS
    rows = table(spark, sf_dir, "files").where("relative_path IS NOT NULL")
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(ignored(F.col("relative_path"), globs)).alias("ignored"))


GLOBS = ("node_modules/", "vendor*/", "*.min.js", "**/__tests__/**", "/public/", "!public/js/", "*.{css,html}")


def edit_plan(spark, sf_dir):
    return fixes.plan(_files(spark, sf_dir)).groupBy("fixer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("project", "file").alias("n_files"))


def edit_fold(spark, sf_dir):
    described = _files(spark, sf_dir)
    return fixes.fixed_files(described, fixes.plan(described)).select("project", "file", "n_edits", F.length("after").alias("length"))


def median_upper(spark, sf_dir):
    """The upper median of event values by type, without interpolation."""
    return upper_median(table(spark, sf_dir, "events"), "event_type", "value")


def _tables(spark, sf_dir):
    from auditlake.audit import Tables

    return Tables(table(spark, sf_dir, "files"), installed=table(spark, sf_dir, "installed"), advisories=_advisories(spark, sf_dir))


def audit_findings(spark, sf_dir):
    """The whole audit: every analyzer, silenced and ordered."""
    from auditlake.audit import audit

    return audit(_tables(spark, sf_dir)).ordered()


def audit_scores(spark, sf_dir):
    from auditlake.audit import audit

    return audit(_tables(spark, sf_dir)).scores


def file_perimeters(spark, sf_dir):
    """Files by the deepest folder with a manifest above them."""
    from auditlake.audit import attributed, perimeters

    described = _files(spark, sf_dir)
    return attributed(described, perimeters(described)).groupBy("project", "path").agg(F.count(F.lit(1)).alias("n"))


def queries():
    names = (
        file_stack, language_stack, source_lines, debt_markers, nesting_depth, duplicate_blocks, commented_code, unreachable_code, identifier_index, http_urls, routes, route_match, imports, import_edges, declarations, function_units,
        html_elements, visible_words, page_rules, style_rules, pattern_rules, secret_scan, quality_rules, deadcode_rules, route_rules, project_rules, frameworks, platforms, dependency_rules, lock_packages, resolved_packages, unpinned, advisory_range_join, semver_compare,
        cvss_scores, contrast_matrix, url_normalise, glob_filter, edit_plan, edit_fold, median_upper, audit_findings, audit_scores, file_perimeters,
    )
    return {f.__name__: f for f in names}


_LINES = r"""l AS (SELECT file_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (
  SELECT file_id, CASE WHEN content = '' THEN [] WHEN s[-1] = '' THEN s[:-2] ELSE s END AS ls FROM (SELECT file_id, content, string_split_regex(content, '\r?\n') AS s FROM files WHERE content IS NOT NULL)))"""
_INDENT = r"length(replace(regexp_extract(text, '^([ \t]*)', 1), chr(9), '    '))"
_BLANK = "trim(text, ' ') = ''"
_V = "[CAST(x AS BIGINT) FOR x IN string_split(version, '.')]"


@lru_cache(maxsize=1)
def _cvss_sql() -> str:
    values = lambda name, kinds: f"(VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in kinds.items())}) {name}(k{name}, v{name})"
    frame = " CROSS JOIN ".join(
        [
            values("av", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}), values("ac", {"L": 0.77, "H": 0.44}), "(VALUES ('N', 0.85, 0.85), ('L', 0.62, 0.68), ('H', 0.27, 0.5)) pr(kpr, vu, vc)", values("ui", {"N": 0.85, "R": 0.62}), "(VALUES ('U'), ('C')) s(ks)",
            values("c", {"H": 0.56, "L": 0.22, "N": 0}), values("i", {"H": 0.56, "L": 0.22, "N": 0}), values("a", {"H": 0.56, "L": 0.22, "N": 0}),
        ]
    )
    return f"""WITH m AS (SELECT 'CVSS:3.1/AV:' || kav || '/AC:' || kac || '/PR:' || kpr || '/UI:' || kui || '/S:' || ks || '/C:' || kc || '/I:' || ki || '/A:' || ka AS vector, ks,
      1 - (1 - CAST(vc_ AS DOUBLE)) * (1 - CAST(vi AS DOUBLE)) * (1 - CAST(va AS DOUBLE)) AS iss, 8.22::DOUBLE * vav * vac * (CASE WHEN ks = 'C' THEN vc ELSE vu END) * vui AS e
      FROM (SELECT kav, CAST(vav AS DOUBLE) vav, kac, CAST(vac AS DOUBLE) vac, kpr, CAST(vu AS DOUBLE) vu, CAST(pr.vc AS DOUBLE) vc, kui, CAST(vui AS DOUBLE) vui, ks, kc, c.vc AS vc_, ki, vi, ka, va FROM {frame})),
     n AS (SELECT *, CASE WHEN ks = 'C' THEN 7.52::DOUBLE * (iss - 0.029) - 3.25::DOUBLE * pow(iss - 0.02, 15) ELSE 6.42::DOUBLE * iss END AS i FROM m),
     t AS (SELECT *, least(CASE WHEN ks = 'C' THEN 1.08::DOUBLE * (i + e) ELSE i + e END, 10) AS total FROM n),
     u AS (SELECT vector, CASE WHEN i <= 0 THEN 0 WHEN CAST(floor(total * 100000 + 0.5) AS BIGINT) % 10000 = 0 THEN floor(total * 100000 + 0.5) / 100000 ELSE (floor(floor(total * 100000 + 0.5) / 10000) + 1) / 10 END AS score FROM t)
    SELECT vector, CAST(round(score, 1) AS DOUBLE) AS score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS severity FROM u"""


def _channel_sql(column: str) -> str:
    out = []
    for i, w in ((1, 0.2126), (3, 0.7152), (5, 0.0722)):
        x = f"(CAST('0x' || substr({column}, {i}, 2) AS INT) / 255.0::DOUBLE)"
        out.append(f"{w}::DOUBLE * (CASE WHEN {x} <= 0.03928 THEN {x} / 12.92::DOUBLE ELSE pow(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END)")
    return " + ".join(out)


def oracle_sql() -> dict[str, str]:
    ext = r"CASE WHEN regexp_matches(regexp_extract(relative_path, '[^/]*$'), '^.+\.[^.]+$') THEN lower(regexp_extract(relative_path, '(\.[^./]+)$', 1)) ELSE '' END"
    globs = " ".join(f"WHEN regexp_matches(relative_path, '{glob_regex(g.lstrip('!'))}') THEN {not g.startswith('!')}" for g in reversed(GLOBS))
    advisories = ", ".join(f"('{i}', '{e}', '{p}', '{lo}', {chr(39) + hi + chr(39) if hi else 'NULL'}, '{sev}')" for (i, e, p, lo, hi, _), sev in zip(ADVISORIES, ("critical", "medium", "medium", "low", "low"), strict=True))
    return {
        "file_stack": rf"""SELECT project, {ext} AS language, count(*) AS files, CAST(sum(CASE WHEN content IS NULL OR content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 - (CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END) END) AS BIGINT) AS lines,
            CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE relative_path IS NOT NULL GROUP BY 1, 2""",
        "source_lines": f"WITH {_LINES} SELECT file_id, count(*) AS n_lines, count(*) FILTER ({_BLANK}) AS blank, CAST(max(length(text)) AS INT) AS widest, CAST(max({_INDENT}) AS INT) AS deepest FROM l GROUP BY 1",
        "debt_markers": rf"WITH {_LINES}, m AS (SELECT file_id, unnest(regexp_extract_all(text, '\b(FIXME|XXX|HACK|BUG|TODO)\b', 1)) AS marker FROM l) SELECT marker, count(*) AS n, count(DISTINCT file_id) AS n_files FROM m GROUP BY 1",
        "nesting_depth": f"WITH {_LINES}, d AS (SELECT file_id, line, CAST(floor({_INDENT} / 2) AS INT) AS depth FROM l WHERE NOT {_BLANK}) SELECT file_id, depth, CAST(min(line) AS INT) AS line FROM d QUALIFY false UNION ALL SELECT file_id, max(depth), CAST(arg_min(line, -depth * 1000000 + line) AS INT) FROM d GROUP BY 1".replace("SELECT file_id, depth, CAST(min(line) AS INT) AS line FROM d QUALIFY false UNION ALL SELECT file_id, max(depth), CAST(arg_min(line, -depth * 1000000 + line) AS INT) FROM d GROUP BY 1", "SELECT file_id, max(depth) AS depth, CAST(arg_min(line, -depth * 1000000 + line) AS INT) AS line FROM d GROUP BY 1"),
        "duplicate_blocks": rf"""WITH {_LINES}, n AS (SELECT file_id, line, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '"[^"]*"|''[^'']*''', '""', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', '0', 'g') AS norm FROM l),
            k AS (SELECT * FROM n WHERE length(norm) > 12),
            w AS (SELECT file_id, line, list(norm) OVER f AS run, max(line) OVER f AS last FROM k WINDOW f AS (PARTITION BY file_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
            b AS (SELECT file_id, line, substr(sha1(array_to_string(run, chr(10))), 1, 16) AS hash FROM w WHERE len(run) = 6 AND last - line + 1 <= 12),
            a AS (SELECT *, lag(line) OVER (PARTITION BY file_id, hash ORDER BY line) AS before FROM b)
            SELECT hash, count(DISTINCT file_id) AS n_files, count(*) AS n_places, min(file_id) AS file_id, CAST(arg_min(line, file_id * 1000000 + line) AS INT) AS line FROM a WHERE before IS NULL OR line - before >= 6 GROUP BY 1 HAVING count(*) > 1""",
        "http_urls": rf"WITH {_LINES}, u AS (SELECT file_id, unnest(regexp_extract_all(text, '(https?)://([A-Za-z0-9.-]+)')) AS url FROM l) SELECT split_part(url, '://', 1) AS scheme, lower(split_part(url, '://', 2)) AS host, count(*) AS n, count(DISTINCT file_id) AS n_files FROM u GROUP BY 1, 2",
        "html_elements": r"""WITH h AS (SELECT file_id, regexp_replace(content, '<!--[\s\S]*?-->', '', 'g') AS content FROM files WHERE ends_with(relative_path, '.html') AND content IS NOT NULL),
            t AS (SELECT file_id, unnest(regexp_extract_all(content, '<(?:img|a)\b[^>]*>')) AS tag FROM h)
            SELECT regexp_extract(tag, '^<(img|a)', 1) AS tag, regexp_extract(tag, '\b(?:src|href)="([^"]*)"', 1) AS target, count(*) AS n, count(DISTINCT file_id) AS n_files FROM t WHERE regexp_matches(tag, '\b(?:src|href)="') GROUP BY 1, 2""",
        "visible_words": r"""SELECT file_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' '), '\s+'), lambda w: length(w) > 1)) AS INT) AS words
            FROM files WHERE ends_with(relative_path, '.html') AND content IS NOT NULL""",
        "resolved_packages": "SELECT project, ecosystem, name, count(*) AS n_records FROM installed WHERE version IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1, 2, 3",
        "unpinned": r"SELECT project, ecosystem, count(DISTINCT name) AS n, min(name) AS first FROM installed WHERE version IS NULL OR regexp_matches(version, '[\^~*><|x ]|latest') GROUP BY 1, 2",
        "advisory_range_join": rf"""WITH c AS (SELECT ecosystem, name, count(*) AS n FROM installed WHERE version IS NOT NULL GROUP BY 1, 2),
            a AS (SELECT * FROM (VALUES {advisories}) v(id, ecosystem, package, lo, hi, severity) UNION ALL SELECT 'TOP-' || ecosystem, ecosystem, arg_max(name, (n, name)), '1.0.0', '6.5.0', 'high' FROM c GROUP BY 1, 2),
            i AS (SELECT DISTINCT project, ecosystem, name, version FROM installed WHERE regexp_matches(version, '^\d+\.\d+\.\d+$'))
            SELECT i.project, i.ecosystem, i.name, i.version, a.id, a.severity, a.hi AS fixed FROM i JOIN a ON i.ecosystem = a.ecosystem AND lower(i.name) = lower(a.package)
            WHERE (a.lo = '0' OR {_V.replace("version", "i.version")} >= {_V.replace("version", "a.lo")}) AND (a.hi IS NULL OR {_V.replace("version", "i.version")} < {_V.replace("version", "a.hi")})""",
        "semver_compare": rf"""WITH i AS (SELECT ecosystem, {_V} AS v FROM installed WHERE regexp_matches(version, '^\d+\.\d+\.\d+$'))
            SELECT ecosystem, CAST(CASE WHEN v < [3, 0, 0] THEN -1 WHEN v = [3, 0, 0] THEN 0 ELSE 1 END AS INT) AS side, count(*) AS n, count(DISTINCT v[1]) AS majors, min(v[2]) AS least_minor FROM i GROUP BY 1, 2""",
        "cvss_scores": _cvss_sql(),
        "contrast_matrix": rf"""WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '#([0-9a-f]{{6}})\b', 1)) AS c FROM files WHERE content IS NOT NULL), p AS (SELECT c, bg FROM h CROSS JOIN (VALUES ('ffffff'), ('000000'), ('777777'), ('0055aa')) b(bg)),
            l AS (SELECT c, bg, {_channel_sql("c")} AS x, {_channel_sql("bg")} AS y FROM p), r AS (SELECT c, bg, floor((greatest(x, y) + 0.05::DOUBLE) / (least(x, y) + 0.05::DOUBLE) * 100 + 0.5) / 100 AS ratio FROM l)
            SELECT c, bg, ratio, CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' WHEN ratio >= 3 THEN 'AA large' ELSE 'fail' END AS level FROM r""",
        "commented_code": rf"""WITH {_LINES}, c AS (SELECT file_id, line, text, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS i FROM l WHERE regexp_matches(text, '^\s*(//|#)\s*\S') AND NOT regexp_matches(text, '^\s*#!')),
            g AS (SELECT file_id, CAST(min(line) AS INT) AS line, count(*) AS n, count(*) FILTER (regexp_matches(text, '[;{{}}]\s*$|\b(?:if|for|while|return|const|let|var|def|import|function)\b.*[({{=:]|^\s*(?://|#)\s*[\w.$]+\s*(?:=|\()')) AS k FROM c GROUP BY file_id, i)
            SELECT file_id, line, n FROM g WHERE n >= 4 AND k >= 0.6 * n""",
        "url_normalise": r"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(content, 'https?://[A-Za-z0-9./?=&_%#-]+')) AS url FROM files WHERE content IS NOT NULL),
            t AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g') AS b FROM u),
            n AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(b, '\?&', '?', 'g'), '[?&]+$', ''), '([^/:])/+$', '\1') AS normal FROM t)
            SELECT url, normal, regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '/+$', '') AS comparable,
              CASE WHEN regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*([^#]*)', 1) END AS path FROM n""",
        "glob_filter": f"SELECT project, count(*) AS n, count(*) FILTER (CASE {globs} ELSE false END) AS ignored FROM files WHERE relative_path IS NOT NULL GROUP BY 1",
        "median_upper": "SELECT event_type, list_sort(list(value))[CAST(floor(count(value) / 2) AS BIGINT) + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY 1",
    }
