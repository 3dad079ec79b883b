"""Dependencies: manifests, versions, advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import versions
from auditlake.schema import check, emit, rank, severity_of, union

# Packages that are given up, that are heavy, and first safe versions where no advisory list is at hand.
DEPRECATED = "request node-sass tslint moment bower gulp-util babel-eslint popper.js core-js-2 left-pad querystring har-validator uuid-v3 phantomjs protractor".split()
HEAVY = "moment lodash jquery rxjs three d3 @mui/material".split()
FALLBACK = {"lodash": "4.17.21", "minimist": "1.2.6", "axios": "1.6.0", "express": "4.17.3", "jquery": "3.5.0", "node-fetch": "2.6.7", "jsonwebtoken": "9.0.0", "semver": "7.5.2", "ws": "8.17.1", "tar": "6.2.1", "django": "3.2.25", "flask": "2.2.5", "requests": "2.31.0", "pyyaml": "5.4", "jinja2": "3.1.3", "urllib3": "1.26.18", "pillow": "10.3.0"}


def declared(files: DataFrame) -> DataFrame:
    """(project, name, range, scope, ecosystem, file): of package.json, requirements and the like; the last of a name and scope wins."""
    manifests = files.where(F.col("content").isNotNull() & ~F.col("file").contains("node_modules"))
    scopes = F.map_from_arrays(F.array(*[F.lit(x) for x in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]), F.array(*[F.lit(x) for x in ("prod", "dev", "peer", "optional")]))
    npm = manifests.where(F.col("name") == "package.json")
    parsed = F.from_json("content", "struct<dependencies: map<string,string>, devDependencies: map<string,string>, peerDependencies: map<string,string>, optionalDependencies: map<string,string>>")
    parts = [npm.select("project", "file", F.explode(parsed[k]).alias("name", "range"), F.element_at(scopes, F.lit(k)).alias("scope"), F.lit("npm").alias("ecosystem")) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    requirements = manifests.where(F.col("name").rlike(r"^requirements[^/]*\.txt$")).select("project", "file", F.explode(F.split("content", "\r?\n")).alias("_l"))
    pip = requirements.where(F.col("_l").rlike(r"^\s*[A-Za-z0-9]")).select("project", "file", F.lower(F.regexp_extract("_l", r"^\s*([A-Za-z0-9._-]+)", 1)).alias("name"), F.trim(F.regexp_extract("_l", r"^\s*[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*([^#;]*)", 1)).alias("range"), F.lit("prod").alias("scope"), F.lit("PyPI").alias("ecosystem"))
    composer = manifests.where(F.col("name") == "composer.json").select("project", "file", F.explode(F.from_json("content", "struct<require: map<string,string>>")["require"]).alias("name", "range"), F.lit("prod").alias("scope"), F.lit("Packagist").alias("ecosystem"))
    out = parts[0]
    for p in [*parts[1:], pip, composer]:
        out = out.unionByName(p)
    return out.groupBy("project", "ecosystem", "name", "scope").agg(F.max_by("range", "file").alias("range"), F.max("file").alias("file"))


def resolved(installed: DataFrame) -> DataFrame:
    """One version of each package and project: exact ones before ranges, then the latest record."""
    order = F.struct(F.coalesce("exact", F.lit(False)).alias("e"), F.coalesce("recorded_at", F.lit("1970-01-01").cast("timestamp")).alias("t"), F.coalesce("version", F.lit("")).alias("v"))
    return installed.groupBy("project", "ecosystem", "name").agg(F.max_by(F.struct("version", "exact", "direct"), order).alias("_x"), F.count(F.lit(1)).alias("n_records")).select("project", "ecosystem", "name", "_x.version", "_x.exact", "_x.direct", "n_records")


ADVISORY = "id string, ecosystem string, package string, score double, severity string, summary string, versions array<string>, events array<struct<introduced: string, fixed: string, last_affected: string>>"


def vulnerable(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """(project, ecosystem, name, version, id, severity, fixed): installed packages inside an advisory's range.

    An equi join on ecosystem and name, then the range: explicit versions first, else the events
    folded in version order. Packages without a readable version are never inside.
    """
    a = advisories.select(F.col("ecosystem").alias("_e"), F.col("package").alias("_n"), "id", "score", F.col("severity").alias("_declared"), "versions", "events")
    joined = installed.join(a, (F.col("ecosystem") == F.col("_e")) & (F.lower("name") == F.lower("_n")))
    hit = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)) | versions.affected_by(F.col("version"), F.coalesce("events", F.array().cast("array<struct<introduced: string, fixed: string, last_affected: string>>")))
    severity = F.when(F.col("score").isNotNull(), versions.severity_of_score(F.col("score"))).otherwise(F.when(F.lower("_declared") == "moderate", "medium").otherwise(F.lower("_declared")))
    fixes = F.filter(F.transform("events", lambda e: e["fixed"]), lambda v: v.isNotNull())
    return joined.where(hit).select("project", "ecosystem", "name", "version", "id", severity.alias("severity"), versions.first_fix(F.col("version"), fixes).alias("fixed"))


def vulnerable_packages(hits: DataFrame) -> DataFrame:
    """One row a package: worst severity, number of advisories, highest fix by version order."""
    return hits.groupBy("project", "ecosystem", "name", "version").agg(severity_of(F.min(rank(F.col("severity")))).alias("severity"), F.count_distinct("id").alias("n_advisories"), F.max_by("fixed", versions.parse_version(F.col("fixed"))).alias("fixed"))


def findings(files: DataFrame, installed: DataFrame, advisories: DataFrame | None = None, cache_days: int | None = None) -> DataFrame:
    """All dependency rules; without advisories a short list of first safe versions stands in."""
    spark = files.sparkSession
    wanted = declared(files)
    names = spark.createDataFrame([(n,) for n in DEPRECATED], "_n string")
    old = wanted.join(F.broadcast(names), F.col("name") == F.col("_n"), "left_semi")
    heavy = wanted.join(F.broadcast(spark.createDataFrame([(n,) for n in HEAVY], "_n string")), F.col("name") == F.col("_n"), "left_semi")
    parts = [
        emit(old, [check("DEP-DEPRECATED", F.when(F.col("scope") == "prod", "medium").otherwise("low"), F.lit(True), F.concat(F.col("name"), F.lit(" is given up")), "Package given up")], "dependencies"),
        emit(heavy.where("scope = 'prod'"), [check("PERF-HEAVY-DEPENDENCY", "info", F.lit(True), F.concat(F.col("name"), F.lit(" is heavy")), "Heavy package")], "performance"),
    ]
    loose = wanted.where((F.col("ecosystem") == "npm") & F.col("range").rlike(r"^\s*(\*|latest|x)?\s*$|^(https?|git)[:+]")).groupBy("project").agg(F.min("file").alias("file"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    parts.append(emit(loose, [check("DEP-UNPINNED", "medium", F.lit(True), F.col("names"), "Packages of any version")], "dependencies"))
    words = files.where(F.col("content").isNotNull() & F.col("family").isin("js", "json", "yaml", "markup") & (F.col("name") != "package.json") & ~F.col("name").rlike("lock")).select(F.col("project").alias("_p"), F.explode(F.regexp_extract_all("content", F.lit(r"[\"'](@?[\w.-]+(?:/[\w.-]+)?)"), F.lit(1))).alias("_w"))
    used = words.select("_p", F.explode(F.array_distinct(F.array("_w", F.substring_index("_w", "/", 1)))).alias("_w")).distinct()
    unused = wanted.where("ecosystem = 'npm' AND scope = 'prod'").where(~F.col("name").rlike(r"^(@types/|eslint|babel|webpack|vite|prettier|typescript|jest)")).join(used, (F.col("project") == F.col("_p")) & (F.col("name") == F.col("_w")), "left_anti")
    parts.append(emit(unused, [check("DEP-UNUSED", "low", F.lit(True), F.concat(F.col("name"), F.lit(" is not imported")), "Package nobody imports")], "dependencies", effort="rapide"))
    rows = resolved(installed)
    if advisories is not None:
        packages = vulnerable_packages(vulnerable(rows, advisories))
        message = F.concat_ws(" ", F.col("name"), F.col("version"), F.lit("fixed in"), F.coalesce("fixed", F.lit("no version")))
        parts.append(emit(packages.withColumn("_sev", F.col("severity")).drop("severity"), [check("DEP-VULNERABLE", F.col("_sev"), F.lit(True), message, "Package with known holes", confidence="certain")], "dependencies", effort="rapide"))
        if cache_days is not None and cache_days > 7:
            severity = "high" if cache_days >= 180 else "medium" if cache_days >= 90 else "low" if cache_days >= 30 else "info"
            stale = spark.createDataFrame([(None,)], "project string")
            parts.append(emit(stale, [check("DEP-CACHE-STALE", severity, F.lit(True), f"Advisories are {cache_days} days old", "Advisories out of date")], "dependencies"))
    else:
        safe = spark.createDataFrame(list(FALLBACK.items()), "_n string, _safe string")
        risky = rows.join(F.broadcast(safe), F.lower("name") == F.col("_n")).where(versions.compare_versions(versions.minimum_satisfying(F.col("version")), F.col("_safe")) < 0)
        parts.append(emit(risky, [check("DEP-VULNERABLE", "high", F.lit(True), F.concat_ws(" ", F.col("name"), F.lit("below"), F.col("_safe")), "Package with known holes", confidence="tentative")], "dependencies"))
        fired = risky.select(F.col("project").alias("_p")).distinct()
        unsynced = rows.select("project").distinct().join(fired, F.col("project") == F.col("_p"), "left")
        parts.append(emit(unsynced, [check("DEP-NO-OSV-SYNC", F.when(F.col("_p").isNotNull(), "medium").otherwise("low"), F.lit(True), "No advisories at hand")], "dependencies"))
    return union(parts)


def audit_report(reports: DataFrame) -> DataFrame:
    """DEP-AUDIT rows of dropped audit reports: ``reports`` has (project, file, content)."""
    parsed = F.from_json("content", "struct<vulnerabilities: map<string, struct<severity: string, range: string>>>")["vulnerabilities"]
    rows = reports.select("project", "file", F.explode(parsed).alias("name", "v")).select("project", "file", "name", F.when(F.col("v.severity") == "moderate", "medium").otherwise(F.col("v.severity")).alias("_sev"))
    return emit(rows, [check("DEP-AUDIT", F.col("_sev"), F.lit(True), F.concat(F.lit("Reported: "), F.col("name")), "Hole told by an audit")], "dependencies")
