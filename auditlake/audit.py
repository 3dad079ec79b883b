"""The whole audit: analyzers in their order, findings silenced and ordered, scores and plan.

An analyzer is a function of the tables and the settings that returns findings; anyone can register
one. One that fails leaves a finding that says so, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.functions import paths
from auditlake.operators import code, files, markup, post, score
from auditlake.rules import crawl, dependencies, pages, scan, structure, styles
from auditlake.schema import as_findings, union
from auditlake.session import checkpointed


@dataclass
class Tables:
    """What an audit reads; derived relations are built when first asked for and shared."""

    files: DataFrame
    config: Config = field(default_factory=Config)
    installed: DataFrame | None = None
    advisories: DataFrame | None = None
    crawled: DataFrame | None = None
    robots: DataFrame | None = None
    external: DataFrame | None = None
    measurements: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def described(self) -> DataFrame:
        return files.describe(self.files, self.config)

    @cached_property
    def nodes(self) -> DataFrame:
        page = pages.pages_of(self.described)
        return markup.nodes(page, "file_id", "content").join(page.select(F.col("file_id").alias("_p"), "project", "file"), F.col("file_id") == F.col("_p")).drop("_p")

    @cached_property
    def routes(self) -> DataFrame:
        return code.routes(self.described)

    @cached_property
    def links(self) -> DataFrame:
        return code.links(self.nodes, self.described)

    @cached_property
    def frameworks(self) -> DataFrame:
        return structure.detect_frameworks(self.described)

    @cached_property
    def platforms(self) -> DataFrame:
        """Detected platforms, or those the settings name."""
        if self.config.platforms:
            named = self.spark.createDataFrame([(p,) for p in self.config.platforms], "platform string")
            return self.described.select("project").distinct().crossJoin(F.broadcast(named))
        return structure.detect_platforms(self.frameworks, self.described)


@dataclass(frozen=True)
class Analyzer:
    id: str
    categories: tuple[str, ...]
    order: int
    run: Callable[[Tables], DataFrame]
    wants: Callable[[Tables], bool] = lambda t: True


REGISTRY: list[Analyzer] = [
    Analyzer("security", ("security",), 10, lambda t: union([scan.pattern_findings(t.described), scan.secret_findings(t.described)])),
    Analyzer("routes", ("routes",), 20, lambda t: union([structure.route_findings(t.routes, t.links, t.described), structure.named_route_findings(t.described)])),
    Analyzer("deadcode", ("deadcode",), 30, lambda t: structure.deadcode_findings(t.described)),
    Analyzer("frameworks", ("quality",), 35, lambda t: structure.coverage_gaps(t.frameworks)),
    Analyzer("pages", ("seo", "design", "performance", "routes"), 40, lambda t: pages.page_findings(t.described, t.config)),
    Analyzer("styles", ("design",), 50, lambda t: styles.style_findings(t.described, t.config)),
    Analyzer("performance", ("performance",), 60, lambda t: union([structure.asset_findings(t.described, t.config), structure.n_plus_one(t.described)])),
    Analyzer("quality", ("quality",), 70, lambda t: structure.quality_findings(t.described, t.config)),
    Analyzer("projects", ("quality", "security", "seo", "performance", "dependencies"), 75, lambda t: structure.project_findings(t.described, t.routes)),
    Analyzer("dependencies", ("dependencies", "performance"), 80, lambda t: dependencies.findings(t.described, t.installed, t.advisories), lambda t: t.installed is not None),
    Analyzer("crawl", ("seo", "routes", "security", "performance"), 90, lambda t: crawl.page_findings(t.crawled, t.robots, t.routes), lambda t: t.crawled is not None and t.robots is not None),
    Analyzer("external", ("routes",), 91, lambda t: crawl.external_findings(t.external), lambda t: t.external is not None),
    Analyzer("loads", ("performance",), 95, lambda t: crawl.load_findings(t.measurements), lambda t: t.measurements is not None),
]


def register(analyzer: Analyzer) -> None:
    """Adds an analyzer; one of the same id is replaced."""
    REGISTRY[:] = [a for a in REGISTRY if a.id != analyzer.id] + [analyzer]


def findings(tables: Tables, analyzers: Sequence[Analyzer] | None = None) -> DataFrame:
    """The findings of every enabled analyzer that has its tables. Branches of categories that are off are never planned.

    Each analyzer runs as a job of its own whose findings are checkpointed: the plans stay small,
    and one that fails, while planned or while running, leaves the findings of the others alone.
    """
    parts, failed = [], []
    for a in sorted(analyzers if analyzers is not None else REGISTRY, key=lambda a: a.order):
        if not set(a.categories) & set(tables.config.categories) or not a.wants(tables):
            continue
        try:
            parts.append(checkpointed(a.run(tables)))
        except Exception as e:
            failed.append((a.id, f"{type(e).__name__}: {e}"[:500]))
    if failed or not parts:
        lost = tables.spark.createDataFrame(failed, "snippet string, message string")
        parts.append(as_findings(lost, rule_id="AUDIT-ANALYZER-FAILED", category="quality", severity="low", title="An analyzer failed", confidence="certain"))
    return union(parts)


@dataclass
class Result:
    """What an audit says: judged findings (with the reason of those not kept), scores, plan."""

    judged: DataFrame
    n_files: DataFrame
    config: Config

    @cached_property
    def kept(self) -> DataFrame:
        return post.kept(self.judged)

    @cached_property
    def scores(self) -> DataFrame:
        return score.category_scores(self.kept, self.n_files, ["project"], self.config.categories)

    @cached_property
    def totals(self) -> DataFrame:
        return score.global_scores(self.scores, ["project"])

    def plan(self, top: int = 12) -> DataFrame:
        return score.action_plan(self.kept.withColumn("_seq", F.concat_ws("\u0001", F.coalesce("file", F.lit("")), F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 9, "0"))), "_seq", top)

    def ordered(self) -> DataFrame:
        return post.ordered(self.kept)


def audit(tables: Tables, baseline: DataFrame | None = None, changed: DataFrame | None = None) -> Result:
    """Runs everything. With ``changed`` (files of a change) only their findings count, and the score's size is theirs."""
    described = tables.described
    rows = files.lines(scan.sources(described).where(F.col("content").contains("audit-ignore")), "file_id", "content", "project", "file")
    # the branches of all analyzers are evaluated once; scores, plan and order read the judged rows
    judged = checkpointed(post.filter_chain(findings(tables), tables.config, tables.platforms, post.comment_silence(rows), baseline))
    counted = described
    if changed is not None:
        judged = post.only_changed(judged, changed)
        counted = described.join(changed.select("file").distinct(), "file", "left_semi")
    n_files = counted.groupBy("project").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_files"))
    return Result(judged, n_files, tables.config)


# Manifests that mark a sub-project, and folders that never are one.
MANIFESTS = ("package.json", "composer.json", "pyproject.toml", "requirements.txt", "pubspec.yaml", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "Cargo.toml", "Gemfile")
NO_PERIMETER = r"(^|/)(node_modules|vendor|tests?|spec|fixtures|examples?|templates?)(/|$)|(^|/)(?<!(apps|packages|services|modules|projects|libs)/)(android|ios|macos|windows|linux|web)(/|$)"


def perimeters(described: DataFrame) -> DataFrame:
    """(project, path) of sub-projects: folders with a manifest, the root as the empty path, native targets and test folders left out."""
    return described.where(F.col("name").isin(*MANIFESTS)).select("project", paths.directory(F.col("file")).alias("path")).where(~F.col("path").rlike(NO_PERIMETER)).distinct()


def attributed(described: DataFrame, perimeters_: DataFrame) -> DataFrame:
    """(project, file, path): each file in the deepest perimeter above it; paths explode into ancestors, so it is an equi join."""
    up = described.select("project", "file", F.explode(paths.ancestors(F.col("file"))).alias("_a"))
    p = perimeters_.select(F.col("project").alias("_p"), "path")
    return up.join(p, (F.col("project") == F.col("_p")) & (F.col("_a") == F.col("path"))).groupBy("project", "file").agg(F.max_by("path", F.length("path")).alias("path"))


def is_monorepo(perimeters_: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(project, n, monorepo): two sub-projects or more below the root, or one and a declaration of workspaces."""
    below = perimeters_.groupBy("project").agg(F.count_if(F.col("path") != "").alias("n"))
    if described is None:
        return below.withColumn("monorepo", F.col("n") >= 2)
    says = (F.col("file") == "package.json") & F.col("content").rlike(r'"workspaces"\s*:') | F.col("file").isin("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "melos.yaml") | (F.col("file") == "Cargo.toml") & F.col("content").contains("[workspace]")
    declared = described.where(says).select(F.col("project").alias("_p")).distinct()
    return below.join(declared, F.col("project") == F.col("_p"), "left").select("project", "n", ((F.col("n") >= 2) | (F.col("n") == 1) & F.col("_p").isNotNull()).alias("monorepo"))
