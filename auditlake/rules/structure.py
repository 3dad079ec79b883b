"""Rules about quality, dead code, routes and projects, as queries over derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.functions import languages, paths
from auditlake.functions.text import invalid_yaml_escape
from auditlake.operators import code, zones
from auditlake.operators import imports as imports_of
from auditlake.operators.files import lines as lines_of
from auditlake.operators.stack import COVERED, detect_frameworks, detect_platforms, modern_jsx, mount_includes, served_routes  # noqa: F401
from auditlake.schema import check, emit, union

SOURCE_FAMILIES = ("js", "python", "php", "ruby", "jvm", "go", "dart", "dotnet", "swift", "rust")
#: Names that conventions call, and files that tools or frameworks load.
CONVENTIONAL = ("default", "main", "setup", "teardown", "init", "constructor", "build", "render", "handler", "middleware", "config", "metadata", "loader", "action", "getServerSideProps", "getStaticProps", "getStaticPaths", "generateMetadata", "upgrade", "downgrade")
ENTRY = r"(?i)(^|/)(index|main|app|server|cli|setup|manage|wsgi|asgi|conftest|__init__|__main__|settings|config|urls|routes|gulpfile|gruntfile|webpack[^/]*|vite[^/]*|rollup[^/]*|next[^/]*|nuxt[^/]*|babel[^/]*|jest[^/]*|tailwind[^/]*|postcss[^/]*|eslint[^/]*|service-?worker|sw|polyfills?|middleware)\.[^/]+$|(^|/)(bin|scripts?|migrations|pages|routes|app|views|api|public|static|config|tests?|fixtures|examples?)/|\.d\.ts$|\.(config|stories|setup)\.\w+$"
PLATFORM_OVERLAY = r"\.(web|ios|android|native|windows|macos)\.\w+$"


def _sources(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNotNull() & F.col("family").isin(*SOURCE_FAMILIES) & ~F.col("is_vendored") & ~F.col("is_generated"))


def quality_findings(files: DataFrame, config: Config | None = None) -> DataFrame:
    """File size, functions, nesting, duplication, escapes."""
    q = (config or Config()).quality
    sources = _sources(files).where(~F.col("is_test"))
    n = F.size(F.split("content", "\n"))
    size = emit(sources.withColumn("n", n), [check("QUAL-FILE-TOO-LONG", F.when(F.col("n") > 3 * q.max_file_lines, "medium").otherwise("low"), F.col("n") > q.max_file_lines, F.format_string("%d lines", F.col("n")), "File too long")], "quality", effort="important")
    units = code.functions(sources).join(files.select(F.col("file_id").alias("_i"), "project", "file"), F.col("file_id") == F.col("_i")).withColumn("line", F.col("start_line"))
    functions = emit(
        units,
        [
            check("QUAL-HIGH-COMPLEXITY", F.when(F.col("complexity") > 2 * q.max_complexity, "medium").otherwise("low"), F.col("complexity") > q.max_complexity, F.format_string("%s: complexity %d", F.col("name"), F.col("complexity")), "Function too complex"),
            check("QUAL-LONG-FUNCTION", "low", F.col("lines") > q.max_function_lines, F.format_string("%s: %d lines", F.col("name"), F.col("lines")), "Function too long"),
            check("QUAL-TOO-MANY-PARAMS", "low", F.col("params") > q.max_params, F.format_string("%s: %d parameters", F.col("name"), F.col("params")), "Too many parameters"),
        ],
        "quality",
        effort="important",
    )
    rows = lines_of(sources, "file_id", "content", "project", "file", "family")
    deep = rows.where(F.trim("text") != "").groupBy("project", "file").agg(F.max(F.struct(F.floor(F.col("indent") / F.when(F.col("family") == "python", 4).otherwise(2)).cast("int").alias("depth"), (-F.col("line")).alias("_l"))).alias("_d"))
    nesting = emit(deep.select("project", "file", (-F.col("_d._l")).alias("line"), F.col("_d.depth").alias("depth")), [check("QUAL-DEEP-NESTING", "low", F.col("depth") >= 7, F.format_string("%d levels", F.col("depth")), "Code nested too deeply")], "quality")
    # literal blocks and style sheets repeat by nature
    told = rows.join(zones.skipped_lines(sources), ["project", "file", "line"], "left_anti")
    blocks = code.duplicate_blocks(told, q.duplication_min_lines, by=("project", "file")).select("first.project", "first.file", "first.line", "n_files", "n_places")
    copies = emit(blocks, [check("QUAL-DUPLICATION", F.when(F.col("n_files") > 1, "low").otherwise("info"), F.lit(True), F.format_string("%d places in %d files", F.col("n_places"), F.col("n_files")), "Duplicated code")], "quality", effort="important")
    yaml = lines_of(files.where((F.col("language") == "yaml") & F.col("content").isNotNull()), "file_id", "content", "project", "file").where(F.col("text").contains("\\") & ~F.trim("text").startswith("#"))
    escapes = emit(yaml.where(invalid_yaml_escape(F.col("text"))).withColumn("snippet", F.trim("text")), [check("QUAL-YAML-ECHAPPEMENT-INVALIDE", "high", F.lit(True), "Escape that YAML doesn't know", confidence="certain")], "quality", effort="rapide")
    return union([size, functions, nesting, copies, escapes])


def n_plus_one(files: DataFrame) -> DataFrame:
    """Database access inside a loop of Python (by indentation) or Ruby (by do and end): the first line of each file."""
    from pyspark.sql import Window

    access = r"\.(objects\.(get|filter|all)|query\(|execute\(|filter_by\(|find_by|where\(|find\(|fetchone\(|save\()"
    rows = lines_of(_sources(files).where(F.col("family").isin("python", "ruby")), "file_id", "content", "project", "file").where(F.trim("text") != "")
    order = Window.partitionBy("project", "file").orderBy("line")
    loops = F.col("text").rlike(r"^\s*(for\b.*:|while\b.*:|.*\.each\b.*\bdo\b)\s*(#.*)?$")
    # the innermost open loop of a line: the last loop line above it that stands further left, with nothing as far left between
    marked = rows.withColumn("_loop", F.last(F.when(loops, F.struct("line", "indent")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    left = F.min("indent").over(Window.partitionBy("project", "file", "_loop.line").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = marked.where(F.col("_loop").isNotNull()).withColumn("_left", left).where((F.col("_left") > F.col("_loop.indent")) & F.col("text").rlike(access))
    first = inside.groupBy("project", "file").agg(F.min_by(F.struct("line", F.trim("text").alias("snippet")), "line").alias("_x")).select("project", "file", "_x.line", "_x.snippet")
    return emit(first, [check("PERF-NESTED-LOOP-QUERY", "high", F.lit(True), "Query inside a loop")], "performance", effort="important")


def deadcode_findings(files: DataFrame) -> DataFrame:
    """Files nobody imports, exports and imports nobody uses, code that can't run, commented code, assets nobody names."""
    sources = _sources(files)
    imports = code.imports(sources).persist()
    edges = imports_of.followed(imports_of.edges(imports, files.select("project", "file", "name", "content")))
    per_name = code.identifier_counts(sources).persist()
    index = code.inverted(per_name)
    per_file = sources.where(F.col("family").isin("js", "python", "dart", "php", "ruby") & ~F.col("is_test") & ~F.col("file").rlike(ENTRY) & ~F.col("file").rlike(PLATFORM_OVERLAY) & (F.size(F.split("content", "\n")) >= 3))
    targets = edges.select(F.col("project").alias("_p"), F.col("target").alias("_t")).distinct()
    loaded = imports_of.loaded_targets(files).select(F.col("project").alias("_p"), F.col("target").alias("_t"))
    unreached = per_file.join(targets.unionByName(loaded).distinct(), (F.col("project") == F.col("_p")) & (F.col("file") == F.col("_t")), "left_anti").select("project", "file")
    # a file may also be named as a string: its path without ending, looked up among the path-like words of the project
    words = sources.select("project", F.col("file").alias("_in"), F.explode(F.regexp_extract_all("content", F.lit(r"[\w./-]*\w/[\w./-]+"), F.lit(0))).alias("w"))
    named = words.select(F.col("project").alias("_p"), F.regexp_replace(F.regexp_replace("w", r"^\W+", ""), r"\.\w+$", "").alias("_w")).distinct()
    stem = F.regexp_replace("file", r"\.\w+$", "")
    lonely = unreached.withColumn("_s", stem).join(named, (F.col("project") == F.col("_p")) & (F.col("_s") == F.col("_w")), "left_anti")
    dead_files = emit(lonely, [check("DEAD-FILE", "medium", F.lit(True), "Nobody imports this file")], "deadcode")
    declared = code.declarations(sources.where(~F.col("is_test"))).persist()
    used = edges.select(F.col("project").alias("_p"), F.col("target").alias("_t"), F.col("name").alias("_n")).distinct()
    public = declared.where(F.col("exported") & ~F.col("decorated") & (F.length("name") >= 3) & ~F.col("file").rlike(ENTRY) & ~F.col("name").isin(*CONVENTIONAL))
    same = (F.col("project") == F.col("_p")) & (F.col("file") == F.col("_t"))
    alone = public.join(used, same & ((F.col("name") == F.col("_n")) | (F.col("_n") == "*")), "left_anti")
    one_file = index.where("n_files = 1").select(F.col("project").alias("_p"), F.col("name").alias("_n"), F.col("file").alias("_t"))
    exports = emit(alone.join(one_file, same & (F.col("name") == F.col("_n")), "left_semi").withColumn("snippet", F.col("name")), [check("DEAD-EXPORT", "low", F.lit(True), F.concat(F.lit("Nobody uses "), F.col("name")), "Export nobody uses")], "deadcode")
    counts = index.select(F.col("project").alias("_p"), F.col("name").alias("_n"), F.col("n").alias("_k"), F.col("n_files").alias("_f"), F.col("file").alias("_t"))
    hidden = declared.where(~F.col("exported") & ~F.col("decorated") & (F.length("name") >= 3) & ~F.col("name").rlike(r"^(_|test)") & ~F.col("name").isin(*CONVENTIONAL))
    locals_ = emit(hidden.join(counts.where("_k = 1"), same & (F.col("name") == F.col("_n")), "left_semi").withColumn("snippet", F.col("name")), [check("DEAD-LOCAL", "low", F.lit(True), F.concat(F.lit("Nobody uses "), F.col("name")), "Declaration nobody uses", confidence="tentative")], "deadcode", effort="rapide")
    bound = imports.where((F.col("binding") != "") & ~F.col("type").isin("reexport", "reexport-all", "use", "include", "require") & (F.col("source") != "__future__") & ~F.col("binding").isin("*") & ~F.col("file").rlike(r"(^|/)(index|__init__)\.\w+$") & (F.length("binding") > 1))
    # before the automatic transform every component needs the name in scope
    plain_jsx = bound.where("binding = 'React'").join(modern_jsx(files), "project", "left_anti").select("project", "file", "binding")
    bound = bound.join(plain_jsx, ["project", "file", "binding"], "left_anti")
    again = per_name.where("n > 1").select(F.col("project").alias("_p"), F.col("file").alias("_t"), F.col("name").alias("_n"))
    typed = per_name.where("name = 'TYPE_CHECKING'").select(F.col("project").alias("_p"), F.col("file").alias("_t"))
    once = bound.join(again, same & (F.col("binding") == F.col("_n")), "left_anti").join(typed, same, "left_anti")
    unused = emit(once.withColumn("snippet", F.col("binding")), [check("DEAD-IMPORT", "low", F.lit(True), F.concat(F.lit("Unused: "), F.col("binding")), "Import nobody uses")], "deadcode", effort="rapide")
    rows = lines_of(sources, "file_id", "content", "project", "file")
    jumps = emit(code.unreachable(rows, ("project", "file")).withColumn("snippet", F.col("text")), [check("DEAD-UNREACHABLE", "medium", F.lit(True), "Code after a jump")], "deadcode", effort="rapide")
    comments = emit(code.comment_runs(rows, by=("project", "file")), [check("DEAD-COMMENTED-CODE", "info", F.lit(True), F.format_string("%d lines", F.col("n")), "Code in comments")], "deadcode", effort="rapide")
    assets = files.where(paths.extension(F.col("file")).isin(*sorted(languages.IMAGES), ".css", ".woff", ".woff2", ".ttf", ".mp4") & (F.length("name") > 3)).select("project", "file", "name")
    tokens = files.where(F.col("content").isNotNull() & ~F.col("is_vendored")).select(F.col("project").alias("_p"), F.col("file").alias("_in"), F.explode(F.regexp_extract_all("content", F.lit(r"[\w.@-]+\.\w+"), F.lit(0))).alias("_n"))
    named_assets = assets.join(tokens.select("_p", "_n").distinct(), (F.col("project") == F.col("_p")) & (F.col("name") == F.col("_n")), "left_anti")
    asset = emit(named_assets, [check("DEAD-ASSET", "low", F.lit(True), "Nobody names this asset")], "deadcode", effort="rapide")
    return union([dead_files, exports, locals_, unused, jumps, comments, asset])


def route_findings(routes: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Duplicate and odd routes, broken and missing targets, pages nobody links, no page for errors."""
    routes = routes.persist()
    at = F.concat_ws(":", "file", "line")
    twice = routes.where("kind <> 'mount'").groupBy("project", "framework", "method", "pattern").agg(F.count_distinct(at).alias("n"), F.min("file").alias("file"), F.min_by("line", "file").alias("line"))
    duplicate = emit(twice.where("n >= 2").withColumn("snippet", F.concat_ws(" ", "method", "pattern")), [check("ROUTE-DUPLICATE", "medium", F.lit(True), F.format_string("%d definitions", F.col("n")), "Route defined twice")], "routes")
    odd = emit(
        routes.withColumn("snippet", F.col("raw")),
        [
            check("ROUTE-DOUBLE-SLASH", "low", F.col("raw").contains("//"), "Route with a doubled slash"),
            check("ROUTE-UPPERCASE", "low", F.regexp_replace("pattern", r":\w+|\{[^}]*\}|<[^>]*>", "").rlike("[A-Z]"), "Route with capitals"),
            check("ROUTE-UNDERSCORE", "info", F.regexp_replace("pattern", r":\w+|\{[^}]*\}|<[^>]*>", "").contains("_") & (F.col("kind") != "server"), "Route with underscores"),
            check("ROUTE-TOO-DEEP", "info", (F.col("segments") > 5) & (F.col("kind") != "server"), "Route too deep"),
        ],
        "routes",
        effort="rapide",
    )
    inside = code.resolve_links(links).persist()
    alias = F.explode(F.array_distinct(F.array(F.concat(F.lit("/"), F.col("file")), F.concat(F.lit("/"), F.regexp_replace("file", r"^(public|static|src|www)/", "")), paths.file_route(F.col("file")), paths.file_route(F.regexp_replace("file", r"^(public|static|src|www)/", "")))))
    assets = files.select(F.col("project").alias("_p"), alias.alias("_a")).distinct()
    open_ = inside.join(assets, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_a")), "left_anti")
    fixed = routes.where("NOT dynamic").select(F.col("project").alias("_p"), F.col("pattern").alias("_a")).distinct()
    open_ = open_.join(fixed, (F.col("project") == F.col("_p")) & (F.regexp_replace("path", r"\.html?$", "") == F.col("_a")), "left_anti")
    # patterns with parameters: an equi join on project and number of steps, then the expression
    moving = routes.where("dynamic").select(F.col("project").alias("_p"), "regex", F.col("segments").alias("_s"), F.col("pattern").contains("*").alias("_any")).distinct()
    steps = F.size(F.filter(F.split("path", "/"), lambda s: s != ""))
    broken = open_.withColumn("_n", steps)
    broken = broken.join(moving.where("NOT _any"), (F.col("project") == F.col("_p")) & (F.col("_n") == F.col("_s")) & F.regexp_like("path", F.col("regex")), "left_anti")
    broken = broken.join(moving.where("_any"), (F.col("project") == F.col("_p")) & F.regexp_like("path", F.col("regex")), "left_anti")
    with_routes = routes.select(F.col("project").alias("_p")).distinct()
    once = broken.groupBy("project", "path").agg(F.min_by(F.struct("file", "line"), "file").alias("_x")).select("project", "path", "_x.file", "_x.line").withColumn("snippet", F.col("path"))
    static_asset = F.col("path").rlike(r"\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|woff2?|ttf|pdf|mp4|json|xml|txt)$")
    missing = emit(once, [check("ROUTE-MISSING-ASSET", "medium", static_asset, "Asset that doesn't exist")], "routes")
    dead = emit(once.join(with_routes, F.col("project") == F.col("_p"), "left_semi"), [check("ROUTE-BROKEN-LINK", "high", ~static_asset, "Link that leads nowhere")], "routes")
    pages = routes.where("NOT dynamic AND kind IN ('page', 'client') AND pattern <> '/' AND NOT pattern RLIKE '(404|500|error|not-?found)'").select("project", "file", "line", "pattern").distinct()
    reached = inside.select(F.col("project").alias("_p"), F.regexp_replace("path", r"\.html?$", "").alias("_a")).distinct()
    orphan = emit(pages.join(reached, (F.col("project") == F.col("_p")) & (F.col("pattern") == F.col("_a")), "left_anti").withColumn("snippet", F.col("pattern")), [check("ROUTE-ORPHAN", "medium", F.lit(True), "Page nobody links", confidence="tentative")], "routes")
    count = routes.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("pattern").rlike(r"404|not-?found|\*").cast("int")).alias("caught"))
    page404 = files.where(F.col("file").rlike(r"(?i)(404|not-?found)[^/]*$")).select(F.col("project").alias("_p")).distinct()
    no404 = emit(count.where("n >= 3 AND caught = 0").join(page404, F.col("project") == F.col("_p"), "left_anti"), [check("ROUTE-NO-404", "medium", F.lit(True), "No page for unknown addresses")], "routes")
    return union([duplicate, odd, missing, dead, orphan, no404])


def unknown_names(uses: DataFrame, declared: DataFrame, rule: str = "ROUTE-UNKNOWN-NAME") -> DataFrame:
    """Names of routes that templates use and nobody declares; projects that declare none are left out.

    ``uses``: (project, file, line, name); ``declared``: (project, name).
    """
    known = declared.select(F.col("project").alias("_p"), F.regexp_replace("name", "^.*:", "").alias("_n")).distinct()
    some = known.select(F.col("_p").alias("_q")).distinct()
    local = uses.withColumn("_l", F.regexp_replace("name", "^.*:", ""))
    lost = local.join(some, F.col("project") == F.col("_q"), "left_semi").join(known, (F.col("project") == F.col("_p")) & (F.col("_l") == F.col("_n")), "left_anti")
    once = lost.groupBy("project", "name").agg(F.min("file").alias("file"), F.min_by("line", "file").alias("line")).withColumn("snippet", F.col("name"))
    return emit(once, [check(rule, "high", F.lit(True), F.concat(F.lit("No route named "), F.col("name")), "Route name nobody declares")], "routes")


def named_route_findings(files: DataFrame) -> DataFrame:
    """url_for, route() and {% url %} against handlers and declared names."""
    source = files.where(F.col("content").isNotNull())
    use = r"""(?:\burl_for\s*\(\s*|\broute\s*\(\s*|\{%-?\s*url\s+)["']([\w.:-]+)["']"""
    uses = source.where(F.col("content").rlike(use)).select("project", "file", F.lit(None).cast("int").alias("line"), F.explode(F.regexp_extract_all("content", F.lit(use), F.lit(1))).alias("name"))
    flask = source.where((F.col("family") == "python") & F.col("content").contains(".route(")).select("project", F.explode(F.regexp_extract_all("content", F.lit(r"\.route\([^)]*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?def\s+(\w+)"), F.lit(1))).alias("name"))
    named = source.select("project", F.explode(F.regexp_extract_all("content", F.lit(r"""(?:\bname\s*=\s*|->name\(\s*)["']([\w.:-]+)["']"""), F.lit(1))).alias("name"))
    django = uses.join(files.where(F.col("name") == "urls.py").select(F.col("project").alias("_d")).distinct(), F.col("project") == F.col("_d"), "left_semi")
    other = uses.where(~F.col("name").contains(".")).join(files.where(F.col("name") == "urls.py").select(F.col("project").alias("_d")).distinct(), F.col("project") == F.col("_d"), "left_anti")
    declared = flask.unionByName(named)
    return union([unknown_names(django, declared, "DJANGO-URL-UNKNOWN"), unknown_names(other, declared)])


def project_facts(files: DataFrame) -> DataFrame:
    """One row a project with what project rules ask."""
    f, name = F.col("file"), F.lower("name")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    code_file = F.col("family").isin(*SOURCE_FAMILIES) & ~F.col("is_vendored")
    text = F.coalesce("content", F.lit(""))
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(code_file & ~F.col("is_test")).alias("n_sources"),
        F.count_if(code_file & F.col("is_test")).alias("n_tests"),
        F.count_if((F.col("language") == "javascript") & ~F.col("is_vendored")).alias("n_js"),
        any_(name.startswith("readme")).alias("readme"),
        F.max(F.when(name.startswith("readme"), F.size(F.split(text, "\n")))).alias("readme_lines"),
        any_(name == ".gitignore").alias("gitignore"),
        any_(f.rlike(r"(^|/)(\.github/workflows/|\.gitlab-ci\.yml|\.circleci/|azure-pipelines|Jenkinsfile|\.travis\.yml|bitbucket-pipelines)")).alias("ci"),
        any_(f.rlike(r"(^|/)(\.?eslint[^/]*|biome\.jsonc?)$")).alias("linter"),
        any_((name == "package.json") & ~f.contains("node_modules")).alias("package"),
        any_(f.rlike(r"(^|/)node_modules/.*package\.json$")).alias("modules_committed"),
        F.max(F.when((name == "package.json") & ~f.contains("node_modules"), F.try_parse_json(text).isNull().cast("int"))).alias("package_broken"),
        any_((name == "package.json") & text.rlike(r'"test"\s*:\s*"(?!echo)')).alias("test_script"),
        any_((name == "package.json") & text.rlike(r'"lint[\w:]*"\s*:\s*"')).alias("lint_script"),
        any_(f.rlike(r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|npm-shrinkwrap\.json)$")).alias("lockfile"),
        any_(name == "robots.txt").alias("robots"),
        F.max(F.when(name == "robots.txt", text)).alias("robots_text"),
        any_(name.rlike(r"^sitemap.*\.xml$")).alias("sitemap"),
        any_(name.rlike(r"^(manifest\.json|site\.webmanifest|manifest\.webmanifest)$")).alias("manifest"),
        any_(text.rlike(r"(?i)<html\b|<!doctype html")).alias("web"),
        any_(text.rlike(r"(?i)helmet\s*\(|Content-Security-Policy|X-Frame-Options|Strict-Transport-Security|SECURE_HSTS_SECONDS")).alias("headers"),
        any_(code_file & text.rlike(r"\b(?:express|fastify|koa)\s*\(|Flask\s*\(__name__|FastAPI\s*\(|@SpringBootApplication")).alias("server"),
        any_(text.rlike(r"(?:webpack|vite|rollup|esbuild|parcel)")).alias("bundler"),
        any_((name == "package.json") & text.rlike(r'"(?:react|vue|@angular/core)"\s*:')).alias("spa"),
        any_((name == "package.json") & text.rlike(r'"(?:next|nuxt|@angular/ssr|gatsby|astro|@remix-run/\w+|@sveltejs/kit)"\s*:')).alias("ssr"),
        any_((name == "package.json") & text.rlike(r'"(?:react-helmet(?:-async)?|@unhead/vue|vue-meta|@vueuse/head)"\s*:')).alias("head_library"),
        any_(F.col("ext").isin(".ttf", ".otf", ".eot")).alias("old_fonts"),
        F.sum(F.when(F.col("is_image"), F.col("size"))).alias("image_bytes"),
        any_(code_file & text.rlike(r"methods\s*=\s*\[[^\]]*[\"']POST") & text.contains("lask")).alias("flask_post"),
        any_(text.rlike(r"CSRFProtect|csrf_token|flask_wtf")).alias("csrf_signal"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(name.rlike("settings.*\\.py$") | f.rlike("settings/"), F.regexp_extract_all(text, F.lit(r"\b(SECURE_SSL_REDIRECT|SECURE_HSTS_SECONDS|SESSION_COOKIE_SECURE|CSRF_COOKIE_SECURE)\b"), F.lit(1))))))).alias("hardening"),
        any_(name.rlike("settings.*\\.py$") & text.contains("INSTALLED_APPS")).alias("django"),
    )


def project_findings(files: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Rules that a project as a whole breaks."""
    facts = project_facts(files)
    if routes is not None:
        counts = routes.where("kind IN ('client', 'page')").groupBy(F.col("project").alias("_p")).agg(F.count(F.lit(1)).alias("n_pages"))
        facts = facts.join(counts, F.col("project") == F.col("_p"), "left").drop("_p")
    else:
        facts = facts.withColumn("n_pages", F.lit(0))
    c = lambda name: F.col(name) == 1
    no = lambda name: F.coalesce(F.col(name), F.lit(0)) == 0
    quality = emit(
        facts,
        [
            check("QUAL-NO-README", "low", no("readme") & (F.col("n_files") > 15), "No README"),
            check("QUAL-THIN-README", "info", F.col("readme_lines") < 10, "README says little"),
            check("QUAL-NO-TEST-SCRIPT", "low", c("package") & no("test_script"), "No test command"),
            check("QUAL-NO-LINTER", "low", c("package") & no("lint_script") & no("linter"), "No linter"),
            check("QUAL-NO-CI", "low", no("ci") & (F.col("n_files") > 40), "No automatic checks"),
            check("QUAL-NO-TESTS", "medium", (F.col("n_sources") >= 10) & (F.col("n_tests") == 0), "No tests"),
            check("QUAL-LOW-TEST-RATIO", "low", (F.col("n_tests") > 0) & (F.col("n_tests") < 0.1 * F.col("n_sources")), "Few tests"),
        ],
        "quality",
    )
    security = emit(
        facts,
        [
            check("SEC-NO-GITIGNORE", "low", no("gitignore") & (F.col("n_files") > 20), "No ignore file"),
            check("SEC-VENDOR-COMMITTED", "low", c("modules_committed"), "Packages in the repository"),
            check("SEC-MISSING-HEADERS", "medium", c("server") & no("headers"), "No security headers"),
            check("FLASK-NO-CSRF", "high", c("flask_post") & no("csrf_signal"), "Forms without protection"),
            check("DJANGO-HARDENING-MISSING", F.when(F.col("hardening") <= 1, "medium").otherwise("low"), c("django") & (F.col("hardening") < 4), F.format_string("%d of 4 settings", F.col("hardening")), "Hardening settings missing"),
        ],
        "security",
    )
    seo = emit(
        facts,
        [
            check("SEO-ROBOTS-MISSING", "medium", c("web") & no("robots"), "No robots.txt"),
            check("SEO-ROBOTS-BLOCK-ALL", "critical", F.col("robots_text").rlike(r"(?im)^\s*disallow:\s*/\s*$") & ~F.col("robots_text").rlike(r"(?im)^\s*allow:"), "Whole site kept from search"),
            check("SEO-ROBOTS-NO-SITEMAP", "low", c("robots") & ~F.col("robots_text").rlike(r"(?im)^\s*sitemap:"), "robots.txt without a sitemap"),
            check("SEO-SITEMAP-MISSING", "medium", c("web") & no("sitemap"), "No sitemap"),
            check("SEO-MANIFEST-MISSING", "info", c("web") & no("manifest"), "No web manifest"),
            check("SEO-SPA-NO-SSR", F.when(c("head_library"), "medium").otherwise("high"), c("spa") & no("ssr"), "Pages without server output"),
            check("SEO-SPA-SHARED-META", "high", c("spa") & no("ssr") & no("head_library") & (F.col("n_pages") > 3), "All pages share one head"),
        ],
        "seo",
    )
    performance = emit(
        facts,
        [
            check("PERF-TOTAL-IMAGES", "low", F.col("image_bytes") > 5 * 1024 * 1024, "Images too heavy together"),
            check("PERF-FONT-FORMAT", "low", c("old_fonts"), "Old font formats"),
            check("PERF-NO-BUILD-STEP", "medium", c("web") & no("bundler") & (F.col("n_js") > 15), "Many scripts, no bundle"),
        ],
        "performance",
    )
    dependencies = emit(
        facts, [check("DEP-NO-LOCKFILE", "medium", c("package") & no("lockfile"), "No lock file"), check("DEP-MANIFESTE-ILLISIBLE", "high", c("package_broken"), "Manifest can't be read", confidence="certain")], "dependencies", effort="rapide"
    )
    return union([quality, security, seo, performance, dependencies])


def asset_findings(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Images and other assets that are too heavy."""
    p = (config or Config()).performance
    size = F.col("size")
    rows = files.where(~F.col("is_vendored"))
    return emit(
        rows,
        [
            check("PERF-HEAVY-IMAGE", F.when(size > 1024 * 1024, "high").otherwise("medium"), F.col("is_image") & (F.col("ext") != ".svg") & (size > p.max_image_bytes), "Image too heavy"),
            check("PERF-HEAVY-SVG", "low", (F.col("ext") == ".svg") & (size > 50 * 1024), "Drawing too heavy"),
            check("PERF-HEAVY-ASSET", "medium", F.col("ext").isin(".js", ".css", ".json", ".mp4", ".webm", ".zip", ".pdf") & (size > p.max_asset_bytes), "Asset too heavy"),
        ],
        "performance",
    )


def coverage_gaps(frameworks: DataFrame) -> DataFrame:
    """Frameworks in use that no rules of their own look at."""
    rows = frameworks.where(~F.col("framework").isin(*COVERED)).withColumn("file", F.col("proof"))
    return emit(rows, [check("AUDIT-PARTIAL-COVERAGE", "info", F.lit(True), F.concat(F.lit("No rules of its own: "), F.col("framework")), "Framework without its own rules")], "quality")
