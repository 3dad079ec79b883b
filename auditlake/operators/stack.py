"""What a project is built with: frameworks, platforms, kind, and the routes its parts mount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths
from auditlake.session import checkpointed

# Frameworks by npm package with their platforms; a package of several platforms has several rows.
NPM = {
    "next": "web", "nuxt": "web", "gatsby": "web", "astro": "web", "@remix-run/react": "web", "@sveltejs/kit": "web", "svelte": "web", "react": "web", "react-dom": "web", "preact": "web", "solid-js": "web", "vue": "web",
    "@angular/core": "web", "ember-source": "web", "lit": "web", "alpinejs": "web", "jquery": "web", "@11ty/eleventy": "web", "@docusaurus/core": "web", "vitepress": "web", "qwik": "web",
    "react-native": "mobile", "expo": "mobile", "@ionic/core": "mobile", "@capacitor/core": "mobile", "nativescript": "mobile", "cordova": "mobile",
    "electron": "desktop", "@tauri-apps/api": "desktop", "nw": "desktop", "@neutralinojs/lib": "desktop",
    "express": "api", "fastify": "api", "koa": "api", "@nestjs/core": "api", "@hapi/hapi": "api", "hono": "api", "restify": "api", "apollo-server": "api", "socket.io": "api", "@trpc/server": "api",
}
#: Frameworks of other ecosystems and their platforms.
OTHER = {"django": "web", "flask": "web", "fastapi": "api", "rails": "web", "sinatra": "web", "laravel": "web", "symfony": "web", "spring": "api", "android": "mobile", "flutter": "mobile", "ios": "mobile", "gin": "api", "python": "script"}
#: A web framework proper keeps a project a web project beside a native one.
PROPER_WEB = frozenset("next nuxt gatsby astro @remix-run/react @sveltejs/kit django flask rails laravel symfony @docusaurus/core".split())
#: Python counts as the stack itself from so many files and this share of all lines on.
PYTHON_FILES, PYTHON_SHARE = 3, 0.15
# Labels of projects, the first whose framework is in use names the project.
LABELS = (
    ("expo", "Expo app"), ("react-native", "React Native app"), ("flutter", "Flutter app"), ("android", "Android app"), ("ios", "iOS app"), ("@ionic/core", "Ionic app"), ("@capacitor/core", "Capacitor app"),
    ("electron", "Electron app"), ("@tauri-apps/api", "Tauri app"), ("next", "Next.js site"), ("nuxt", "Nuxt site"), ("gatsby", "Gatsby site"), ("astro", "Astro site"), ("@remix-run/react", "Remix site"), ("@sveltejs/kit", "SvelteKit site"),
    ("@angular/core", "Angular app"), ("vue", "Vue app"), ("svelte", "Svelte app"), ("react", "React app"), ("django", "Django site"), ("fastapi", "FastAPI service"), ("flask", "Flask site"), ("rails", "Rails site"), ("laravel", "Laravel site"), ("symfony", "Symfony site"),
    ("spring", "Spring service"), ("@nestjs/core", "NestJS service"), ("fastify", "Fastify service"), ("express", "Express service"), ("gin", "Go service"), ("python", "Python project"),
)
COVERED = frozenset("next nuxt astro @sveltejs/kit react react-dom react-native expo @angular/core express electron @tauri-apps/api flask django fastapi rails laravel spring flutter android ios vue svelte python".split())
_SCOPES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def npm_packages(files: DataFrame) -> DataFrame:
    """(project, file, scope, package): what the package manifests of a project name, each scope on its own."""
    manifests = files.where((F.col("name") == "package.json") & F.col("content").isNotNull() & ~F.col("file").contains("node_modules"))
    parsed = F.from_json("content", "struct<" + ", ".join(f"{s}: map<string, string>" for s in _SCOPES) + ">")
    scope = lambda s: F.transform(F.coalesce(F.map_keys(parsed[s]), F.array().cast("array<string>")), lambda k: F.struct(F.lit(s).alias("scope"), k.alias("package")))
    listed = F.flatten(F.array(*[scope(s) for s in _SCOPES]))
    return manifests.select("project", "file", F.explode(listed).alias("_x")).select("project", "file", "_x.scope", "_x.package")


def detect_frameworks(files: DataFrame) -> DataFrame:
    """(project, framework, proof): packages of manifests first (peer ones prove nothing), other manifests, signatures of sources, the weight of Python; the first proof counts."""
    npm = npm_packages(files).where(F.col("package").isin(*NPM) & (F.col("scope") != "peerDependencies")).select("project", "file", F.col("package").alias("framework"), F.lit(0).alias("_o"))
    text, name, family = F.coalesce("content", F.lit("")), F.col("name"), F.col("family")
    manifests = (
        ("django", name.rlike(r"^(requirements.*\.txt|pyproject\.toml|Pipfile|setup\.py)$") & text.rlike(r"(?im)^\W*django\b")), ("flask", name.rlike(r"^(requirements.*\.txt|pyproject\.toml|Pipfile|setup\.py)$") & text.rlike(r"(?im)^\W*flask\b")),
        ("fastapi", name.rlike(r"^(requirements.*\.txt|pyproject\.toml|Pipfile|setup\.py)$") & text.rlike(r"(?im)^\W*fastapi\b")), ("rails", (name == "Gemfile") & text.rlike(r"gem\s+[\"']rails[\"']")), ("sinatra", (name == "Gemfile") & text.rlike(r"gem\s+[\"']sinatra[\"']")),
        ("laravel", (name == "composer.json") & text.contains('"laravel/framework"')), ("symfony", (name == "composer.json") & text.contains('"symfony/framework-bundle"')), ("spring", name.isin("pom.xml", "build.gradle", "build.gradle.kts") & text.contains("org.springframework")),
        ("android", (name == "AndroidManifest.xml") & ~F.col("file").rlike(r"(^|/)(android|build)/app/")), ("flutter", (name == "pubspec.yaml") & text.rlike(r"(?m)^\s+sdk:\s*flutter|^flutter:")), ("ios", name.isin("Podfile", "Info.plist", "Package.swift")), ("gin", (name == "go.mod") & text.contains("gin-gonic/gin")),
    )
    signatures = (
        ("django", text.rlike(r"(?m)^\s*(?:from|import)\s+django\b")), ("flask", text.rlike(r"(?m)^\s*(?:from|import)\s+flask\b")), ("fastapi", text.rlike(r"(?m)^\s*(?:from|import)\s+fastapi\b")),
        ("rails", (family == "ruby") & text.rlike(r"ApplicationController|Rails\.application")), ("laravel", (family == "php") & text.rlike(r"Illuminate\\|Route::(?:get|post)")), ("spring", (family == "jvm") & text.contains("org.springframework")),
    )
    rows = files.where(F.col("content").isNotNull() & ~F.col("is_vendored"))
    proofs = []
    for order, told in ((1, manifests), (2, signatures)):
        found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in told]), lambda x: x.isNotNull())
        proofs.append(rows.select("project", "file", F.explode(found).alias("framework"), F.lit(order).alias("_o")))
    n_lines = F.size(F.split("content", "\n")).cast("long")
    weight = rows.where(family.isin("js", "python", "php", "ruby", "jvm", "go", "dart", "dotnet", "swift", "rust")).groupBy("project").agg(F.sum(n_lines).alias("all"), F.sum(F.when(family == "python", n_lines).otherwise(0)).alias("own"), F.count_if(family == "python").alias("n"), F.min(F.when(family == "python", F.col("file"))).alias("file"))
    python = weight.where((F.col("n") >= PYTHON_FILES) & (F.col("own") >= PYTHON_SHARE * F.col("all"))).select("project", "file", F.lit("python").alias("framework"), F.lit(3).alias("_o"))
    return reduce(DataFrame.unionByName, [npm, *proofs, python]).groupBy("project", "framework").agg(F.min_by("file", F.struct("_o", "file")).alias("proof"))


def detect_platforms(frameworks: DataFrame, files: DataFrame) -> DataFrame:
    """(project, platform): those of frameworks; pages make a web project, but a native one stays native without a web framework proper; 'inconnu' where nothing tells."""
    table = F.create_map(*[F.lit(x) for kv in (NPM | OTHER).items() for x in kv])
    told = frameworks.select("project", F.element_at(table, F.col("framework")).alias("platform"), F.col("framework").isin(*PROPER_WEB).alias("_proper"))
    pages = files.where(F.col("content").rlike(r"(?i)<html\b|<!doctype html") & ~F.col("is_vendored")).select("project", F.lit("web").alias("platform"), F.lit(False).alias("_proper"))
    seen = told.where(F.col("platform").isNotNull()).unionByName(pages).groupBy("project", "platform").agg(F.max("_proper").alias("_proper"))
    native = seen.where("platform IN ('mobile', 'desktop')").select(F.col("project").alias("_p")).distinct()
    known = seen.join(native, F.col("project") == F.col("_p"), "left").where((F.col("platform") != "web") | F.col("_p").isNull() | F.col("_proper")).select("project", "platform")
    # a script is what is left when nothing else tells
    alone = known.groupBy(F.col("project").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    known = known.join(alone, F.col("project") == F.col("_q")).where("platform <> 'script' OR _n = 1").select("project", "platform")
    unknown = files.select("project").distinct().join(known.select("project").distinct(), "project", "left_anti").select("project", F.lit("inconnu").alias("platform"))
    return known.unionByName(unknown)


def describe_projects(frameworks: DataFrame, files: DataFrame) -> DataFrame:
    """(project, label): the first label of the list whose framework is in use; else by pages, else by the language of most files."""
    labels = frameworks.sparkSession.createDataFrame([(i, f, t) for i, (f, t) in enumerate(LABELS)], "_i int, _f string, label string")
    named = frameworks.join(F.broadcast(labels), F.col("framework") == F.col("_f")).groupBy("project").agg(F.min_by("label", "_i").alias("label"))
    shape = files.groupBy(F.col("project").alias("_p"), "language").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("language") == "html").cast("int")).alias("html")).groupBy("_p").agg(F.max("html").alias("html"), F.max_by("language", F.struct("n", "language")).alias("language"))
    other = F.when(F.col("html") == 1, "Static site").otherwise(F.concat(F.initcap("language"), F.lit(" project")))
    return shape.join(named, F.col("_p") == F.col("project"), "left").select(F.col("_p").alias("project"), F.coalesce("label", other).alias("label"))


def libraries(files: DataFrame, platforms: DataFrame) -> DataFrame:
    """(project, library): does a manifest say that others import the project? Private packages and native apps never are."""
    rows = files.where(F.col("content").isNotNull() & ~F.col("file").contains("/"))
    parsed = F.from_json("content", "struct<private: boolean, main: string, module: string, types: string, exports: string, files: array<string>>")
    npm = (F.col("name") == "package.json") & ~F.coalesce(parsed["private"], F.lit(False)) & (parsed["main"].isNotNull() | parsed["module"].isNotNull() | parsed["types"].isNotNull() | parsed["exports"].isNotNull() | parsed["files"].isNotNull())
    python = (F.col("name") == "setup.py") | ((F.col("name") == "pyproject.toml") & F.col("content").rlike(r"(?m)^\[(?:project|tool\.poetry)\]"))
    composer = (F.col("name") == "composer.json") & F.col("content").rlike(r'"type"\s*:\s*"library"|"autoload"\s*:') & ~F.col("content").contains('"laravel/framework"')
    told = rows.groupBy(F.col("project").alias("_p")).agg(F.max((npm | python | composer).cast("int")).alias("_l"))
    native = platforms.where("platform IN ('mobile', 'desktop')").select(F.col("project").alias("_q")).distinct()
    out = files.select("project").distinct().join(told, F.col("project") == F.col("_p"), "left").join(native, F.col("project") == F.col("_q"), "left")
    return out.select("project", ((F.coalesce("_l", F.lit(0)) == 1) & F.col("_q").isNull()).alias("library"))


def modern_jsx(files: DataFrame) -> DataFrame:
    """(project): those whose React brings the automatic transform (17 and later), so that importing it is no use of it."""
    rows = files.where((F.col("name") == "package.json") & F.col("content").isNotNull() & ~F.col("file").contains("node_modules"))
    parsed = F.from_json("content", "struct<dependencies: map<string, string>, devDependencies: map<string, string>, peerDependencies: map<string, string>>")
    version = F.coalesce(parsed["dependencies"]["react"], parsed["devDependencies"]["react"], parsed["peerDependencies"]["react"])
    return rows.where(F.regexp_extract(version, r"(\d+)", 1).try_cast("int") >= 17).select("project").distinct()


_MOUNT = r"""\b(?:path|re_path|url)\s*\(\s*r?["']([^"']*)["']\s*,\s*include\s*\(\s*\(?\s*["']([\w.]+)["']"""


def served_routes(routes: DataFrame, files: DataFrame, depth: int = 8) -> DataFrame:
    """(project, file, pattern): routes of included Django modules as their roots serve them, all other routes as they stand."""
    urls = files.where((F.col("family") == "python") & F.col("content").contains("include"))
    found = urls.select("project", F.col("file").alias("module"), F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(_MOUNT), F.lit(1)).alias("p"), F.regexp_extract_all("content", F.lit(_MOUNT), F.lit(2)).alias("m"))).alias("x"))
    named = found.select("project", "module", F.col("x.p").alias("prefix"), F.concat(F.replace(F.col("x.m"), F.lit("."), F.lit("/")), F.lit(".py")).alias("_inc"))
    # a module's path is a suffix of its file's: ancestors turned round make that an equi join
    tails = files.where(F.col("name").endswith(".py")).select(F.col("project").alias("_p"), F.col("file").alias("included"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), -n, n), "/"))).alias("_tail"))
    mounts = named.join(tails, (F.col("project") == F.col("_p")) & (F.col("_inc") == F.col("_tail"))).groupBy("project", "module", "prefix", "_inc").agg(F.min_by("included", F.struct(F.length("included"), "included")).alias("included"))
    own = routes.where("framework = 'django' AND kind <> 'mount'")
    served = mount_includes(mounts, own.select("project", F.col("file").alias("module"), F.col("raw").alias("pattern"), F.col("file").alias("origin")), depth)
    other = routes.where("framework <> 'django'").select("project", "file", "pattern")
    return served.select("project", F.col("origin").alias("file"), "pattern").unionByName(other).distinct()


def mount_includes(mounts: DataFrame, children: DataFrame, depth: int = 8) -> DataFrame:
    """Patterns of included route files with the prefixes of the files that include them, through at most ``depth`` levels.

    ``mounts``: (project, module, prefix, included); ``children``: (project, module, pattern), and
    perhaps ``origin``, the file that declares them. The result has (project, module, pattern,
    origin) of children as the roots serve them.
    """
    if "origin" not in children.columns:
        children = children.withColumn("origin", F.col("module"))
    included = mounts.select(F.col("project").alias("_p"), F.col("included").alias("_m"), "prefix", F.col("module").alias("_by"))
    current = children.select("project", "module", "pattern", "origin")
    served = []
    for _ in range(depth):
        up = checkpointed(current.join(included, (F.col("project") == F.col("_p")) & (F.col("module") == F.col("_m")), "left"))
        served.append(up.where(F.col("_p").isNull()).select("project", "module", "pattern", "origin"))
        current = up.where(F.col("_p").isNotNull()).select("project", F.col("_by").alias("module"), F.concat(F.regexp_replace("prefix", "/+$", ""), F.lit("/"), F.regexp_replace("pattern", "^/+", "")).alias("pattern"), "origin")
        if current.isEmpty():
            break
    whole = reduce(DataFrame.unionByName, [*served, current])
    return whole.withColumn("pattern", paths.normal_route(F.col("pattern")))
