"""From import names to files: candidates as rows, one equi join, the first candidate that exists wins.

A name is turned into every path it may mean, in order: next to the importer, under the folders
that aliases, packages of the same repository, Composer prefixes and module roots name. Names that
pass through files which only hand them on are followed to where they are declared.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths
from auditlake.operators.mask import batches_of
from auditlake.session import checkpointed

#: What a name without an ending may end in, by preference.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".py", ".php", ".dart", ".rb", ".java", ".kt", ".scss", ".css", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")
#: Levels of files that hand names on; a longer chain stops there.
HANDS = 8


def packages(files: DataFrame) -> DataFrame:
    """(project, kind, prefix, folder): npm packages and Composer name spaces of the repository, aliases of TypeScript settings, Dart packages."""
    rows = files.where(F.col("content").isNotNull() & ~F.col("file").contains("node_modules"))
    folder = paths.directory(F.col("file"))
    npm = rows.where(F.col("name") == "package.json").select("project", F.lit("npm").alias("kind"), F.from_json("content", "struct<name: string>")["name"].alias("prefix"), folder.alias("folder"))
    composer = rows.where(F.col("name") == "composer.json").select("project", folder.alias("_d"), F.explode(F.from_json("content", "struct<autoload: struct<`psr-4`: map<string, string>>>")["autoload"]["psr-4"]).alias("prefix", "_t"))
    psr4 = composer.select("project", F.lit("php").alias("kind"), F.regexp_replace("prefix", r"\\+$", "").alias("prefix"), paths.normal_path(F.concat_ws("/", "_d", "_t")).alias("folder"))
    settings = rows.where(F.col("name").isin("tsconfig.json", "jsconfig.json"))
    parsed = F.from_json(F.regexp_replace("content", r"(?m)^\s*//.*$|,(?=\s*[}\]])", ""), "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>")["compilerOptions"]
    named = settings.select("project", folder.alias("_d"), F.coalesce(parsed["baseUrl"], F.lit(".")).alias("_b"), F.explode(parsed["paths"]).alias("prefix", "_t")).where(F.size("_t") > 0)
    alias = named.select("project", F.lit("alias").alias("kind"), F.regexp_replace("prefix", r"/?\*$", "").alias("prefix"), paths.normal_path(F.concat_ws("/", "_d", "_b", F.regexp_replace(F.element_at("_t", 1), r"/?\*$", ""))).alias("folder"))
    dart = rows.where(F.col("name") == "pubspec.yaml").select("project", F.lit("dart").alias("kind"), F.concat(F.lit("package:"), F.regexp_extract("content", r"(?m)^name:\s*(\w+)", 1)).alias("prefix"), paths.normal_path(F.concat_ws("/", folder, F.lit("lib"))).alias("folder"))
    return reduce(DataFrame.unionByName, [npm, psr4, alias, dart]).where(F.length("prefix") > 0).distinct()


def _prefixes(source: Column) -> Column:
    """A name and everything it begins with, up to a step: the keys by which packages are looked up."""
    steps = F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def places(file: str, kind: str, source: str, name: str) -> list[str]:
    """The paths without ending that an import may mean, in order, but for declared packages."""
    base = posixpath.dirname(file)
    near = lambda p: posixpath.normpath(posixpath.join(base, p)).removeprefix("./")
    if file.endswith(".py"):
        if "/" in source:
            return []
        dots = len(source) - len(source.lstrip("."))
        module = source.lstrip(".").replace(".", "/")
        member = posixpath.join(module, name) if name != "*" else None  # a name may be a module itself
        if dots:
            up = "/".join([".."] * (dots - 1)) or "."
            return [near(posixpath.join(up, p)) for p in (member, module or ".") if p is not None]
        return [p for p in (member, module, f"src/{module}") if p]
    if source.startswith("."):
        return [near(source)]
    if source[:2] in ("@/", "~/"):
        return [f"src/{source[2:]}", source[2:]]
    if file.endswith((".java", ".kt", ".scala", ".groovy")):
        dotted = source.replace(".", "/").removesuffix("/*")
        return [f"src/main/java/{dotted}", f"src/main/kotlin/{dotted}", dotted]
    if file.endswith((".rb", ".php", ".dart")) and "\\" not in source:
        return [near(source), source]
    return [] if source[0] in "@~" else [source]


def _packed(source: str, prefix: str, folder: str) -> list[str]:
    """The paths inside a declared package, name space or alias."""
    rest = source.replace("\\", "/")[len(prefix) :]
    tries = [folder + rest, f"{folder}/src{rest}", *([f"{folder}/src/index", f"{folder}/index"] if not rest else [])]
    return [posixpath.normpath(t).lstrip("/") for t in tries]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for project, file, kind, source, name, line, prefix, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tries = [(i, t) for i, t in enumerate(places(file, kind, source, name))] if prefix is None else [(-len(prefix), t) for t in _packed(source, prefix, folder or "")]
                for o, t in tries:
                    if t and not t.startswith("../"):
                        for e, ending in enumerate(ENDINGS):
                            yield [project, file, kind, source, name, line, o, e, "__init__.py" if t == "." and ending == "/__init__.py" else t + ending]

    yield from batches_of(rows(), CANDIDATE)


CANDIDATE = pa.schema([("project", pa.string()), ("file", pa.string()), ("type", pa.string()), ("source", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("_o", pa.int32()), ("_e", pa.int32()), ("_c", pa.string())])


def edges(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """(project, importer, source, name, line, target): each import against the project's files, the first candidate that exists.

    Order: next to the importer (relative names), declared prefixes with the longest first, ``@/``
    and ``~/`` below ``src``, then the name as a path or module from the roots. Names that lead out
    of the project have no edge. Empty inputs give none.
    """
    rows = imports_.where(F.length("source") > 0).select("project", "file", "type", "source", "name", "line").distinct()
    known = packages(files).select(F.col("project").alias("_p"), F.replace("prefix", F.lit("\\"), F.lit("/")).alias("_x"), "folder")
    looked = rows.where(~F.col("source").startswith(".")).select("*", F.explode(_prefixes(F.col("source"))).alias("_k"))
    under = looked.join(known, (F.col("project") == F.col("_p")) & (F.col("_k") == F.col("_x"))).select(*rows.columns, F.col("_k").alias("prefix"), "folder")
    tries = rows.select("*", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("folder")).unionByName(under)
    candidates = tries.mapInArrow(_candidates, "project string, file string, type string, source string, name string, line int, _o int, _e int, _c string")
    have = files.select(F.col("project").alias("_p"), F.col("file").alias("_f"))
    hits = candidates.join(have, (F.col("project") == F.col("_p")) & (F.col("_c") == F.col("_f")) & (F.col("file") != F.col("_f")))
    return hits.groupBy("project", F.col("file").alias("importer"), "type", "source", "name", "line").agg(F.min_by("_f", F.struct("_o", "_e", "_f")).alias("target"))


def followed(edges_: DataFrame) -> DataFrame:
    """(project, importer, name, target) with names that a target only hands on followed to where they come from.

    A handed-on name is an edge of type ``reexport`` of the same name, or of ``reexport-all``. At
    most :data:`HANDS` levels; each level is one join on (project, file).
    """
    hands = edges_.where(F.col("type").isin("reexport", "reexport-all")).select(F.col("project").alias("_p"), F.col("importer").alias("_by"), F.when(F.col("type") == "reexport", F.col("name")).alias("_n"), F.col("target").alias("_to")).distinct()
    hands = checkpointed(hands)
    own = hands.where(F.col("_n").isNotNull()).select(F.col("_p").alias("_op"), F.col("_by").alias("_oby"), F.col("_n").alias("_on")).distinct()
    current = checkpointed(edges_.select("project", "importer", "name", "target").distinct())
    for _ in range(HANDS if not hands.isEmpty() else 0):
        met = current.join(hands, (F.col("project") == F.col("_p")) & (F.col("target") == F.col("_by")) & (F.col("_n").isNull() | (F.col("_n") == F.col("name"))) & (F.col("_to") != F.col("importer")))
        # a name that the file hands on by itself does not come through its stars
        apart = met.join(own, (F.col("project") == F.col("_op")) & (F.col("_by") == F.col("_oby")) & (F.col("name") == F.col("_on")), "left").where(F.col("_n").isNotNull() | F.col("_on").isNull())
        step = apart.select("project", "importer", "name", F.col("_to").alias("target"))
        more = checkpointed(step.distinct().join(current, ["project", "importer", "name", "target"], "left_anti"))
        if more.isEmpty():
            break
        current = checkpointed(current.unionByName(more))
    return current


def graph_size(edges_: DataFrame, files: DataFrame) -> DataFrame:
    """(project, files, edges): nodes and distinct edges of the import graph."""
    n = files.groupBy("project").agg(F.count_distinct("file").alias("files"))
    e = edges_.groupBy(F.col("project").alias("_p")).agg(F.count_distinct("importer", "target").alias("edges"))
    return n.join(e, F.col("project") == F.col("_p"), "left").select("project", "files", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def loaded_targets(files: DataFrame) -> DataFrame:
    """(project, target, proof): files that something other than an import loads.

    Entry fields of package manifests, scripts of pages, import maps, workers and service workers.
    """
    rows = files.where(F.col("content").isNotNull() & ~F.col("file").contains("node_modules"))
    folder = paths.directory(F.col("file"))
    package = rows.where(F.col("name") == "package.json")
    one = F.from_json("content", "struct<main: string, module: string, browser: string, types: string, bin: string>")
    many = F.from_json("content", "struct<bin: map<string, string>>")["bin"]
    exports = F.regexp_extract_all(F.regexp_extract("content", r'(?s)"exports"\s*:\s*(\{.*|"[^"]*")', 1), F.lit(r'"(\./[^"*]+\.\w+)"'), F.lit(1))
    named = F.concat(F.array(*[one[k] for k in ("main", "module", "browser", "types", "bin")]), F.coalesce(F.map_values(many), F.array().cast("array<string>")), exports)
    manifest = package.select("project", folder.alias("_d"), F.explode(named).alias("_t"), F.lit("manifest").alias("proof"))
    pages = rows.where(F.col("family") == "markup")
    script = pages.select("project", folder.alias("_d"), F.explode(F.regexp_extract_all("content", F.lit(r"""(?i)<(?:script\b[^>]*?\bsrc|link\b[^>]*?\bhref)\s*=\s*["']([^"':?#]+)"""), F.lit(1))).alias("_t"), F.lit("script").alias("proof"))
    maps = F.regexp_extract("content", r"""(?is)<script\b[^>]*\btype\s*=\s*["']importmap["'][^>]*>(.*?)</script""", 1)
    importmap = pages.where(F.lower("content").contains("importmap")).select("project", folder.alias("_d"), F.explode(F.map_values(F.from_json(maps, "struct<imports: map<string, string>>")["imports"])).alias("_t"), F.lit("import map").alias("proof"))
    code = rows.where(F.col("family").isin("js", "markup"))
    worker = code.select("project", folder.alias("_d"), F.explode(F.regexp_extract_all("content", F.lit(r"""(?:serviceWorker\s*\.\s*register|new\s+(?:Shared)?Worker|importScripts)\s*\(\s*(?:new\s+URL\s*\(\s*)?["'`]([^"'`:?#]+)"""), F.lit(1))).alias("_t"), F.lit("worker").alias("proof"))
    told = reduce(DataFrame.unionByName, [manifest, script, importmap, worker]).where(F.length("_t") > 0)
    bare = F.regexp_replace("_t", "^/+", "")
    tries = F.array(paths.normal_path(F.concat_ws("/", "_d", "_t")), bare, F.concat(F.lit("public/"), bare), F.concat(F.lit("static/"), bare), F.concat(F.lit("src/"), bare))
    ends = F.array(*[F.lit(e) for e in ("", ".js", ".ts", "/index.js")])
    candidates = told.select("project", "proof", F.explode(F.flatten(F.transform(F.filter(tries, lambda t: t.isNotNull()), lambda t: F.transform(ends, lambda e: F.concat(t, e))))).alias("_c")).distinct()
    have = files.select(F.col("project").alias("_p"), F.col("file").alias("target"))
    return candidates.join(have, (F.col("project") == F.col("_p")) & (F.col("_c") == F.col("target"))).groupBy("project", "target").agg(F.min("proof").alias("proof"))
