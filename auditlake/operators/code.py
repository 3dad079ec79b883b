"""Relations derived from source code: lines with depth, functions, imports, declarations, identifiers, routes, links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import paths
from auditlake.functions.text import complexity, normal_line
from auditlake.operators.mask import batches_of, brace_end, mask, masked

FUNCTION_SCHEMA = pa.schema([("_id", pa.int64()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("body", pa.string())])
_BRACE_FUNCTION = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|override\s+|async\s+|suspend\s+)*(?:(?:function\*?|func|fun|fn)\s+(?:\([^)]*\)\s*)?(?P<a>[\w$]+)|(?:const|let|var)\s+(?P<b>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b)?|(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|new\b)(?:[\w<>\[\],.?]+\s+)?(?P<c>[\w$]+))\s*(?P<sig>\([^{};]*?\))\s*(?::\s*[^{=;\n]+)?(?:throws\s+[\w, .]+)?\s*(?:=>)?\s*\{",
    re.M,
)
_PY_FUNCTION = re.compile(r"^(?P<i>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?P<sig>\([^)]*\))", re.M)
_RUBY_FUNCTION = re.compile(r"^(?P<i>[ \t]*)def[ \t]+(?P<n>[\w.?!=]+)[ \t]*(?P<sig>\([^)]*\))?", re.M)
BRACED = frozenset("js php jvm go dart dotnet swift rust c".split())


def extract_functions(text: str, family: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(name, first line, last line, signature, body) by braces, indentation or ``end``."""
    clean = mask(text, family)
    if family in BRACED:
        for m in _BRACE_FUNCTION.finditer(clean):
            end = brace_end(clean, m.end() - 1)
            name = m["a"] or m["b"] or m["c"]
            yield name, clean.count("\n", 0, m.start()) + 1, clean.count("\n", 0, end) + 1, m["sig"], clean[m.end() : end]
    elif family in ("python", "ruby"):
        for m in (_PY_FUNCTION if family == "python" else _RUBY_FUNCTION).finditer(clean):
            base = len(m["i"].expandtabs(4))
            end = len(clean)
            at = clean.find("\n", m.end())
            for later in re.compile(r"^([ \t]*)\S", re.M).finditer(clean, at + 1) if at >= 0 else ():
                if len(later[1].expandtabs(4)) <= base:
                    end = later.start() if family == "python" else clean.find("\n", later.start()) + 1 or len(clean)
                    break
            body = clean[m.end() : end].rstrip()
            first = clean.count("\n", 0, m.start()) + 1
            yield m["n"], first, first + clean[m.start() : m.end() + len(body)].count("\n"), m["sig"] or "", body


def _functions(batches):
    def rows():
        for batch in batches:
            for i, text, family in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for f in extract_functions(text, family):
                    yield [i, *f]

    yield from batches_of(rows(), FUNCTION_SCHEMA)


def functions(files: DataFrame) -> DataFrame:
    """Function units of described files: (file_id, name, start_line, end_line, lines, params, complexity)."""
    rows = files.where(F.col("content").isNotNull() & F.col("family").isin(*BRACED, "python", "ruby")).select("file_id", "content", "family")
    units = rows.mapInArrow(_functions, "_id bigint, name string, start_line int, end_line int, signature string, body string")
    inner = F.regexp_replace("signature", r"^\(|\)$", "")
    params = F.size(F.filter(F.split(inner, ","), lambda p: F.trim(p) != ""))
    return units.select(F.col("_id").alias("file_id"), "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), params.alias("params"), complexity(F.col("body")).alias("complexity"))


def duplicate_blocks(lines: DataFrame, size: int = 6, shortest: int = 12, span: int = 12, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(hash, n_files, n_places, first places): runs of ``size`` significant lines that stand in two places or more.

    Lines are compared without white space and literals; short ones are left out; a run may span at
    most ``span`` source lines. Places of one file that overlap count once.
    """
    kept = lines.withColumn("norm", normal_line(F.col("text"))).where(F.length("norm") > shortest)
    order = Window.partitionBy(*by).orderBy("line").rowsBetween(0, size - 1)
    runs = kept.withColumn("_run", F.collect_list("norm").over(order)).withColumn("_last", F.max("line").over(order))
    blocks = runs.where((F.size("_run") == size) & (F.col("_last") - F.col("line") + 1 <= span)).select(*by, "line", F.substring(F.sha1(F.array_join("_run", "\n")), 1, 16).alias("hash"))
    before = F.lag("line").over(Window.partitionBy(*by, "hash").orderBy("line"))
    apart = blocks.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("line") - F.col("_b") >= size))
    return apart.groupBy("hash").agg(F.count_distinct(*by).alias("n_files"), F.count(F.lit(1)).alias("n_places"), F.min(F.struct(*by, "line")).alias("first")).where("n_places > 1")


def nesting(lines: DataFrame, unit: int = 2, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The deepest line of each file: (*by, depth, line), the first of the deepest."""
    depth = F.floor(F.col("indent") / unit).cast("int")
    deep = lines.where(F.trim("text") != "").groupBy(*by).agg(F.max(F.struct(depth.alias("depth"), (-F.col("line")).alias("_l"))).alias("_d"))
    return deep.select(*by, "_d.depth", (-F.col("_d._l")).alias("line"))


def unreachable(lines: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Lines that follow a jump on the same level: (*by, line, text)."""
    order = Window.partitionBy(*by).orderBy("line")
    full = lines.where(F.trim("text") != "").withColumn("_next", F.lead("text").over(order)).withColumn("_ni", F.lead("indent").over(order)).withColumn("_nl", F.lead("line").over(order))
    jump = F.col("text").rlike(r"^\s*(return\b[^{(\[]*;?|throw\b[^{(\[]*;|raise\b[^{(\[]*|break;?|continue;?|exit\(\d*\);?)\s*$")
    free = ~F.col("_next").rlike(r"^\s*([})\]]|else\b|elif\b|elsif\b|except\b|catch\b|finally\b|case\b|default\b|when\b|end\b|rescue\b|ensure\b|//|#|/\*|\*|@|def\b|class\b|function\b|public\b|private\b|protected\b)")
    return full.where(jump & (F.col("_ni") == F.col("indent")) & (F.col("indent") > 0) & free).select(*by, F.col("_nl").alias("line"), F.trim("_next").alias("text"))


def comment_runs(lines: DataFrame, least: int = 4, share: float = 0.6, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Runs of comment lines that look like code: (*by, line, n)."""
    comments = lines.where(F.col("text").rlike(r"^\s*(//|#(?!!))\s*\S"))
    code = F.col("text").rlike(r"[;{}]\s*$|\b(?:if|for|while|return|const|let|var|def|import|function)\b.*[({=:]|^\s*(?://|#)\s*[\w.$]+\s*(?:=|\()")
    island = F.col("line") - F.row_number().over(Window.partitionBy(*by).orderBy("line"))
    return comments.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.count_if(code).alias("_c")).where((F.col("n") >= least) & (F.col("_c") >= share * F.col("n"))).select(*by, "line", "n")


def identifier_counts(files: DataFrame) -> DataFrame:
    """(project, file, name, n) of the identifiers of each file, outside comments and literals."""
    words = files.where(F.col("content").isNotNull()).select("project", "file", F.explode(F.regexp_extract_all(masked(F.col("content"), F.col("family")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("name"))
    return words.groupBy("project", "name", "file").agg(F.count(F.lit(1)).alias("n"))


def inverted(counts: DataFrame) -> DataFrame:
    """The index (project, name, n, n_files, one file) of counted identifiers."""
    return counts.groupBy("project", "name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_files"), F.min("file").alias("file"))


def identifiers(files: DataFrame) -> DataFrame:
    """The inverted index of the identifiers of described files."""
    return inverted(identifier_counts(files))


# imports, by family: pattern with the groups of clause and source; fixed values.
_IMPORTS = {
    "js": [
        ("esm", r"""^\s*import\s+(?!type\b.*?from\s+type)(?P<c>[\w$*{}\s,]+?)\s+from\s+["'](?P<s>[^"']+)["']"""),
        ("side-effect", r"""^\s*import\s+["'](?P<s>[^"']+)["']"""),
        ("reexport", r"""^\s*export\s+(?P<c>\{[^}]*\})\s*from\s+["'](?P<s>[^"']+)["']"""),
        ("reexport-all", r"""^\s*export\s+(?P<c>\*(?:\s+as\s+\w+)?)\s+from\s+["'](?P<s>[^"']+)["']"""),
        ("cjs", r"""\b(?:const|let|var)\s+(?P<c>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*["'](?P<s>[^"']+)["']\s*\)"""),
        ("dynamic", r"""\bimport\(\s*["'](?P<s>[^"']+)["']\s*\)"""),
    ],
    "python": [("from", r"^[ \t]*from\s+(?P<s>[\w.]+)\s+import\s+(?P<c>\([^)]*\)|[^\n#;]+)"), ("import", r"^[ \t]*import\s+(?P<c>[\w., ]+?)(?=\s*(?:#|;|$))")],
    "jvm": [("import", r"^\s*import\s+(?:static\s+)?(?P<s>[\w.]+(?:\.\*)?)")],
    "dart": [("import", r"""^\s*import\s+["'](?P<s>[^"']+)["']""")],
    "go": [("import", r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<s>[\w./-]+)"\s*$""")],
    "php": [("use", r"^\s*use\s+(?P<s>[\w\\]+)"), ("include", r"""\b(?:require|include)(?:_once)?\s*\(?\s*["'](?P<s>[^"']+)["']""")],
    "ruby": [("require", r"""^\s*require(?:_relative)?\s+["'](?P<s>[^"']+)["']""")],
}
_IMPORT_RE = {family: [(kind, re.compile(p, re.M)) for kind, p in rules] for family, rules in _IMPORTS.items()}
IMPORT_SCHEMA = pa.schema([("project", pa.string()), ("file", pa.string()), ("type", pa.string()), ("source", pa.string()), ("name", pa.string()), ("binding", pa.string()), ("line", pa.int32())])


def clause_names(clause: str) -> list[tuple[str, str]]:
    """(imported name, local name) of an import clause: default, namespace, named and renamed ones."""
    out = []
    for part in re.findall(r"\{[^}]*\}|[^,{}]+", clause):
        part = part.strip().strip("()")
        inside = part.startswith("{")
        for item in part.strip("{}").split(",") if inside else [part]:
            words = re.split(r"\s+as\s+|\s*:\s*", item.strip().removeprefix("type "))
            if not words[0]:
                continue
            name = words[0].strip()
            out.append((name if inside or name == "*" else "default", words[-1].strip()))
    return out


def extract_imports(text: str, family: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(type, source, imported name, local name, line)."""
    for kind, pattern in _IMPORT_RE.get(family, ()):
        for m in pattern.finditer(text):
            groups = m.groupdict()
            line = text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
            source, clause = groups.get("s") or "", groups.get("c")
            if family == "python":
                if kind == "from":
                    for item in clause.strip("()").split(","):
                        words = re.split(r"\s+as\s+", re.sub(r"#.*", "", item).strip())
                        if words[0]:
                            yield kind, source, words[0], words[-1], line
                else:
                    for item in clause.split(","):
                        words = re.split(r"\s+as\s+", item.strip())
                        yield kind, words[0], "*", words[-1].split(".")[0], line
            elif family == "js":
                names = clause_names(clause) if clause else [("*", "")]
                if kind == "cjs" and not clause.startswith("{"):
                    names = [("*", clause.strip())]
                for name, local in names:
                    yield kind, source, name, local, line
            elif family == "dart":
                yield kind, source, "*", "", line
            else:
                last = re.split(r"[./\\]", source)[-1]
                yield kind, source, last, last, line


def _imports(batches):
    def rows():
        for batch in batches:
            for project, file, text, family in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for kind, source, name, binding, line in extract_imports(text, family):
                    yield [project, file, kind, source, name, binding, line]

    yield from batches_of(rows(), IMPORT_SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    """(project, file, type, source, name, binding, line) of every imported name of described files."""
    rows = files.where(F.col("content").isNotNull() & F.col("family").isin(*_IMPORTS)).select("project", "file", "content", "family")
    return rows.mapInArrow(_imports, "project string, file string, type string, source string, name string, binding string, line int")


_DECLARATIONS = {
    "js": r"^[ \t]*(?P<e>export\s+(?:default\s+)?)?(?:async\s+)?(?P<k>function\*?|class|const|let|var|interface|type|enum)\s+(?P<n>[A-Za-z_$][\w$]*)",
    "python": r"^(?P<i>[ \t]*)(?:async\s+)?(?P<k>def|class)\s+(?P<n>\w+)",
    "php": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*(?P<k>function|class|interface|trait)\s+(?P<n>\w+)",
    "ruby": r"^[ \t]*(?P<k>def|class|module)\s+(?P<n>[\w.?!]+)",
    "jvm": r"^[ \t]*(?P<e>public\s+)?(?:(?:private|protected|static|final|abstract|open|data|sealed)\s+)*(?P<k>class|interface|enum|object|fun)\s+(?P<n>\w+)",
    "go": r"^(?P<k>func|type)\s+(?:\([^)]*\)\s*)?(?P<n>\w+)",
    "dart": r"^[ \t]*(?:abstract\s+)?(?P<k>class|mixin|enum|extension)\s+(?P<n>\w+)",
    "dotnet": r"^[ \t]*(?P<e>public\s+)?(?:(?:private|protected|internal|static|sealed|abstract|partial)\s+)*(?P<k>class|interface|enum|struct|record)\s+(?P<n>\w+)",
    "swift": r"^[ \t]*(?P<e>public\s+|open\s+)?(?:(?:private|final|static|fileprivate|internal)\s+)*(?P<k>func|class|struct|enum|protocol)\s+(?P<n>\w+)",
}
_DECLARATION_RE = {family: re.compile(p, re.M) for family, p in _DECLARATIONS.items()}
#: Names exported apart from their declaration.
_LISTED = re.compile(r"^[ \t]*export\s*\{([^}]*)\}(?!\s*from)|\bmodule\.exports\s*=\s*\{?([^};\n]*)", re.M)
DECLARATION_SCHEMA = pa.schema([("project", pa.string()), ("file", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("exported", pa.bool_()), ("decorated", pa.bool_())])


def extract_declarations(text: str, family: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(name, kind, line, exported, decorated), the first of each name."""
    pattern = _DECLARATION_RE.get(family)
    if pattern is None:
        return
    clean = mask(text, family)
    lines = clean.split("\n")
    listed = set(re.findall(r"[\w$]+", " ".join(m[1] or m[2] or "" for m in _LISTED.finditer(clean)))) if family == "js" else set()
    seen = set()
    for m in pattern.finditer(clean):
        name, groups = m["n"], m.groupdict()
        if name in seen:
            continue
        seen.add(name)
        line = clean.count("\n", 0, m.start("n")) + 1
        above = line - 2
        decorated = False
        while above >= 0 and line - above <= 7 and lines[above].strip():
            if lines[above].lstrip().startswith(("@", "#[")):
                decorated = True
                break
            if not lines[above].lstrip().startswith((")", "*", "//", "#")):
                break
            above -= 1
        if family in ("python", "ruby", "php"):
            exported = not name.startswith("_") and not (groups.get("i") or "")
        elif family in ("go", "dart"):
            exported = name[0].isupper() if family == "go" else not name.startswith("_")
        else:
            exported = bool(groups.get("e")) or name in listed
        yield name, m["k"], line, exported, decorated


def _declared(batches):
    def rows():
        for batch in batches:
            for project, file, text, family in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for d in extract_declarations(text, family):
                    yield [project, file, *d]

    yield from batches_of(rows(), DECLARATION_SCHEMA)


def declarations(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("content").isNotNull() & F.col("family").isin(*_DECLARATIONS)).select("project", "file", "content", "family")
    return rows.mapInArrow(_declared, "project string, file string, name string, kind string, line int, exported boolean, decorated boolean")


# Routes: framework, families, kind, pattern with method (m) and path (p); fixed values.
_ROUTES = (
    ("express", "js", "server", r"\b(?:app|router|server|api|fastify)\.(?P<m>get|post|put|patch|delete|all|options|head)\s*\(\s*[\"'`](?P<p>/[^\"'`]*|\*)[\"'`]"),
    ("nestjs", "js", "server", r"@(?P<m>Get|Post|Put|Patch|Delete)\s*\(\s*(?:[\"'`](?P<p>[^\"'`]*)[\"'`])?\s*\)"),
    ("react-router", "js", "client", r"<Route\b[^>]*\bpath\s*=\s*[\"'{]+(?P<p>[^\"'}]+)"),
    ("vue-router", "js", "client", r"\bpath\s*:\s*[\"'`](?P<p>/[^\"'`]*)[\"'`]\s*,\s*(?:name|component|children)\b"),
    ("angular", "js", "client", r"\{\s*path\s*:\s*[\"'`](?P<p>[^\"'`]*)[\"'`]\s*,\s*(?:component|loadChildren|loadComponent|redirectTo)\b"),
    ("flask", "python", "server", r"@\w+\.route\s*\(\s*[\"'](?P<p>[^\"']+)[\"'](?:[^)]*methods\s*=\s*\[\s*[\"'](?P<m>\w+))?"),
    ("fastapi", "python", "server", r"@\w+\.(?P<m>get|post|put|patch|delete)\s*\(\s*[\"'](?P<p>[^\"']*)[\"']"),
    ("django", "python", "server", r"\b(?:path|re_path|url)\s*\(\s*r?[\"'](?P<p>[^\"']*)[\"']\s*,"),
    ("spring", "jvm", "server", r"@(?P<m>Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\"(?P<p>[^\"]*)\""),
    ("laravel", "php", "server", r"\bRoute::(?P<m>get|post|put|patch|delete|any|view)\s*\(\s*[\"'](?P<p>[^\"']*)[\"']"),
    ("symfony", "php", "server", r"#\[Route\s*\(\s*(?:path:\s*)?[\"'](?P<p>[^\"']+)[\"']"),
    ("rails", "ruby", "server", r"^\s*(?P<m>get|post|put|patch|delete)\s+[\"'](?P<p>[^\"']+)[\"']"),
    ("go", "go", "server", r"\b\w+\.(?P<m>HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post)\s*\(\s*\"(?P<p>/[^\"]*)\""),
    ("go_router", "dart", "page", r"\bGoRoute\s*\([^)]*?\bpath\s*:\s*[\"'](?P<p>[^\"']+)[\"']"),
    ("flutter", "dart", "page", r"^\s*[\"'](?P<p>/[\w/:-]*)[\"']\s*:\s*\(\s*\w*\s*\)\s*=>"),
)
_ROUTE_RE = [(fw, fam, kind, re.compile(p, re.M)) for fw, fam, kind, p in _ROUTES]
_PREFIX = {"jvm": re.compile(r"@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<p>[^\"]*)\"\s*\)\s*(?:@\w+[^\n]*\s*)*(?:public\s+)?class"), "js": re.compile(r"@Controller\s*\(\s*[\"'`](?P<p>[^\"'`]*)[\"'`]\s*\)")}
_METHODLESS = {"HandleFunc": "ANY", "Handle": "ANY", "all": "ANY", "any": "ANY", "view": "GET"}
ROUTE_SCHEMA = pa.schema([("project", pa.string()), ("file", pa.string()), ("framework", pa.string()), ("kind", pa.string()), ("method", pa.string()), ("raw", pa.string()), ("line", pa.int32())])


def extract_routes(text: str, family: str, path: str = "") -> Iterator[tuple[str, str, str, str, int]]:
    """(framework, kind, method, raw pattern, line); class prefixes stand before method paths."""
    prefix = ""
    if family in _PREFIX and (m := _PREFIX[family].search(text)):
        prefix = "/" + m["p"].strip("/")
    for framework, fam, kind, pattern in _ROUTE_RE:
        if fam != family or (framework == "django" and "urls" not in path):
            continue
        for m in pattern.finditer(text):
            groups = m.groupdict()
            method = groups.get("m")
            method = _METHODLESS.get(method, (method or ("GET" if kind == "server" else "PAGE")).upper())
            raw = groups.get("p") or ""
            mounts = framework == "django" and text[m.end() : m.end() + 40].lstrip().startswith("include")
            if framework in ("spring", "nestjs") and prefix:
                raw = prefix + "/" + raw.strip("/")
            yield framework, "mount" if mounts else kind, method, raw, text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1


def _routes(batches):
    def rows():
        for batch in batches:
            for project, file, text, family in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for r in extract_routes(text, family, file):
                    yield [project, file, *r]

    yield from batches_of(rows(), ROUTE_SCHEMA)


def routes(files: DataFrame) -> DataFrame:
    """(project, file, framework, kind, method, raw, line, pattern, regex, segments, dynamic) of code, files and static pages."""
    rows = files.where(F.col("content").isNotNull() & ~F.col("is_test") & F.col("family").isin("js", "python", "jvm", "php", "ruby", "go", "dart")).select("project", "file", "content", "family")
    code = rows.mapInArrow(_routes, "project string, file string, framework string, kind string, method string, raw string, line int")
    routed = r"(?:^|/)(?:pages|app|routes)/(.+)$"
    served = files.where(F.col("family").isin("js", "markup") & F.col("file").rlike(routed) & ~F.col("file").rlike(r"(^|/)_|/\+(?!page)[^/]*$|_layout\.|/api/") & F.col("language").isin("typescript", "javascript", "vue", "svelte", "astro"))
    app = served.where(~F.col("file").rlike(r"(^|/)app/") | F.col("name").rlike(r"^(page|index)\.\w+$"))
    pages = app.select("project", "file", F.lit("files").alias("framework"), F.lit("page").alias("kind"), F.lit("PAGE").alias("method"), paths.file_route(F.regexp_extract("file", routed, 1)).alias("raw"), F.lit(1).alias("line"))
    static = files.where((F.col("language") == "html") & F.col("content").rlike(r"(?i)<html\b|<!doctype")).select("project", "file", F.lit("static").alias("framework"), F.lit("page").alias("kind"), F.lit("PAGE").alias("method"), paths.file_route(F.col("file")).alias("raw"), F.lit(1).alias("line"))
    all_ = code.unionByName(pages).unionByName(static)
    # bound by the grouping, so that the expression of a route is not derived anew for each column that builds on it
    with_pattern = all_.groupBy("project", "file", "framework", "kind", "method", "raw", "line").agg(F.max(paths.normal_route(F.col("raw"))).alias("pattern"))
    return with_pattern.withColumn("regex", paths.route_regex(F.col("pattern"))).withColumn("segments", F.size(F.filter(F.split("pattern", "/"), lambda s: s != ""))).withColumn("dynamic", F.col("pattern").rlike(r"[:*{<\[]"))


def links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file, line, target, kind, external): of elements and of navigation calls in code."""
    attr = lambda n: F.element_at("attrs", F.lit(n))
    target = F.when(F.col("tag").isin("a", "link"), attr("href")).when(F.col("tag").isin("img", "script", "iframe", "source"), attr("src")).when(F.col("tag") == "form", attr("action"))
    kind = F.when(F.col("tag") == "a", "href").when(F.col("tag") == "form", "action").otherwise("asset")
    dom = nodes.withColumn("target", target).where(F.col("target").isNotNull() & ~F.col("target").rlike(r"^\s*(#|javascript:|mailto:|tel:|data:)|\{\{|<%|\$\{|^\s*$")).select("project", "file", "line", F.trim("target").alias("target"), kind.alias("kind"))
    call = r"(?:\b(?:navigate|push|replace|redirect|res\.redirect)\s*\(\s*|\b(?:to|href)\s*[=:]\s*)[\"'`](/[^\"'`\s]*)[\"'`]"
    code = files.where((F.col("family") == "js") & F.col("content").rlike(call)).select("project", "file", F.explode(F.regexp_extract_all("content", F.lit(call), F.lit(1))).alias("target")).select("project", "file", F.lit(None).cast("int").alias("line"), "target", F.lit("call").alias("kind"))
    return dom.unionByName(code).withColumn("external", F.col("target").rlike(r"^(?:[a-zA-Z][\w+.-]*:)?//"))


def resolve_links(links_: DataFrame) -> DataFrame:
    """Internal links with ``path``: absolute in the project, relative ones from the linking file's folder."""
    bare = F.regexp_replace("target", r"[?#].*$", "")
    path = F.when(bare.startswith("/"), paths.normal_route(bare)).otherwise(paths.normal_route(paths.normal_path(F.concat(paths.directory(F.col("file")), F.lit("/"), bare))))
    return links_.where(~F.col("external")).withColumn("path", path)
