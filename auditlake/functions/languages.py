"""Languages and families of files from their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.paths import base_name, extension

# Languages by extension and by whole name.
EXTENSIONS = {
    "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "vue": ".vue", "svelte": ".svelte", "astro": ".astro", "python": ".py .pyi .pyw", "php": ".php .phtml", "ruby": ".rb .rake .erb .gemspec", "java": ".java", "kotlin": ".kt .kts", "scala": ".scala", "groovy": ".groovy .gradle",
    "go": ".go", "rust": ".rs", "csharp": ".cs .cshtml .razor", "swift": ".swift", "objectivec": ".m .mm", "dart": ".dart", "c": ".c .h", "cpp": ".cpp .cc .hpp .cxx", "html": ".html .htm .xhtml", "twig": ".twig", "handlebars": ".hbs .handlebars", "ejs": ".ejs", "pug": ".pug", "jinja": ".j2 .jinja",
    "xml": ".xml .plist", "css": ".css", "scss": ".scss .sass", "less": ".less", "json": ".json .jsonc", "yaml": ".yml .yaml", "toml": ".toml", "properties": ".properties .ini .cfg .conf", "dotenv": ".env", "sql": ".sql", "shell": ".sh .bash .zsh", "markdown": ".md .mdx", "text": ".txt .log",
}
NAMES = {"Dockerfile": "docker", "Containerfile": "docker", "Makefile": "make", "Gemfile": "ruby", "Rakefile": "ruby", "Podfile": "ruby", "Jenkinsfile": "groovy", "Pipfile": "toml", ".gitignore": "gitignore", ".env": "dotenv"}
FAMILIES = {
    "js": "javascript typescript vue svelte astro", "python": "python", "php": "php blade", "ruby": "ruby", "jvm": "java kotlin scala groovy", "go": "go", "rust": "rust", "dotnet": "csharp", "swift": "swift", "objc": "objectivec", "dart": "dart", "c": "c cpp", "markup": "html twig handlebars ejs pug jinja blade-html xml", "css": "css scss less",
}
BINARY = frozenset(".png .jpg .jpeg .gif .webp .avif .ico .bmp .woff .woff2 .ttf .otf .eot .mp4 .webm .mp3 .wav .pdf .zip .gz .tar .7z .jar .exe .dll .so .dylib .class .pyc .wasm".split())
IMAGES = frozenset(".png .jpg .jpeg .gif .webp .avif .ico .bmp .svg".split())

_BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}
_FAMILY = {lang: fam for fam, langs in FAMILIES.items() for lang in langs.split()}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def detect_language(path: Column) -> Column:
    """Whole names first, then templates, environment and container files, then the extension; 'unknown' else."""
    name = base_name(path)
    return (
        F.when(name.isin(*NAMES), _lookup(NAMES, name))
        .when(name.endswith(".blade.php"), "blade")
        .when(name.rlike(r"^\.env(\..+)?$"), "dotenv")
        .when(name.rlike(r"(?i)^dockerfile[.\-]"), "docker")
        .otherwise(F.coalesce(_lookup(_BY_EXTENSION, extension(path)), F.lit("unknown")))
    )


def family_of(language: Column) -> Column:
    return F.coalesce(_lookup(_FAMILY, language), language)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec|specs|e2e|cypress|__mocks__)/|[._-](test|tests|spec)\.[a-z]+$|(^|/)(test_[^/]*\.py|[^/]*_test\.(go|py|dart|rb)|conftest\.py)$|Tests?\.(java|kt|cs)$")


def is_vendored_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(node_modules|bower_components|vendor|vendors|third[_-]?party|external|site-packages|pods|\.venv|venv)/|\.min\.(js|css)$")


def is_generated(path: Column, content: Column) -> Column:
    return path.rlike(r"(?i)\.(g|gen|generated|pb|freezed)\.[a-z]+$|_pb2\.py$|(^|/)(dist|build|out|generated|__generated__)/") | F.coalesce(
        F.substring(content, 1, 500).rlike(r"(?i)@generated|auto-?generated|code generated by|do not edit"), F.lit(False)
    )


def is_image(path: Column) -> Column:
    return extension(path).isin(*sorted(IMAGES))


def is_binary(path: Column) -> Column:
    return extension(path).isin(*sorted(BINARY))
