"""Source files that nobody wrote by hand: generated, minified, vendored, data kept as code.

A multi-pattern automaton finds generation notices and licence banners in one pass over a text.
They count in comments of the header (or the last lines, where some generators sign) and only if
they say it of the file itself: a comment that speaks of generated files is no notice. What opens
a comment depends on the language, as the path's extension and the ``language`` column tell it.
Path rules know vendored and build directories, lock files and the suffixes of generators and
minifiers. What carries neither is judged by its shape: minified lines, list literals that fill
the file, numbered statements that only a program would write.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of generation notices (lower case), in several languages.
NOTICES = (
    "@generated",
    "<auto-generated",
    "<autogenerated",
    "code generated by",
    "file generated by",
    "file is generated",
    "file was generated",
    "autogenerated",
    "auto-generated by",
    "auto-generated file",
    "auto generated file",
    "automatically generated",
    "automatically created",
    "automatically produced",
    "machine generated",
    "machine-generated",
    "maschinell erzeugt",
    "automatisch erzeugt",
    "automatisch generiert",
    "généré automatiquement",
    "généré par",
    "produit par",
    "produit automatiquement",
    "erzeugt von",
    "erzeugt durch",
    "generiert von",
    "producido por",
    "produzido por",
    "prodotto da",
    "gegenereerd door",
    "automatisch gegenereerd",
    "produced by",
    "generado automáticamente",
    "gerado automaticamente",
    "generato automaticamente",
    "сгенерирован автоматически",
    "自动生成",
    "自動生成",
    "자동 생성",
    "generated by the protocol buffer compiler",
    "generated from protobuf",
    "generated by swagger",
    "generated by openapi",
    "vendored from",
    "upstream copy",
    "do not edit: generated",
    "generated file, do not",
    "generated file. do not",
    "generated file - do not",
)
#: Licences that a third-party banner names beside a version.
LICENCES = ("mit licen", "bsd licen", "apache licen", "mpl licen", "isc licen", "gpl licen", "mit-licen", "licensed under", "released under", "@license", "@licence", "@preserve", "apache-2.0", "bsd-3", "bsd-2")
#: Directories of copies of third-party packages, and of build output wherever they stand.
VENDOR_DIRS = frozenset("node_modules bower_components jspm_packages third_party third-party thirdparty 3rdparty vendor vendored external externals site-packages dist-packages pods carthage .venv venv virtualenv godeps".split())
OUTPUT_DIRS = frozenset("dist .next .nuxt .output .svelte-kit __generated__ __pycache__ generated-sources .parcel-cache .turbo htmlcov".split())
#: Names of build directories that count at the top, below a public or package folder, or above one another.
BUILD_DIRS = frozenset("build out target".split())
BUILD_PARENTS = frozenset("public static www android ios app build target packages apps services modules".split())
LOCK_FILES = frozenset(
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml pnpm-lock.yml bun.lock composer.lock gemfile.lock cargo.lock poetry.lock pipfile.lock uv.lock pdm.lock pubspec.lock go.sum mix.lock podfile.lock packages.lock.json flake.lock gradle.lockfile conda-lock.yml deno.lock".split()
)
_SUFFIX = re.compile(r"[a-z]-\d+\.\d+(?:\.\d+)+\.(?:js|css|mjs)$|(?:[.\-_]min|\.bundle|\.chunk|\.packed|[.\-_]pb|_pb2(?:_grpc)?|\.gen|\.generated|\.g|\.designer|\.freezed|\.snap)\.\w+$|\.(?:map|snap)$")
#: What opens or continues a comment, and languages and extensions in which a mark means something else.
_MARKS = {"//": r"//", "*": r"/?\*", "#": r"#", "<!--": r"<!--", "--": r"--", ";": r";", "%": r"%", "doc": r"\"\"\"|\'\'\'", "php": r"<\?php\s*(?://|/\*|#)"}
_OTHERWISE = {"css scss less sass": ("#", "--"), "markdown md mdx": ("#", "*", "--", ";", "%"), "c cpp h hpp csharp cs": ("#", "%", ";"), "sql": ("#",)}
_NOT_COMMENT = {name: marks for names, marks in _OTHERWISE.items() for name in names.split()}
#: What may stand between the mark and a notice: nothing, a warning, or the file as its subject.
_SUBJECT = re.compile(
    r"[\s*/#;!<%=~:.\-]*(?:(?:warning|note|attention|achtung|important)\s*[:!,-]*\s*)?"
    r"(?:(?:this|the|all)?\s*(?:source\s+)?(?:file|code|module|class|script|document|stylesheet|content|contents)(?:\s+(?:was|were|is|are|has\s+been))?"
    r"|(?:diese|die)\s+datei\s+(?:wurde|ist)|(?:ce|le)?\s*(?:fichier|code|module)(?:\s+(?:est|a\s+été))?|(?:este|el|o)?\s*(?:archivo|fichero|arquivo|ficheiro|código)(?:\s+(?:fue|es|ha\s+sido|foi|é))?"
    r"|(?:questo)?\s*(?:file|codice)(?:\s+(?:è|e\'|è\s+stato))?|dit\s+bestand\s+(?:is|werd)|(?:этот\s+)?файл|(?:本|此|该)文件(?:由\S*)?|このファイルは(?:\S*)|이\s*파일은)?\s*[:,-]*\s*$"
)
_VERSION = re.compile(r"(?:\bv(?:ersion)?\s*|\s|@)\d+\.\d+(?:\.\d+)?")
_OWN = ("internal licen", "all rights kept", "all rights reserved")

_PHRASES = ahocorasick.Automaton()
for _p in NOTICES:
    _PHRASES.add_word(_p, ("notice", len(_p)))
for _p in LICENCES:
    _PHRASES.add_word(_p, ("licence", len(_p)))
_PHRASES.make_automaton()

#: Lines without blank ones at the top and at the end of a file in which a notice counts.
HEADER_LINES, FOOTER_LINES = 12, 3
LONG_LINE = 300
_LIST_LINE = re.compile(r"\s*(?:[\[\]{}(),;\s]|[\"'](?:[^\"'\\\n]|\\.)*[\"']|-?\d[\w.+\-]*|null|true|false|None|True|False|nil)+\s*$")
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"[A-Za-z]_?\d{3,}\b")


_MIGRATION = re.compile(r"(?:^|/)migrations/\d{3,}_\w+\.py$")


def path_says(path: str | None) -> bool:
    """Do the directories or the name of a file tell that it was made or copied?"""
    steps = [s for s in (path or "").strip().lower().replace("\\", "/").split("/") if s not in ("", ".")]
    if not steps:
        return False
    *dirs, name = steps
    for i, d in enumerate(dirs):
        if d in VENDOR_DIRS or d in OUTPUT_DIRS:
            return True
        if d in BUILD_DIRS and (i == 0 or dirs[i - 1] in BUILD_PARENTS or (i == 2 and dirs[0] in ("packages", "apps", "services", "modules"))):
            return True
        if d in ("bin", "obj") and dirs[i + 1 : i + 2] in (["debug"], ["release"]):
            return True
    return name in LOCK_FILES or bool(_SUFFIX.search(name))


@cache
def _comment(ext: str, language: str) -> re.Pattern:
    """What begins a comment line: any mark but those that mean something else in the language: that of the extension, of the stored label only without one."""
    other = _NOT_COMMENT.get(ext.lower() if ext else language.strip().lower(), ())
    return re.compile(r"\s*(?:" + "|".join(p for m, p in _MARKS.items() if m not in other) + ")")


def _margins(text: str) -> tuple[str, str]:
    """The header and the last lines of a text, blank lines not counted."""
    head, at, n = 0, 0, 0
    while at < len(text) and n < HEADER_LINES:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        n += bool(text[at:end].strip())
        head = at = end + 1
    tail, n = len(text), 0
    while tail > head and n < FOOTER_LINES:
        begin = text.rfind("\n", 0, max(0, tail - 1)) + 1
        n += bool(text[begin:tail].strip())
        tail = begin
    return text[:head], text[max(head, tail) :]


def notice_in(text: str, path: str | None = None, language: str | None = None) -> bool:
    """A generation notice in a comment of the header or the last lines, or the banner of a third-party package at the head."""
    comment = _comment(path.rsplit(".", 1)[-1] if path and "." in path else "", language or "")
    for where, part in enumerate(_margins(text)):
        low = part.lower()
        licensed = False
        for end, (kind, size) in _PHRASES.iter(low):
            begin = low.rfind("\n", 0, end - size + 1) + 1
            line = low[begin : (low.find("\n", end) if low.find("\n", end) >= 0 else len(low))]
            mark = comment.match(line)
            if not mark:
                continue
            if kind == "notice":
                if _SUBJECT.match(low, begin + mark.end(), end - size + 1):
                    return True
            elif not where and not any(o in line for o in _OWN):
                licensed = True
        # a banner names licence and version in the comments at the head
        if licensed and any(_VERSION.search(line) for line in low.split("\n") if comment.match(line)):
            return True
        if not where and low.lstrip().startswith("/*!") and _VERSION.search(low[: low.find("*/") + 1]):
            return True
    return False


def shape_says(text: str) -> bool:
    """Minified code, list literals that fill the file, or numbered statements."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    size = sum(map(len, full))
    long = [x for x in full if len(x) > LONG_LINE]
    if long:
        mass = sum(map(len, long))
        spaces = sum(x.count(" ") + x.count("\t") for x in long)
        marks = sum(x.count(c) for x in long for c in ";{}()=,:")
        if mass > 0.6 * size and spaces < 0.12 * mass and marks > 0.12 * mass:
            return True
    if len(full) < 8:
        return False
    listed = [x for x in full if _LIST_LINE.match(x)]
    if size > 1500 and sum(map(len, listed)) > 0.8 * size and not any(re.match(r"\s*[\"'][^\"']*[\"']\s*:", x) for x in full[1:4]):
        return True
    numbered: dict[str, set[str]] = {}
    count: dict[str, int] = {}
    for x in full:
        if _NUMBERED.search(x):
            shape = re.sub(r"[A-Za-z]+", "w", _DIGITS.sub("0", x.strip()))
            count[shape] = count.get(shape, 0) + 1
            numbered.setdefault(shape, set()).update(_DIGITS.findall(x))
    return any(n >= 12 and n > 0.6 * len(full) and len(numbered[s]) >= 0.8 * n for s, n in count.items())


def not_by_hand(path: str | None, text: str | None, language: str | None = None) -> bool:
    """Was a file made by a program, minified, copied from a package or filled with data? Without content: no."""
    if not text or not text.strip():
        return False
    if path_says(path) or notice_in(text, path, language) or shape_says(text):
        return True
    # numbered migration modules are written by the framework's command
    return bool(_MIGRATION.search((path or "").replace("\\", "/")) and "(migrations.Migration)" in text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = [not_by_hand(p, t, k) for p, t, k in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(judged, pa.bool_())], [*batch.schema.names[3:], "_made"])


def classify(files: DataFrame, keep: Sequence[str] = ("file_id",), path_col: str = "relative_path", text_col: str = "content", language_col: str | None = "language", out: str = "not_by_hand") -> DataFrame:
    """The kept columns and ``not_by_hand`` of every row; null and empty contents are no case, null paths and languages are judged by what is left.

    One pass without a shuffle: a row's verdict depends on that row alone. Other columns are ignored.
    """
    language = F.col(language_col) if language_col else F.lit(None).cast("string")
    rows = files.select(F.col(path_col).alias("_p"), F.col(text_col).alias("_t"), language.alias("_l"), *keep)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:]]
    return rows.mapInArrow(_judge, ", ".join([*kept, "_made boolean"])).withColumnRenamed("_made", out)
