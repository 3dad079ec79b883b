"""Edits that repair findings: planned as rows, applied as one fold a file, never written in place."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators.markup import parse_nodes
from auditlake.operators.mask import batches_of, mask

Edit = tuple[int, int, str]


def noopener(text: str) -> Iterator[Edit]:
    for n in parse_nodes(text):
        if n["tag"] == "a" and n["attrs"].get("target", "").lower() == "_blank":
            rel = n["attrs"].get("rel")
            if rel is None:
                yield n["end"] - 1, n["end"] - 1, ' rel="noopener"'
            elif not re.search("noopener|noreferrer", rel):
                at = re.compile(r"\brel\s*=\s*[\"']?").search(text, n["start"], n["end"])
                if at:
                    yield at.end(), at.end(), "noopener "


#: What browsers fill into fields of these types and names.
AUTOCOMPLETE = (("email", "email"), ("tel", "tel"), ("phone", "tel"), ("new-password", "new-password"), ("password", "current-password"), ("username", "username"), ("firstname", "given-name"), ("prenom", "given-name"), ("lastname", "family-name"), ("nom", "family-name"), ("name", "name"), ("zip", "postal-code"), ("postal", "postal-code"), ("city", "address-level2"), ("ville", "address-level2"), ("country", "country-name"), ("pays", "country-name"), ("address", "street-address"))


def autocomplete_value(attrs: dict[str, str]) -> str | None:
    words = (attrs.get("type", "") + " " + attrs.get("name", "") + " " + attrs.get("id", "")).lower().replace("_", "").replace("-", "")
    return next((v for k, v in AUTOCOMPLETE if k.replace("-", "") in words), None)


def autocomplete(text: str) -> Iterator[Edit]:
    for n in parse_nodes(text):
        if n["tag"] == "input" and "autocomplete" not in n["attrs"] and n["attrs"].get("type", "text") in ("text", "email", "tel", "password") and (v := autocomplete_value(n["attrs"])):
            end = n["end"] - 1 - text[n["start"] : n["end"]].endswith("/>")
            yield end, end, f' autocomplete="{v}"'


def label_for(text: str) -> Iterator[Edit]:
    nodes = parse_nodes(text)
    taken = {n["attrs"]["id"] for n in nodes if "id" in n["attrs"]}
    for a, b in zip(nodes, nodes[1:]):
        if a["tag"] == "label" and "for" not in a["attrs"] and b["tag"] in ("input", "select", "textarea") and "label" not in b["parents"]:
            name = b["attrs"].get("id")
            if name is None:
                base = re.sub(r"\W+", "-", b["attrs"].get("name") or "field").strip("-") or "field"
                name = next(x for x in (base, *(f"{base}-{i}" for i in range(2, 10_000))) if x not in taken)
                taken.add(name)
                yield b["start"] + 1 + len(b["tag"]), b["start"] + 1 + len(b["tag"]), f' id="{name}"'
            yield a["end"] - 1, a["end"] - 1, f' for="{name}"'


def _in_head(tag: str, present: Callable[[dict], bool]):
    def fix(text: str) -> Iterator[Edit]:
        nodes = parse_nodes(text)
        head = next((n for n in nodes if n["tag"] == "head"), None)
        if head and not any(present(n) for n in nodes):
            yield head["end"], head["end"], "\n  " + tag

    return fix


def font_display(text: str) -> Iterator[Edit]:
    for m in re.finditer(r"@font-face\s*\{(?P<b>[^}]*)\}", text):
        if "font-display" not in m["b"]:
            body = m["b"].rstrip()
            yield m.start("b") + len(body), m.start("b") + len(body), ("" if body.endswith((";", "")) and (not body or body.endswith(";")) else ";") + " font-display: swap;"


def debugger(text: str) -> Iterator[Edit]:
    for m in re.finditer(r"^[ \t]*debugger\s*;?[ \t]*(?:\n|\Z)", mask(text, "js"), re.M):
        yield m.start(), m.end(), ""


def lazy_images(text: str) -> Iterator[Edit]:
    seen = 0
    for n in parse_nodes(text):
        if n["tag"] == "img":
            seen += 1
            if seen > 1 and "loading" not in n["attrs"] and "fetchpriority" not in n["attrs"]:
                end = n["end"] - 1 - text[n["start"] : n["end"]].endswith("/>")
                yield end, end, ' loading="lazy"'


def defer_scripts(text: str) -> Iterator[Edit]:
    nodes = parse_nodes(text)
    body = next((n["start"] for n in nodes if n["tag"] == "body"), len(text))
    for n in nodes:
        if n["tag"] == "script" and n["start"] < body and "src" in n["attrs"] and not {"async", "defer"} & n["attrs"].keys() and n["attrs"].get("type") != "module":
            yield n["start"] + 7, n["start"] + 7, " defer"


def unused_imports(text: str) -> Iterator[Edit]:
    """Whole import lines of one name that stands nowhere else."""
    clean = mask(text, "js")
    for m in re.finditer(r"^[ \t]*import\s+(?:\{\s*)?([A-Za-z_$][\w$]*)(?:\s*\})?\s+from\s+[^\n]*\n?", clean, re.M):
        if len(re.findall(rf"(?<![\w$]){re.escape(m[1])}(?![\w$])", clean)) == 1:
            yield m.start(), m.end(), ""


#: Fixers by name: rule they repair, families they read, function.
FIXERS: dict[str, tuple[str, tuple[str, ...], Callable[[str], Iterator[Edit]]]] = {
    "noopener": ("ROUTE-TARGET-BLANK", ("markup",), noopener),
    "autocomplete": ("UX-NO-AUTOCOMPLETE", ("markup",), autocomplete),
    "label-for": ("A11Y-INPUT-NO-LABEL", ("markup",), label_for),
    "charset": ("SEO-CHARSET-MISSING", ("markup",), _in_head('<meta charset="utf-8">', lambda n: n["tag"] == "meta" and "charset" in n["attrs"])),
    "viewport": ("SEO-VIEWPORT-MISSING", ("markup",), _in_head('<meta name="viewport" content="width=device-width, initial-scale=1">', lambda n: n["tag"] == "meta" and n["attrs"].get("name", "").lower() == "viewport")),
    "font-display": ("PERF-FONT-DISPLAY", ("css",), font_display),
    "debugger": ("DEAD-DEBUG-INSTRUCTION-DEBUGGER", ("js",), debugger),
    "lazy-images": ("SEO-IMG-NO-LAZY", ("markup",), lazy_images),
    "defer-scripts": ("PERF-BLOCKING-SCRIPT", ("markup",), defer_scripts),
    "unused-imports": ("DEAD-IMPORT", ("js",), unused_imports),
}
SCHEMA = pa.schema([("project", pa.string()), ("file", pa.string()), ("fixer", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string()), ("order", pa.int32())])


def _plan(names: tuple[str, ...]):
    def run(batches):
        def rows():
            for batch in batches:
                for project, file, text, family in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    for order, name in enumerate(names):
                        _, families, fix = FIXERS[name]
                        if family in families:
                            for start, end, replacement in fix(text):
                                if text[start:end] != replacement:
                                    yield [project, file, name, start, end, replacement, order]

        yield from batches_of(rows(), SCHEMA)

    return run


def plan(files: DataFrame, names: tuple[str, ...] = tuple(FIXERS)) -> DataFrame:
    """(project, file, fixer, start, end, replacement, order) of described files; edits that change nothing are left out."""
    rows = files.where(F.col("content").isNotNull() & ~F.col("is_vendored")).select("project", "file", "content", "family")
    return rows.mapInArrow(_plan(names), "project string, file string, fixer string, start int, end int, replacement string, `order` int")


def apply_edits(text: Column, edits: Column) -> Column:
    """A text with its edits (array of struct(start, end, order, replacement)) applied from the end; of two that overlap the later one is dropped."""
    ordered = F.reverse(F.array_sort(edits))
    start = F.struct(text.alias("t"), F.lit(2**31 - 1).alias("at"))
    done = F.aggregate(
        ordered,
        start,
        lambda acc, e: F.when(
            e["end"] <= acc["at"],
            F.struct(F.concat(F.substring(acc["t"], F.lit(1), e["start"]), e["replacement"], F.substring(acc["t"], e["end"] + 1, F.lit(2**31 - 1))).alias("t"), e["start"].alias("at")),
        ).otherwise(acc),
    )
    return done["t"]


def fixed_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(project, file, before, after, n_edits) of the files that edits change."""
    per_file = edits.groupBy(F.col("project").alias("_p"), F.col("file").alias("_f")).agg(F.collect_list(F.struct("start", "end", "order", "replacement")).alias("_e"), F.count(F.lit(1)).alias("n_edits"))
    joined = files.join(per_file, (F.col("project") == F.col("_p")) & (F.col("file") == F.col("_f")))
    return joined.select("project", "file", F.col("content").alias("before"), apply_edits(F.col("content"), F.col("_e")).alias("after"), "n_edits").where("before <> after")


@F.arrow_udf(T.StringType())
def _diff(before: pa.Array, after: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True):
        out.append("\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "before", "after", lineterm="", n=2)))
    return pa.array(out, pa.string())


def diff(before: Column, after: Column) -> Column:
    """Changed lines with two lines around them."""
    return _diff(before, after)
