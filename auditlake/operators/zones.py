"""Stretches of texts that rules treat on their own: scripts in markup, literal blocks, style sheets in code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCRIPT = re.compile(r"(?i)<script\b(?P<a>[^>]*)>(?P<body>.*?)(?:</script\s*>|\Z)", re.S)
_TYPE = re.compile(r"(?i)\btype\s*=\s*[\"']?([\w/+.-]+)")
#: Types of script elements that a browser runs; no type runs too.
EXECUTABLE = frozenset(("text/javascript", "application/javascript", "module", "text/ecmascript", "application/ecmascript", "text/babel", "text/jsx"))
_BLOCK_KEY = re.compile(r"^(?P<i>[ ]*)(?:- +)?[^#\s][^#]*:\s*(?:[&!]\S+\s+)*[|>][+-]?\d*\s*(?:#.*)?$")
_SHEET = re.compile(r"\bStyleSheet\s*\.\s*create\s*\(")


def script_zones(html: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, type, executable) of what script elements hold, in code points."""
    out = []
    for m in _SCRIPT.finditer(html):
        kind = _TYPE.search(m["a"])
        name = kind[1].lower() if kind else ""
        out.append((m.start("body"), m.end("body"), name, not name or name in EXECUTABLE))
    return out


def literal_lines(text: str) -> list[int]:
    """Numbers of the lines inside YAML's literal and folded blocks."""
    out: list[int] = []
    depth = -1
    for n, line in enumerate(text.split("\n"), 1):
        blank = not line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if depth >= 0 and not blank and indent <= depth:
            depth = -1
        if depth >= 0:
            out.append(n)
        elif m := _BLOCK_KEY.match(line.rstrip("\r")):
            depth = len(m["i"])
    return out


def sheet_lines(text: str) -> list[int]:
    """Numbers of the lines of style sheets that native components create in code."""
    out: list[int] = []
    for m in _SHEET.finditer(text):
        depth, end = 0, len(text)
        for b in re.compile(r"[()]").finditer(text, m.end() - 1):
            depth += 1 if b[0] == "(" else -1
            if not depth:
                end = b.start()
                break
        first = text.count("\n", 0, m.start()) + 1
        out.extend(range(first, first + text.count("\n", m.start(), end) + 1))
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _skipped(text: pa.Array, language: pa.Array) -> pa.Array:
    pick = lambda t, k: literal_lines(t) if k == "yaml" else sheet_lines(t)
    return pa.array([pick(t, k) if t else [] for t, k in zip(text.to_pylist(), language.to_pylist(), strict=True)], pa.list_(pa.int32()))


def skipped_lines(files: DataFrame) -> DataFrame:
    """(project, file, line) that say nothing about duplication; only files that hold such a stretch are read."""
    may = ((F.col("language") == "yaml") & F.col("content").rlike(r"(?m):\s*[|>][+-]?\d*\s*$")) | F.col("content").contains("StyleSheet")
    return files.where(F.col("content").isNotNull() & may).select("project", "file", F.explode(_skipped(F.col("content"), F.col("language"))).alias("line"))


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = script_zones(text)
            a, b, kinds, runs = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kinds, pa.string()), pa.array(runs, pa.bool_())], ["file_id", "start", "end", "type", "executable"])


def scripts(files: DataFrame) -> DataFrame:
    """(file_id, start, end, type, executable): the script zones of markup."""
    rows = files.where((F.col("family") == "markup") & F.lower("content").contains("<script")).select("file_id", "content")
    return rows.mapInArrow(_zones, "file_id bigint, start int, end int, type string, executable boolean")


def in_scripts(matches: DataFrame, zones: DataFrame) -> DataFrame:
    """Matches (file_id, offset, ...) that lie in a script, with its type and whether it runs: an equi join on the file, then the interval."""
    z = zones.select(F.col("file_id").alias("_f"), "start", "end", "type", "executable")
    return matches.join(z, (F.col("file_id") == F.col("_f")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))).drop("_f", "start", "end")
