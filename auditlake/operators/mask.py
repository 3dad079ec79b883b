"""Source texts with comments and literals blanked, every offset and line kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"`(?:[^`\\]|\\[\s\S])*`?"
_C_LINE, _C_BLOCK, _HASH = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)", r"\#[^\n]*"
_TRIPLE = r'(?:[rRbBfFuU]{0,2})(?:"""[\s\S]*?(?:"""|\Z)|' + r"'''[\s\S]*?(?:'''|\Z))"
_REGEX = r"(?<=[=(,:;!&|?{}\[\n+])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
#: What is blanked in each family: comments (c) and literals (s), in the order they are tried.
_SYNTAX = {
    "js": [("c", _C_LINE), ("c", _C_BLOCK), ("s", _REGEX), ("s", _DOUBLE), ("s", _SINGLE), ("t", _BACK)],
    "python": [("c", _HASH), ("s", _TRIPLE), ("f", r'(?<![A-Za-z0-9_])[fF][rR]?"(?:[^"\\\n]|\\.)*"?' + r"|(?<![A-Za-z0-9_])[fF][rR]?'(?:[^'\\\n]|\\.)*'?"), ("s", _DOUBLE), ("s", _SINGLE)],
    "php": [("c", _C_LINE), ("c", _HASH), ("c", _C_BLOCK), ("s", _DOUBLE), ("s", _SINGLE)],
    "ruby": [("c", r"^=begin[\s\S]*?^=end|" + _HASH), ("s", _DOUBLE), ("s", _SINGLE)],
    "markup": [("c", r"<!--[\s\S]*?(?:-->|\Z)")],
    "css": [("c", _C_BLOCK), ("s", _DOUBLE), ("s", _SINGLE)],
    "shell": [("c", r"(?<![\w$])" + _HASH), ("s", _DOUBLE), ("s", r"'[^']*'?")],
    "yaml": [("c", r"(?:(?<=\s)|^)" + _HASH)],
    "sql": [("c", r"--[^\n]*"), ("c", _C_BLOCK), ("s", _SINGLE)],
}
_CURLY = [("c", _C_LINE), ("c", _C_BLOCK), ("s", r'"""[\s\S]*?(?:"""|\Z)'), ("s", _DOUBLE), ("s", _SINGLE)]
_SYNTAX |= dict.fromkeys(("jvm", "dotnet", "swift", "dart", "c", "rust", "objc"), _CURLY)
_SYNTAX["go"] = [("c", _C_LINE), ("c", _C_BLOCK), ("s", _BACK), ("s", _DOUBLE), ("s", _SINGLE)]
_KINDS = {family: [kind for kind, _ in rules] for family, rules in _SYNTAX.items()}
_SCAN = {family: re.compile("|".join(f"(?P<g{i}>{p})" for i, (_, p) in enumerate(rules)), re.M) for family, rules in _SYNTAX.items()}
_NOT_NEWLINE = re.compile(r"[^\n]")


def _blank(text: str) -> str:
    return _NOT_NEWLINE.sub(" ", text)


def _inner(text: str) -> str:
    """A literal with its quotes kept."""
    if len(text) < 2:
        return text
    return text[0] + _blank(text[1:-1]) + text[-1] if text[0] in "\"'`/" else _blank(text)


def _holes(text: str, opening: str) -> str:
    """A template with its literal parts blanked and the code in its holes kept."""
    out, at = [], 0
    while True:
        hole = text.find(opening, at)
        if hole < 0:
            return "".join([*out, _blank(text[at:])])
        depth, end = 1, hole + len(opening)
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        out += [_blank(text[at:hole]), text[hole:end]]
        at = end


def mask(text: str, family: str | None) -> str:
    """Same length as ``text``; comments are spaces, literals keep their quotes, template holes their code."""
    scan = _SCAN.get(family or "")
    if scan is None:
        return text
    kinds = _KINDS[family]

    def put(m: re.Match) -> str:
        kind = kinds[int(m.lastgroup[1:])]
        if kind == "c":
            return _blank(m[0])
        if kind == "t":
            return m[0][0] + _holes(m[0][1:-1], "${") + m[0][-1] if len(m[0]) > 1 else m[0]
        if kind == "f":
            return _holes(m[0], "{")
        return _inner(m[0])

    return scan.sub(put, text)


def comment_ranges(text: str, family: str | None) -> list[tuple[int, int]]:
    """[start, end) of the comments; what strings hold is no comment."""
    scan = _SCAN.get(family or "")
    return [m.span() for m in scan.finditer(text) if _KINDS[family][int(m.lastgroup[1:])] == "c"] if scan else []


@F.arrow_udf(T.StringType())
def _masked(text: pa.Array, family: pa.Array) -> pa.Array:
    return pa.array([None if t is None else mask(t, f) for t, f in zip(text.to_pylist(), family.to_pylist(), strict=True)], pa.string())


def masked(text: Column, family: Column) -> Column:
    return _masked(text, family)


def brace_end(masked_text: str, at: int) -> int:
    """Offset behind the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked_text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked_text)


def batches_of(rows: Iterator[list], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded size."""
    kept: list = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
