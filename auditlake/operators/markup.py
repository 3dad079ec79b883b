"""Tables of markup elements and style rules, derived in one Arrow pass each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.mask import batches_of

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript"))
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "eacute": "e", "egrave": "e", "agrave": "a", "ccedil": "c", "hellip": "...", "rsquo": "'", "copy": "(c)"}
_TAG = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|\{\{[\s\S]*?\}\}|[^\"'>])*)>")
_ATTR = re.compile(r"(?P<n>[^\s\"'<>/=]+)(?:\s*=\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)'|(?P<b>[^\s\"'>]+)))?")
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z]{2,8}));")
_HIDDEN = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->")
_ANY_TAG = re.compile(r"(?s)<[^>]*>")
_SPACE = re.compile(r"\s+")

NODE_SCHEMA = pa.schema(
    [("_id", pa.int64()), ("idx", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("close_start", pa.int32()), ("line", pa.int32()), ("depth", pa.int32()), ("text", pa.string()), ("parents", pa.list_(pa.string()))]
)
NODE_DDL = "_id bigint, idx int, tag string, attrs map<string,string>, start int, end int, close_start int, line int, depth int, text string, parents array<string>"


def decode_entities(text: str) -> str:
    def put(m: re.Match) -> str:
        if m[1] or m[2]:
            code = int(m[1] or m[2], 10 if m[1] else 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
        return ENTITIES.get(m[3], m[0])

    return _ENTITY.sub(put, text) if "&" in text else text


def readable(html: str) -> str:
    """Text of markup: scripts, styles, comments and tags are spaces, white space is folded."""
    return decode_entities(_SPACE.sub(" ", _ANY_TAG.sub(" ", _HIDDEN.sub(" ", html))).strip())


def attributes(source: str) -> dict[str, str]:
    """Names in lower case, the last of a name wins, bare ones have the empty string."""
    out = {}
    for m in _ATTR.finditer(source):
        value = m["d"] if m["d"] is not None else m["s"] if m["s"] is not None else m["b"]
        out[m["n"].lower()] = decode_entities(value or "")
    return out


def parse_nodes(html: str) -> list[dict]:
    """Elements in order, each with its attributes, place, text, depth and open parents.

    Raw elements end at their own closing tag whatever they hold; an element that is never closed
    ends where its parent does; a closing tag without an opening one is ignored.
    """
    nodes: list[dict] = []
    stack: list[dict] = []
    at = 0
    while m := _TAG.search(html, at):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k]["tag"] == tag:
                    for open_node in stack[k:]:
                        open_node["close_start"] = m.start()
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"]
        node = {"tag": tag, "attrs": attributes(attrs.rstrip("/")), "start": m.start(), "end": m.end(), "close_start": -1, "depth": len(stack), "parents": [n["tag"] for n in stack]}
        nodes.append(node)
        if tag in VOID or attrs.endswith("/"):
            node["close_start"] = m.end()
        elif tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            node["close_start"] = close.start() if close else len(html)
            at = close.end() if close else len(html)
        else:
            stack.append(node)
    for node in stack:
        node["close_start"] = len(html)
    for node in nodes:
        inner = html[node["end"] : node["close_start"]] if node["close_start"] > node["end"] else ""
        node["text"] = decode_entities(_SPACE.sub(" ", inner).strip()) if node["tag"] in RAW else readable(inner)[:2000]
    return nodes


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line, at = 1, 0
                for k, n in enumerate(parse_nodes(html or "")):
                    line += html.count("\n", at, n["start"])
                    at = n["start"]
                    yield [i, k, n["tag"], list(n["attrs"].items()), n["start"], n["end"], n["close_start"], line, n["depth"], n["text"], n["parents"]]

    yield from batches_of(rows(), NODE_SCHEMA)


def nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The elements of every page: (id, idx, tag, attrs, start, end, close_start, line, depth, text, parents).

    Offsets are code points, lines begin at 1. Null and empty pages have no element. No shuffle.
    """
    rows = pages.where(F.col(html_col).contains("<")).select(F.col(id_col).cast("long"), html_col)
    return rows.mapInArrow(_nodes, NODE_DDL).withColumnRenamed("_id", id_col)


RULE_SCHEMA = pa.schema([("_id", pa.int64()), ("idx", pa.int32()), ("selector", pa.string()), ("line", pa.int32()), ("declarations", pa.map_(pa.string(), pa.string()))])
_RULE = re.compile(r"(?P<sel>[^{}@;]+)\{(?P<body>[^{}]*)\}")
_COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)")


def parse_rules(css: str) -> list[tuple[str, int, dict[str, str]]]:
    """(selector, offset, declarations) of every plain block; at-rules are looked into, not reported."""
    css = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), css)
    out = []
    for m in _RULE.finditer(css):
        selector = m["sel"].strip()
        if not selector:
            continue
        declared = {}
        for part in m["body"].split(";"):
            name, colon, value = part.partition(":")
            if colon and name.strip():
                declared[name.strip().lower()] = value.strip()
        out.append((_SPACE.sub(" ", selector), m.start() + len(m["sel"]) - len(m["sel"].lstrip()), declared))
    return out


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i, css in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (selector, offset, declared) in enumerate(parse_rules(css or "")):
                    yield [i, k, selector, css.count("\n", 0, offset) + 1, list(declared.items())]

    yield from batches_of(rows(), RULE_SCHEMA)


def style_rules(sheets: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """The blocks of every style sheet: (id, idx, selector, line, declarations). Null and empty sheets have none."""
    rows = sheets.where(F.col(css_col).contains("{")).select(F.col(id_col).cast("long"), css_col)
    return rows.mapInArrow(_rules, "_id bigint, idx int, selector string, line int, declarations map<string,string>").withColumnRenamed("_id", id_col)
