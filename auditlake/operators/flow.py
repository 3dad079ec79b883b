"""Where a value comes from: enough of scopes and assignments to grade a match.

An identifier's origin is that of its last visible assignment: a literal, something from outside
(request, environment, arguments, storage), a parameter, or unknown. A match whose right-hand side
is literal is no finding; one from outside is firm, one from a parameter tentative.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from auditlake.operators.mask import mask

EXTERNAL = re.compile(
    r"\b(?:req|request|ctx|event|process\.(?:env|argv)|window\.location|location\.(?:search|hash|href)|document\.(?:cookie|URL|referrer)|(?:local|session)Storage|URLSearchParams|params|searchParams|sys\.argv|os\.environ|input\s*\(|flask\.request|self\.request|\$_(?:GET|POST|REQUEST|COOKIE|SERVER))\b"
)
_IDENT = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
_JS_ASSIGN = re.compile(r"(?:\b(?:const|let|var)\s+)?(?P<n>\{[^}=]*\}|\[[^\]=]*\]|[A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]| ]+)?=(?![=>])\s*(?P<v>[^;\n]*)")
_JS_FUNCTION = re.compile(r"\bfunction\b\s*[\w$]*\s*\((?P<p>[^)]*)\)\s*\{|(?P<a>\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>\s*(?P<b>\{)?|^\s*(?:async\s+)?(?!if|for|while|switch|catch)[\w$]+\s*\((?P<m>[^)]*)\)\s*\{", re.M)
_PY_ASSIGN = re.compile(r"^(?P<i>[ \t]*)(?P<n>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*(?::[^=\n]+)?=(?!=)\s*(?P<v>[^\n]*)|^(?P<i2>[ \t]*)for\s+(?P<n2>[\w, ]+)\s+in\s+(?P<v2>[^\n]*):", re.M)
_PY_DEF = re.compile(r"^(?P<i>[ \t]*)(?:async\s+)?def\s+\w+\s*\((?P<p>[^)]*)\)", re.M)
_KEYWORDS = frozenset("if else for while return new await async function const let var true false null undefined this None True False in not and or is lambda typeof instanceof f r b".split())


@dataclass(frozen=True)
class Binding:
    name: str
    start: int
    end: int
    at: int
    kind: str
    value: str


def _end_of_brace(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _end_of_indent(text: str, at: int, base: int) -> int:
    for m in re.compile(r"^([ \t]*)\S", re.M).finditer(text, text.find("\n", at) + 1 or len(text)):
        if len(m[1].expandtabs(4)) <= base:
            return m.start()
    return len(text)


def _names(pattern: str) -> list[str]:
    """Names that a pattern binds: values, not keys, without defaults."""
    if pattern[:1] in "{[":
        parts = [p.split("=")[0] for p in pattern.strip("{}[] ").split(",")]
        return [n for p in parts if (n := p.split(":")[-1].strip().lstrip(".")) and re.fullmatch(r"[A-Za-z_$][\w$]*", n)]
    return [n for p in pattern.split(",") if (n := p.strip().split(":")[0].split("=")[0].strip().lstrip("*.").strip()) and re.fullmatch(r"[A-Za-z_$][\w$]*", n)]


def scopes_of(text: str, family: str) -> list[Binding] | None:
    """All bindings of a file with the stretch they hold in; null for other families and texts that can't be read."""
    if family not in ("js", "python"):
        return None
    try:
        masked = mask(text, family)
        out: list[Binding] = []
        if family == "js":
            blocks: list[tuple[int, int]] = []
            for m in _JS_FUNCTION.finditer(masked):
                params = m["p"] if m["p"] is not None else m["m"] if m["m"] is not None else (m["a"] or "").strip("()")
                brace = m.end() - 1 if masked[m.end() - 1 : m.end()] == "{" else -1
                end = _end_of_brace(masked, brace) if brace >= 0 else (masked.find("\n", m.end()) if masked.find("\n", m.end()) >= 0 else len(masked))
                blocks.append((m.start(), end))
                out += [Binding(n, m.start(), end, m.start(), "parameter", "") for n in _names(params)]
            for m in _JS_ASSIGN.finditer(masked):
                inside = [b for b in blocks if b[0] <= m.start() < b[1]]
                start, end = max(inside, default=(0, len(text)))
                value = text[m.start("v") : m.end("v")]
                out += [Binding(n, start, end, m.start(), _kind(value, masked[m.start("v") : m.end("v")]), value) for n in _names(m["n"])]
        else:
            blocks = []
            for m in _PY_DEF.finditer(masked):
                end = _end_of_indent(masked, m.end(), len(m["i"].expandtabs(4)))
                blocks.append((m.start(), end))
                out += [Binding(n, m.start(), end, m.start(), "parameter", "") for n in _names(m["p"]) if n not in ("self", "cls")]
            for m in _PY_ASSIGN.finditer(masked):
                inside = [b for b in blocks if b[0] <= m.start() < b[1]]
                start, end = max(inside, default=(0, len(text)))
                g = "v" if m["n"] is not None else "v2"
                value = text[m.start(g) : m.end(g)]
                out += [Binding(n, start, end, m.start(), _kind(value, masked[m.start(g) : m.end(g)]), value) for n in _names(m["n"] or m["n2"])]
        return out
    except (re.error, RecursionError, IndexError):
        return None


def _kind(value: str, masked_value: str) -> str:
    """literal, external or unknown."""
    if EXTERNAL.search(masked_value):
        return "external"
    names = [n for n in _IDENT.findall(masked_value) if n not in _KEYWORDS]
    return "literal" if value.strip() and not names else "unknown"


def origin(bindings: list[Binding], name: str, at: int) -> str:
    """literal, external, parameter or unknown: the innermost scope that binds the name decides; all its values count."""
    seen = [b for b in bindings if b.name == name and b.start <= at < b.end]
    if not seen:
        return "unknown"
    inner = max(b.start for b in seen)
    kinds = {b.kind for b in seen if b.start == inner}
    for kind in ("parameter", "external"):
        if kind in kinds:
            return kind
    return "literal" if kinds == {"literal"} else "unknown"


def grade(bindings: list[Binding] | None, text: str, masked: str, start: int, end: int, family: str) -> str | None:
    """'drop', 'firm', 'tentative' or null for unchanged: what the values behind a match say."""
    if bindings is None:
        return None
    stop = min([i for i in (masked.find(";", end), masked.find("\n", end)) if i >= 0], default=len(masked))
    behind = masked[end:stop] if text[start:end].rstrip().endswith(("=", "(", ":", "+=")) else masked[start:stop]
    raw = text[end:stop]
    if EXTERNAL.search(behind):
        return "firm"
    names = [n for n in _IDENT.findall(behind) if n not in _KEYWORDS]
    if text[start:end].rstrip().endswith(("=", "(", ":", "+=")):
        if not names and raw.strip(" )"):
            return "drop"
    else:
        names = [n for n in names if any(b.name == n for b in bindings)]
    kinds = {origin(bindings, n, start) for n in names}
    if kinds and kinds == {"literal"}:
        return "drop"
    if "external" in kinds:
        return "firm"
    return "tentative" if "parameter" in kinds else None
