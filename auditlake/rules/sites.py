"""Places in a source text: the call or assignment a match begins, its arguments and how they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = re.compile(r"[()\[\]{}]")
#: A literal joined with a value, on text whose literals are blanked.
_SEAM = re.compile(r"[\"'`]\s*[+%]\s*[\w$({]|[\w$)\]]\s*\+\s*[\"'`]|[\"']\s*\.\s*\$\w|\$[\w\]>-]+\s*\.\s*[\"']|[\"']\s*\|\|\s*\w")
#: A value inside a literal: template holes, Python and Ruby interpolation, ``format``.
_HOLE = re.compile(r"\$\{|#\{|(?<!\w)[fF][rR]?[\"'][^\"'\n]*\{\w|[\"']\s*\.\s*format\s*\(")
_PHP_HOLE = re.compile(r"\"[^\"\n]*\$[A-Za-z_]")
_KEYWORD = re.compile(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*")

# Where the web frameworks' manuals put what a client sends: members of the request object.
_PARTS = {
    r"req|request": "query params body headers cookies files args form values json data GET POST COOKIES FILES input get getParameter getQueryString getHeader".split(),
    r"ctx": "query params request".split(),
}
FROM_REQUEST = re.compile("|".join([rf"\b(?:{who})\s*(?:\.|->)\s*(?:{'|'.join(parts)})\b" for who, parts in _PARTS.items()] + [r"\$_(?:GET|POST|REQUEST|COOKIE|FILES)\b", r"(?<![\w.$])params\s*\["]))


def bracket_pairs(masked: str) -> dict[int, int]:
    """Opening place to closing place of every bracket that is closed; one pass."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _BRACKETS.finditer(masked):
        c = m[0]
        if c in _OPEN:
            stack.append((_OPEN[c], m.start()))
        elif stack and stack[-1][0] == c:
            pairs[stack.pop()[1]] = m.start()
    return pairs


@dataclass(frozen=True)
class Site:
    """A match in a text. ``masked`` has the same offsets with literals and comments blanked."""

    text: str
    masked: str
    family: str
    start: int
    end: int
    pairs: dict[int, int]

    @cached_property
    def close(self) -> int:
        """Where the call whose bracket ends the match closes; the end of the line if it never does."""
        known = self.pairs.get(self.end - 1)
        return known if known is not None else self.line_end

    @cached_property
    def line_end(self) -> int:
        at = self.text.find("\n", self.end)
        return at if at >= 0 else len(self.text)

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """[start, end) of the arguments: what commas of the call's own level part."""
        out, begin, at, last = [], self.end, self.end, self.close
        while at < last:
            c = self.masked[at]
            if c == ",":
                out.append((begin, at))
                begin = at + 1
            elif c in _OPEN:
                at = min(self.pairs.get(at, at), last)
            at += 1
        if self.text[begin:last].strip():
            out.append((begin, last))
        return out

    def argument(self, n: int) -> str:
        return self.text[slice(*self.spans[n])].strip() if n < len(self.spans) else ""

    @property
    def first_is_literal(self) -> bool:
        return self.argument(0)[:1] in ("'", '"', "`")

    def built(self, begin: int, end: int) -> bool:
        """Does a stretch put a literal together with values?"""
        raw = self.text[begin:end]
        return bool(_SEAM.search(self.masked, begin, end) or _HOLE.search(raw) or (self.family == "php" and _PHP_HOLE.search(raw)))

    @property
    def first_is_built(self) -> bool:
        return bool(self.spans) and not self.argument(0).startswith("[") and self.built(*self.spans[0])

    def keyword(self, name: str) -> str | None:
        """The value of a named argument."""
        for begin, end in self.spans:
            m = _KEYWORD.match(self.text, begin, end)
            if m and m[1] == name:
                return self.text[m.end() : end].strip()
        return None

    @property
    def takes_request(self) -> bool:
        """Is something of the request among the arguments?"""
        return bool(FROM_REQUEST.search(self.masked, self.end, self.close))

    @property
    def receiver(self) -> str:
        """What stands before the match without a gap."""
        begin = self.text.rfind("\n", 0, self.start) + 1
        return re.split(r"[\s(,;=]", self.text[begin : self.start])[-1]

    @property
    def assigned(self) -> str:
        """The value that is assigned: the rest of the statement."""
        stop = self.masked.find(";", self.end, self.line_end)
        return self.text[self.end : stop if stop >= 0 else self.line_end].strip()
