"""What a pattern rule is."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from auditlake.rules.sites import Site

ALL = "*"


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    ``raw`` reads the text as it is, else comments and literals are blanked. ``test`` judges the
    place that a match gives (arguments, receiver, what follows); false silences it. ``unless``
    silences a match whose line it fits, ``unless_file`` one whose file it fits. ``per`` is
    'match', 'first' (first match of a file) or 'file' (one finding with the number of matches).
    ``need`` names literals (small letters) of which a file holds one wherever the rule can match.
    """

    id: str
    severity: str
    families: str
    pattern: str
    title: str
    category: str = "security"
    raw: bool = False
    unless: str | None = None
    unless_file: str | None = None
    only_file: str | None = None
    path: str | None = None
    per: str = "match"
    least: int = 1
    need: tuple[str, ...] = ()
    confidence: str = "firm"
    effort: str = "moyen"
    flow: bool = False
    tests: bool = True
    test: Callable[[Site], bool] | None = None

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.M)

    @cached_property
    def silent_line(self) -> re.Pattern | None:
        return re.compile(self.unless) if self.unless else None

    @cached_property
    def silent_file(self) -> re.Pattern | None:
        return re.compile(self.unless_file) if self.unless_file else None

    @cached_property
    def wanted_file(self) -> re.Pattern | None:
        return re.compile(self.only_file) if self.only_file else None

    @cached_property
    def wanted_path(self) -> re.Pattern | None:
        return re.compile(self.path) if self.path else None

    def reads(self, family: str, language: str) -> bool:
        names = self.families.split()
        return ALL in names or family in names or language in names
