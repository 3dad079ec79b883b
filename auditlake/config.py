"""Settings that parameterise the predicates, and the files they are read from."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace

#: Severities with rank and weight, categories with weight and order, as the scores need them.
SEVERITIES = {"critical": 40.0, "high": 18.0, "medium": 7.0, "low": 2.5, "info": 0.5}
CATEGORIES = {"security": 3.0, "routes": 2.0, "deadcode": 1.5, "seo": 2.5, "design": 2.0, "performance": 2.0, "quality": 1.5, "dependencies": 2.0}
EFFORTS = {"rapide": 0, "moyen": 1, "important": 2, "long": 3}
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (55, "D"), (40, "E"))
DEFAULT_IGNORES = (
    "node_modules/", ".git/", ".svn/", ".hg/", "dist/", "build/", "out/", "coverage/", ".next/", ".nuxt/", ".svelte-kit/", ".cache/", ".turbo/", "vendor/", "venv/", ".venv/", "__pycache__/", ".idea/", ".vscode/", "target/", ".gradle/", "Pods/", ".dart_tool/", "*.min.js", "*.min.css", "*.map"
)


@dataclass(frozen=True)
class Quality:
    max_complexity: int = 15
    max_file_lines: int = 500
    max_function_lines: int = 80
    max_params: int = 5
    duplication_min_lines: int = 6


@dataclass(frozen=True)
class Design:
    min_contrast: float = 4.5
    min_tap_px: float = 44.0
    min_font_px: float = 12.0


@dataclass(frozen=True)
class Seo:
    min_words: int = 250
    title_min: int = 30
    title_max: int = 60
    desc_min: int = 70
    desc_max: int = 160


@dataclass(frozen=True)
class Performance:
    max_image_bytes: int = 300 * 1024
    max_asset_bytes: int = 1024 * 1024


@dataclass(frozen=True)
class Config:
    """One immutable set of settings; its values enter plans as literals."""

    categories: tuple[str, ...] = tuple(CATEGORIES)
    min_severity: str = "info"
    fail_on: str = "high"
    fail_under: int = 0
    max_file_size: int = 2 * 1024 * 1024
    max_files: int = 20_000
    include_tests: bool = False
    platforms: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    suppressions: tuple[tuple[str, str | None, int | None], ...] = ()
    rule_severity: dict[str, str] = field(default_factory=dict)
    baseline: str | None = None
    ignore: tuple[str, ...] = DEFAULT_IGNORES
    quality: Quality = Quality()
    design: Design = Design()
    seo: Seo = Seo()
    performance: Performance = Performance()


def merged(base, changes: dict):
    """``base`` with the given settings changed, section by section; unknown names raise."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    out = {}
    for name, value in changes.items():
        if name not in known:
            raise ValueError(f"unknown setting: {name}")
        old = known[name]
        if is_dataclass(old):
            value = merged(old, value)
        elif isinstance(old, tuple):
            value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
        out[name] = value
    return replace(base, **out)


_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)')
_TRAILING = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])')


def strip_json_comments(text: str) -> str:
    """JSON without comments and trailing commas; what strings hold stays."""
    keep_strings = lambda m: m[0] if m[0][0] == '"' else ""
    return _TRAILING.sub(keep_strings, _JSON_PART.sub(keep_strings, text))


def load_config(folder: str, names: tuple[str, ...] = ("auditlake.config.json", ".auditlake.json", "auditlake.json"), **overrides) -> Config:
    """Defaults, then the first settings file of the folder, then the overrides."""
    config = Config()
    for name in names:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                config = merged(config, json.loads(strip_json_comments(f.read())))
            break
    return merged(config, overrides)
