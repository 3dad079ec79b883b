"""Installed packages from lock files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.mask import batches_of

Package = tuple[str, str]


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def package_lock(text: str) -> Iterator[Package]:
    """Versions 1, 2 and 3: a map by place, or a tree."""
    data = _json(text)
    if not isinstance(data, dict):
        return
    entries = data.get("packages") if isinstance(data.get("packages"), dict) else {k: v for k, v in data.items() if str(k).startswith("node_modules/")}
    for place, entry in entries.items():
        if place and isinstance(entry, dict) and entry.get("version"):
            yield place.rpartition("node_modules/")[2], str(entry["version"])
    if not entries:
        todo = [data.get("dependencies")]
        while todo:
            for name, entry in (todo.pop() or {}).items():
                if isinstance(entry, dict):
                    if entry.get("version"):
                        yield name, str(entry["version"])
                    todo.append(entry.get("dependencies"))


def yarn_lock(text: str) -> Iterator[Package]:
    names: list[str] = []
    for line in text.split("\n"):
        if line and not line[0].isspace() and line.rstrip().endswith(":") and not line.startswith("#"):
            names = sorted({re.sub(r"@(?:npm:)?[^@]*$", "", p.strip().strip('"')) for p in line.rstrip().rstrip(":").split(",")})
        elif m := re.match(r"""\s+version:?\s+["']?([^"'\s]+)""", line):
            for n in names:
                yield n, m[1]
            names = []


def pnpm_lock(text: str) -> Iterator[Package]:
    for m in re.finditer(r"^\s{2}['\"]?/?((?:@[\w.-]+/)?[\w.-]+)[@/](\d[\w.+-]*)[^:\n]*['\"]?:", text, re.M):
        yield m[1], m[2]


def composer_lock(text: str) -> Iterator[Package]:
    data = _json(text)
    for key in ("packages", "packages-dev"):
        for p in (data or {}).get(key) or []:
            if p.get("name") and p.get("version"):
                yield p["name"], str(p["version"]).lstrip("v")


def pubspec_lock(text: str) -> Iterator[Package]:
    for m in re.finditer(r"^  ([\w-]+):\n(?:    .*\n)*?    version: [\"']?([^\"'\n]+)", text, re.M):
        yield m[1], m[2]


def toml_lock(text: str) -> Iterator[Package]:
    for m in re.finditer(r"\[\[package\]\]\s*\nname = \"([^\"]+)\"\s*\nversion = \"([^\"]+)\"", text):
        yield m[1], m[2]


def requirements(text: str) -> Iterator[Package]:
    for m in re.finditer(r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([\w.+!-]+)", text, re.M):
        yield m[1].lower(), m[2]


READERS: dict[str, tuple[str, Callable[[str], Iterator[Package]]]] = {
    "package-lock.json": ("npm", package_lock), "npm-shrinkwrap.json": ("npm", package_lock), "yarn.lock": ("npm", yarn_lock), "pnpm-lock.yaml": ("npm", pnpm_lock), "composer.lock": ("Packagist", composer_lock),
    "pubspec.lock": ("Pub", pubspec_lock), "Cargo.lock": ("crates.io", toml_lock), "poetry.lock": ("PyPI", toml_lock), "requirements.txt": ("PyPI", requirements),
}
SCHEMA = pa.schema([("project", pa.string()), ("file", pa.string()), ("ecosystem", pa.string()), ("name", pa.string()), ("version", pa.string())])


def _read(batches):
    def rows():
        for batch in batches:
            for project, file, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ecosystem, reader = READERS[file.rpartition("/")[2]]
                for name, version in reader(text):
                    yield [project, file, ecosystem, name, version]

    yield from batches_of(rows(), SCHEMA)


def installed(files: DataFrame) -> DataFrame:
    """(project, ecosystem, name, version, exact) of described files; exact versions of lock files come before those of lists."""
    locks = files.where(F.col("name").isin(*READERS) & F.col("content").isNotNull()).select("project", "file", "content")
    rows = locks.mapInArrow(_read, "project string, file string, ecosystem string, name string, version string")
    exact = ~F.col("file").endswith("requirements.txt")
    return rows.groupBy("project", "ecosystem", "name").agg(F.max_by(F.struct("version", exact.alias("exact")), F.struct(exact, "version")).alias("_x")).select("project", "ecosystem", "name", "_x.version", "_x.exact")
