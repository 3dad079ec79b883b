"""Files as a relation, and the patterns that leave some out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.config import Config


def glob_regex(glob: str) -> str:
    """An expression for a pattern of ignore files: ``*``, ``**``, ``?``, ``[]``, ``{}``, a slash at the ends."""
    anchored = glob.startswith("/") or "/" in glob.strip("/")
    body, folder = glob.strip("/"), glob.endswith("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end
        elif c == "{" and "}" in body[i:]:
            end = body.index("}", i)
            out.append("(?:" + "|".join(map(re.escape, body[i + 1 : end].split(","))) + ")")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if folder else "(?:/|$)")


def ignored(path: Column, globs: Sequence[str]) -> Column:
    """Is a path left out? The last pattern that fits decides; ``!`` takes a path back in."""
    verdicts = [F.when(path.rlike(glob_regex(g.lstrip("!"))), F.struct(F.lit(i).alias("i"), F.lit(not g.startswith("!")).alias("out"))) for i, g in enumerate(globs)]
    if not verdicts:
        return F.lit(False)
    return F.coalesce(F.array_max(F.filter(F.array(*verdicts), lambda v: v.isNotNull()))["out"], F.lit(False))


def read_tree(spark: SparkSession, root: str, project: str, config: Config | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """The files under a folder: (file_id, project, relative_path, content, size, mtime).

    Contents that are no text or above the size limit are null. Directories are walked by the
    source, ignored paths are dropped on its metadata before any content is read.
    """
    config = config or Config()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", rf"^(?:\w+:/*)?{prefix.replace('^', '')}/|^file:/*{prefix.lstrip('/')}/", "")
    named = raw.withColumn("relative_path", F.regexp_replace(path, "^file:/+", "/")).where(~ignored(F.col("relative_path"), [*config.ignore, *ignore]))
    text = F.when(F.col("length") <= config.max_file_size, F.try_validate_utf8(F.decode("content", "UTF-8")))
    binary = F.col("relative_path").rlike(r"(?i)\.(png|jpe?g|gif|webp|avif|ico|bmp|woff2?|ttf|otf|eot|mp4|webm|mp3|wav|pdf|zip|gz|tar|7z|jar|exe|dll|so|class|pyc|wasm)$")
    return named.select(F.xxhash64("relative_path").alias("file_id"), F.lit(project).alias("project"), "relative_path", F.when(~binary, text).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def parse_yaml(text: str) -> dict[str, str]:
    """Key paths and scalars of simple YAML: nesting by indentation, no lists, no anchors."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    for line in text.split("\n"):
        m = re.match(r"^(\s*)([\w.\-\"'@/]+)\s*:\s*(.*?)\s*(?:#.*)?$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        indent = len(m[1].expandtabs(4))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        key = m[2].strip("\"'")
        path = ".".join([*(k for _, k in stack), key])
        if m[3] and m[3] not in ("|", ">", "|-", ">-"):
            out[path] = m[3].strip("\"'")
        else:
            stack.append((indent, key))
    return out


def parse_toml(text: str) -> dict[str, str]:
    """Key paths and scalars of simple TOML: sections and assignments."""
    out, section = {}, ""
    for line in text.split("\n"):
        line = line.strip()
        if m := re.match(r"^\[+([^\]]+)\]+", line):
            section = m[1].strip().replace('"', "")
        elif m := re.match(r"""^["']?([\w.\-]+)["']?\s*=\s*(.+?)\s*(?:#.*)?$""", line):
            out[f"{section}.{m[1]}" if section else m[1]] = m[2].strip("\"'")
    return out
