"""The files relation and the line relation that the rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.functions import languages, paths, text


#: Superseded captures up to this number are broadcast by their id (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def latest_captures(files: DataFrame) -> DataFrame:
    """The rows of each path's latest capture (largest ``file_id``); contents stay where they were read.

    Only ids and paths are shuffled to find the captures that a later one supersedes. Their ids
    leave by an anti join: broadcast behind a check of their number, else by a sort-merge join.
    Rows without an id are kept as they are.
    """
    ids = files.where(F.col("file_id").isNotNull()).select("file_id", F.xxhash64("project", F.trim("relative_path")).alias("_k"))
    last = ids.groupBy("_k").agg(F.max("file_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", "_last")
    old = ids.join(last, "_k").where(F.col("file_id") < F.col("_last")).select(F.col("file_id").alias("_old"))
    if old.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        old = F.broadcast(old)
    return files.join(old, F.col("file_id") == F.col("_old"), "left_anti")


def describe(files: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per captured path: (project, file, name, ext, language, family, flags, file_id, content, size).

    Captures of one path keep the latest (largest ``file_id``); contents above the size limit count
    as unreadable. Null contents stay null and no rule reads them; rows without a path are left out.
    """
    config = config or Config()
    path = F.regexp_replace(F.trim("relative_path"), r"\\", "/")
    size = F.coalesce(F.col("size"), F.length("content").cast("long"))
    rows = latest_captures(files.where(F.col("relative_path").isNotNull())).select("project", path.alias("file"), "file_id", F.when(size <= config.max_file_size, F.col("content")).alias("content"), size.alias("size"))
    return (
        rows.withColumn("name", paths.base_name(F.col("file")))
        .withColumn("ext", paths.extension(F.col("file")))
        .withColumn("language", languages.detect_language(F.col("file")))
        .withColumn("family", languages.family_of(F.col("language")))
        .withColumn("is_test", languages.is_test_path(F.col("file")))
        .withColumn("is_vendored", languages.is_vendored_path(F.col("file")))
        .withColumn("is_generated", languages.is_generated(F.col("file"), F.col("content")))
        .withColumn("is_image", languages.is_image(F.col("file")))
    )


def lines(files: DataFrame, id_col: str = "file_id", text_col: str = "content", *keep: str) -> DataFrame:
    """(id, line, text, indent) of every line; a last line end opens no line of its own."""
    split = text.lines(F.col(text_col))
    whole = F.when(F.element_at(split, F.lit(-1)) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
    rows = files.where(F.col(text_col).isNotNull()).select(id_col, *keep, F.posexplode(whole).alias("_p", "text"))
    return rows.select(id_col, *keep, (F.col("_p") + 1).alias("line"), "text", text.indent_width(F.col("text")).alias("indent"))


def stack(files: DataFrame, *by: str) -> DataFrame:
    """Files, lines and bytes per language (and project, if asked for), for a summary ordered by lines."""
    n = F.when(F.col("content").isNull() | (F.col("content") == ""), 0).otherwise(F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0))
    return files.groupBy(*by, "language").agg(F.count(F.lit(1)).alias("files"), F.sum(n.cast("long")).alias("lines"), F.sum("size").alias("bytes"))
