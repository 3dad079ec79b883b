"""Languages of messages: which one is asked for, and how much of a catalogue is translated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "fr"


def language(*told: Column, known: Sequence[str] = ("fr", "en"), default: str = DEFAULT) -> Column:
    """The first of several settings (option, configuration, environment, system) that names a known language: ``en_GB.UTF-8`` is ``en``."""
    short = [F.lower(F.regexp_extract(F.trim(t), r"^([A-Za-z]{2})(?:[-_.].*)?$", 1)) for t in told]
    return F.coalesce(*[F.when(s.isin(*known), s) for s in short], F.lit(default))


def coverage(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """(language, n, total, share): messages of each language against all keys; ``messages`` has (language, key, message), blank ones don't count."""
    done = messages.where(F.length(F.trim("message")) > 0).join(keys.select("key").distinct(), "key", "left_semi").groupBy("language").agg(F.count_distinct("key").alias("n"))
    total = keys.agg(F.count_distinct("key").alias("total"))
    return done.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 4))
