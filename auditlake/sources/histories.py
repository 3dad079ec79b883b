"""Added lines of a version history, advisories, baselines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.mask import batches_of
from auditlake.rules.dependencies import ADVISORY
from auditlake.rules.scan import detect_secrets, star
from auditlake.schema import rank, severity_of

LEAK_LINE = 1_000
_COMMIT = re.compile(r"^commit ([0-9a-f]{7,40})")
_DATE = re.compile(r"^Date:\s+(.*)")
_FILE = re.compile(r"^\+\+\+ (?:b/)?(.*)")
SCHEMA = pa.schema([("commit", pa.string()), ("date", pa.string()), ("file", pa.string()), ("kind", pa.string()), ("severity", pa.string()), ("fingerprint", pa.string()), ("redacted", pa.string())])


def _leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def rows():
        for batch in batches:
            for log in batch.column(0).to_pylist():
                commit = date = file = None
                for line in (log or "").split("\n"):
                    if m := _COMMIT.match(line):
                        commit, file = m[1], None
                    elif m := _DATE.match(line):
                        date = m[1].strip()
                    elif m := _FILE.match(line):
                        file = None if m[1] == "/dev/null" else m[1]
                    elif line.startswith("+") and file and len(line) <= LEAK_LINE:
                        for kind, severity, value, _ in detect_secrets(line[1:], True):
                            yield [commit, date, file, kind, severity, hashlib.sha1(value.encode()).hexdigest()[:12], star(value)]

    yield from batches_of(rows(), SCHEMA)


def leaks_in_logs(logs: DataFrame, text_col: str = "value") -> DataFrame:
    """Secrets in the added lines of patch logs (``git log -p --date=iso``), a log or a part of it a row that begins at a commit."""
    return logs.select(text_col).mapInArrow(_leaks, "commit string, date string, file string, kind string, severity string, fingerprint string, redacted string")


def leaks(added: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """One row a secret: first and last commit, number of files and the first of them, and whether it still stands (``present``: (fingerprint)).

    The files of a secret are a relation of their own (:func:`leak_files`), as a hot one has any number.
    """
    test = F.col("file").rlike(r"(?i)(^|/)(tests?|spec|fixtures|examples?|mocks?)/")
    rows = added.groupBy("fingerprint", "kind").agg(
        F.min_by("commit", "date").alias("first_commit"), F.min("date").alias("first_date"), F.max_by("commit", "date").alias("last_commit"), F.max("date").alias("last_date"), F.count_distinct("commit").alias("commits"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("file").alias("n_files"), F.min("file").alias("first_file"), F.min("redacted").alias("redacted"), severity_of(F.min(rank(F.col("severity")))).alias("severity"), F.min(test.cast("int")).alias("test_data"),
    )
    if present is None:
        return rows
    now = present.select(F.col("fingerprint").alias("_f")).distinct()
    return rows.join(now, F.col("fingerprint") == F.col("_f"), "left").withColumn("still_present", F.col("_f").isNotNull()).drop("_f")


def leak_files(added: DataFrame) -> DataFrame:
    """(fingerprint, file): the files that held each secret."""
    return added.where(F.col("file").isNotNull()).select("fingerprint", "file").distinct()


# Where keys of a kind are revoked.
REVOKE = {"aws-access-key": "AWS console, IAM, security credentials", "aws-secret": "AWS console, IAM, security credentials", "github-token": "GitHub, settings, developer settings, tokens", "gitlab-token": "GitLab, preferences, access tokens", "slack-token": "Slack, your apps, OAuth tokens", "stripe-key": "Stripe dashboard, developers, API keys", "google-api-key": "Google Cloud console, credentials", "npm-token": "npm, access tokens", "private-key": "remove the public key wherever it is trusted", "openai-key": "provider's dashboard, API keys", "anthropic-key": "provider's console, API keys", "sendgrid-key": "SendGrid, settings, API keys", "db-url": "change the password in the database"}


def revocation_advice(leaks_: DataFrame) -> DataFrame:
    """Leaks with where to revoke them; kinds without an entry are told to be changed at their issuer."""
    advice = leaks_.sparkSession.createDataFrame(list(REVOKE.items()), "_k string, advice string")
    joined = leaks_.join(F.broadcast(advice), F.col("kind") == F.col("_k"), "left").drop("_k")
    return joined.withColumn("advice", F.coalesce("advice", F.lit("change it at its issuer")))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories of a JSON dump, a record a line."""
    return spark.read.schema(ADVISORY).json(path)


def write_baseline(fingerprints: DataFrame, path: str) -> None:
    """Sorted distinct fingerprints as JSON lines."""
    fingerprints.select("fingerprint").distinct().sort("fingerprint").write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string").json(path)


def append_history(run: DataFrame, path: str, keep: int = 200) -> DataFrame:
    """Appends a run's scores to a history and gives back its latest ``keep`` runs; the bound is the history's.

    ``run`` has (run_at, ...): all its rows share the time. Older runs stay in the folder and are
    not read: each run is a folder of its own, named by its time.
    """
    spark = run.sparkSession
    run.withColumn("_run", F.date_format("run_at", "yyyyMMdd'T'HHmmssSSS")).write.mode("append").partitionBy("_run").json(path)
    history = spark.read.schema(run.schema).option("basePath", path).json(path)
    latest = history.select("run_at").distinct().orderBy(F.desc("run_at")).limit(keep)
    return history.join(latest, "run_at", "left_semi")


def backup(files: DataFrame, edits: DataFrame, path: str) -> None:
    """The contents of the files that edits will change, as they are, before anything is written."""
    touched = edits.select("project", "file").distinct()
    files.join(touched, ["project", "file"], "left_semi").select("project", "file", "content").write.mode("error").parquet(path)
