"""Each new batch against everything seen so far, without reading the history again.

Statements are compared as sequences of words under a bounded edit distance: with n and m words,
at least 0.3 (n + m) of them must be common in order, which leaves at most 0.4 (n + m) insertions
and deletions. At that bound a partition into one segment more than edits comes down to segments
of one word, so a statement's segments are its words. They are stored in the index by group (rule
and file), word, length of the statement and position in the order of rarity; only the segments
that a partner within the bound cannot miss all of are stored (the rarest n - 0.6 n + 1) and
probed (the rarest n - 0.43 n + 1), the longer statement of a pair probing the shorter. A hit is
kept if the words after its positions can still make up the common part that is due. Candidates
are verified on the whole sequences; exact copies are folded before and unfolded after.

Any fixed order of the words gives the same pairs; rarity keeps hits few. The most frequent words,
from a sketch of fixed size over all statements, are ordered by their counts and come last, all
others by a hash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.paths import normal_path
from auditlake.llm.credentials import credential_values
from auditlake.session import checkpointed, work_folder

#: Two statements are the same from this agreement on: twice the common words over all words.
AGREEMENT = 0.6
#: What the second hash of a name begins with.
SECOND_SEED = 1
#: Words that the sketch of word counts keeps at a time.
TRACKED_WORDS = 8192
_WORD = re.compile(r"\w+")


def due(n: int, m: int) -> int:
    """Common words that statements of n and m words must have."""
    return math.ceil(AGREEMENT * (n + m) / 2 - 1e-9)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of it per word of ``b`` as the bits of one number."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def _stored(n: int) -> int:
    return n - due(n, n) + 1


def _probed(n: int) -> int:
    return n - due(n, math.ceil(n * AGREEMENT / (2 - AGREEMENT) - 1e-9)) + 1


def statements(findings: DataFrame, id_col: str = "finding_id") -> DataFrame:
    """(_id, _c, _d, _g, _h, snippet) of the rows that can repeat or be repeated; null rule, file or snippet never are.

    ``_g`` and ``_h`` stand for the group (rule and file however spelled), ``_c`` and ``_d`` for the
    group and the exact snippet: two hashes of 64 bits each, so that 128 bits tell texts apart.
    """
    rows = findings.where(F.col("rule_id").isNotNull() & F.col("file").isNotNull() & F.col("snippet").isNotNull() & F.col(id_col).isNotNull())
    named = rows.select(F.col(id_col).cast("long").alias("_id"), "rule_id", normal_path(F.col("file")).alias("_f"), "snippet")
    two = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit(SECOND_SEED), *c))
    (c, d), (g, h) = two("rule_id", "_f", "snippet"), two("rule_id", "_f")
    return named.select("_id", c.alias("_c"), d.alias("_d"), g.alias("_g"), h.alias("_h"), "snippet")


def word_order(rows: DataFrame, tracked: int = TRACKED_WORDS) -> dict[str, int]:
    """The frequent words and their counts over all rows, from a sketch of fixed size that every row goes through.

    The sketch knows every word above 1 / ``tracked`` of all words, with an error below that; at
    most ``tracked`` / 4 come back. Only the sketches of the tasks are shuffled.
    """
    words = rows.select(F.explode(F.expr(r"regexp_extract_all(snippet, '[\\p{L}\\p{N}_]+', 0)")).alias("w"))
    top = words.agg(F.expr(f"approx_top_k(w, {tracked // 4}, {tracked})").alias("top")).first()["top"] or []
    return {r["item"]: r["count"] for r in top if r["count"] > 20}


def _segments(order: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed: dict[str, int] = {}
        for batch in batches:
            names, groups, sizes, lists = [], [], [], []
            for i, g, snippet in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = _WORD.findall(snippet)
                n = len(words)
                if not n:
                    continue
                times: dict[str, int] = {}
                keys = []
                for w in words:
                    k = times[w] = times.get(w, 0) + 1
                    name = w if k == 1 else f"{w} {k}"
                    h = hashed.get(name)
                    if h is None:
                        h = hashed[name] = xxhash.xxh3_64_intdigest(name) - (1 << 63)
                    keys.append((order.get(w, 0), h))
                keys.sort()
                names.append(i)
                groups.append(g)
                sizes.append(n)
                lists.append([h for _, h in keys[: _probed(n)]])
            if len(hashed) > 500_000:
                hashed.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(groups, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["_id", "_g", "_n", "_words"])

    return run


def segments(texts: DataFrame, order: dict[str, int]) -> DataFrame:
    """(_key, _id, _n, _at): the segments of each text by group and word, with its length and their position; their number is fixed by the length."""
    words = texts.select("_id", "_g", "snippet").mapInArrow(_segments(order), "_id bigint, _g bigint, _n int, _words array<bigint>")
    placed = words.select("_id", "_n", "_g", F.posexplode("_words").alias("_at", "_w"))
    return placed.select(F.shiftrightunsigned(F.xxhash64("_g", "_w"), 14).alias("_key"), "_id", "_n", "_at")


def _stored_size(n: Column) -> Column:
    return n - F.ceil(F.lit(AGREEMENT) * n - 1e-9).cast("int") + 1


def _candidates(new: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (_a, _b) of ids, the smaller first, of a new text and one of lower id that share a segment and may still agree enough.

    The longer text of a pair probes with all its segments, the shorter is found by its rarest
    ones; both tables are bucketed by the key, so they meet without being shuffled.
    """
    x = new.select("_key", F.col("_id").alias("_b"), F.col("_n").alias("_bn"), F.col("_at").alias("_bat"))
    y = known.select("_key", F.col("_id").alias("_a"), F.col("_n").alias("_an"), F.col("_at").alias("_aat"))
    owed = F.ceil(F.lit(AGREEMENT / 2) * (F.col("_an").cast("long") + F.col("_bn")) - 1e-9)
    shorter = F.when(F.col("_an") <= F.col("_bn"), F.col("_aat") < _stored_size(F.col("_an"))).otherwise(F.col("_bat") < _stored_size(F.col("_bn")))
    room = F.least(F.col("_an") - F.col("_aat"), F.col("_bn") - F.col("_bat")) >= owed
    return x.join(y, "_key").where((F.col("_a") < F.col("_b")) & (owed <= F.least("_an", "_bn")) & shorter & room).select("_a", "_b").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, frozenset[str]] = {}
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = _WORD.findall(x), _WORD.findall(y)
            same = common_words(a, b) >= due(len(a), len(b))
            if same:
                for t in (x, y):
                    if t not in held:
                        held[t] = credential_values(t)
                same = not _differ(held[x], held[y])
            keep.append(same)
        if len(held) > 50_000:
            held.clear()
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["_a", "_b"])


def _differ(a: frozenset[str], b: frozenset[str]) -> bool:
    """Do two statements hold different credentials? A value cut short counts as the one it begins."""
    if not a or not b:
        return False
    return not any(x == y or (min(len(x), len(y)) >= 8 and (x.startswith(y) or y.startswith(x))) for x in a for y in b)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(_a, _b) of the pairs that are the same statement, judged on the whole snippets."""
    x, y = (texts.select(F.col("_id").alias(i), F.col("_g").alias(g), F.col("_h").alias(h), F.col("snippet").alias(t)) for i, g, h, t in (("_a", "_ga", "_ha", "_x"), ("_b", "_gb", "_hb", "_y")))
    both = pairs.join(x, "_a").join(y, "_b").where("_ga = _gb AND _ha = _hb").select("_a", "_b", "_x", "_y")
    return both.mapInArrow(_verify, "_a bigint, _b bigint")


def _roots(first: DataFrame) -> DataFrame:
    """(_b, _a) with _a followed to a statement that repeats none; chains halve each round."""
    current = checkpointed(first)
    while True:
        up = current.select(F.col("_b").alias("_m"), F.col("_a").alias("_top"))
        joined = current.join(up, F.col("_a") == F.col("_m"), "left")
        if joined.where(F.col("_top").isNotNull()).limit(1).count() == 0:
            return current
        current = checkpointed(joined.select("_b", F.coalesce("_top", "_a").alias("_a")))


#: The tables of an index: columns, and the column whose hash places a row in a bucket.
_TABLES = {
    "names": ("_c bigint, _d bigint, _id bigint", "_c"),
    "texts": ("_id bigint, _g bigint, _h bigint, snippet string", "_id"),
    "segments": ("_key bigint, _id bigint, _n int, _at int", "_key"),
    "roots": ("_b bigint, _a bigint", "_b"),
}


class HistoryIndex:
    """All statements so far, their segments and what each repeats, in a folder, for checking batches as they arrive.

    ``deduplicate`` appends the new texts of a batch and their segments, probes all segments with
    those of the batch, verifies the candidates and records what repeats what; repeats are
    recorded too, so batches give the rows of one batch that holds them all. The history is never
    shuffled: its tables lie in ``buckets`` buckets (names by their hash, texts by id, segments by
    key), only the batch's rows and candidates are brought to them.

    All state is in the folder: the number of buckets and the order of words, which the segments
    depend on, are those of the first batch ever after, and a batch counts once its number is
    written last. So any instance, also of another process, carries on where the last whole batch
    ended; what a broken batch left is removed, and a batch given again yields its rows again.
    One batch at a time may be written, and ids must rise from batch to batch.
    """

    def __init__(self, path: str, buckets: int | None = None):
        self.path, self.buckets = path.rstrip("/"), buckets

    def _place(self, spark: SparkSession, name: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, spark: SparkSession, name: str) -> bool:
        place, system = self._place(spark, f"{name}/_SUCCESS")
        return system.exists(place)

    def _drop(self, spark: SparkSession, name: str) -> None:
        place, system = self._place(spark, name)
        system.delete(place, True)

    def batches(self, spark: SparkSession) -> int:
        """Whole batches in the folder."""
        return spark.read.parquet(f"{self.path}/state").count() if self._exists(spark, "state") else 0

    def _table(self, spark: SparkSession, name: str, buckets: int) -> str:
        columns, key = _TABLES[name]
        place, system = self._place(spark, name)
        system.mkdirs(place)
        called = f"history_{name}_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {called} ({columns}, _batch int) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (_batch) CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        spark.catalog.recoverPartitions(called)
        return called

    def _append(self, spark: SparkSession, called: str, name: str, batch: int, rows: DataFrame) -> None:
        """Writes a batch's rows, one file a bucket; what stands there of a broken run goes first."""
        self._drop(spark, f"{name}/_batch={batch}")
        columns, key = _TABLES[name]
        spread = rows.repartition(self._buckets, key) if name != "texts" else rows
        spread.select(*[c.split()[0] for c in columns.split(", ")], F.lit(batch).alias("_batch")).write.insertInto(called)
        spark.catalog.recoverPartitions(called)

    def _opened(self, spark: SparkSession, rows: DataFrame) -> dict[str, int]:
        """The order of words; number of buckets and order are fixed with the first batch."""
        if not self._exists(spark, "order"):
            self._buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            order = [("", self._buckets), *word_order(rows).items()]
            spark.createDataFrame(order, "word string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order")
        order = {r["word"]: r["n"] for r in spark.read.parquet(f"{self.path}/order").collect()}
        self._buckets = order.pop("")
        return order

    def deduplicate(self, batch: DataFrame, id_col: str = "finding_id") -> DataFrame:
        """(dup_of, finding_id) of the batch's repeats."""
        spark = batch.sparkSession
        # shuffle files go with the write that made them; what a later step needs is read from the folder
        cleaning = spark.conf.get(_CLEANING, "false")
        spark.conf.set(_CLEANING, "true")
        try:
            return self._deduplicate(spark, statements(batch, id_col), id_col)
        finally:
            spark.conf.set(_CLEANING, cleaning)

    def _deduplicate(self, spark: SparkSession, rows: DataFrame, id_col: str) -> DataFrame:
        done = self.batches(spark)
        order = self._opened(spark, rows)
        called = {name: self._table(spark, name, self._buckets) for name in _TABLES}
        stored = lambda name: spark.table(called[name]).where(F.col("_batch") <= done)
        earlier = lambda name: spark.table(called[name]).where(F.col("_batch") < done)

        # the batch's texts, each with its first id, here or in the history
        folded = rows.groupBy("_c", "_d").agg(F.min("_id").alias("_first")).repartition(self._buckets, "_c")
        known = earlier("names").select("_c", "_d", F.col("_id").alias("_known"))
        named = self._kept(folded.join(known, ["_c", "_d"], "left"), "named", done)
        fresh = named.where("_known IS NULL").select("_c", "_d", F.col("_first").alias("_id"))
        self._append(spark, called["names"], "names", done, fresh)
        told = rows.repartition(self._buckets, "_id").join(fresh.select("_id").repartition(self._buckets, "_id"), "_id", "left_semi").dropDuplicates(["_id"])
        self._append(spark, called["texts"], "texts", done, told)
        new = spark.table(called["texts"]).where(F.col("_batch") == done)
        self._append(spark, called["segments"], "segments", done, segments(new, order))

        probing = spark.table(called["segments"]).where(F.col("_batch") == done)
        found = links(_candidates(probing, stored("segments")), stored("texts"))
        above = earlier("roots").select(F.col("_b").alias("_a"), F.col("_a").alias("_root"))
        up = found.groupBy("_b").agg(F.min("_a").alias("_a")).join(above, "_a", "left").select("_b", F.coalesce("_root", "_a").alias("_a"))
        self._append(spark, called["roots"], "roots", done, _roots(up))

        spark.createDataFrame([(done,)], "batch int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        standing = named.select("_c", "_d", F.coalesce("_known", "_first").alias("_b")).join(stored("roots").select("_b", "_a"), "_b", "left")
        standing = standing.select("_c", "_d", F.coalesce("_a", "_b").alias("dup_of"))
        repeated = rows.select("_id", "_c", "_d").join(standing, ["_c", "_d"]).where(F.col("_id") > F.col("dup_of"))
        out = self._kept(repeated.select("dup_of", F.col("_id").alias(id_col)).distinct(), "repeats", done)
        for name in called.values():
            spark.sql(f"DROP TABLE {name}")
        self._drop(spark, f"named/{done}")
        return out

    def _kept(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        """A step's result, written to the folder and read from there."""
        place = f"{self.path}/{name}/{batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(place)
        return rows.sparkSession.read.schema(rows.schema).parquet(place)


_CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def replay(findings: DataFrame, path: str, batch_col: str = "batch_id", rounds: int = 3, id_col: str = "finding_id", buckets: int | None = None) -> DataFrame:
    """(dup_of, finding_id) of a recorded history, delivered again to an index in ``path``.

    The deliveries are given to the index in their order, in ``rounds`` ranges of the batch column
    of equal width; a row without batch comes with the last. Rows are those of one round over all:
    same statement: equal rule, same file however spelled, words in agreement from ``AGREEMENT``
    on, no different credentials. Null rule, file, snippet or id: neither repeats nor repeated.
    Snippets without any word are the same only if they are equal. An id met twice counts as one.
    Empty input gives no rows. Ids must rise with the batch.
    """
    index = HistoryIndex(path, buckets)
    ends = findings.agg(F.min(batch_col), F.max(batch_col)).first()
    if rounds <= 1 or ends[0] is None or ends[1] - ends[0] + 1 < rounds:
        return index.deduplicate(findings, id_col)
    width = (ends[1] - ends[0] + 1) / rounds
    bounds = [ends[0] + math.floor(k * width) for k in range(1, rounds)]
    b, parts = F.col(batch_col), []
    for k, low in enumerate([None, *bounds]):
        part = F.lit(True) if low is None else b >= low
        part = part & (b < bounds[k]) if k < len(bounds) else part | b.isNull()
        parts.append(index.deduplicate(findings.where(part), id_col))
    return reduce(DataFrame.unionByName, parts)


def repeats(findings: DataFrame, id_col: str = "finding_id") -> DataFrame:
    """(dup_of, finding_id) over a whole history given as one batch; see :func:`replay`."""
    return HistoryIndex(work_folder(findings.sparkSession, "history")).deduplicate(findings, id_col)
