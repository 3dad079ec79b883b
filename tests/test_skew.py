import random
from collections import Counter

from pyspark.sql import functions as F

from auditlake.operators import ranking, skew

FINDINGS = "finding_id long, batch_id long, rule_id string, file string, received_at timestamp, line int, severity string"


def _rows(n=3000):
    rng = random.Random(3)
    out = []
    for i in range(n):
        rule = "HOT" if rng.random() < 0.4 else rng.choice([None, "A", "B", f"R{rng.randrange(200)}"])
        out.append((i, rng.randrange(1, 25) if rng.random() < 0.95 else None, rule, rng.choice([None, "p/x.js", f"p/{rng.randrange(300)}.py"]), None, rng.choice([None, 1, 2]), rng.choice(["low", "high"])))
    return out


def test_heavy_keys_against_counting(spark):
    rows = _rows()
    got = {(r.key_field, r.key_value) for r in skew.heavy_keys(spark.createDataFrame(rows, FINDINGS), ["rule_id", "file"], 0.03).collect()}
    rules, files = Counter(r[2] for r in rows), Counter(r[3] for r in rows)
    want = {("rule_id", k) for k, n in rules.items() if k and n > 0.03 * len(rows)} | {("file", k) for k, n in files.items() if k and n > 0.03 * len(rows)}
    assert got == want and ("rule_id", "HOT") in got


def test_share_is_strict_and_counts_null_rows(spark):
    rows = [(i, 1, "A" if i < 3 else None, None, None, None, "low") for i in range(100)]
    assert skew.heavy_keys(spark.createDataFrame(rows, FINDINGS), ["rule_id", "file"], 0.03).count() == 0
    assert skew.heavy_keys(spark.createDataFrame(rows, FINDINGS), ["rule_id"], 0.029).count() == 1


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], FINDINGS)
    assert skew.heavy_keys(empty, ["rule_id", "file"], 0.03).count() == 0
    assert skew.key_profile(empty, ["rule_id"], "received_at", "batch_id").count() == 0
    assert skew.eager_join_aggregate(empty, empty.select("rule_id", F.col("severity").alias("s2")), ["rule_id"], ["severity"], ["s2"]).count() == 0


def test_key_profile_counts_batches_once_and_keeps_nulls_out(spark):
    rows = [(1, 1, "A", None, None, None, "low"), (2, 1, "A", None, None, None, "low"), (3, 2, "A", None, None, None, "low"), (4, None, "A", None, None, None, "low"), (5, 1, None, "f", None, None, "low")]
    got = {r.key_value: (r.n_rows, r.n_batches) for r in skew.key_profile(spark.createDataFrame(rows, FINDINGS), ["rule_id", "file"], "received_at", "batch_id").collect()}
    assert got == {"A": (4, 2), "f": (1, 1)}


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame(_rows(800), FINDINGS)
    right = spark.createDataFrame([("HOT", "x", 5), ("HOT", "y", 7), ("HOT", None, None), ("A", "x", 1), (None, "x", 9)], "rule_id string, kind string, size int")
    got = skew.eager_join_aggregate(left, right, ["rule_id"], ["severity"], ["kind"], {"sum_line": F.col("line")}, {"sum_size": F.col("size")})
    want = left.join(right, "rule_id").groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("line").alias("sum_line"), F.sum("size").alias("sum_size"))
    key = lambda r: (r.severity, r.kind or "")
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_eager_outer_join_keeps_left_keys(spark):
    left = spark.createDataFrame([("A",), ("B",), ("B",)], "k string")
    right = spark.createDataFrame([("A", 1)], "k string, t int")
    got = {(r.t, r.n_rows) for r in skew.eager_join_aggregate(left, right, ["k"], [], ["t"], outer=True).collect()}
    assert got == {(1, 1), (None, 2)}


def test_numbers_inside_groups_have_no_gaps(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = ranking.number_in_group(df, "g", ["id"], "n").collect()
    seen = {}
    for r in got:
        seen.setdefault(r.g, []).append(r.n)
    assert len(got) == 2000 and all(sorted(v) == list(range(len(v))) for v in seen.values())
