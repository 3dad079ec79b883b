import random

from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import history

SCHEMA = "finding_id long, rule_id string, file string, snippet string, dup_of string"


def _brute(rows):
    import posixpath

    seen, out = {}, {}
    for i, rule, file, snippet, _ in sorted(rows, key=lambda r: r[0]):
        if None in (rule, file, snippet):
            continue
        key = (rule, posixpath.normpath(file.strip().replace("\\", "/")))
        words = history._WORD.findall(snippet)
        hit = None
        for j, w, s in seen.setdefault(key, []):
            same = s == snippet or (w and words and history.common_words(w, words) >= history.due(len(w), len(words)))
            if same and (s == snippet or not history._differ(history.credential_values(s), history.credential_values(snippet))):
                hit = out.get(j, j)
                break
        if hit is not None:
            out[i] = hit
        seen[key].append((i, words, snippet))
    return out


def _rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["if", "return", "const"] * 4
    out, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.4:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new"], [words[at], rng.choice(vocabulary)]])
                words = words or ["x"]
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randrange(1, 18)))
        texts.append(text)
        out.append((i, rng.choice(["HOT", "HOT", "B", None]), rng.choice(["p/a.js", "./p/a.js", "p//a.js ", "p\\a.js", "p/x/../a.js", "p/b.js", None]), rng.choice([text, text, text, None]) if i % 9 == 0 else text, "clash"))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_words_is_the_longest_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert history.common_words(a, b) == table[-1][-1]


def test_history_equals_brute_force(spark):
    rows = _rows(700)
    got = {r.finding_id: r.dup_of for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _brute(rows)
    assert want and got == want


def test_batches_equal_whole_history(spark, tmp_path):
    rows = _rows(240, seed=7)
    index, got = history.HistoryIndex(str(tmp_path / "index")), {}
    for k in range(0, 240, 80):
        got |= {r.finding_id: r.dup_of for r in index.deduplicate(spark.createDataFrame(rows[k : k + 80], SCHEMA)).collect()}
    assert got == {r.finding_id: r.dup_of for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_replayed_deliveries_equal_brute_force(spark, tmp_path):
    rows = _rows(300, seed=3)
    frame = spark.createDataFrame([(*r, None if r[0] > 295 else 1 + r[0] // 30) for r in rows], SCHEMA + ", batch_id int")
    got = {r.finding_id: r.dup_of for r in history.replay(frame, str(tmp_path / "index"), rounds=4, buckets=3).collect()}
    want = _brute(rows)
    assert want and got == want
    assert history.HistoryIndex(str(tmp_path / "index")).batches(spark) == 4
    assert history.replay(frame.limit(0), str(tmp_path / "empty")).count() == 0


def test_history_is_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = history.HistoryIndex(str(tmp_path / "index"), 4)
        index.deduplicate(spark.createDataFrame(_rows(60), SCHEMA))
        called = index._table(spark, "segments", 4)
        plan = history._candidates(spark.table(called), spark.table(called))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the pairs alone, to drop those met twice
        spark.sql(f"DROP TABLE {called}")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_empty_credentials_and_long(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, "R", "f", "{", None) for i in range(50)] + [(100, "R", "f", "}", None), (101, "R", "f", "", None), (102, "R", "f", "", None)]
    rows += [(200, "R", "f", long, None), (201, "R", "f", long + " tail", None)]
    rows += [(300, "R", "f", 'a.b.c.password = "River_vessel345"', None), (301, "R", "f", 'a.b.c.password = "Cloud_temple812"', None), (302, "R", "f", '+ a.b.c.password = "River_vessel345"', None)]
    got = {r.finding_id: r.dup_of for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: 0 for i in range(1, 50)}, 102: 101, 201: 200, 302: 300}
    assert history.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_is_exact_and_carries_on_in_new_instances(spark, tmp_path):
    rows = _rows(240, seed=7)
    path, got = str(tmp_path / "index"), {}
    for k in range(0, 240, 80):
        # a new instance a batch: a restarted driver knows only the folder
        part = {r.finding_id: r.dup_of for r in history.HistoryIndex(path).deduplicate(spark.createDataFrame(rows[k : k + 80], SCHEMA)).collect()}
        got |= part
    assert got == {r.finding_id: r.dup_of for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    again = {r.finding_id: r.dup_of for r in history.HistoryIndex(path).deduplicate(spark.createDataFrame(rows[160:], SCHEMA)).collect()}
    assert again == part


def test_index_links_through_a_recorded_repeat(spark, tmp_path):
    # 3 agrees with 2 only, 2 was a repeat of 1
    texts = ["a b c d e f g h i j", "a b c d e f g x y z", "d e f g x y z u v w"]
    index, got = history.HistoryIndex(str(tmp_path / "index")), {}
    for i, text in enumerate(texts, 1):
        got |= {r.finding_id: r.dup_of for r in index.deduplicate(spark.createDataFrame([(i, "R", "f", text, None)], SCHEMA)).collect()}
    assert got == {2: 1, 3: 1}
    assert index.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_snippets(spark):
    long = " ".join(f"word{i}" for i in range(70_000))
    rows = [(1, "R", "f", long, None), (2, "R", "f", long + " tail", None), (3, "R", "f", "word1 word2", None), (4, "R", "f", "head " + long, None)]
    assert {r.finding_id: r.dup_of for r in history.repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == {2: 1, 4: 1}
