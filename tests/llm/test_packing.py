import itertools
import os
import random
from collections import Counter, defaultdict

import pytest

from auditlake.llm import packing, tokens

files = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, tokens.BYTE_BPE_50K)), reason="no tokenizer files")


def test_buckets_are_optimal_against_all_choices():
    rng = random.Random(1)
    for _ in range(20):
        histogram = {s: rng.randrange(1, 30) for s in rng.sample(range(1, 60), 8)}
        sizes = sorted(histogram)

        def padding(bounds, histogram=histogram, sizes=sizes):
            return sum(histogram[s] * (min(b for b in bounds if b >= s) - s) for s in sizes)

        best = min(padding([*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1], 3))
        assert padding(packing.length_buckets(histogram, 60, 4)) == best


def test_batches_place_every_item_within_capacity():
    rng = random.Random(2)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 400)))
        plan = packing.form_batches(dict(counts), 100)
        used = Counter()
        for times, shape in plan:
            assert sum(b * n for b, n in shape.items()) <= 100
            for b, n in shape.items():
                used[b] += n * times
        assert used == counts
        need = sum(b * n for b, n in counts.items())
        assert sum(t for t, _ in plan) <= 1.25 * need / 100 + 1


@files
def test_documents_in_containers(spark):
    rng = random.Random(4)
    texts = [None, "", "word " * 5000] + ["tok " * rng.randrange(1, 900) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, container_id string")
    n = {r.doc_id: r.n for r in tokens.encode(df, out="n", count_only=True).collect()}
    rows = packing.pack(df, capacity=1000, max_buckets=40).collect()
    filled, places, ranges = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        ranges[r.doc_id].append((r.token_start, r.token_end))
        if r.container_id is not None:
            filled[r.container_id] += r.token_end - r.token_start
            places[r.container_id].append(r.position)
    for i in range(len(texts)):
        got = sorted(ranges[i])
        assert got[0][0] == 0 and got[-1][1] == n[i] and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert len(got) == max(1, -(-n[i] // 1000))
    assert max(filled.values()) <= 1000
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(filled) <= 1.03 * sum(n.values()) / 1000 + 1
    assert {r.container_id for r in rows if r.doc_id in (0, 1)} == {None}


@files
def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = packing.pack(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()
    assert [(r.container_id, r.token_start, r.token_end) for r in only] == [(None, 0, 0)] * 2
