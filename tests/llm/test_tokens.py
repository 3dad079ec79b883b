import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, tokens.BYTE_BPE_50K)), reason="no tokenizer files")


def _whole(text):
    return tokens._encoder(tokens._rank_bytes(tokens.TOKENIZER_DIR, tokens.BYTE_BPE_50K)).encode_ordinary(text)


TEXTS = [None, "", " ", "plain", "<|endoftext|> is text", "a" * 5000, "  \n\n x" * 900, "日本語のテキスト。" * 300, "it's we'll they've " * 250, "é́🎉👩‍💻 " * 400, "\r\n\t" * 700 + "end", "word " * 2000]


def test_equal_to_whole_encoding_at_any_chunk_size(spark):
    df = spark.createDataFrame([(i % 9, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for size, overlap in ((97, 31), (512, 64), (16384, 1024)):
        got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(df, chunk_chars=size, overlap_chars=overlap).collect())
        assert got == sorted((i % 9, _whole(t or "")) for i, t in enumerate(TEXTS))


def test_counts_and_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = {r.doc_id: r.n for r in tokens.encode(df, out="n", count_only=True, chunk_chars=300, overlap_chars=40).collect()}
    assert counts == {i: len(_whole(t or "")) for i, t in enumerate(TEXTS)}
    for r in tokens.encode(df, chunk_chars=300, overlap_chars=40).collect():
        assert tokens.decode(list(r.ids)) == (TEXTS[r.doc_id] or "")


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t'sdab1。é-", min_size=1, max_size=400), st.integers(20, 60))
def test_stitching_is_exact(text, size):
    import regex

    overlap = size // 2
    pattern = regex.compile(tokens.PATTERN)
    starts = range(0, len(text), size)
    marks = []
    for k, s in enumerate(starts):
        chunk = text[s : s + size + overlap]
        marks.append({b + k * size for m in pattern.finditer(chunk) if (b := m.start()) and not chunk[b - 1].isspace()})
    cuts = [0]
    for k in range(1, len(marks)):
        common = [b for b in marks[k] & marks[k - 1] if k * size <= b < k * size + overlap]
        if not common:
            return
        cuts.append(min(common))
    pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    assert [i for p in pieces for i in _whole(p)] == _whole(text)
