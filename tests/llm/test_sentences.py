import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import sentences
from auditlake.llm.sentences import Splitter, corpus_evidence, split

S = Splitter(frozenset({"sog"}), frozenset({"npm"}))


def _parts(text):
    return [text[a:b] for a, b in S.units(text)]


# each case is the list of its units; they are joined by a space
CASES = [
    ["It took 32.4 s, approx. 5.4 MB.", "The rest is fine.", "npm v8.x flags it."],
    ["See p. 63 and fig. 16 of the report.", "Mrs. Dorvex and Prof. Yevrand read it.", "J. R. Sandrovik wrote it."],
    ["Images, fonts, etc. of the page count twice.", "We removed routes, exports, etc.", "Who did?"],
    ["It starts at 11 p.m.", "The U.S. mirror opened at 9 a.m. on Monday."],
    ['The report says: "Nothing was checked. Run it again."', "The crawler stopped."],
    ['"Why is it called twice?" asked Pellanor.', "Nobody knew."],
    ["(The same holds for index.html.)", "Call session.refresh() before it."],
    ["Im 2. Lauf stieg die Zahl.", "Am 3. Januar wurde es verschoben.", "Das sog. „Element“ fehlt, d. h. vor dem Laden."],
    ["Dorvex schrieb: „Nichts wurde geprüft. Bitte erneut starten.“", "Stimmt es?"],
    ["Bref... le gabarit n'a jamais été testé.", "Est-il vrai qu'il casse ?", "Mme Brannoway a écrit : « Rien n'a été vérifié. Il faut relancer. »"],
    ["Fixed it! 🎉", "The 👩‍💻 on call saw it."],
    ["Краулер нашёл рисунки и т. п. из src/a.ts за 29,2 с.", "Второй проход, т. е. до загрузки.", "Правда ли?"],
    ["Γιατί το x.y();", "Ο κ. Dorvex βρήκε τις εικόνες κ.λπ. του page."],
    ["डॉ. Quillane ने पढ़ा।", "क्या यह बेकार है?"],
    ["هل سجّل الزاحف a.py؟", "قال د. Ilmarest إن الروابط حُذفت."],
    ["ทีมงานพบลิงก์ 98 รายการ", "ระบบอ่านไฟล์ a/b.py เสร็จแล้ว"],
    ['"왜 실패했나요?"라고 담당자가 물었다.', "크롤러는 보고했습니다."],
]


@pytest.mark.parametrize("parts", CASES)
def test_units(parts):
    assert _parts(" ".join(parts)) == parts


def test_scripts_without_spaces():
    assert _parts("报告写道：“什么都没有检查。请重新运行。”第二次扫描读取了3.5MB。“为什么？”审查者问道。") == ["报告写道：“什么都没有检查。请重新运行。”", "第二次扫描读取了3.5MB。", "“为什么？”审查者问道。"]
    assert _parts("「なぜ下がったのか。」と担当者は尋ねた。次は？はい！") == ["「なぜ下がったのか。」と担当者は尋ねた。", "次は？", "はい！"]


def test_missing_space_and_hard_wraps():
    assert _parts("The rest is fine.If npm reads\nindex.html it stops!The end") == ["The rest is fine.", "If npm reads\nindex.html it stops!", "The end"]
    assert _parts("der Rest passt.Hr. Maier kennt es.") == ["der Rest passt.", "Hr. Maier kennt es."]


def test_blocks():
    text = "# Title one. Two\nFirst. Second\nline\r\n\r\n- item a. More\n- item b\n1. one\n2. two\n\n```py\nx = 1.\n\ny\n```\nlast"
    assert _parts(text) == ["# Title one. Two", "First.", "Second\nline", "- item a.", "More", "- item b", "1. one", "2. two", "```py\nx = 1.\n\ny\n```", "last"]
    assert _parts("a\n\n```\nnever closed. Yes") == ["a", "```\nnever closed. Yes"]


def test_document_decides_unknown_short_word():
    assert _parts("A zkr. word here.") == ["A zkr. word here."]
    assert _parts("The zkr ended. A zkr. word here.") == ["The zkr ended.", "A zkr.", "word here."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\t\"'()«»„“。？；;-#*`…ก คде🎉 ", max_size=120))
def test_units_cover_all_but_white_space(text):
    units = S.units(text)
    covered = "".join(text[a:b] for a, b in units)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in units)
    assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))


def test_table(spark):
    rows = [(1, "One. Two.", "en"), (2, None, None), (3, " \n", None), (1, "One. Two.", "xx"), (4, "word " * 20000 + "end. Next.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_start string")
    got = sorted(tuple(r) for r in split(df).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 100004), (4, 105 - 105 + 100005, 100010)]
    assert split(df.limit(0)).count() == 0


def test_corpus_counts_are_whole_whatever_the_tasks(spark):
    # 60 different successors, each met once; a starter after a period counts against the word
    texts = [f"A qzv. {a}{b} here" for a in "abcdefghij" for b in "klmnop"] + ["npm reads it"] * 6 + ["The xvw. npm reads it"] * 30 + ["A rare. word here"] * 19
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for tasks in (1, 40, len(texts)):
        assert corpus_evidence(df.repartition(tasks), "text") == (frozenset({"qzv"}), frozenset({"npm"}))


@pytest.mark.parametrize(
    "parts",
    [
        # before small words: an abbreviation; the capital after it is a name of the document, or not
        ["The bldg. manager of Quorvane left.", "Later the bldg. Quorvane stood empty.", "He saw the bldg.", "The manager left."],
        ["The deptmnt. head met Quorvane.", "A deptmnt. clerk left.", "Then deptmnt. Quorvane closed."],
        # always before names: a title
        ["We met Dorvex and saw Pellanor.", "Then Rvd. Dorvex spoke to Rvd. Pellanor about it."],
        # it also stands without a period: a word
        ["The bldg manager of Quorvane left.", "He saw the bldg.", "Quorvane stood empty."],
    ],
)
def test_document_decides_before_capitals(parts):
    assert _parts(" ".join(parts)) == parts


def test_corpus_only_where_the_document_is_silent():
    s = Splitter(frozenset({"zkr"}))
    cut = lambda t: [t[a:b] for a, b in s.units(t)]
    assert cut("A zkr. word here.") == ["A zkr. word here."]
    assert cut("The zkr ended. A zkr. word here.") == ["The zkr ended.", "A zkr.", "word here."]


def test_open_brackets_quotes_and_many_periods_stay_linear():
    import time

    splitter = sentences.Splitter()
    began = time.perf_counter()
    for text in ("a (b " * 8_000, '"x “y ' * 8_000, " ".join(f"ab{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}. foo" for k in range(8_000))):
        assert splitter.units(text)
    assert time.perf_counter() - began < 5


def test_corpus_counts_do_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame([(i, "We see Xyzq. foo bar. The end.") for i in range(60)], "doc_id long, text string")
    assert [sentences.corpus_evidence(docs.repartition(n), "text") for n in (1, 7)] == [sentences.corpus_evidence(docs.coalesce(1), "text")] * 2
    held, sentences.HELD_WORDS = sentences.HELD_WORDS, 1
    try:
        assert sentences.corpus_evidence(docs, "text") == sentences.corpus_evidence(docs.coalesce(1), "text")
    finally:
        sentences.HELD_WORDS = held


def test_marks_behind_white_space_alone():
    assert sentences.Splitter().units(" ?B") == [(1, 2), (2, 3)]
