from auditlake.llm.terms import term_stats

SCHEMA = "finding_id long, rule_id string, category string, tags array<string>, term string"


def _stats(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in term_stats(df, ["rule_id", "category"], ["tags"]).collect()}


def test_forms_nulls_blanks_and_repeats(spark):
    rows = [
        (1, "A", " Seo ", ["Équipe", "équipe ", None, "  ", "équipe"], "clash"),
        (2, None, "SEO", None, None),
        (3, "a", "", [], None),
    ]
    got = _stats(spark, rows)
    assert got[("tags", "équipe")] == (3, 1, "rare")
    assert got[("category", "seo")] == (2, 2, "rare")
    assert got[("rule_id", "a")] == (2, 2, "rare")
    assert len(got) == 3


def test_marks(spark):
    rows = [(i, "common" if i < 30 else "few" if i < 34 else f"r{i % 10}", None, ["t"] if i < 20 else None, None) for i in range(100)]
    got = _stats(spark, rows)
    assert got[("rule_id", "common")][2] == "common"
    assert got[("rule_id", "few")][2] == "rare"
    assert got[("rule_id", "r4")][2] is None
    # exactly a fifth is not above a fifth
    assert got[("tags", "t")] == (20, 20, None)


def test_empty_and_long(spark):
    assert _stats(spark, []) == {}
    long = "x" * 100_000
    assert _stats(spark, [(1, long, None, [long], None)])[("tags", long)] == (1, 1, "rare")
