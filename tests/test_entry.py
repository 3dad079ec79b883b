import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_names_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 60 and set(sql) <= set(queries)


@needs_tables
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1


@needs_tables
@pytest.mark.parametrize("name", ["p3_found", "scores_by_category", "filter_chain", "action_plan", "duplicate_blocks", "advisory_range_join", "cvss_scores", "contrast_matrix", "p3_file_captures", "planted_import_edges", "planted_mounted_routes", "planted_pattern_rules"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from compare import canonical

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    assert canonical(entry.queries()[name](spark, SMALL).toPandas()) == canonical(con.execute(entry.oracle_sql()[name]).df())
