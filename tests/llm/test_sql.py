import pytest
from pyspark.sql import functions as F

from loomline.llm import queries, sql

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    names, got, want_names, want = oracle.both(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF)
    assert (names, got) == (want_names, want)


def test_base_columns_against_sql(spark):
    con = oracle.connect(SF)
    for query, text in ((queries.op3_secret_scan, sql.OP3_BASE), (queries.op8_lm_score, sql.OP8_BASE), (queries.op10_url_filter, sql.op10_base(queries.URL_RULES))):
        cur = con.execute(text)
        names = [x[0] for x in cur.description]
        got = query(spark, SF).select(*names)
        if "base_score" in names:
            got = got.withColumn("base_score", F.round("base_score", 4))
        assert oracle.rows(names, [tuple(r) for r in got.collect()]) == oracle.rows(names, cur.fetchall()), query.__name__
