import pytest

from helixframe.plans import driver_queries, intron_queries
from tests.oracle import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver_queries.QUERIES, driver_queries.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(spark, FOLDER, QUERIES[name], ORACLES[name], con)


def test_intron_queries_meet_all_kinds_of_introns(con):
    kinds = con.sql(f"WITH {intron_queries.SQL}, {intron_queries.TAGS} SELECT (SELECT count(DISTINCT coalesce(omitted, '-')) FROM o), (SELECT count(duplicate) FROM t), (SELECT count(*) FROM t WHERE NOT longest_isoform)").fetchall()[0]
    assert kinds[0] == 4 and kinds[1] > 10 and kinds[2] > 10
