"""Every query of the library against its SQL."""

import pytest
from compare import connect, rows_of, rows_of_sql

from quarry.plans import CASE_ROWS, CASES, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Queries over whole tables that no SQL states, and the golden queries that check their operators row by row.
UNSTATED = {"p10_html_parse": "p10_parsed_fields", "p13_menu_groups": "p13_menus", "t4_text_units": "t4_units_of_text", "e4_capability_terms": "e4_capabilities", "n4_contact_selection": "u5_contact_selection"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows_of(QUERIES[name](spark, DATA))
    if name in ORACLES:
        assert got == rows_of_sql(con, ORACLES[name])
    else:
        assert name in UNSTATED and got[1], "a query without SQL needs a golden one beside it"


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, con, name):
    assert rows_of(CASES[name](spark, DATA)) == rows_of_sql(con, CASE_ROWS[name])


def test_unstated_queries_have_golden_ones():
    assert all(golden in ORACLES for golden in UNSTATED.values()) and set(QUERIES) - set(ORACLES) == set(UNSTATED)


def test_entry(spark):
    import __spark_entry__

    assert "match_score" in __spark_entry__.entry(spark).columns
    assert set(QUERIES) <= set(__spark_entry__.queries())
