"""Joins are left to the optimizer: with broadcasts off the shuffled plans give the same results, and
no plan carries a forced broadcast."""

import pytest

from conftest import SF_SMALL
from helpers import rows
from transitlake.operators import nest
from transitlake.operators.docviews import DocViews
from transitlake.plans import products as P
from transitlake.plans import reports_doc as D
from transitlake.plans import reports_rel as R
from transitlake.plans.catalog import rounded
from transitlake.sources.binding import bind_network


def _trend(net):
    docs = DocViews.from_network(net)
    return P.co2_trend(docs, P.stop_board(docs, id_ligne=7))


CASES = {
    "R_i_rel": lambda net: R.report_i(net),
    "R_i_rel_trunc": lambda net: R.report_i(net, truncate=True),
    "R_i_doc": lambda net: D.report_i(DocViews.from_network(net)),
    "R_m_rel": lambda net: R.report_m(net),
    "D05": _trend,
    "M4": lambda net: nest.nest_trafic(net, max_items=2).select("id_trafic", "part"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_shuffled_plan_agrees(spark, case):
    net = bind_network(spark, SF_SMALL)
    df = CASES[case](net)
    assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = rows(rounded(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(rounded(CASES[case](bind_network(spark, SF_SMALL)))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
