"""The output gate and case counts read results and evidence whole: against brute force."""

import pandas as pd
import pytest

from casefile.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Evidence 3, 12 and 13 of cases 1, 3 and 4; case 2 has none. Item 3 has nothing to hold it
    back; 12 only a low confidence at seq 5; 13 only an anomaly at seq 7."""
    d = str(tmp_path_factory.mktemp("tables"))
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    orders = [(k, c, "F", "1-URGENT", pd.Timestamp("1996-01-01").date(), 400000.0) for k, c in ((3, 1), (12, 3), (13, 4))]
    frame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date, o_totalprice double", "orders")
    low = {(12, 5): 0.04, (13, 7): 0.01}
    lines = [(k, n, n, low.get((k, n), 0.09), 10.0, "N") for k in (3, 12, 13) for n in range(1, 8)]
    frame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_discount double, l_quantity double, l_returnflag string", "lineitem")
    frame([(c, f"n{c}", 1) for c in (1, 2, 3, 4)], "c_custkey long, c_name string, c_nationkey int", "customer")
    return d


def test_reasons_from_all_results(spark, tables):
    got = {(r["evidence_id"], r["code"]): r["n"] for r in QUERIES["scr17_block_reasons"](spark, tables).collect()}
    assert got == {(12, "LOW_AGENT_CONFIDENCE"): 1, (13, "LOW_AGENT_CONFIDENCE"): 1, (13, "ANOMALY_DETECTED"): 1}


def test_gate_over_all_results(spark, tables):
    routing = {r["evidence_id"]: r["routing"] for r in QUERIES["scr17_routing"](spark, tables).collect()}
    assert routing == {3: "auto_ok", 12: "review", 13: "review"}
    assert [r["evidence_id"] for r in QUERIES["scr18_client_view"](spark, tables).collect()] == [3]
    withheld = {r["code"]: r["n"] for r in QUERIES["scr18_withheld"](spark, tables).collect()}
    assert withheld == {"ROUTING_REVIEW": 2, "LOW_AGENT_CONFIDENCE": 2, "ANOMALY_DETECTED": 1}
    internal = {r["evidence_id"]: r["n_reasons"] for r in QUERIES["fil9_internal_view"](spark, tables).collect()}
    assert internal == {3: 0, 12: 1, 13: 2}


def test_every_case_is_counted(spark, tables):
    got = {r["case_id"]: r["evidence_count"] for r in QUERIES["join1_2_case_counts"](spark, tables).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}
