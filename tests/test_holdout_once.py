"""Both periods of the holdout come out of one panel."""

from ledgerflow.catalog import QUERIES


def test_holdout_reads_the_panel_once(spark, sf_dir):
    scans = lambda q: QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate#")
    assert scans("e13_e15_e23_holdout") <= scans("e10_feature_ic")
