"""Plan properties that matter at scale: filters reach the scan, projections
are pruned, no cartesian products."""

from riskloom.operators import features as fe


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_filter_pushed_and_pruned(spark, tables_small):
    df = fe.recent_transactions(tables_small.lineitem.select("l_orderkey", "l_shipdate"),
                                "2001-11-05 00:00:00", 90, ts_col="l_shipdate")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p


def test_flagship_has_no_cartesian(spark):
    import __spark_entry__ as E
    p = _plan(E.entry(spark))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_trailing_counts_window_is_bucketed(spark, tables_small):
    from riskloom.operators.windows import trailing_counts
    p = _plan(trailing_counts(tables_small.fx_fraude.select("id", "conta_id", "data_transacao")))
    # the window is partitioned by the key and the day bucket, not the key alone
    assert "Window" in p and "_b" in p
