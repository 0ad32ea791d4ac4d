"""Shapes of plans: pushed filters, pruned columns, work done before shuffles."""

from flowlens.plans import QUERIES



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_and_prunes(spark, small_dir):
    text = plan(QUERIES["a1_table_scan"](spark, small_dir))
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_extendedprice" not in text and "l_tax" not in text


def test_tail_thins_before_the_shuffle(spark, small_dir):
    for name in ("e4_tail", "e6_latest_rows"):
        text = plan(QUERIES[name](spark, small_dir))
        assert "WindowGroupLimit" in text and "Partial" in text


def test_roll_up_combines_map_side(spark, small_dir):
    text = plan(QUERIES["d4_submission_roll_up"](spark, small_dir))
    assert text.count("partial_") > 4 and "Window" not in text
