"""Alerts and the delivery queue tell changes apart before they meet the watches, of which there may be very many."""

from permrisk.plans import monitor


def plan(spark, sf, name):
    return monitor.QUERIES[name][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_alerts_are_not_told_apart_after_the_join(spark, sf):
    above, join, _ = plan(spark, sf, "monitor_alerts").partition("Join Inner")
    assert join and "Aggregate" not in above


def test_a_watch_meets_twenty_changes_at_most(spark, sf):
    above, join, below = plan(spark, sf, "monitor_delivery_queue").partition("Join Inner")
    assert join and "Aggregate" not in above and "row_number()" in below
