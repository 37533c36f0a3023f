"""Interval joins by slices of time, against all pairs."""

from datetime import datetime, timedelta

import pytest

from quayside.streaming import jobs

AT = datetime(1969, 12, 30)


@pytest.mark.parametrize("within, hours", [("6 hours", 6), ("0 hours", 0), ("1 day", 24)])
def test_pairs_meet_once_in_slices_of_time(spark, within, hours):
    a = [(i, None if i == 4 else i % 2, AT + timedelta(hours=i)) for i in range(120)] + [(120, 0, None)]
    b = [(i, None if i == 9 else i % 2, AT + timedelta(hours=i / 2)) for i in range(240)] + [(5, 1, AT + timedelta(hours=2.5))]
    left, right = spark.createDataFrame(a, "x long, u long, s timestamp"), spark.createDataFrame(b, "y long, u long, t timestamp")
    made = jobs.interval_join(left, right, "u", "s", "t", within)
    assert made.columns == ["x", "u", "s", "y", "t"]
    want = sorted((x, y) for x, u, s in a for y, w, t in b if None not in (u, s) and u == w and s <= t <= s + timedelta(hours=hours))
    assert sorted((r.x, r.y) for r in made.collect()) == want and want
    keys = made._jdf.queryExecution().executedPlan().toString()
    assert any("Join" in line and "_slice" in line and "_in" in line for line in keys.splitlines())
