"""Streaming queries without SQL against plain loops over the events."""

import datetime
from collections import defaultdict

import pandas as pd
import pytest

from quillon import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events():
    rows = pd.read_parquet(f"{SF}/events.parquet")
    rows["ts"] = pd.to_datetime(rows["ts"])
    return rows.sort_values(["user_id", "ts", "event_id"])


def test_breaker_equals_a_loop(spark, events):
    want = {}
    for user, own in events.groupby("user_id"):
        recent, until, wait = [], 0.0, 3600.0
        for r in own.itertuples():
            t = r.ts.tz_localize("UTC").timestamp() if r.ts.tzinfo is None else r.ts.timestamp()
            if t < until:
                want[r.event_id] = (user, "open")
                continue
            recent = [x for x in recent if x >= t - 7200] + ([t] if r.value < 20 else [])
            if r.value < 20 and len(recent) >= 5:
                until, wait, recent = t + wait, wait * 2, []
                want[r.event_id] = (user, "opens")
                continue
            if r.value >= 20 and not recent:
                wait = 3600.0
            want[r.event_id] = (user, "closed")
    got = {r.event_id: (r.user_id, r.state) for r in catalog.queries()["stream_breaker"](spark, SF).collect()}
    assert got == want


def test_windows_behind_the_watermark_equal_a_loop(spark, events):
    sums = defaultdict(lambda: [0, 0.0])
    for r in events.itertuples():
        key = (r.ts.to_pydatetime().replace(minute=0, second=0, microsecond=0, tzinfo=None), r.event_type)
        sums[key][0] += 1
        sums[key][1] += r.value
    passed = events["ts"].max().to_pydatetime().replace(tzinfo=None) - datetime.timedelta(hours=2)
    want = {k: (n, round(x, 4)) for k, (n, x) in sums.items() if k[0] + datetime.timedelta(hours=1) <= passed}
    found = catalog.queries()["stream_windowed_counts"](spark, SF).selectExpr("date_format(start, 'yyyy-MM-dd HH:mm') AS start", "event_type", "n", "total").collect()
    got = {(datetime.datetime.strptime(r.start, "%Y-%m-%d %H:%M"), r.event_type): (r.n, r.total) for r in found}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
