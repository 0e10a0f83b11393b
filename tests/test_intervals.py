"""Interval joins against a comparison of every pair."""

import datetime as dt
import random
from collections import Counter

import pytest

from tallygrove.operators import intervals

DAY = dt.datetime(2024, 2, 28)


def at(seconds):
    return None if seconds is None else DAY + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    times = [at(rng.choice([rng.uniform(-9e4, 9e5), rng.randrange(0, 800) * 1000.0, 3600.0])) for _ in range(700)] + [None, at(0), at(-1e8), at(0.5)]
    spans = [(None, 5), (5, None), (10, 3), (3600, 3600), (0, 0), (-1e9, 1e9), (0.25, 0.5), (0.5, 0.75), (86399, 86401)]
    spans += [(s, s + rng.choice([0, 1, 59, 3600, 86400, 7 * 86400.0])) for s in [rng.randrange(0, 800) * 1000.0 for _ in range(60)]]
    spans += [(3600, 7200)] * 2
    rows = [(i, t, "mine") for i, t in enumerate(times)]
    found = [(rng.randrange(20), f"p{k}", at(a), at(b)) for k, (a, b) in enumerate(spans)] + [(0, "same", at(0), at(9)), (0, "same", at(0), at(9))]
    df = spark.createDataFrame(rows, "i int, date timestamp_ntz, _note string").repartition(4)
    return df, spark.createDataFrame(found, "prio int, name string, start_t timestamp_ntz, end_t timestamp_ntz"), rows, found


def held(rows, spans, closed):
    return [
        (r, s) for r in rows for s in spans
        if None not in (r[1], s[2], s[3]) and s[2] <= s[3] and s[2] <= r[1] and (r[1] <= s[3] if closed else r[1] < s[3])
    ]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("limit", [10_000, 0])
def test_all(tables, closed, limit):
    df, spans, rows, found = tables
    got = intervals.tag_all(df, spans, closed=closed, broadcast_rows=limit)
    assert got.columns == ["i", "date", "_note", "prio", "name"]
    want = Counter((*r, s[0], s[1]) for r, s in held(rows, found, closed))
    assert Counter(map(tuple, got.collect())) == want and want


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("limit", [10_000, 0])
def test_first(tables, closed, limit):
    df, spans, rows, found = tables
    got = intervals.tag_first(df, spans, "prio", closed=closed, broadcast_rows=limit)
    best = {}
    for r, s in held(rows, found, closed):
        best[r[0]] = min(best.get(r[0], s), s)
    assert Counter(map(tuple, got.collect())) == Counter((*r, *(best[r[0]][:2] if r[0] in best else (None, None))) for r in rows)


@pytest.mark.parametrize("limit", [10_000, 0, -1])
def test_nothing(tables, limit):
    df, spans, rows, _ = tables
    none = spans.limit(0)
    assert intervals.tag_all(df, none, broadcast_rows=limit).count() == 0
    got = intervals.tag_first(df, none, "prio", broadcast_rows=limit)
    assert got.columns[-2:] == ["prio", "name"] and {(r["prio"], r["name"]) for r in got.collect()} == {(None, None)} and got.count() == len(rows)
    assert intervals.tag_first(df.limit(0), spans, "prio", broadcast_rows=limit).count() == 0


def test_rows_are_not_shuffled_nor_copied(tables):
    df, spans, *_ = tables
    text = intervals.tag_first(df, spans, "prio")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Generate" not in text and "SortMergeJoin" not in text and "NestedLoop" not in text


def test_many_intervals_meet_times_not_rows(spark, tables, monkeypatch):
    """What is written for the join does not grow with the rows, but with their times."""
    _, spans, *_ = tables
    written, plain = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda df, name: written.append(plain(df, name)) or written[-1])
    counts = []
    for n in (100, 5000):
        rows = spark.range(n).selectExpr("id", "'wide' AS note", "timestamp_ntz'2024-02-29' + make_dt_interval(0, CAST(id % 24 AS INT)) AS date")
        written.clear()
        assert intervals.tag_first(rows, spans, "prio", broadcast_rows=0).count() == n
        assert intervals.tag_all(rows, spans, broadcast_rows=0).count() >= n
        counts.append([w.count() for w in written])
    assert counts[0] == counts[1] and all("note" not in w.columns for w in written)


def test_an_interval_touches_two_bins_at_most(tables):
    _, spans, *_ = tables
    binned = intervals._binned(spans, "start_t", "end_t", True)
    assert max(r["count"] for r in binned.groupBy("prio", "name", "start_t", "end_t", "_level").count().collect()) <= 4  # two equal intervals


def test_session_time_zone_does_not_matter(spark, tables):
    df, spans, rows, found = tables
    want = Counter(map(tuple, intervals.tag_all(df, spans).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert Counter(map(tuple, intervals.tag_all(df, spans).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
