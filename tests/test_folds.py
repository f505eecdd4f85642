"""Curves as merged summaries, time folds and their verdicts, and metrics of given tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at
from quotelake.operators import curves, evidence, folds

DAY = 86_400


def day(n, hours=0):
    return (pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(n), hours=hours)).to_pydatetime()


def plain_curve(r):
    c = np.r_[1.0, np.cumprod(1 + np.asarray(r))]
    return c[-1], c.max(), c.min(), (1 - c / np.maximum.accumulate(c)).max()


@pytest.mark.parametrize("fanout", [2, 7, 64])
def test_a_curve_is_a_tree_of_merges(spark, fanout):
    r = np.random.default_rng(fanout)
    rows = [(k, i, float(x)) for k, n in (("A", 1), ("B", 130), ("C", 301)) for i, x in enumerate(r.normal(0, 0.05, n))]
    df = spark.createDataFrame(rows, "k string, i long, ret double").repartition(5)
    for row in curves.summaries(df, ["k"], "i", "ret", fanout).collect():
        np.testing.assert_allclose([row.curve.p, row.curve.hi, row.curve.lo, row.curve.dd], plain_curve([x for k, _, x in rows if k == row.k]), rtol=1e-12)
    assert curves.summaries(df.where("k = 'none'"), ["k"], "i", "ret", fanout).count() == 0


def test_bootstrap_of_a_long_series(spark):
    """Long enough for several levels of merges; against paths drawn and walked in numpy."""
    from quotelake.functions import sampling

    r = np.random.default_rng(5).normal(0.0005, 0.01, 900)
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(r)], "asset string, rn long, ret double")
    got = evidence.block_bootstrap(df, ["asset"], samples=20, block_sizes=(5,)).first()
    n, block = len(r), 5
    need = n // block
    draws = spark.range(20 * need).select((F.col("id") / need).cast("long").alias("path"), (F.col("id") % need).alias("k"))
    draws = draws.select("path", "k", (sampling.draw(42, F.col("path"), F.col("k"), F.lit(block)) % n).alias("start")).toPandas().sort_values(["path", "k"])
    paths = [plain_curve(np.concatenate([r[(s + np.arange(block)) % n] for s in p.start])) for _, p in draws.groupby("path")]
    np.testing.assert_allclose(got.return_p50, np.quantile([p[0] - 1 for p in paths], 0.5), rtol=1e-9)
    np.testing.assert_allclose(got.drawdown_p95, np.quantile([p[3] for p in paths], 0.95), rtol=1e-9)


def test_folds_leave_a_holding_time_before_each_test(spark):
    bounds = spark.createDataFrame([("A", day(0), day(300), day(505)), ("B", day(0), day(61), day(400))], "asset string, start timestamp, split timestamp, end timestamp")
    got = {(r.asset, r.fold): r for r in folds.time_folds(bounds, ["asset"], 3, DAY, holding_seconds=5 * DAY + 3600).collect()}
    assert [(got["A", f].test_from, got["A", f].test_to, got["A", f].train_to) for f in (1, 2, 3)] == [(day(300), day(368), day(294)), (day(368), day(436), day(362)), (day(436), day(505), day(430))]
    assert all(got["A", f].enough for f in (1, 2, 3)) and not got["B", 1].enough and got["B", 2].enough


def test_folds_purged_by_events(spark):
    bounds = spark.createDataFrame([("A", day(0), day(300), day(400)), ("B", day(0), day(300), day(400))], "asset string, start timestamp, split timestamp, end timestamp")
    decisions = spark.createDataFrame([("A", day(d, 5)) for d in range(0, 400, 10)] + [("B", day(299))], "asset string, ts timestamp")
    got = {(r.asset, r.fold): r for r in folds.time_folds(bounds, ["asset"], 2, DAY, decisions=decisions, holding_events=3).collect()}
    # decisions before day 300: ..., 270, 280, 290; the third last is that of day 270
    assert got["A", 1].train_to == day(270) and got["A", 2].train_to == day(320) and got["A", 1].enough
    assert got["B", 1].train_to is None and not got["B", 1].enough


def case(r, n=500):
    returns = [("A", day(i), float(x)) for i, x in enumerate(r.normal(0.003, 0.01, n))] + [("A", day(3, 1), None)]
    trades = []
    for i in range(400):
        a = int(r.integers(0, n - 5))
        trades.append(("A", day(a), day(a + int(r.integers(0, 30))) if r.random() < 0.95 else None, float(r.normal())))
    return returns, trades


def test_fold_metrics_against_pandas(spark):
    returns, trades = case(np.random.default_rng(3))
    bounds = spark.createDataFrame([("A", day(0), day(250), day(499))], "asset string, start timestamp, split timestamp, end timestamp")
    f = folds.time_folds(bounds, ["asset"], 3, DAY, holding_seconds=20 * DAY)
    rs = spark.createDataFrame(returns, "asset string, ts timestamp, ret double").repartition(4)
    ts = spark.createDataFrame(trades, "asset string, entry_ts timestamp, exit_ts timestamp, pnl double")
    got = {(x.fold, x.part): x for x in folds.fold_metrics(rs, ts, f, ["asset"], DAY).collect()}
    assert len(got) == 6
    for row in f.collect():
        for part in ("train", "test"):
            lo, hi = row[f"{part}_from"], row[f"{part}_to"]
            own = [x for _, t, x in returns if x is not None and lo < t <= hi]
            p, _, low, dd = plain_curve(own)
            g = got[row.fold, part]
            np.testing.assert_allclose([g.periods, g.net_return, g.max_drawdown, g.sharpe], [len(own), p - 1, dd, np.mean(own) / np.std(own, ddof=1) * 252**0.5], rtol=1e-9)
            begun = [(e, x) for _, b, e, x in trades if lo <= b < hi]
            whole = [x for e, x in begun if e is not None and e <= hi]
            assert (g.trades, g.purged) == (len(whole), len(begun) - len(whole)) and abs(g.expectancy - np.mean(whole)) < 1e-12


def test_verdicts_in_time(spark):
    returns, trades = case(np.random.default_rng(4))
    rows = returns + [("B", t, -x if x is not None else None) for _, t, x in returns] + [("C", t, x) for _, t, x in returns[:40]]
    rs = spark.createDataFrame(rows, "asset string, ts timestamp, ret double")
    ts = spark.createDataFrame(trades + [("B", *t[1:]) for t in trades], "asset string, entry_ts timestamp, exit_ts timestamp, pnl double")
    bounds = spark.createDataFrame([(a, day(0), day(250), day(499)) for a in "ABD"] + [("C", day(0), day(20), day(40))], "asset string, start timestamp, split timestamp, end timestamp")
    f = folds.time_folds(bounds, ["asset"], 3, DAY, holding_seconds=20 * DAY)
    got = {r.asset: r for r in folds.walk_forward_in_time(rs, ts, f, ["asset"], DAY, 3).collect()}
    assert got["A"].status == "PASSED" and got["A"].passing_folds == 3 and got["B"].status == "FAILED" and got["B"].passing_folds == 0
    assert got["C"].status == "INSUFFICIENT_DATA" and got["C"].trades is None and got["D"].status == "FAILED"


def test_walk_forward_by_rows(spark):
    """The verdict from fold metrics, with the joined curve cut by position."""
    make = lambda part, fold, ok: ("A", fold, part, False, 0.1 if ok else -0.1, 1.0, 0.05, 0.0, 40)
    m = spark.createDataFrame([make(p, f, f != 2) for f in (1, 2, 3) for p in ("train", "test")], "asset string, fold int, part string, bankrupt boolean, net_return double, sharpe double, max_drawdown double, intrabar_drawdown double, trades long")
    r = spark.createDataFrame([("A", i, 0.01 if i % 3 else -0.01) for i in range(60)], "asset string, rn long, ret double")
    got = evidence.walk_forward(m, r, ["asset"], 3).first()
    p, _, _, dd = plain_curve([0.01 if i % 3 else -0.01 for i in range(60)])
    assert got.passing_folds == 2 and got.passed and abs(got.net_return - (p - 1)) < 1e-12 and abs(got.max_drawdown - dd) < 1e-12


@pytest.mark.parametrize("ruined", [False, True])
def test_metrics_of_given_tables(spark, ruined):
    """Against a plain walk over the calendar: long silences, a mark on a boundary, several marks of one time."""
    from quotelake.operators import metrics

    r = np.random.default_rng(2)
    minutes = np.sort(r.choice(6000, 150, replace=False)).tolist()
    minutes = [m for m in minutes if not 2000 < m < 4000] + [4020, 4080, 4080, 6100]
    value = (1000 + r.normal(0, 15, len(minutes)).cumsum()).tolist()
    if ruined:
        value[20] = -5.0
    stamp = lambda m: (pd.Timestamp("2024-01-01 00:30") + pd.Timedelta(minutes=m)).to_pydatetime()
    rows = sorted((stamp(m), i, v) for i, (m, v) in enumerate(zip(minutes, value)))
    start, end = stamp(0), stamp(6001)
    equity = spark.createDataFrame([("A", *x) for x in rows], "asset string, ts timestamp, seq long, equity double").repartition(3)
    trades = spark.createDataFrame([("A", stamp(60), stamp(120), 2.0, 10.0, 12.0, 4.0), ("A", stamp(200), stamp(260), 1.0, 10.0, 9.0, -1.0)],
                                   "asset string, entry_ts timestamp, exit_ts timestamp, quantity double, entry_price double, exit_price double, pnl double")
    bounds = spark.createDataFrame([("A", start, end, 1000.0), ("B", start, end, 500.0)], "asset string, start timestamp, end timestamp, capital double")
    got = {x.asset: x for x in metrics.table_metrics(equity, trades, bounds, ["asset"], 3600, order=("ts", "seq")).collect()}
    own = [x for x in rows if start <= x[0] < end]
    grid = pd.date_range(pd.Timestamp(start).floor("1h") + pd.Timedelta(hours=1), pd.Timestamp(end).ceil("1h"), freq="1h")
    curve = np.array([1000.0] + [next((v for t, _, v in reversed(own) if t < g), 1000.0) for g in grid])
    ret = np.diff(curve) / np.maximum(curve[:-1], 1e-12)
    marks = np.r_[1000.0, [v for *_, v in own]]
    a = got["A"]
    np.testing.assert_allclose([a.final_equity, a.sharpe, a.max_drawdown], [own[-1][2], ret.mean() / ret.std(ddof=1) * 252**0.5, (1 - marks / np.maximum.accumulate(marks)).max()], rtol=1e-9)
    assert a.bankrupt == ruined and (a.trades, a.profit_factor, a.expectancy, a.hit_rate) == (2, 4.0, 1.5, 0.5)
    np.testing.assert_allclose([a.exposure, a.turnover], [7200 / (6001 * 60), (2 * 22 + 19) / 1000])
    b = got["B"]
    assert (b.final_equity, b.net_return, b.sharpe, b.trades, b.bankrupt, b.profit_factor, b.no_losing_trades) == (500.0, 0.0, 0.0, 0, False, None, False)
