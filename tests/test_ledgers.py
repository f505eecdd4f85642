"""Hand-computed trades on bars and quotes, and a random comparison with a plain walk."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import FREE, at, bar_run, bars_of, quote_run, times
from quotelake.operators import evidence as ev
from quotelake.operators import ledger as lg
from quotelake.operators import quote_ledger as ql


def final(run):
    return run.metrics().collect()[0]


def test_short_profit(spark):
    m = final(bar_run(spark, bars_of(spark, [100, 100, 90, 80]), direction=-1))
    assert (round(m.final_equity, 6), m.trades) == (1200, 1)


def test_short_stop_fills_at_the_gap(spark):
    r = bar_run(spark, bars_of(spark, [100, 100, 120, 150]), direction=-1, stop_loss=0.1)
    assert r.ledger.collect()[0].exit_price == 150
    assert round(final(r).final_equity, 6) == 500


@pytest.mark.parametrize("side", [1, -1])
def test_round_trip_costs(spark, side):
    m = final(bar_run(spark, bars_of(spark, [100, 100, 100]), direction=side, allocation=0.9, commission_rate=0.01, fixed_commission=1.0, quantity_step=1.0))
    assert round(m.final_equity, 6) == 982 and round(m.expectancy, 6) == -18


def test_carry_follows_the_calendar(spark):
    m = final(bar_run(spark, bars_of(spark, [100] * 25, "1h"), holding_cost_bps=24.0))
    assert abs(m.final_equity - (1000 - 23 * 0.1)) < 1e-6


def test_signal_of_five_minutes_on_one_minute_bars(spark):
    b = bars_of(spark, [100.0] * 12, "1min").withColumn("decision", F.minute("ts").isin(4, 9)).withColumn("entry", F.col("decision")).withColumn("exit", F.lit(False))
    b = b.withColumn("signal_price", F.when(F.col("decision"), F.col("close")))
    assert bar_run(spark, b).ledger.collect()[0].entry_row == 5


def test_holding_is_counted_in_decisions(spark):
    b = bars_of(spark, [100.0] * 20, "1min").withColumn("decision", F.minute("ts") % 5 == 4).withColumn("entry", F.minute("ts") == 4).withColumn("exit", F.lit(False))
    t = bar_run(spark, b, max_holding=2).ledger.collect()[0]
    assert (t.entry_row, t.exit_row, t.exit_at_close) == (5, 15, False)


def test_intrabar_loss_that_recovers(spark):
    b = bars_of(spark, [100, 100, 100, 100]).withColumn("low", F.when(F.dayofmonth("ts") == 3, 50.0).otherwise(F.col("low")))
    m = final(bar_run(spark, b))
    assert m.max_drawdown == 0 and abs(m.intrabar_drawdown - 0.5) < 1e-9


def test_ruin_ends_the_run(spark):
    r = bar_run(spark, bars_of(spark, [100, 100, 150, 250, 10, 10]), direction=-1, stop_loss=100.0)
    m, t = final(r), r.ledger.collect()[0]
    assert m.bankrupt and m.bars == 4 and (t.exit_row, t.exit_price) == (3, 250)
    assert abs(m.final_equity - (1000 + t.pnl)) < 1e-6


def test_unaffordable_orders_are_counted(spark):
    m = final(bar_run(spark, bars_of(spark, [100, 100, 100, 100]), quantity_step=1000.0))
    assert (m.trades, m.skipped_orders, m.final_equity) == (0, 3, 1000)


def walk(o, c, entry, exit_, days, p, delay):
    """A plain bar-by-bar walk, for comparison."""
    d, cash, qty, eq, log, skipped = p["direction"], p["capital"], 0.0, [], [], 0
    fr = p["slippage_bps"] / 1e4
    half = p["spread_bps"] / 2 / 1e4
    price = lambda x, s: x * (1 + s * (half + fr))
    for i in range(len(o)):
        j, sold = i - 1 - delay, False
        if qty:
            carry = qty * c[i - 1] * p["holding_cost_bps"] / 1e4 * days
            cash -= carry
            debit += carry
            age += 1
            move = d * (c[i - 1] / ep - 1)
            if (j >= 0 and exit_[j]) or move <= -p["stop_loss"] or move >= p["take_profit"] or age >= p["max_holding"]:
                x = price(o[i], -d)
                fee = qty * x * p["commission_rate"] + p["fixed_commission"]
                cash += d * qty * x - fee
                log.append(d * qty * (x - ep) - debit - fee)
                qty, sold = 0.0, True
        if not qty and not sold and j >= 0 and entry[j] and not exit_[j] and cash > 0:
            x = price(o[i], d)
            n = math.floor(max(0.0, (cash * p["allocation"] - p["fixed_commission"]) / (x * (1 + p["commission_rate"]))) / p["quantity_step"]) * p["quantity_step"]
            if n > 0 and n * x >= p["min_notional"]:
                debit = n * x * p["commission_rate"] + p["fixed_commission"]
                cash -= d * n * x + debit
                qty, ep, age = n, x, 0
            else:
                skipped += 1
        eq.append(cash + d * qty * c[i])
        if eq[-1] <= 0:
            break
    if qty:
        x = price(c[len(eq) - 1], -d)
        fee = qty * x * p["commission_rate"] + p["fixed_commission"]
        cash += d * qty * x - fee
        log.append(d * qty * (x - ep) - debit - fee)
        eq[-1] = cash
    return log, eq, skipped


def test_many_runs_equal_a_plain_walk(spark):
    rng = np.random.default_rng(11)
    frames, plans = [], {}
    for k in range(24):
        n = 60
        c = 100 * np.exp(rng.normal(0, 0.05, n).cumsum())
        o = c * np.exp(rng.normal(0, 0.01, n))
        e, x = rng.random(n) < 0.4, rng.random(n) < 0.2
        p = {"capital": float(rng.choice([150, 1000])), "allocation": float(rng.choice([0.5, 1.0])), "commission_rate": float(rng.choice([0, 0.002])), "fixed_commission": float(rng.choice([0, 1.5])),
             "spread_bps": 10.0, "slippage_bps": 3.0, "min_notional": float(rng.choice([0, 80])), "quantity_step": float(rng.choice([0.01, 1.0])), "holding_cost_bps": float(rng.choice([0, 4])),
             "stop_loss": float(rng.choice([0.05, 0.2])), "take_profit": float(rng.choice([0.06, 0.3])), "max_holding": int(rng.choice([3, 9])), "direction": int(rng.choice([1, -1]))}
        plans[f"r{k:02d}"] = (o, c, e, x, p)
        frames.append(pd.DataFrame({"asset": f"r{k:02d}", "ts": times(n), "open": o, "high": np.maximum(o, c), "low": np.minimum(o, c), "close": c, "entry": e, "exit": x, **{a: b for a, b in p.items()}}))
    from quotelake.plans import backtest

    bars = backtest.positioned(spark.createDataFrame(pd.concat(frames, ignore_index=True)), ["asset"])
    for delay in (0, 2):
        run = backtest.run(bars, ["asset"], {"max_holding": 9}, delay=delay, bucket=4)
        book = run.ledger.toPandas()
        marks = run.marks.toPandas()
        trades = 0
        for name, (o, c, e, x, p) in plans.items():
            log, eq, skipped = walk(o, c, e, x, 1.0, p, delay)
            mine = book[book.asset == name].sort_values("entry_row")
            np.testing.assert_allclose(mine[mine.kind == "trade"].pnl, log, atol=1e-6, err_msg=name)
            assert (mine.kind == "skipped").sum() == skipped, name
            np.testing.assert_allclose(marks[marks.asset == name].sort_values("rn").equity, eq, atol=1e-6, err_msg=name)
            trades += len(log)
        assert trades > 100


# ---- quotes --------------------------------------------------------------------------------

FLAT = [(99, 100), (99, 100)]


def only(book, name="X"):
    t = book[(book.asset == name) & (book.result == "trade")]
    assert len(t) == 1
    return t.iloc[0]


def test_limit_targets_stops_and_event_log(spark):
    sdf, last = quote_run(spark, {"gap": ([*FLAT, (94, 95), (90, 91)], {0, 1}), "better": ([*FLAT, (112, 113), (80, 81)], {0, 1}),
                                  "same": ([*FLAT, (112, 113)], {0, 1}, [at("2020-01-01")] * 3)})
    book = sdf.toPandas()
    t = only(book, "gap")
    assert (t.entry_price, t.exit_price, t.exit_reason, t.quantity) == (100, 90, "stop", 5) and last["gap"] == 950
    t = only(book, "better")
    assert (t.exit_price, t.exit_reason) == (112, "target_limit") and last["better"] == 1060
    assert only(book, "same").entry_sequence == 1  # order follows the sequence within one time
    log = ql.order_events(sdf.filter("asset = 'gap'"), ["asset"]).orderBy("position", "event").collect()
    assert [r.event for r in log] == ["entry_submit", "entry_fill", "exit_trigger", "exit_fill"]


def test_market_target_keeps_its_trigger(spark):
    book, _ = quote_run(spark, {"X": ([*FLAT, (112, 113), (104, 105)], {0, 1})}, target_limit=False)
    t = only(book.toPandas())
    assert (t.exit_price, t.exit_reason) == (104, "target")


def test_short_stop_watches_the_ask(spark):
    book, last = quote_run(spark, {"X": ([(99, 100), (100, 101), (103, 106), (104, 108)], {0})}, direction=-1)
    t = only(book.toPandas())
    assert (t.entry_price, t.exit_price) == (100, 108) and last["X"] == 960


def test_latency_delays_the_fill(spark):
    book, _ = quote_run(spark, {"X": ([(99, 100), (100, 101), (101, 102), (102, 103)], {0})}, latency_ms=1500)
    t = only(book.toPandas())
    assert (t.entry_price, t.entry_sequence) == (102, 2)


def test_limit_entry_waits_or_expires(spark):
    slow = times(3, "6s")
    book, _ = quote_run(spark, {"X": ([*FLAT, (97, 98), (100, 101)], {0, 1}), "late": ([*FLAT, (97, 98)], {0}, slow)}, entry_limit_offset=2.0)
    pdf = book.toPandas()
    assert only(pdf).entry_price == 98
    assert list(pdf[pdf.asset == "late"].cancel_reason) == ["expired"]


def test_slipped_limit_target_is_not_filled_early(spark):
    book, _ = quote_run(spark, {"X": ([*FLAT, (111, 112), (113, 114)], {0, 1})}, slippage_bps=100.0)
    t = only(book.toPandas())
    assert t.exit_sequence == 3 and abs(t.exit_price - 111.87) < 1e-9


def test_commission_and_carry(spark):
    book, last = quote_run(spark, {"X": ([*FLAT, (110, 111)], {0, 1}, times(3))}, commission_rate=0.01, holding_cost_bps=100.0, order_ttl_ms=200_000_000, max_holding=10**9)
    assert abs(last["X"] - 1027.62) < 1e-9 and abs(book.toPandas().pnl.sum() - 27.62) < 1e-9


def test_passive_order_that_expires_makes_no_trade(spark):
    stamps = [at(f"2020-01-01 00:00:{s:02d}") for s in (0, 20, 21, 22, 23)]
    book, _ = quote_run(spark, {"X": ([(99, 100)] * 4 + [(112, 113)], {0}, stamps)}, protected=False)
    assert [r.result for r in book.collect()] == ["cancelled"]
    one = spark.createDataFrame([("X", 0.1, 1.0, 0.0, 3)], "asset string, net_return double, sharpe double, max_drawdown double, trades int")
    assert ev.benchmark_compare(one, one.withColumn("trades", F.lit(0)), ["asset"]).collect()[0].status == "INSUFFICIENT_DATA"


def test_observed_spread_is_stressed_around_the_mid(spark):
    b = bars_of(spark, [100.0]).withColumns({"bid_open": F.lit(99.0), "ask_open": F.lit(101.0)})
    p = {**lg.DEFAULTS, **FREE, "cost_multiplier": 3.0}
    assert b.select(lg.execution_price(b, p, F.lit(1)), lg.execution_price(b, p, F.lit(-1))).collect()[0][:] == (103.0, 97.0)
