"""Small tables typed by hand."""

from __future__ import annotations

import pandas as pd

from quotelake.operators import ledger as lg
from quotelake.operators import quote_ledger as ql
from quotelake.plans import backtest


def times(n, step="1D", start="2020-01-01"):
    return [t.to_pydatetime() for t in pd.date_range(start, periods=n, freq=step)]


def at(t):
    return pd.Timestamp(t).to_pydatetime()


def bars_of(spark, prices, step="1D", entry=None, opens=None, **extra):
    n = len(prices)
    pdf = pd.DataFrame({"asset": "X", "ts": times(n, step), "open": opens or prices, "high": [p * 1.001 for p in prices], "low": [p * 0.999 for p in prices], "close": prices})
    pdf[["open", "close"]] = pdf[["open", "close"]].astype(float)
    pdf["entry"] = True if entry is None else entry
    for k, v in extra.items():
        pdf[k] = v
    return spark.createDataFrame(pdf)


FREE = {"capital": 1000.0, "allocation": 1.0, "commission_rate": 0.0, "fixed_commission": 0.0, "spread_bps": 0.0, "slippage_bps": 0.0, "min_notional": 0.0,
        "quantity_step": 1e-6, "stop_loss": 1.0, "take_profit": 1e9, "max_holding": 100000}


def bar_run(spark, bars, **params):
    delay = params.pop("delay", 0)
    return backtest.run(backtest.positioned(bars, ["asset"]), ["asset"], {**FREE, **params}, delay=delay)


def quote_rows(name, quotes, entry, stamps=None):
    n = len(quotes)
    return pd.DataFrame({"asset": name, "ts": stamps or times(n, "1s"), "sequence": range(n), "bid": [float(b) for b, _ in quotes], "ask": [float(a) for _, a in quotes],
                         "entry": [i in entry for i in range(n)], "exit": False, "decision": True})


def quote_run(spark, cases, **terms):
    """Run several small quote histories at once; ``cases``: name -> (quotes, entries, times)."""
    pdf = pd.concat([quote_rows(n, *c) for n, c in cases.items()], ignore_index=True)
    t = ql.Terms(**{**dict(stop_loss=5.0, take_profit=10.0, order_ttl_ms=10_000, target_limit=True, max_holding=100_000, capital=1000.0, allocation=0.5, min_notional=0.0, quantity_step=1.0), **terms})
    _, book, marks = ql.run_quotes(spark.createDataFrame(pdf), ["asset"], t)
    return book, marks.toPandas().sort_values(["asset", "rn"]).groupby("asset").value.last()
