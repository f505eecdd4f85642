"""From signals to trades, equity and costs, as sets.

Where a position ends depends only on where it began, never on cash. So every eligible
entry finds its exit in parallel (as-of joins and a bounded search), and what is left to do
in order is a walk over entry candidates: skip those inside an open trade, size the next
one, carry the cash. That walk streams through sorted partitions with a constant-size
state per run; no run is ever gathered in memory.

Runs are told apart by ``keys``: the asset and any scenario columns (rule, variant, cost
multiplier, segment). Parameters may be columns of the table, per run or per bar, or
entries of ``params``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.guards import micros
from . import asof, blocks

# Default costs and limits of a run.
DEFAULTS = {
    "capital": 10000.0, "allocation": 0.9, "commission_rate": 0.001, "fixed_commission": 0.0,
    "spread_bps": 5.0, "slippage_bps": 5.0, "min_notional": 5.0, "quantity_step": 1e-5,
    "holding_cost_bps": 0.0, "quote_side": 0, "cost_multiplier": 1.0, "direction": 1,
    "stop_loss": 0.1, "take_profit": 0.2, "max_holding": 20,
}


def param(df: DataFrame, params: dict, name: str) -> Column:
    if name in df.columns:
        return F.col(name)
    value = params.get(name, DEFAULTS[name])
    return value if isinstance(value, Column) else F.lit(value)


def execution_price(df: DataFrame, params: dict, side: Column, at: str = "open") -> Column:
    """What an order on ``side`` (+1 buys) pays at the bar's open or close.

    With observed bid/ask columns the half spread around the mid is scaled; otherwise the
    assumed spread falls on the side the quotes do not already contain.
    """
    p = lambda n: param(df, params, n)
    m, slip = p("cost_multiplier"), p("slippage_bps") / 10000
    if f"bid_{at}" in df.columns:
        bid, ask = F.col(f"bid_{at}"), F.col(f"ask_{at}")
        mid = (bid + ask) / 2
        return mid + side * ((ask - bid) / 2 * m + mid * slip * m)
    s, quoted = p("spread_bps"), p("quote_side")
    paid = ((side > 0) & (quoted == 1)) | ((side < 0) & (quoted == 2))
    free = ((side > 0) & (quoted == 2)) | ((side < 0) & (quoted == 1))
    portion = F.when(paid, s).when(free, F.lit(0.0)).otherwise(s / 2)
    return F.col(at) * (1 + side * (portion + p("slippage_bps")) / 10000 * m)


def execution_rows(bars: DataFrame, keys: list[str], params: dict, delay: int = 0,
                   block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Bars with the decision each one acts on, its fills, and running carry.

    Input columns: ts, rn (position), open, close, entry, and optionally exit (default: not entry),
    decision (default: every bar) and signal_price (default: close). A decision at bar t is
    acted on at the open of t + 1 + delay; stops look at the previous bar's signal price.
    """
    if "decision" not in bars.columns:
        bars = bars.withColumn("decision", F.lit(True))
    if "exit" not in bars.columns:
        bars = bars.withColumn("exit", ~F.col("entry"))
    if "signal_price" not in bars.columns:
        bars = bars.withColumn("signal_price", F.col("close"))
    b = blocks.split(bars, keys, ["ts"], 1 + delay, block_rows=block_rows, position="rn")
    w = b.window()
    no = F.lit(False)
    p = lambda n: param(bars, params, n)
    days = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 86_400e6
    step = F.lag("close").over(w) * p("holding_cost_bps") / 10000 * p("cost_multiplier") * days
    own = F.col(blocks.OWN)
    shifted = b.df.withColumns({
        "entry_now": F.coalesce(F.lag("entry", 1 + delay).over(w), no),
        "exit_now": F.coalesce(F.lag("exit", 1 + delay).over(w), no),
        "acts": F.coalesce(F.lag("decision", 1 + delay).over(w), no),
        "decided": F.when(own & F.lag("decision").over(w), 1).otherwise(0).cast("long"),
        "seen_price": F.lag("signal_price").over(w),
        "_carry_step": F.when(own, F.coalesce(step, F.lit(0.0))).otherwise(F.lit(0.0)),
    })
    # Running totals cross blocks through the per-block sums.
    s = blocks.Blocked(shifted, b.keys, b.order)
    rows = blocks.carried(s, {"_d0": F.sum("decided"), "_c0": F.sum("_carry_step")}, {"_d0": "sum", "_c0": "sum"})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    side = p("direction")
    return b.own(rows.withColumns({
        "age": F.coalesce("_d0", F.lit(0)) + F.sum("decided").over(run),
        "carry": F.coalesce("_c0", F.lit(0.0)) + F.sum("_carry_step").over(run),
        "buy": execution_price(bars, params, side),
        "sell": execution_price(bars, params, -side),
        "sell_close": execution_price(bars, params, -side, "close"),
    })).drop("_d0", "_c0", "_carry_step")


def candidates(rows: DataFrame) -> DataFrame:
    """Bars at whose open a position could be opened."""
    return rows.filter(F.col("entry_now") & ~F.col("exit_now"))


#: Holding limits beyond this are no useful bound of a search; the longest stretch of rows is looked up instead.
LOOKED_UP = 1 << 16


def exit_scan(rows: DataFrame, keys: list[str], params: dict, max_holding: int, bucket: int = 16,
              entries: DataFrame | None = None) -> DataFrame:
    """Each candidate entry with the row its position ends on, found independently.

    It ends at the open of the first later bar that acts on an exit signal, whose previous
    signal price is beyond the stop or target, or at which ``max_holding`` decisions have
    passed (a column of that name sets it per run); else at the close of the last bar.
    """
    e = candidates(rows) if entries is None else entries
    p = lambda n: param(rows, params, n)
    side = p("direction")
    up, down = 1 + p("take_profit"), 1 - p("stop_loss")
    e = e.select(
        *keys, "rn", "ts", "age", F.col("buy").alias("entry_price"), F.col("carry").alias("entry_carry"),
        (F.col("max_holding") if "max_holding" in rows.columns else F.lit(max_holding)).cast("long").alias("hold"),
        F.when(side > 0, F.col("buy") * down).otherwise(F.col("buy") * (1 - p("take_profit"))).alias("lower"),
        F.when(side > 0, F.col("buy") * up).otherwise(F.col("buy") * (1 + p("stop_loss"))).alias("upper"),
    )
    # Decisions are numbered, so the search for a stop and the holding limit are bounded.
    marks = rows.filter("decided = 1").select(*keys, F.col("age").alias("_age"), F.col("rn").alias("_row"), F.col("seen_price"))
    ages = rows.groupBy(*keys).agg(F.max("age").alias("_last"))
    probe = e.join(ages, keys).select(*keys, F.col("age").alias("from"), F.least(F.col("age") + F.col("hold"), F.greatest("_last", "age")).alias("to"), "lower", "upper").distinct()
    touch = asof.first_touch(probe, marks.withColumn("rn", F.col("_age")), keys, low="seen_price", high="seen_price",
                             bucket=bucket, span=max_holding if max_holding <= LOOKED_UP else None)
    by_age = e.join(
        touch.select(*keys, F.col("from").alias("age"), "lower", "upper", "at"), [*keys, "age", "lower", "upper"], "left"
    ).withColumn("_age", F.coalesce("at", F.col("age") + F.col("hold")))
    by_age = by_age.join(marks.select(*keys, "_age", "_row"), [*keys, "_age"], "left").drop("_age", "at")
    by_signal = asof.asof(
        by_age, rows.filter("acts AND exit_now").select(*keys, "rn"), keys, "rn", "rn", ["rn"],
        forward=True, strict=True, positions=True, prefix="signal_",
    )
    last = rows.groupBy(*keys).agg(F.max("rn").alias("_end"))
    ended = by_signal.join(last, keys).withColumn("_exit", F.least("_row", "signal_rn"))
    ended = ended.withColumn("exit_row", F.coalesce("_exit", "_end")).withColumn("exit_at_close", F.col("_exit").isNull())
    return ended.select(*keys, "rn", "ts", "entry_price", "entry_carry", "exit_row", "exit_at_close")


def priced_candidates(rows: DataFrame, keys: list[str], params: dict, max_holding: int, bucket: int = 16) -> DataFrame:
    """Candidates with everything the ledger walk needs."""
    scan = exit_scan(rows, keys, params, max_holding, bucket)
    names = ("capital", "allocation", "commission_rate", "fixed_commission", "min_notional", "quantity_step", "cost_multiplier", "direction")
    out = rows.select(
        *keys, F.col("rn").alias("exit_row"), F.col("ts").alias("exit_ts"), "sell", "sell_close", F.col("carry").alias("exit_carry"),
        *[param(rows, params, n).cast("double").alias(f"p_{n}") for n in names],
    )
    j = scan.join(out, [*keys, "exit_row"])
    return j.select(
        *keys, "rn", "ts", "entry_price", "exit_row", "exit_ts", "exit_at_close", "entry_carry",
        F.when(F.col("exit_at_close"), F.col("sell_close")).otherwise(F.col("sell")).alias("exit_price"),
        (F.col("exit_carry") - F.col("entry_carry")).alias("unit_carry"), *[f"p_{n}" for n in names],
    )


TRADE_FIELDS = (
    ("kind", T.StringType()), ("entry_row", T.LongType()), ("exit_row", T.LongType()), ("entry_ts", T.TimestampType()),
    ("exit_ts", T.TimestampType()), ("direction", T.DoubleType()), ("quantity", T.DoubleType()),
    ("entry_price", T.DoubleType()), ("exit_price", T.DoubleType()), ("pnl", T.DoubleType()),
    ("exit_at_close", T.BooleanType()), ("entry_carry", T.DoubleType()), ("cash_open", T.DoubleType()),
    ("cash_after", T.DoubleType()), ("capital", T.DoubleType()),
)


def _walk(keys: list[str]):
    columns = [*keys, *[n for n, _ in TRADE_FIELDS]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cash, busy_until = None, 0.0, -1
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != current:
                    current, cash, busy_until = key, r.p_capital, -1
                if r.rn <= busy_until or cash <= 0:
                    continue
                rate, fixed = r.p_commission_rate * r.p_cost_multiplier, r.p_fixed_commission * r.p_cost_multiplier
                units = max(0.0, (cash * r.p_allocation - fixed) / (r.entry_price * (1 + rate)))
                qty = math.floor(units / r.p_quantity_step) * r.p_quantity_step
                if not (qty > 0 and qty * r.entry_price >= r.p_min_notional):
                    out.append((*key, "skipped", r.rn, r.rn, r.ts, r.ts, r.p_direction, 0.0, r.entry_price, r.entry_price,
                                0.0, False, r.entry_carry, cash, cash, r.p_capital))
                    continue
                fee = qty * r.entry_price * rate + fixed
                opened = cash - r.p_direction * qty * r.entry_price - fee
                held, gross = qty * r.unit_carry, qty * r.exit_price
                leave = gross * rate + fixed
                cash = opened - held + r.p_direction * gross - leave
                pnl = r.p_direction * qty * (r.exit_price - r.entry_price) - fee - held - leave
                busy_until = r.exit_row
                out.append((*key, "trade", r.rn, r.exit_row, r.ts, r.exit_ts, r.p_direction, qty, r.entry_price, r.exit_price,
                            pnl, r.exit_at_close, r.entry_carry, opened, cash, r.p_capital))
            if out:
                yield pd.DataFrame(out, columns=columns)

    return walk


def trade_ledger(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Trades and skipped orders of each run, from its candidates in order."""
    schema = T.StructType([cands.schema[k] for k in keys] + [T.StructField(n, t) for n, t in TRADE_FIELDS])
    ordered = cands.repartition(*keys).sortWithinPartitions(*keys, "rn")
    return ordered.mapInPandas(_walk(keys), schema)


def equity_marks(rows: DataFrame, ledger: DataFrame, keys: list[str], params: dict) -> DataFrame:
    """Equity of every bar, and the worst value inside bars while holding.

    A run whose equity falls to zero or below is closed at that bar's close and ends there.
    """
    trades = ledger.filter("kind = 'trade'")
    fields = ["entry_row", "exit_row", "quantity", "direction", "exit_at_close", "entry_carry", "cash_open", "cash_after"]
    cols = [c for c in ("high", "low") if c in rows.columns]
    bars = rows.select(*keys, "rn", "ts", "close", "carry", "sell_close", *cols, param(rows, params, "capital").cast("double").alias("capital"),
                       (param(rows, params, "commission_rate") * param(rows, params, "cost_multiplier")).alias("_rate"),
                       (param(rows, params, "fixed_commission") * param(rows, params, "cost_multiplier")).alias("_fixed"))
    m = asof.asof(bars, trades, keys, "rn", "entry_row", fields, positions=True, prefix="t_")
    before_exit = F.col("rn") < F.col("t_exit_row")
    closing = F.col("t_exit_at_close") & (F.col("rn") == F.col("t_exit_row"))
    held = F.coalesce(before_exit | closing, F.lit(False))
    cash = F.col("t_cash_open") - F.col("t_quantity") * (F.col("carry") - F.col("t_entry_carry"))
    stock = F.col("t_direction") * F.col("t_quantity")
    mark = F.when(F.col("t_entry_row").isNull(), F.col("capital")).when(held, cash + stock * F.col("close")).otherwise(F.col("t_cash_after"))
    adverse = F.when(F.col("t_direction") > 0, F.col("low")).otherwise(F.col("high")) if len(cols) == 2 else F.col("close")
    gross = F.col("t_quantity") * F.col("sell_close")
    out = m.select(
        *keys, "rn", "ts", "capital", held.alias("held"), mark.alias("_mark"),
        F.when(closing, F.col("t_cash_after")).otherwise(mark).alias("equity"),
        F.when(held, cash + stock * adverse).alias("worst"),
        F.when(held, cash + F.col("t_direction") * gross - gross * F.col("_rate") - F.col("_fixed")).alias("_liquid"),
        F.when(held, F.col("t_entry_row")).alias("trade_row"),
    )
    ruin = out.filter(F.col("_mark") <= 0).groupBy(*keys).agg(F.min("rn").alias("_ruin"))
    out = out.join(ruin, keys, "left").filter(F.col("_ruin").isNull() | (F.col("rn") <= F.col("_ruin")))
    broke = F.col("rn") == F.col("_ruin")
    value = F.when(broke & F.col("held"), F.col("_liquid")).otherwise(F.col("equity"))
    return out.withColumn("equity", value).withColumn("ruined", F.coalesce(broke, F.lit(False))).drop("_ruin", "_mark", "_liquid")


def settle_ruin(ledger: DataFrame, marks: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger cut at the bar a run was ruined on; the open trade closes at that close."""
    at = marks.filter("ruined").select(*keys, F.col("rn").alias("_ruin"), F.col("ts").alias("_ruin_ts"), F.col("equity").alias("_left"))
    price = rows.select(*keys, F.col("rn").alias("_ruin"), F.col("sell_close").alias("_price"))
    at = at.join(price, [*keys, "_ruin"])
    j = ledger.join(at, keys, "left")
    j = j.filter(F.col("_ruin").isNull() | (F.col("entry_row") <= F.col("_ruin")))
    cut = (F.col("kind") == "trade") & F.col("_ruin").isNotNull() & (
        (F.col("exit_row") > F.col("_ruin")) | (F.col("exit_at_close") & (F.col("exit_row") == F.col("_ruin")))
    )
    cut = F.coalesce(cut, F.lit(False))
    return j.withColumns({
        # Cash before the trade plus its result is what is left.
        "pnl": F.when(cut, F.col("_left") - (F.col("cash_after") - F.col("pnl"))).otherwise(F.col("pnl")),
        "exit_price": F.when(cut, F.col("_price")).otherwise(F.col("exit_price")),
        "exit_row": F.when(cut, F.col("_ruin")).otherwise(F.col("exit_row")),
        "exit_ts": F.when(cut, F.col("_ruin_ts")).otherwise(F.col("exit_ts")),
        "exit_at_close": F.when(cut, F.lit(True)).otherwise(F.col("exit_at_close")),
        "cash_after": F.when(cut, F.col("_left")).otherwise(F.col("cash_after")),
    }).drop("_ruin", "_ruin_ts", "_left", "_price")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """The same table with the signal always on, for a passive run without stops."""
    return bars.withColumn("entry", F.lit(True)).withColumn("exit", F.lit(False))
