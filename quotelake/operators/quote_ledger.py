"""Orders on bid/ask quotes: fills after latency, brackets, time limits, ledger, equity.

Every submit candidate finds its whole course (cancel or fill, first trigger, exit) by
as-of joins and a bounded search on row positions, independent of cash. Candidates are few
beside quotes: they come from closed signal bars. A streaming walk then drops candidates
inside an open order or position and carries the cash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.guards import micros
from ..session import stage
from . import asof, blocks
from .resample import signal_bars, stressed_quotes


@dataclass(frozen=True)
class Terms:
    """How orders are executed and what they cost."""

    direction: int = 1
    latency_ms: int = 0
    signal_delay_ms: int = 0
    order_ttl_ms: int = 60_000
    entry_limit_offset: float | None = None  # None: market entry
    target_limit: bool = False
    distance_unit: str = "price"  # price, percent or pips
    pip_size: float = 0.0001
    stop_loss: float = 1.0
    take_profit: float = 1.0
    max_holding: int = 86_400_000
    holding_unit: str = "milliseconds"  # or events: number of decisions
    protected: bool = True  # False: no stop, target or time limit
    capital: float = 10000.0
    allocation: float = 0.9
    commission_rate: float = 0.0
    fixed_commission: float = 0.0
    slippage_bps: float = 0.0
    holding_cost_bps: float = 0.0
    min_notional: float = 5.0
    quantity_step: float = 0.001
    cost_multiplier: float = 1.0

    def distance(self, price: Column, value: float) -> Column:
        if self.distance_unit == "percent":
            return price * value
        return F.lit(value * self.pip_size if self.distance_unit == "pips" else float(value))

    @property
    def slip(self) -> float:
        return self.slippage_bps * self.cost_multiplier / 10000

    @property
    def rate(self) -> float:
        return self.commission_rate * self.cost_multiplier

    @property
    def fixed(self) -> float:
        return self.fixed_commission * self.cost_multiplier


#: Rows that share an entry of the tables by which a time or a position is looked up.
LOOKUP_ROWS = 4096


def _chapter(position: str = "rn") -> Column:
    return F.floor(F.col(position) / LOOKUP_ROWS).alias("_chapter")


def chapter_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last time in each stretch of ``LOOKUP_ROWS`` positions. Written."""
    return stage(rows.groupBy(*keys, _chapter()).agg(F.max("ts").alias("_until")))


def _first_at(probes: DataFrame, rows: DataFrame, ends: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Position of the first row at or after a time, for few times beside rows.

    The times are placed among the ends of stretches of positions; then only the rows of those stretches are looked at, and no row is moved unless
    the times are too many to broadcast.
    """
    probes = stage(probes)
    times = probes.filter(F.col(at).isNotNull()).select(*keys, at).distinct()
    placed = stage(asof.asof(times, ends, keys, at, "_until", ["_chapter"], forward=True, right_order="_chapter").filter("_chapter IS NOT NULL"))
    seen = blocks.null_safe_join(rows.select(*keys, "rn", "ts", _chapter()), placed, [*keys, "_chapter"], "inner").filter(F.col("ts") >= F.col(at))
    return blocks.null_safe_join(probes, seen.groupBy(*keys, at).agg(F.min("rn").alias(name)), [*keys, at], "left")


def place_decisions(quotes: DataFrame, decided: DataFrame, seconds: int) -> DataFrame:
    """Give each closed bar's decision to the first quote at or after its close.

    ``decided``: asset, ts (bar start), entry, exit. The latest bar wins a shared quote. Quotes that have their position are not moved.
    """
    closes = decided.withColumn("closes", F.timestamp_micros(micros(F.col("ts")) + seconds * 1_000_000))
    if blocks.POSITION in quotes.columns:
        found = stage(_first_at(closes, quotes, chapter_ends(quotes, ["asset"]), ["asset"], "closes", "q_rn"))
        hit = quotes.select("asset", F.col("rn").alias("q_rn"), F.col("ts").alias("q_ts"), F.col("sequence").alias("q_sequence")).join(found, ["asset", "q_rn"])
    else:
        hit = asof.asof(closes, quotes, ["asset"], "closes", "ts", ["ts", "sequence"], forward=True, right_order="sequence", prefix="q_")
    latest = stage(hit.filter("q_ts IS NOT NULL").groupBy("asset", F.col("q_ts").alias("ts"), F.col("q_sequence").alias("sequence")).agg(
        F.max_by(F.struct("entry", "exit"), "closes").alias("_d")))
    j = quotes.join(latest, ["asset", "ts", "sequence"], "left")
    return j.select(*quotes.columns, F.coalesce("_d.entry", F.lit(False)).alias("entry"), F.coalesce("_d.exit", F.lit(False)).alias("exit"), F.col("_d").isNotNull().alias("decision"))


def quote_rows(quotes: DataFrame, keys: list[str], t: Terms) -> DataFrame:
    """Quotes with position, stressed sides, fills of both directions and running carry."""
    if blocks.POSITION not in quotes.columns:
        quotes = stage(blocks.with_row_number(quotes, keys, ["ts", "sequence"]))
    q = stressed_quotes(quotes, t.cost_multiplier)
    b = blocks.split(q, keys, ["ts", "sequence"], 1, position=blocks.POSITION)
    w = b.window()
    days = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 86_400e6
    own = F.col(blocks.OWN)
    step = F.when(own, F.coalesce(F.lag("mid").over(w) * t.holding_cost_bps / 10000 * t.cost_multiplier * days, F.lit(0.0))).otherwise(0.0)
    s = blocks.Blocked(b.df.withColumn("_step", step).withColumn("_one", F.when(own & F.col("decision"), 1).otherwise(0).cast("long")), b.keys, b.order)
    rows = blocks.carried(s, {"_c": F.sum("_step"), "_a": F.sum("_one")}, {"_c": "sum", "_a": "sum"})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    buy, sell = F.col("stressed_ask") * (1 + t.slip), F.col("stressed_bid") * (1 - t.slip)
    long = t.direction > 0
    return b.own(rows.withColumns({
        "carry": F.coalesce("_c", F.lit(0.0)) + F.sum("_step").over(run),
        "age": F.coalesce("_a", F.lit(0)) + F.sum("_one").over(run),
        "open_price": buy if long else sell,
        "close_price": sell if long else buy,
        "liquid": F.col("stressed_bid") if long else F.col("stressed_ask"),
    })).drop("_c", "_a", "_step", "_one")


def _look(cands: DataFrame, rows: DataFrame, keys: list[str], at: str, fields: dict[str, str]) -> DataFrame:
    """Fetch columns of the row at a position."""
    r = rows.select(*keys, F.col("rn").alias(at), *[F.col(c).alias(n) for n, c in fields.items()])
    return cands.join(r, [*keys, at], "left")


def order_courses(rows: DataFrame, keys: list[str], t: Terms, bucket: int = 16) -> DataFrame:
    """The full course of each submit candidate, as if it were free to act.

    outcome: filled, cancelled or pending; then trigger, reason and exit of a filled one.
    """
    ms = lambda c, n: F.timestamp_micros(micros(F.col(c)) + int(n) * 1000)
    later = lambda c, i: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.col(i) + 1))
    last, ends = rows.groupBy(*keys).agg(F.max("rn").alias("end")), chapter_ends(rows, keys)
    c = rows.filter("entry AND NOT exit").select(*keys, F.col("rn").alias("submit"), F.col("ts").alias("submit_ts"), "open_price", "stressed_bid", "stressed_ask")
    exits = rows.filter("exit").select(*keys, "rn")
    when = F.explode(F.array(F.struct(F.lit("ready").alias("kind"), ms("submit_ts", t.latency_ms + t.signal_delay_ms).alias("at")),
                             F.struct(F.lit("expires").alias("kind"), ms("submit_ts", t.order_ttl_ms).alias("at"))))
    probes = c.select(*keys, "submit", when.alias("w")).select(*keys, "submit", "w.*")
    found = _first_at(probes, rows, ends, keys, "at", "k").withColumn("k", later("k", "submit")).groupBy(*keys, "submit").pivot("kind", ["ready", "expires"]).agg(F.first("k"))
    c = c.join(found, [*keys, "submit"], "left")
    c = asof.asof(c, exits, keys, "submit", "rn", ["rn"], forward=True, strict=True, positions=True, prefix="next_exit_")
    c = c.join(last, keys).withColumn("cancel", F.least("expires", "next_exit_rn"))
    if t.entry_limit_offset is None:
        c = c.withColumn("limit", F.lit(None).cast("double")).withColumn("fill", F.col("ready"))
    else:
        ref = F.col("stressed_ask") if t.direction > 0 else F.col("stressed_bid")
        c = stage(c.withColumn("limit", ref - t.direction * t.distance(ref, t.entry_limit_offset)))
        span = c.filter("ready IS NOT NULL").select(
            *keys, (F.col("ready") - 1).alias("from"), F.coalesce(F.col("cancel") - 1, F.col("end")).alias("to"),
            (F.col("limit") if t.direction > 0 else F.lit(None).cast("double")).alias("lower"), (F.col("limit") if t.direction < 0 else F.lit(None).cast("double")).alias("upper"))
        hit = asof.first_touch(span.filter("to > from").distinct(), rows, keys, low="open_price", high="open_price", bucket=bucket)
        hit = hit.select(*keys, (F.col("from") + 1).alias("ready"), F.coalesce("lower", "upper").alias("limit"), F.col("at").alias("fill")).groupBy(*keys, "ready", "limit").agg(F.min("fill").alias("fill"))
        c = c.join(hit, [*keys, "ready", "limit"], "left")
    gone = F.col("cancel").isNotNull() & (F.col("fill").isNull() | (F.col("cancel") <= F.col("fill")))
    c = c.withColumn("outcome", F.when(gone, F.lit("cancelled")).when(F.col("fill").isNull(), F.lit("pending")).otherwise(F.lit("filled")))
    c = stage(c.select(*keys, "submit", "submit_ts", "limit", "cancel", "fill", "outcome", "end", "expires"))
    f = c.filter("outcome = 'filled'").select(*keys, "submit", "fill", "end")
    f = _look(f, rows, keys, "fill", {"fill_ts": "ts", "entry_price": "open_price", "fill_age": "age", "entry_carry": "carry"})
    if t.protected:
        f = f.withColumn("stop", F.col("entry_price") - t.direction * t.distance(F.col("entry_price"), t.stop_loss))
        f = f.withColumn("target", F.col("entry_price") + t.direction * t.distance(F.col("entry_price"), t.take_profit))
        if t.holding_unit == "milliseconds":
            f = _first_at(f.withColumn("_due", ms("fill_ts", t.max_holding)), rows, ends, keys, "_due", "timed").drop("_due")
        else:
            aged = rows.filter("decision").select(*keys, F.col("age").alias("_age"), F.col("rn").alias("timed"))
            f = f.withColumn("_age", F.col("fill_age") + t.max_holding).join(aged, [*keys, "_age"], "left").drop("_age")
        f = asof.asof(f, exits, keys, "fill", "rn", ["rn"], forward=True, positions=True, prefix="signal_")
        f = stage(f.withColumn("bound", F.least("timed", "signal_rn", "end")))
        up = t.direction > 0
        span = f.select(*keys, (F.col("fill") - 1).alias("from"), F.col("bound").alias("to"), F.col("stop" if up else "target").alias("lower"), F.col("target" if up else "stop").alias("upper"))
        gain = "close_price" if t.target_limit else "liquid"
        low, high = ("liquid", gain) if up else (gain, "liquid")
        touch = asof.first_touch(span.distinct(), rows, keys, low=low, high=high, bucket=bucket)
        touch = touch.select(*keys, (F.col("from") + 1).alias("fill"), F.col("to").alias("bound"), F.col("lower").alias("_lo"), F.col("upper").alias("_up"), F.col("at").alias("guard"))
        f = f.withColumn("_lo", F.col("stop" if up else "target")).withColumn("_up", F.col("target" if up else "stop"))
        f = f.join(touch, [*keys, "fill", "bound", "_lo", "_up"], "left").drop("_lo", "_up")
        f = _look(f, rows, keys, "guard", {"guard_liquid": "liquid"})
        stopped = t.direction * (F.col("guard_liquid") - F.col("stop")) <= 0
        reason = F.when(F.col("guard").isNotNull(), F.when(stopped, F.lit("stop")).otherwise(F.lit("target_limit" if t.target_limit else "target")))
        other = F.least("signal_rn", "timed")
        f = f.withColumn("trigger", F.coalesce("guard", other))
        f = f.withColumn("reason", F.coalesce(reason, F.when(F.col("signal_rn") == other, F.lit("condition")).when(other.isNotNull(), F.lit("max_holding"))))
    else:
        f = asof.asof(f, exits, keys, "fill", "rn", ["rn"], forward=True, positions=True, prefix="signal_")
        none = F.lit(None).cast("double")
        f = f.withColumns({"stop": none, "target": none, "trigger": F.col("signal_rn"), "reason": F.when(F.col("signal_rn").isNotNull(), F.lit("condition"))})
    f = _look(f, rows, keys, "trigger", {"trigger_ts": "ts", "trigger_exit": "exit"})
    wait = F.lit(t.latency_ms) + F.when((F.col("reason").isin("condition", "max_holding")) & F.col("trigger_exit"), t.signal_delay_ms).otherwise(0)
    f = stage(f.withColumn("_ready", F.timestamp_micros(micros(F.col("trigger_ts")) + wait.cast("long") * 1000)))
    # Rows without a trigger have no time to look from; they end with the segment.
    timed = _first_at(f.filter("trigger IS NOT NULL").select(*keys, "submit", "trigger", "_ready"), rows, ends, keys, "_ready", "_x")
    timed = timed.withColumn("_x", later("_x", "trigger")).select(*keys, "submit", "_x")
    f = f.join(timed, [*keys, "submit"], "left")
    at_once = F.col("reason") == "target_limit"
    x = F.when(at_once, F.col("trigger")).otherwise(F.col("_x"))
    # A trigger on the last event finds no later one: greatest(...) may pass the end.
    x = F.when(x <= F.col("end"), x)
    f = f.withColumn("exit_at", F.coalesce(x, F.col("end"))).withColumn("exit_reason", F.when(x.isNull(), F.lit("segment_end")).otherwise(F.col("reason")))
    f = _look(f, rows, keys, "exit_at", {"exit_ts": "ts", "exit_price": "close_price", "exit_carry": "carry", "exit_sequence": "sequence"})
    f = _look(f, rows, keys, "fill", {"entry_sequence": "sequence"})
    keep = ["fill_ts", "entry_price", "stop", "target", "trigger", "reason", "exit_at", "exit_ts", "exit_price", "exit_reason", "entry_carry", "exit_carry", "entry_sequence", "exit_sequence"]
    return c.join(f.select(*keys, "submit", *keep), [*keys, "submit"], "left")


ACTIVE_FIELDS = (
    ("result", T.StringType()), ("submit", T.LongType()), ("submit_ts", T.TimestampType()), ("limit", T.DoubleType()), ("cancel", T.LongType()), ("cancel_reason", T.StringType()),
    ("fill", T.LongType()), ("fill_ts", T.TimestampType()), ("entry_sequence", T.LongType()), ("entry_price", T.DoubleType()), ("quantity", T.DoubleType()),
    ("stop", T.DoubleType()), ("target", T.DoubleType()), ("trigger", T.LongType()), ("reason", T.StringType()), ("exit_at", T.LongType()), ("exit_ts", T.TimestampType()),
    ("exit_sequence", T.LongType()), ("exit_price", T.DoubleType()), ("exit_reason", T.StringType()), ("pnl", T.DoubleType()), ("entry_carry", T.DoubleType()),
    ("cash_open", T.DoubleType()), ("cash_after", T.DoubleType()), ("end", T.LongType()),
)


def _walk(keys: list[str], t: Terms):
    columns = [*keys, *[n for n, _ in ACTIVE_FIELDS]]

    def whole(v):
        return None if v is None or v != v else int(v)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cash, busy = None, 0.0, -1
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != current:
                    current, cash, busy = key, t.capital, -1
                if r.submit <= busy or cash <= 0:
                    continue
                row = dict.fromkeys(columns)
                row.update(zip(keys, key))
                row.update(submit=r.submit, submit_ts=r.submit_ts, limit=r.limit, end=r.end, cash_open=cash, cash_after=cash)
                if r.outcome == "pending":
                    row.update(result="pending")
                    busy = r.end
                elif r.outcome == "cancelled":
                    why = "expired" if r.expires == r.expires and r.expires is not None and r.cancel == r.expires else "exit_signal"
                    row.update(result="cancelled", cancel=whole(r.cancel), cancel_reason=why)
                    busy = int(r.cancel)
                else:
                    row.update(fill=whole(r.fill), fill_ts=r.fill_ts, entry_sequence=whole(r.entry_sequence), entry_price=r.entry_price)
                    units = math.floor(max(0.0, (cash * t.allocation - t.fixed) / (r.entry_price * (1 + t.rate))) / t.quantity_step) * t.quantity_step
                    if units > 0 and units * r.entry_price >= t.min_notional:
                        fee = units * r.entry_price * t.rate + t.fixed
                        opened = cash - (t.direction * units * r.entry_price + fee)
                        held, gross = units * (r.exit_carry - r.entry_carry), units * r.exit_price
                        leave = gross * t.rate + t.fixed
                        cash = opened - held + t.direction * gross - leave
                        pnl = t.direction * units * (r.exit_price - r.entry_price) - fee - held - leave
                        row.update(result="trade", quantity=units, stop=r.stop, target=r.target, trigger=whole(r.trigger), reason=r.reason, exit_at=whole(r.exit_at), exit_ts=r.exit_ts,
                                   exit_sequence=whole(r.exit_sequence), exit_price=r.exit_price, exit_reason=r.exit_reason, pnl=pnl, entry_carry=r.entry_carry, cash_open=opened, cash_after=cash)
                        busy = int(r.exit_at)
                    else:
                        row.update(result="rejected")
                        busy = int(r.fill)
                out.append(tuple(row[c] for c in columns))
            if out:
                made = pd.DataFrame(out, columns=columns)
                for n, kind in ACTIVE_FIELDS:
                    if isinstance(kind, T.LongType):
                        made[n] = made[n].astype("Int64")
                    elif isinstance(kind, T.DoubleType):
                        made[n] = made[n].astype("float64")
                    elif isinstance(kind, T.TimestampType):
                        made[n] = pd.to_datetime(made[n])
                yield made

    return walk


def order_book(courses: DataFrame, keys: list[str], t: Terms) -> DataFrame:
    """The candidates that really act, in order, with sizes and cash."""
    schema = T.StructType([courses.schema[k] for k in keys] + [T.StructField(n, k) for n, k in ACTIVE_FIELDS])
    return courses.repartition(*keys).sortWithinPartitions(*keys, "submit").mapInPandas(_walk(keys, t), schema)


def order_events(book: DataFrame, keys: list[str]) -> DataFrame:
    """Six kinds of events per order, each at the position it happened."""
    c = F.col
    e = lambda cond, kind, at, why=F.lit(None).cast("string"), price=F.lit(None).cast("double"): F.when(
        cond, F.struct(F.lit(kind).alias("event"), c(at).alias("position"), why.alias("reason"), price.alias("price")))
    trade, res = c("result") == "trade", c("result")
    made = F.array_compact(F.array(
        e(F.lit(True), "entry_submit", "submit", price=c("limit")),
        e(res == "cancelled", "entry_cancel", "cancel", c("cancel_reason")),
        e(res == "pending", "entry_cancel", "end", F.lit("segment_end")),
        e(res == "rejected", "entry_rejected", "fill", F.lit("capital_or_minimum")),
        e(trade, "entry_fill", "fill", price=c("entry_price")),
        e(trade & c("trigger").isNotNull() & (c("reason") != "target_limit"), "exit_trigger", "trigger", c("reason")),
        e(trade, "exit_fill", "exit_at", c("exit_reason"), c("exit_price")),
    ))
    return book.select(*keys, "submit", F.explode(made).alias("e")).select(*keys, "submit", "e.*")


def _in_force(rows: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the last trade filled at or before it: a trade is laid out over the stretches of positions up to the next one's fill."""
    fields = ["fill", "exit_at", "quantity", "entry_carry", "cash_open", "cash_after"]
    until = F.coalesce(F.lead("fill").over(Window.partitionBy(*keys).orderBy("fill")) - 1, "end")
    spans = trades.select(*keys, *[F.col(c).alias(f"t_{c}") for c in fields], until.alias("_until"))
    spans = stage(spans.withColumn("_chapter", F.explode(F.sequence(F.floor(F.col("t_fill") / LOOKUP_ROWS), F.floor(F.col("_until") / LOOKUP_ROWS)))))
    names = {c: f"_on_{c}" for c in [*keys, "_chapter"]}
    own = rows.withColumn("_chapter", _chapter())
    r = spans.withColumnsRenamed(names)
    same = F.col("rn").between(F.col("t_fill"), F.col("_until"))
    for c, o in names.items():
        same = same & own[c].eqNullSafe(r[o])
    return own.join(r, same, "left").drop(*names.values(), "_chapter", "_until")


def liquidation_marks(rows: DataFrame, book: DataFrame, keys: list[str], t: Terms) -> DataFrame:
    """Value of the run at every quote if the position were closed there, costs included."""
    m = _in_force(rows.select(*keys, "rn", "ts", "sequence", "close_price", "carry"), book.filter("result = 'trade'"), keys)
    gross = F.col("t_quantity") * F.col("close_price")
    held = F.col("rn") < F.col("t_exit_at")
    value = F.col("t_cash_open") - F.col("t_quantity") * (F.col("carry") - F.col("t_entry_carry")) + t.direction * gross - gross * t.rate - t.fixed
    mark = F.when(F.col("t_fill").isNull(), F.lit(t.capital)).when(held, value).otherwise(F.col("t_cash_after"))
    out = m.select(*keys, "rn", "ts", "sequence", F.coalesce(held, F.lit(False)).alias("held"), mark.alias("value"))
    ruin = out.filter("value <= 0").groupBy(*keys).agg(F.min("rn").alias("_ruin"))
    return out.join(ruin, keys, "left").filter(F.col("_ruin").isNull() | (F.col("rn") <= F.col("_ruin"))).withColumn(
        "ruined", F.coalesce(F.col("rn") == F.col("_ruin"), F.lit(False))).drop("_ruin")


def settle_ruin(book: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The order book cut at the quote where a run's liquidation value is gone."""
    at = marks.filter("ruined").select(*keys, F.col("rn").alias("_ruin"), F.col("ts").alias("_rts"), F.col("sequence").alias("_rseq"), F.col("value").alias("_left"))
    j = book.join(at, keys, "left").filter(F.col("_ruin").isNull() | (F.col("submit") <= F.col("_ruin")))
    cut = F.coalesce((F.col("result") == "trade") & (F.col("exit_at") > F.col("_ruin")) & (F.col("fill") <= F.col("_ruin")), F.lit(False))
    new = {
        "pnl": F.col("_left") - (F.col("cash_after") - F.col("pnl")), "exit_at": F.col("_ruin"), "exit_ts": F.col("_rts"), "exit_sequence": F.col("_rseq"),
        "exit_reason": F.lit("insolvency"), "cash_after": F.col("_left"),
    }
    return j.withColumns({n: F.when(cut, v).otherwise(F.col(n)) for n, v in new.items()}).drop("_ruin", "_rts", "_rseq", "_left")


def run_quotes(quotes: DataFrame, keys: list[str], t: Terms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, order book and liquidation marks of quotes with entry, exit and decision."""
    rows = stage(quote_rows(quotes, keys, t))
    book = stage(order_book(order_courses(rows, keys, t), keys, t))
    marks = stage(liquidation_marks(rows, book, keys, t))
    if not marks.filter("ruined").isEmpty():
        book = settle_ruin(book, marks, keys)
    return rows, book, marks


def signal_quotes(quotes: DataFrame, seconds: int, side: str, rule) -> DataFrame:
    """Quotes with the decisions of a rule on their closed bars; ``rule`` maps bars to bars with entry and exit.

    Quotes are written once with their position, bars and decisions once each: all later
    steps read those.
    """
    placed = stage(blocks.with_row_number(quotes, ["asset"], ["ts", "sequence"]))
    decided = stage(rule(stage(signal_bars(placed, seconds, side))).select("asset", "ts", "entry", "exit"))
    return stage(place_decisions(placed, decided, seconds))
