"""Named signal families as rule features over open, high, low, close."""

from __future__ import annotations

import inspect

from . import ta
from .ta import Feature


def _rsi(c, fast, slow, threshold):
    move = ta.change(c, 1)
    gain = ta.sma(ta.clip_low(move, 0.0), fast)
    loss = ta.sma(-ta.clip_high(move, 0.0), fast)
    return (100 * gain / (gain + loss) < 50 - 10 * threshold) & (c > ta.sma(c, slow))


# The entry condition of each family over the close; a rule names the parameters it depends on.
RULES = {
    "trend": lambda c, fast, slow: ta.sma(c, fast) > ta.sma(c, slow),
    "mean_reversion": lambda c, slow, threshold: (c - ta.sma(c, slow)) / ta.std(c, slow) < -threshold,
    "breakout": lambda c, slow: c > ta.lag(ta.highest(ta.number("high"), slow), 1),
    "momentum": lambda c, slow, threshold: ta.pct(c, slow) > threshold / 100,
    "dip": lambda c, fast, slow: (c > ta.sma(c, slow)) & (c < ta.sma(c, fast)),
    "ema_trend": lambda c, fast, slow: ta.ema(c, fast) > ta.ema(c, slow),
    "rsi_reversion": _rsi,
    "volatility_breakout": lambda c, slow, threshold: c > ta.sma(c, slow) + threshold * ta.std(c, slow),
}
FAMILIES = tuple(RULES)


def reads(name: str) -> frozenset[str]:
    """The parameters a family depends on."""
    return frozenset(inspect.signature(RULES[name]).parameters) - {"c"}


def family(name: str, fast: int, slow: int, threshold: float = 1.0) -> Feature:
    """The entry condition of a family; three-valued, wrap in ``ta.signal`` at the end."""
    if name not in RULES:
        raise ValueError(f"unknown signal family {name!r}")
    given = {"fast": fast, "slow": slow, "threshold": threshold}
    return RULES[name](ta.number("close"), **{p: given[p] for p in reads(name)})


def regime(name: str, fast: int, slow: int) -> Feature:
    c = ta.number("close")
    if name == "uptrend":
        return c > ta.sma(c, slow)
    if name == "low_volatility":
        r = ta.pct(c, 1)
        return ta.lag(ta.std(r, fast), 1) < ta.lag(ta.std(r, slow), 1)
    raise ValueError(f"unknown regime {name!r}")


def strong_close() -> Feature:
    c, high, low = ta.number("close"), ta.number("high"), ta.number("low")
    return (c - low) / (high - low) >= 0.75


def entry(name: str, fast: int, slow: int, threshold: float = 1.0, regime_name: str = "none",
          confirmation: str = "none") -> Feature:
    """Family, regime and confirmation together; its complement is the family's exit."""
    rule = family(name, fast, slow, threshold)
    if regime_name != "none":
        rule = rule & regime(regime_name, fast, slow)
    if confirmation == "strong_close":
        rule = rule & strong_close()
    return ta.signal(rule)
