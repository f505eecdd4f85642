"""Trailing-window rule functions over an ordered series.

A :class:`Feature` is a Column recipe that also knows how many earlier rows it reads. That
count gives both the warm-up of a rule and the halo its blocks need. Functions only look
back, so no feature can read the future.

    fast, slow = ta.sma(ta.col("close"), 5), ta.sma(ta.col("close"), 20)
    out = ta.evaluate(bars, {"fast": fast, "entry": ta.signal(fast > slow)}, ["asset"], ["ts"])
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..operators import blocks
from ..session import stage
from . import order_stats
from .guards import finite, ratio

#: Windows up to this long are summed up row by row; longer ones are put together from two parts, in constant work per row.
DIRECT = 32


class Stage:
    """The rows a set of features is being added to; windowed results become columns."""

    def __init__(self, blocked: blocks.Blocked, built: dict[int, str] | None = None):
        self.blocked, self.df = blocked, blocked.df
        self.w = blocked.window()
        self._built: dict[int, Column] = {k: F.col(name) for k, name in (built or {}).items()}
        self._count, self._place = 0, None

    def trailing(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def past(self):
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    def running(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def pin(self, c: Column) -> Column:
        return F.col(self.named(c))

    def named(self, c: Column) -> str:
        name = self.fresh()
        self.df = self.df.withColumn(name, c)
        return name

    def fresh(self) -> str:
        self._count += 1
        return f"_f{self._count}"

    def place(self) -> str:
        """The column with a row's number in its block, from 0."""
        if self._place is None:
            self._place = self.named(F.row_number().over(self.w) - 1)
        return self._place

    def parts(self, n: int, /, **aggregates: Column) -> tuple[dict[str, Column], dict[str, Column]]:
        """The aggregates over a trailing window of n rows, in two parts that do not overlap.

        Rows are dealt into stretches of n. A window ends in one stretch and begins in the one before it, so it is what the first has seen up to
        here and what the other has yet to see from there on. Both run along once; nothing is taken away again, so sums do not cancel.
        """
        place, group = self.place(), self.blocked.group
        stretch = self.pin(F.floor(F.col(place) / n))
        part = Window.partitionBy(*group, stretch)
        along, back = (part.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(place).asc(), F.col(place).desc()))
        here = {k: self.pin(c.over(along)) for k, c in aggregates.items()}
        left = {k: self.pin(c.over(back)) for k, c in aggregates.items()}
        whole = F.pmod(F.col(place), F.lit(n)) == n - 1
        series = Window.partitionBy(*group).orderBy(place)
        return here, {k: self.pin(F.when(~whole, F.lag(c, n - 1).over(series))) for k, c in left.items()}

    def operand(self, f: Feature) -> Column:
        """A feature as a plain column, so that a window can be taken over it."""
        return self.value(f) if f.windowed else f.make(self)

    def value(self, f: Feature) -> Column:
        if not f.windowed:
            return f.make(self)
        if id(f) not in self._built:
            self._built[id(f)] = self.pin(f.make(self))
        return self._built[id(f)]


class Feature:
    def __init__(self, make: Callable[[Stage], Column], lookback: int = 0, windowed: bool = False, whole: tuple[Feature, ...] = ()):
        """``whole``: the features in this one that depend on all earlier rows, inner ones first."""
        self.make, self.lookback, self.windowed, self.whole = make, lookback, windowed, whole

    def _with(self, other, op, guard=True) -> Feature:
        other = of(other)

        def make(s: Stage) -> Column:
            c = op(_value(s, self), _value(s, other))
            return finite(c) if guard else c

        return Feature(make, max(self.lookback, other.lookback), self.windowed or other.windowed, self.whole + other.whole)

    def _compare(self, other, op) -> Feature:
        """Missing where either side is NaN or infinite."""
        sound = lambda c: finite(c.cast("double")).isNotNull()
        return self._with(other, lambda a, b: F.when(sound(a) & sound(b), op(a, b)), guard=False)

    def _map(self, op) -> Feature:
        return Feature(lambda s: op(_value(s, self)), self.lookback, self.windowed, self.whole)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __radd__(self, o):
        return of(o) + self

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return of(o) - self

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return of(o) * self

    def __truediv__(self, o):
        return self._with(o, ratio)

    def __rtruediv__(self, o):
        return of(o) / self

    def __neg__(self):
        return self._map(lambda c: -c)

    def __pos__(self):
        return self

    def __gt__(self, o):
        return self._compare(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._compare(o, lambda a, b: a >= b)

    def __lt__(self, o):
        return self._compare(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._compare(o, lambda a, b: a <= b)

    def __eq__(self, o):  # noqa: D105 - a comparison node, as on Column
        return self._compare(o, lambda a, b: a == b)

    def __ne__(self, o):
        return self._compare(o, lambda a, b: a != b)

    __hash__ = object.__hash__

    def __and__(self, o):
        return self._with(o, lambda a, b: a & b, guard=False)

    def __or__(self, o):
        return self._with(o, lambda a, b: a | b, guard=False)

    def __invert__(self):
        return self._map(lambda c: ~c)


def _value(s: Stage | None, f: Feature) -> Column:
    return s.value(f) if f.windowed else f.make(s)


def of(x) -> Feature:
    if isinstance(x, Feature):
        return x
    if isinstance(x, Column):
        return Feature(lambda s: x)
    return Feature(lambda s: F.lit(float(x)) if not isinstance(x, bool) else F.lit(x))


def col(name: str) -> Feature:
    """A field of the frame; the analyzer rejects a name that is absent."""
    return Feature(lambda s: F.col(name))


def number(name: str) -> Feature:
    """A numeric field with NaN and infinity read as missing."""
    return Feature(lambda s: finite(F.col(name).cast("double")))


def _window(x: Feature, n: int, extra: int, make: Callable[[Stage, Column], Column], least: int = 1) -> Feature:
    if not isinstance(n, int) or n < least:
        raise ValueError(f"a window holds at least {least} rows, got {n!r}")
    x = of(x)
    return Feature(lambda s: make(s, s.operand(x)), x.lookback + extra, windowed=True, whole=x.whole)


def lag(x, n: int) -> Feature:
    return _window(x, n, n, lambda s, c: F.lag(c, n).over(s.w))


def change(x, n: int) -> Feature:
    return _window(x, n, n, lambda s, c: c - F.lag(c, n).over(s.w))


def pct(x, n: int) -> Feature:
    return _window(x, n, n, lambda s, c: finite(ratio(c, F.lag(c, n).over(s.w)) - 1))


def _full(s: Stage, c: Column, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(s.trailing(n)) == n, value)


def _seen(here: dict[str, Column], left: dict[str, Column]) -> Column:
    return here["n"] + F.coalesce(left["n"], F.lit(0))


def _aggregate(agg: Callable[[Column], Column], merge: Callable[[Column, Column, int], Column]):
    """``merge`` puts the results of two parts together; the second one may be missing."""

    def feature(x, n: int) -> Feature:
        def make(s: Stage, c: Column) -> Column:
            if n <= DIRECT:
                return _full(s, c, n, agg(c).over(s.trailing(n)))
            here, left = s.parts(n, n=F.count(c), v=(F.sum if agg is F.avg else agg)(c))
            return F.when(_seen(here, left) == n, merge(here["v"], left["v"], n))

        return _window(x, n, n - 1, make)

    return feature


sma = _aggregate(F.avg, lambda a, b, n: (a + F.coalesce(b, F.lit(0.0))) / n)
total = _aggregate(F.sum, lambda a, b, n: a + F.coalesce(b, F.lit(0)))
lowest = _aggregate(F.min, lambda a, b, n: F.least(a, b))
highest = _aggregate(F.max, lambda a, b, n: F.greatest(a, b))


def _co_moment(here: dict[str, Column], left: dict[str, Column], x: str, y: str, own: str) -> Column:
    """Sum of products of deviations over both parts, from each part's own."""
    n, m = here["n"], left["n"]
    apart = (here[x] - left[x]) * (here[y] - left[y]) * (n * m / (n + m))
    return here[own] * n + F.when(m > 0, left[own] * m + apart).otherwise(F.lit(0.0))


def _deviation(values: Column) -> Column:
    """Sample deviation of an array, by Welford's update in its order.

    The step is the textbook's, d * (x - mean after x): Spark's own aggregate takes another one, and where a window holds nothing but one price
    written in two ways (100.2849 and the next double) the two differ by more than the deviation itself.
    """

    def step(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1, x - a["mean"]
        mean = a["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + d * (x - mean)).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, zero, step, lambda a: F.sqrt(a["m2"] / (a["n"] - 1)))


def std(x, n: int) -> Feature:
    """Sample deviation; missing for a window of one."""
    if n == 1:
        return Feature(lambda s: F.lit(None).cast("double"), of(x).lookback, windowed=False)

    def make(s: Stage, c: Column) -> Column:
        if n <= DIRECT:
            held = s.pin(F.collect_list(c.cast("double")).over(s.trailing(n)))
            return F.when(F.size(held) == n, _deviation(held))
        here, left = s.parts(n, n=F.count(c), mean=F.avg(c), v=F.var_pop(c), low=F.min(c), high=F.max(c))
        left = {**left, "n": F.coalesce(left["n"], F.lit(0))}
        flat = F.least(here["low"], left["low"]) == F.greatest(here["high"], left["high"])
        return F.when(_seen(here, left) == n, F.when(flat, F.lit(0.0)).otherwise(F.sqrt(_co_moment(here, left, "mean", "mean", "v") / (n - 1))))

    return _window(x, n, n - 1, make)


def _ordered(x, n: int, q: float | None) -> Feature:
    """A rank (no ``q``) or quantile of the trailing window, found for a whole block at once (:mod:`order_stats`)."""

    def make(s: Stage, c: Column) -> Column:
        value, place, name = s.named(c.cast("double")), s.place(), s.fresh()
        kinds = StructType([StructField(f.name, f.dataType) for f in s.df.schema] + [StructField(name, DoubleType())])
        # groups are the blocks the windows run in, so nothing is shuffled again
        s.df = s.df.groupBy(*s.blocked.group).applyInArrow(order_stats.grouped(value, place, n, {name: q}), kinds)
        return F.col(name)

    return _window(x, n, n - 1, make)


def rank(x, n: int) -> Feature:
    """Average-tie rank of the current value in its window, as a fraction of n."""
    return _ordered(x, n, None)


def quantile(x, n: int, q: float) -> Feature:
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies in [0, 1]")
    return _ordered(x, n, float(q))


def corr(x, y, n: int) -> Feature:
    x, y = of(x), of(y)

    def make(s: Stage) -> Column:
        a, b = s.operand(x), s.operand(y)
        both = a.isNotNull() & b.isNotNull()
        a, b = s.pin(F.when(both, a)), s.pin(F.when(both, b))
        if n <= DIRECT:
            t = s.trailing(n)
            spread = F.stddev_samp(a).over(t) * F.stddev_samp(b).over(t)
            flat = (F.min(a).over(t) == F.max(a).over(t)) | (F.min(b).over(t) == F.max(b).over(t))
            value = ratio(F.covar_samp(a, b).over(t), spread)
            return F.when((F.count(a).over(t) == n) & ~flat, finite(value))
        here, left = s.parts(
            n, n=F.count(a), a=F.avg(a), b=F.avg(b), aa=F.var_pop(a), bb=F.var_pop(b), ab=F.covar_pop(a, b), la=F.min(a), ha=F.max(a), lb=F.min(b), hb=F.max(b))
        left = {**left, "n": F.coalesce(left["n"], F.lit(0))}
        ends = lambda low, high: F.least(here[low], left[low]) == F.greatest(here[high], left[high])
        spread = F.sqrt(_co_moment(here, left, "a", "a", "aa")) * F.sqrt(_co_moment(here, left, "b", "b", "bb"))
        return F.when((_seen(here, left) == n) & ~ends("la", "ha") & ~ends("lb", "hb"), finite(ratio(_co_moment(here, left, "a", "b", "ab"), spread)))

    if not isinstance(n, int) or n < 2:
        raise ValueError("a correlation needs at least two rows")
    return Feature(make, max(x.lookback, y.lookback) + n - 1, windowed=True, whole=x.whole + y.whole)


# Weighted running sums restart after this much decay, so exp() stays finite; what is further back weighs less than exp(-300).
EMA_DECAY = 300.0


def _decayed(term: Column, depth: Column, rows: list[str], order: list[Column]) -> Column:
    """Sum over rows so far of term * exp(-(decay since that row)), for a running ``depth`` of decay."""
    stretch = F.floor(depth / EMA_DECAY)
    within = depth - stretch * EMA_DECAY
    here = Window.partitionBy(*rows, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*rows).orderBy(stretch).rangeBetween(-1, -1)
    grown = term * F.exp(within)
    return F.sum(grown).over(here) * F.exp(-within) + F.coalesce(F.sum(grown).over(prior), F.lit(0.0)) * F.exp(-within - EMA_DECAY)


class Ema(Feature):
    """An exponential mean. It depends on all earlier rows, so :func:`evaluate` makes it a plain column before anything else."""

    def __init__(self, x: Feature, n: int):
        super().__init__(self._not_yet, x.lookback + n - 1, windowed=True)
        self.x, self.n, self.whole = x, n, (*x.whole, self)

    @staticmethod
    def _not_yet(s: Stage) -> Column:
        raise ValueError("an exponential mean needs evaluate()")


def ema(x, n: int) -> Feature:
    """Exponential mean of span n, seeded by the first value, missing before n values.

    A value moves the mean m to a*m + b*x, with a = q^g / (q^g + alpha) after a gap of g rows. Such moves compose, so a
    block is one move from its start to its end: the rows of a block are summed by themselves, the blocks' moves are joined in a
    table with one row per block, and each row adds what its block began with. Every earlier row counts, wherever blocks are cut.
    """
    if not isinstance(n, int) or n < 1:
        raise ValueError("a span holds at least one row")
    return Ema(of(x), n)


def _means(s: Stage, emas: list[Ema]) -> list[Column]:
    """The columns of several means at once: the rows are written once and joined with two tables of one row per block."""
    group, keys, own = s.blocked.group, list(s.blocked.keys), F.col(blocks.OWN)
    order = [F.col(o) for o in s.blocked.order]
    value = [s.pin(F.when(own, s.operand(e.x))) for e in emas]
    p = s.pin(F.min(F.when(own, F.col(blocks.BASE))).over(Window.partitionBy(*group)) + F.count(F.when(own, 1)).over(s.running()) - 1)
    s.df = stage(s.df)
    at = [F.when(c.isNotNull(), p) for c in value]
    summaries, merge = {}, {}
    for i, c in enumerate(value):
        summaries |= {f"_en{i}": F.count(c), f"_ep{i}": F.max(at[i]), f"_ev{i}": F.max_by(c, at[i])}
        merge |= {f"_en{i}": "sum", f"_ep{i}": "last", f"_ev{i}": "last"}
    s.df = blocks.carried(blocks.Blocked(s.df, s.blocked.keys, s.blocked.order), summaries, merge)
    depth, mine, moved = [], [], []
    for i, (e, c) in enumerate(zip(emas, value, strict=True)):
        alpha = 2.0 / (e.n + 1)
        before = s.pin(F.coalesce(F.last(at[i], ignorenulls=True).over(s.past()), F.col(f"_ep{i}")))
        first = before.isNull()
        fade = math.log(1 - alpha) if e.n > 1 else 0.0
        kept = F.exp((p - before) * fade) if e.n > 1 else F.lit(0.0)
        decay = s.pin(F.when(c.isNull() | first, 0.0).otherwise(F.ln(kept + alpha) - (p - before) * fade) if e.n > 1 else F.lit(0.0))
        depth.append(s.pin(F.sum(decay).over(s.running())))
        term = s.pin(F.coalesce(F.when(first, 1.0).otherwise(alpha / (kept + alpha)) * c, F.lit(0.0)))
        mine.append(s.pin(_decayed(term, depth[i], group, order)))
        moved += [F.sum(decay).alias(f"_d{i}"), F.max_by(mine[i], p).alias(f"_v{i}")]
    moves, along = s.df.where(own).groupBy(*group).agg(*moved), Window.partitionBy(*keys).orderBy(blocks.BLOCK)
    for i in range(len(emas)):
        moves = moves.withColumn(f"_depth{i}", F.sum(f"_d{i}").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        moves = moves.withColumn(f"_m{i}", _decayed(F.col(f"_v{i}"), F.col(f"_depth{i}"), keys, [F.col(blocks.BLOCK)]))
    s.df = blocks.null_safe_join(s.df, moves.select(*group, *[F.lag(f"_m{i}").over(along).alias(f"_start{i}") for i in range(len(emas))]), group, "left")
    out = []
    for i, (e, c) in enumerate(zip(emas, value, strict=True)):
        if e.n == 1:
            out.append(F.coalesce(F.last(c, ignorenulls=True).over(s.running()), F.col(f"_ev{i}")))
            continue
        seen = F.coalesce(F.col(f"_en{i}"), F.lit(0)) + F.count(c).over(s.running())
        mean = mine[i] + F.coalesce(F.col(f"_start{i}"), F.lit(0.0)) * F.exp(-depth[i])
        out.append(F.when(seen >= e.n, finite(mean)))
    return out


def absolute(x) -> Feature:
    return of(x)._map(F.abs)


def log(x) -> Feature:
    return of(x)._map(lambda c: F.when(c > 0, F.ln(c)))


def sqrt(x) -> Feature:
    return of(x)._map(lambda c: F.when(c >= 0, F.sqrt(c)))


def where(cond: Feature, a, b) -> Feature:
    a, b = of(a), of(b)

    def make(s: Stage) -> Column:
        k = _value(s, cond)
        return F.when(k, _value(s, a)).when(~k, _value(s, b))

    return Feature(make, max(cond.lookback, a.lookback, b.lookback), cond.windowed or a.windowed or b.windowed, cond.whole + a.whole + b.whole)


def clip_low(x, low: float) -> Feature:
    return of(x)._map(lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(low))))


def clip_high(x, high: float) -> Feature:
    return of(x)._map(lambda c: F.when(c.isNotNull(), F.least(c, F.lit(high))))


def signal(cond: Feature) -> Feature:
    """A rule's final answer: missing means no."""
    return cond._map(lambda c: F.coalesce(c, F.lit(False)))


def warmup(*features: Feature) -> int:
    return max((f.lookback for f in features), default=0)


def evaluate(
    df: DataFrame,
    features: dict[str, Feature],
    keys: list[str],
    order: list[str],
    block_rows: int = blocks.BLOCK_ROWS,
    position: str | None = None,
) -> DataFrame:
    """Add the features as columns, block by block; row-wise features need no blocks.

    ``position`` names a gapless position column, if the rows have one (``blocks.with_row_number``).
    """
    if not any(f.windowed for f in features.values()):
        return df.withColumns({n: f.make(None) for n, f in features.items()})
    columns, built = df.columns, {}
    waiting = list({id(f): f for g in features.values() for f in g.whole}.values())
    while waiting:
        # What depends on all earlier rows becomes a plain column first; then others may look back at it from any block.
        ready = [f for f in waiting if all(id(g) in built for g in f.whole[:-1])]
        b = blocks.split(df, keys, order, warmup(*ready), block_rows=block_rows, position=position)
        s = Stage(b, built)
        names = {id(f): f"_whole{len(built) + i}" for i, f in enumerate(ready)}
        made = dict(zip(names.values(), _means(s, ready), strict=True))
        df = b.own(s.df.withColumns(made).select(*b.df.columns, *made))
        built |= names
        waiting = [f for f in waiting if id(f) not in built]
    b = blocks.split(df, keys, order, warmup(*features.values()), block_rows=block_rows, position=position)
    s = Stage(b, built)
    made = {n: s.value(f) for n, f in features.items()}
    return b.own(s.df.withColumns(made).select(*b.df.columns, *features)).select(*columns, *features)
