"""Joins by time: as-of in both directions, interval overlap, bounded search ahead.

Both sides of an as-of join are put in one ordered series and cut into blocks, so a hot
asset is spread over many tasks. Inside a block the last seen right row is a running
window; what happened before the block arrives from a table with one row per block.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import micros, required
from ..session import stage
from . import blocks

#: Where an interval that has no start or end is put: before and after every time.
ALWAYS = 1 << 62


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, fields: list[str],
    *, forward: bool = False, strict: bool = False, tolerance_seconds: int | None = None,
    right_order: str | None = None, prefix: str = "", positions: bool = False, block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Each left row with the nearest right row at or before it (``forward``: at or after).

    The right row travels whole, so a NULL field stays NULL and is not filled from an older
    row. ``strict`` hides a right row at the very same time. ``right_order`` ranks right
    rows of one time (the latest wins, ``forward``: the earliest). ``positions`` says that
    the two columns are row positions instead of times.
    """
    axis = (lambda c: F.col(c).cast("long")) if positions else (lambda c: micros(F.col(c)))
    sign = -1 if forward else 1
    rank = F.col(right_order) if right_order else F.lit(0)
    lname = "_left"
    payload = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(axis(right_on).alias("_at"), *[F.col(c).alias(f"f_{c}") for c in fields])
    no_left = F.lit(None).cast(left.select(payload.alias("x")).schema["x"].dataType)
    no_right = F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType)
    # A left row without a time or key has no match, but stays.
    one = left.select(
        *keys, (sign * axis(left_on)).alias("_t"), F.lit(0 if strict else 2).alias("_side"), F.lit(0).cast("long").alias("_q"),
        payload.alias(lname), no_right.alias("_right"))
    two = right.filter(F.col(right_on).isNotNull()).select(
        *keys, (sign * axis(right_on)).alias("_t"), F.lit(1).alias("_side"), (sign * rank).cast("long").alias("_q"),
        no_left.alias(lname), found.alias("_right"))
    line, order = one.unionByName(two), ["_t", "_side", "_q"]
    if positions:
        b = blocks.split_dense(line, keys, order, F.col("_t"), block_rows=block_rows)
    else:
        b = blocks.split(line, keys, order, axis=F.col("_t"), block_rows=block_rows)
    when = F.when(F.col("_right").isNotNull(), F.struct("_t", "_q"))
    rows = blocks.carried(b, {"_carry": F.max_by("_right", when)}, {"_carry": "last"})
    here = F.last("_right", ignorenulls=True).over(b.window().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_hit", F.coalesce(here, F.col("_carry"))).filter(F.col(lname).isNotNull())
    if tolerance_seconds is not None:
        near = F.abs(F.col("_t") * sign - F.col("_hit._at")) <= tolerance_seconds * 1_000_000
        rows = rows.withColumn("_hit", F.when(near, F.col("_hit")))
    return rows.select(f"{lname}.*", *[F.col(f"_hit.f_{c}").alias(prefix + c) for c in fields])


def cross_market(bars: DataFrame, sources: list[str], fields: list[str], bar_seconds: int,
                 tolerance_seconds: int = 7 * 86400, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Every asset's bars widened with the latest closed bar of each source.

    A source bar is visible from its start plus its own length, for at most a week. All
    sources ride in one time-ordered series, so the data is shuffled once however many
    sources there are.
    """
    us = bar_seconds * 1_000_000
    payload = F.struct(*[F.col(c) for c in bars.columns])
    seen = F.struct((micros(F.col("ts")) + us).alias("_at"), *[F.col(c).alias(f"f_{c}") for c in fields])
    no_left = F.lit(None).cast(bars.select(payload.alias("x")).schema["x"].dataType)
    no_right = F.lit(None).cast(bars.select(seen.alias("x")).schema["x"].dataType)
    targets = bars.select(micros(F.col("ts")).alias("_t"), F.lit(1).alias("_side"), F.col("asset").alias("_src"),
                          payload.alias("_left"), no_right.alias("_right"))
    known = bars.filter(F.col("asset").isin(*sources)).select(
        (micros(F.col("ts")) + us).alias("_t"), F.lit(0).alias("_side"), F.col("asset").alias("_src"),
        no_left.alias("_left"), seen.alias("_right"))
    b = blocks.split(targets.unionByName(known), [], ["_t", "_side", "_src"], axis=F.col("_t"), block_rows=block_rows)
    mine = lambda s: F.when((F.col("_src") == s) & (F.col("_side") == 0), F.col("_right"))
    order = lambda s: F.when((F.col("_src") == s) & (F.col("_side") == 0), F.col("_t"))
    names = {s: f"_c{i}" for i, s in enumerate(sources)}
    rows = blocks.carried(b, {names[s]: F.max_by(mine(s), order(s)) for s in sources}, {names[s]: "last" for s in sources})
    run = b.window().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({names[s]: F.coalesce(F.last(mine(s), ignorenulls=True).over(run), F.col(names[s])) for s in sources})
    rows = rows.filter(F.col("_left").isNotNull())
    out: list[Column] = [F.col("_left.*")]
    for s in sources:
        near = F.col("_t") - F.col(f"{names[s]}._at") <= tolerance_seconds * 1_000_000
        tag = "".join(ch if ch.isalnum() else "_" for ch in s.lower())
        out += [F.when(near, F.col(f"{names[s]}.f_{f}")).alias(f"market_{tag}_{f}") for f in fields]
    return rows.select(*out)


def count_overlaps(requests: DataFrame, taken: DataFrame, start: str = "start", end: str = "end",
                   block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """How many taken intervals touch each request (closed ends), without forming pairs.

    Intervals touching [a, b] are those that start by b less those that end before a. Both
    are running counts over one time line holding starts, ends and the two probes. Requests
    carry an ``id``. An interval without an end is still running, one without a start has always been, on either side.
    """
    bound = {start: -ALWAYS, end: ALWAYS}
    point = lambda df, c, side, kind: df.select(
        F.coalesce(micros(F.col(c)), F.lit(bound[c])).alias("_t"), F.lit(side).alias("_side"),
        (F.col("id") if kind == "probe" else F.lit(None).cast(requests.schema["id"].dataType)).alias("id"),
        F.lit(1 if kind == "start" else 0).alias("_s"), F.lit(1 if kind == "end" else 0).alias("_e"))
    # Taken intervals are counted by time before anything is shuffled: only their numbers matter.
    counted = lambda df: df.groupBy("_t", "_side", "id").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    line = (
        counted(point(taken, start, 0, "start")).unionByName(point(requests, end, 3, "probe"))
        .unionByName(point(requests, start, 1, "probe")).unionByName(counted(point(taken, end, 2, "end")))
    )
    line = stage(line)
    b = blocks.split(line, [], ["_t", "_side"], axis=F.col("_t"), block_rows=block_rows)
    rows = blocks.carried(b, {"_cs": F.sum("_s"), "_ce": F.sum("_e")}, {"_cs": "sum", "_ce": "sum"})
    run = b.window().rowsBetween(Window.unboundedPreceding, 0)
    begun = F.coalesce("_cs", F.lit(0)) + F.sum("_s").over(run)
    ended = F.coalesce("_ce", F.lit(0)) + F.sum("_e").over(run)
    probes = rows.withColumn("_v", F.when(F.col("_side") == 3, begun).when(F.col("_side") == 1, -ended)).filter(F.col("id").isNotNull())
    return requests.join(probes.groupBy("id").agg(F.sum("_v").alias("overlaps")), "id")


def first_touch(
    entries: DataFrame, series: DataFrame, keys: list[str], *, pos: str = "rn", low: str, high: str,
    bucket: int = 16, span: int | None = None,
) -> DataFrame:
    """First row in (from, to] of each entry where ``low`` <= lower or ``high`` >= upper.

    ``entries``: keys, ``from``, ``to`` (positions), lower and upper (NULL switches a side off). ``series``: keys, ``pos``, the two watched
    columns. ``span`` bounds ``to - from``, and a longer entry is an error; without it the longest entry is looked up.

    The series gets a hierarchy of extremes: of ``bucket`` rows, of ``bucket`` such buckets, and so on. An entry's range is a few whole nodes of each level,
    at most ``2 * bucket`` of them, so it is joined with a logarithmic number of nodes; in the first one that a touch lies in it then walks down,
    ``bucket`` children a level.
    """
    if span is None:
        span = entries.agg(F.max(F.col("to") - F.col("from"))).first()[0] or 1
    else:
        entries = entries.withColumn("to", required(F.col("to"), F.col("to").isNull() | (F.col("to") - F.col("from") <= span), f"an entry looks further ahead than {span} rows"))
    top = 0
    while bucket ** (top + 1) < span:
        top += 1
    nodes = series.select(*keys, F.lit(0).alias("_level"), F.col(pos).cast("long").alias("_node"), F.col(low).alias("_min"), F.col(high).alias("_max"))
    if top:
        first = nodes.groupBy(*keys, F.floor(F.col("_node") / bucket).alias("_node")).agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"))
        upper = [stage(first.withColumn("_level", F.lit(1)))]
        for level in range(2, top + 1):
            upper.append(upper[-1].groupBy(*keys, F.floor(F.col("_node") / bucket).alias("_node")).agg(F.min("_min").alias("_min"), F.max("_max").alias("_max")).withColumn("_level", F.lit(level)))
        nodes = functools.reduce(DataFrame.unionByName, [nodes, *upper])
    touched = (F.col("_min") <= F.col("lower")) | (F.col("_max") >= F.col("upper"))
    e = entries.select(*keys, "lower", "upper", F.struct("from", "to", "lower", "upper").alias("_id"))
    cover = F.explode(covering(F.col("_id.from") + 1, F.col("_id.to") + 1, bucket, top)).alias("_n")
    seen = e.select(*keys, "_id", "lower", "upper", cover).select(*keys, "_id", "lower", "upper", "_n.*").join(nodes, [*keys, "_level", "_node"]).filter(touched)
    at = F.col("_node") * F.element_at(F.array(*[F.lit(bucket**i).cast("long") for i in range(top + 1)]), F.col("_level") + 1)
    best = seen.groupBy(*keys, "_id").agg(F.min(F.struct(at.alias("at"), "_level", "_node")).alias("_b")).select(*keys, "_id", "_b._level", "_b._node")
    for level in range(top, 0, -1):
        if level == top:
            best = stage(best)
        children = F.explode(F.sequence(F.col("_node") * bucket, F.col("_node") * bucket + (bucket - 1)))
        down = best.filter(F.col("_level") == level).select(*keys, "_id", F.col("_id.lower").alias("lower"), F.col("_id.upper").alias("upper"), children.alias("_node"))
        down = down.join(nodes.filter(F.col("_level") == level - 1), [*keys, "_node"]).filter(touched)
        down = down.groupBy(*keys, "_id").agg(F.min("_node").alias("_node")).select(*keys, "_id", F.lit(level - 1).alias("_level"), "_node")
        best = best.filter(F.col("_level") < level).unionByName(down)
    return best.select(*keys, "_id.*", F.col("_node").alias("at"))


def covering(start: Column, end: Column, bucket: int, top: int) -> Column:
    """The positions [start, end) as whole nodes (_level, _node) of a hierarchy with levels 0 to ``top``."""

    def run(level: int, a: Column, z: Column) -> Column:
        own = F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(own, lambda n: F.struct(F.lit(level).alias("_level"), n.cast("long").alias("_node")))

    parts, a, z = [], start.cast("long"), end.cast("long")
    for level in range(top):
        up, down = F.ceil(a / bucket), F.floor(z / bucket)
        inside = up > down  # within one node of the level above: nothing is left for it
        parts += [run(level, a, F.when(inside, z).otherwise(up * bucket)), run(level, F.when(inside, z).otherwise(down * bucket), z)]
        a, z = F.when(inside, F.lit(0)).otherwise(up).cast("long"), F.when(inside, F.lit(0)).otherwise(down).cast("long")
    parts.append(run(top, a, z))
    return F.concat(*parts)
