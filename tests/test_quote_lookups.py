import datetime as dt
import random

from quotelake.operators import quote_ledger as ql

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, n=300):
    rng = random.Random(5)
    out = []
    for asset in ("A", "B", None):
        at = 0
        for rn in range(n):
            at += rng.choice([0, 0, 1, 7])
            out.append((asset, rn, T0 + dt.timedelta(seconds=at), rn + 10, float(rn), 0.5 * rn))
    return spark.createDataFrame(out, "asset string, rn long, ts timestamp, sequence long, close_price double, carry double"), out


def test_first_row_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ql, "LOOKUP_ROWS", 16)
    rows, have = _rows(spark)
    rng = random.Random(6)
    asked = [(a, i, None if i == 3 else T0 + dt.timedelta(seconds=rng.randint(-5, 800))) for a in ("A", "B", None, "C") for i in range(60)]
    probes = spark.createDataFrame(asked, "asset string, id long, at timestamp")
    found = ql._first_at(probes, rows, ql.chapter_ends(rows, ["asset"]), ["asset"], "at", "k")
    got = {(r.asset, r.id): r.k for r in found.collect()}
    want = {(a, i): min((rn for b, rn, ts, *_ in have if b == a and at is not None and ts >= at), default=None) for a, i, at in asked}
    assert got == want and None in want.values()


def test_marks_move_no_quotes(spark, monkeypatch):
    """Trades are sent to the quotes, which are neither shuffled nor sorted, and every quote has the last trade filled by then."""
    monkeypatch.setattr(ql, "LOOKUP_ROWS", 16)
    rows, have = _rows(spark)
    trades = [("A", 5, 5, 299), ("A", 6, 40, 299), ("A", 200, 290, 299), (None, 31, 64, 299)]
    book = spark.createDataFrame([(*t, 2.0, 1.0, 100.0, 90.0, "trade") for t in trades], "asset string, fill long, exit_at long, end long, quantity double, entry_carry double, cash_open double, cash_after double, result string")
    out = ql._in_force(rows, book, ["asset"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = {(r.asset, r.rn): r.t_fill for r in out.collect()}
    assert got == {(a, rn): max((f for b, f, *_ in trades if b == a and f <= rn), default=None) for a, rn, *_ in have} and out.count() == len(have)


def test_decisions_by_position_equal_those_by_time(spark, monkeypatch):
    monkeypatch.setattr(ql, "LOOKUP_ROWS", 16)
    rows, _ = _rows(spark)
    rows = rows.where("asset IS NOT NULL")
    decided = spark.createDataFrame([(a, T0 + dt.timedelta(seconds=30 * i), i % 2 == 0, i % 3 == 0) for a in ("A", "B") for i in range(30)], "asset string, ts timestamp, entry boolean, exit boolean")
    columns = ["asset", "ts", "sequence", "entry", "exit", "decision"]
    by_position, by_time = (sorted(map(tuple, ql.place_decisions(q, decided, 60).select(*columns).collect())) for q in (rows, rows.drop("rn")))
    assert by_position == by_time and any(r[-1] for r in by_time)
