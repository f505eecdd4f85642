"""Statistics with planted truth, registries, sources, streams and the driver contract."""

import hashlib
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, times
from quotelake.functions import normal
from quotelake.operators import evidence as ev
from quotelake.operators import registry as rg
from quotelake.sources import hour_files, payloads, readers, store
from quotelake.streaming import live


def series(spark, **groups):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"asset": k, "rn": range(len(v)), "ret": np.asarray(v, float)}) for k, v in groups.items()], ignore_index=True))


def test_planted_alpha_and_beta(spark):
    rng = np.random.default_rng(1)
    market = rng.normal(0.0002, 0.01, 1500)
    y = 0.001 + 0.4 * market + rng.normal(0, 0.004, 1500)
    pdf = pd.DataFrame({"asset": "X", "rn": range(1500), "ret": y, "market": market})
    flat = pd.DataFrame({"asset": "F", "rn": range(100), "ret": 0.0, "market": market[:100]})
    got = {r.asset: r for r in ev.hac_regression(spark.createDataFrame(pd.concat([pdf, flat])), ["asset"]).collect()}
    r = got["X"]
    X = np.column_stack([np.ones(1500), market])
    coef, *_ = np.linalg.lstsq(X, y, rcond=None)
    s = X * (y - X @ coef)[:, None]
    meat = s.T @ s
    for k in range(1, r.hac_lags + 1):
        cross = s[k:].T @ s[:-k]
        meat += (1 - k / (r.hac_lags + 1)) * (cross + cross.T)
    bread = np.linalg.inv(X.T @ X)
    se = math.sqrt((bread @ meat @ bread)[0, 0] * 1500 / 1498)
    assert r.passed and abs(r.beta - 0.4) < 0.05
    np.testing.assert_allclose([r.alpha, r.alpha_se], [coef[0], se], rtol=1e-6)
    assert not got["F"].passed


def test_bootstrap_gates_and_guards(spark):
    s = series(spark, good=np.linspace(0.0001, 0.0003, 120), few=[0.01] * 20 + [0.0] * 20, lost=[0.01, -1.0] * 40, zero=np.zeros(90))
    got = ev.block_bootstrap(s, ["asset"], samples=50).collect()
    assert {(r.asset, r.block) for r in got} == {("good", 5), ("good", 10), ("good", 20)}
    assert all(r.passed and r.profit_probability == 1 and abs(r.drawdown_p95) < 1e-9 for r in got)
    c = {r.asset: r for r in ev.concentration(series(spark, lucky=[0.5] + [-0.001] * 100, good=np.linspace(0.0001, 0.0003, 120)), ["asset"]).collect()}
    assert not c["lucky"].passed and c["good"].passed
    m = {r.asset: r for r in ev.mean_interval(s, ["asset"], samples=50).collect()}
    assert m["good"].lower < 0.0002 < m["good"].upper and m["few"].status == "INSUFFICIENT_DATA"


def test_more_trials_lower_the_deflated_sharpe(spark):
    s = series(spark, X=np.random.default_rng(2).normal(0.001, 0.01, 500))
    z = [ev.deflated_sharpe(s, ["asset"], n, samples=50).collect()[0].dsr_z for n in (1, 100)]
    assert z[0] > z[1]


def test_normal_cdf_is_close(spark):
    from statistics import NormalDist

    got = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.2, 4.0)], "z double").select("z", normal.cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - NormalDist().cdf(r.z)) < 1e-7 for r in got)


def test_hash_chain(spark):
    rows, parent = [], None
    for i in range(6):
        body = f"{i}|EVENT|p{i}|{parent or ''}"
        h = hashlib.sha256(body.encode()).hexdigest()
        rows.append([i, "EVENT", f"p{i}", parent, h])
        parent = h
    make = lambda r: spark.createDataFrame(r, "id long, kind string, payload string, parent string, event_hash string")
    check = lambda r: {(x.id, x.problem) for x in rg.chain_breaks(make(r), "id", ["id", "kind", "payload", "parent"], slot_rows=2).collect()}
    assert check(rows) == set()
    assert check([[*x[:2], "forged", *x[3:]] if x[0] == 3 else x for x in rows]) == {(3, "content")}
    assert check([x for x in rows if x[0] != 2]) == {(3, "parent")}


def test_hour_files_on_disk(spark, folder):
    path = f"{folder}/EURUSD/2024/01/02"
    os.makedirs(path)
    ms = list(range(0, 60_000, 1000))
    with open(f"{path}/05.bi5", "wb") as f:
        f.write(hour_files.encode_hour(ms, [1.1] * 60, [1.10005] * 60, 1e5))
    with open(f"{path}/06.bi5", "wb") as f:
        f.write(b"broken")
    scales = spark.createDataFrame([("EURUSD", 1e5)], "asset string, scale double")
    got = hour_files.read_hour_files(spark, folder, scales).orderBy("hour", "sequence").collect()
    assert len(got) == 61 and (got[1].bid, got[1].ask, got[1].sequence) == (1.1, 1.10005, 1)
    assert got[1].ts == at("2024-01-02 05:00:01") and got[-1].problem and got[-1].bid is None


def test_store_refuses_replaces_and_prunes(spark, folder):
    q = lambda bid: spark.createDataFrame([("X", at("2024-01-02 01:00"), 0, bid, bid + 1), ("Y", at("2024-01-03 01:00"), 0, bid, bid + 1)], "asset string, ts timestamp, sequence long, bid double, ask double")
    path = folder + "/store"
    store.put_days(spark, q(1.0), path, "2024-02-01")
    with pytest.raises(readers.SourceError):  # the store is looked up
        store.put_days(spark, q(1.0), path, "2024-02-01")
    have = spark.createDataFrame([("X", at("2024-01-02").date())], "asset string, day date")
    with pytest.raises(readers.SourceError):
        store.put_days(spark, q(2.0), path, "2024-02-01", have)
    with pytest.raises(readers.SourceError):
        store.put_days(spark, q(2.0), path, "2024-01-03 12:00:00")
    store.put_days(spark, q(3.0).filter("asset = 'X'"), path, "2024-02-01", have, replace=True)
    r = store.read_range(spark, path, "2024-01-02", "2024-01-04")
    assert sorted((x.asset, x.bid) for x in r.collect()) == [("X", 3.0), ("Y", 1.0)]
    one = store.read_range(spark, path, "2024-01-03", "2024-01-04", ["Y"])
    assert "PartitionFilters: [isnotnull(asset" in one._jdf.queryExecution().toString() and one.count() == 1


def test_every_file_of_a_folder_has_its_header_checked(spark, folder):
    for name, head in (("a", "timestamp,sequence,bid,ask"), ("b", "timestamp,sequence,ask,bid")):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(f"{head}\n2024-01-01T00:00:00Z,0,1.0,1.1\n")
    assert readers.read_quotes_csv(spark, f"{folder}/a.csv", "X").count() == 1
    with pytest.raises(Exception, match="header"):
        readers.read_quotes_csv(spark, f"{folder}/*.csv", "X").collect()


def test_csv_and_document_sources(spark, folder):
    with open(f"{folder}/q.csv", "w") as f:
        f.write("timestamp,sequence,bid,ask\n2024-01-01T00:00:00Z,0,1.0,1.1\n2024-01-01 00:00:01,1,1.0,1.1\n")
    with pytest.raises(Exception, match="without its offset"):
        readers.read_quotes_csv(spark, f"{folder}/q.csv", "X").collect()
    with open(f"{folder}/n.csv", "w") as f:
        f.write("timestamp,sequence,bid,ask\n2024-01-01T00:00:00Z,0,NaN,1.1\n")
    with pytest.raises(Exception, match="not a finite number"):
        readers.read_quotes_csv(spark, f"{folder}/n.csv", "X").collect()
    with open(f"{folder}/ok.csv", "w") as f:
        f.write("timestamp,sequence,bid,ask\n2024-01-01T00:00:00Z,0,1.0,1.1\n")
    assert readers.read_quotes_csv(spark, f"{folder}/ok.csv", "X").first().ts == at("2024-01-01")
    with open(f"{folder}/bad.csv", "w") as f:
        f.write("timestamp,sequence,bid,ask,extra\n")
    with pytest.raises(readers.SourceError):
        readers.read_quotes_csv(spark, f"{folder}/bad.csv", "X")
    with open(f"{folder}/b.csv", "w") as f:
        f.write("Timestamp,Open,High,Low,Close,Volume\n2024-01-01T00:00:00+00:00,1,2,0.5,1.5,7\n")
    with open(f"{folder}/m.json", "w") as f:
        json.dump({"datasets": [{"asset": "X", "path": f"{folder}/b.csv"}]}, f)
    assert readers.read_bars_manifest(spark, f"{folder}/m.json").collect()[0].volume == 7
    with open(f"{folder}/t.csv", "w") as f:
        f.write("signal_timestamp;direction\n1704067200;long\n2024-01-01T00:00:00Z;-1\n")
    assert [(r.timestamp, r.direction) for r in readers.read_trace(spark, f"{folder}/t.csv").collect()] == [(at("2024-01-01"), 1), (at("2024-01-01"), -1)]
    with open(f"{folder}/r.csv", "w") as f:
        f.write("published,value\n2024-01-01T00:00:00Z,3.5\n")
    assert readers.read_release_csv(spark, f"{folder}/r.csv", "cpi", "published", "value", 40).collect()[0].value == 3.5


def test_delta_candles_keep_their_gap(spark):
    p = spark.createDataFrame([("X", 0, 86_400_000, 0.5, [1, 3], 10.0, 11.0, 9.0, 10.5, [0, 2], [0, 2], [0, 2], [0, 2])],
                              "asset string, base_ms long, shift long, multiplier double, times array<long>, open double, high double, low double, close double, opens array<long>, highs array<long>, lows array<long>, closes array<long>")
    got = payloads.decode_delta_candles(p, ["asset"]).orderBy("ts").collect()
    assert [(r.ts.day, r.open, r.close) for r in got] == [(2, 10.0, 10.5), (5, 11.0, 11.5)]


def test_late_quotes_are_dropped_and_open_bars_withheld(spark, folder):
    schema = "asset string, ts timestamp, sequence long, bid double, ask double"
    def land(i, *rows):
        spark.createDataFrame([("X", at(t), i, b, b + 1) for t, b in rows], schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    out = f"{folder}/out"
    def catch_up():
        bars = live.live_bars(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), 60, "10 seconds", "bid")
        bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
        return [(r.ts.minute, r.open, r.close, r.quotes) for r in spark.read.parquet(out).orderBy("ts").collect()]
    land(0, ("2024-01-01 00:00:05", 1.0), ("2024-01-01 00:00:50", 2.0), ("2024-01-01 00:01:30", 3.0))
    assert catch_up() == [(0, 1.0, 2.0, 2)]
    land(1, ("2024-01-01 00:00:55", 9.0), ("2024-01-01 00:02:30", 4.0))
    assert catch_up() == [(0, 1.0, 2.0, 2), (1, 3.0, 3.0, 1)]


def test_evaluation_fires_once(spark, folder):
    schema = "asset string, ts timestamp, close double"
    fired = []
    def feed(i, first, n):
        spark.createDataFrame([("X", t, 1.0) for t in times(n, start=first)], schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        bars = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        live.prospective_trigger(bars, folder + "/seen", folder + "/claim", folder + "/state", lambda df: fired.append(df.count()), 86400, 86400, 10, need=20)
    feed(0, "2024-01-01", 15)
    assert fired == []
    feed(1, "2024-01-16", 10)
    assert fired == [20]
    feed(2, "2024-01-26", 10)
    assert fired == [20]


def test_each_asset_is_evaluated_when_it_is_due(spark, folder):
    schema = "asset string, ts timestamp, close double"
    fired = []

    def feed(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        bars = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        live.prospective_trigger(bars, folder + "/seen", folder + "/claim", folder + "/state", lambda df: fired.append(sorted((r.asset, r["count"]) for r in df.groupBy("asset").count().collect())), 86400, 86400, 10, need=20)

    feed(0, [("X", t, 1.0) for t in times(25)] + [("Y", t, 1.0) for t in times(5)])
    assert fired == [[("X", 20)]]
    feed(1, [("Y", t, 1.0) for t in times(25)[5:]] + [("X", t, 1.0) for t in times(60)[25:]])
    assert fired == [[("X", 20)], [("Y", 20)]]


def test_candle_payloads_are_checked(spark):
    from quotelake.sources import payloads

    good = {"asset": "X", "base_ms": 0, "shift": 1000, "multiplier": 0.1, "times": [0, 1], "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, **{f"{f}s": [0, 1] for f in ("open", "high", "low", "close")}}
    schema = "asset string, base_ms long, shift long, multiplier double, times array<long>, open double, high double, low double, close double, opens array<long>, highs array<long>, lows array<long>, closes array<long>"
    decode = lambda **bad: payloads.decode_delta_candles(spark.createDataFrame([{**good, **bad}], schema), ["asset"]).collect()
    assert [round(r.close, 6) for r in decode()] == [1.0, 1.1]
    for bad in ({"closes": [0]}, {"multiplier": 0.0}, {"shift": -1}, {"times": [0, -1]}):
        with pytest.raises(Exception, match="candle payload"):
            decode(**bad)


def test_driver_contract():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert "trend_fills" in q and all(isinstance(s, str) for s in o.values())
