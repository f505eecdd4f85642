"""Importance resampling and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from quotelake.llm import resampling, whitening
from quotelake.session import stage

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# ---- resampling


def features(text, longest):
    w = WORD.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, longest, buckets, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(of(f) for _, d in docs for f in features(d, longest)[1]), Counter(of(f) for d in target for f in features(d, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, d in docs:
        w, f = features(d, longest)
        weight = sum(gain(of(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(f), weight, score, len(w)])
    able = sorted([r for r in rows if r[0] is not None and r[4] >= least], key=lambda r: (-r[3], r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: len(able) * percent // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize("longest,percent,probes", [(1, 10, 15), (3, 55, 1), (1, 100, 3)])
def test_resample(docs_of, longest, percent, probes):
    r = random.Random(longest)
    vocab = ["Alpha", "beta", "über", "x1", "日本", "gamma-ray", "it's", "DELTA"]
    docs = [(i * 7 % 311, " ".join(r.choices(vocab, k=r.choice([0, 3, 8, 30])))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, " .,- "), (903, "word " * 60_000 + "x" * 300_000), (None, "alpha beta " * 5), (5000, docs[3][1]), (5001, docs[3][1])]
    target = ["beta über beta", "日本 日本 x1", None, ""]
    got = resampling.resample(docs_of(docs).repartition(3), docs_of([(1, t) for t in target]), percent, 5, 97, longest, probes=probes, per_part=16)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(x) for x in got.collect()], key=str) == plain_resample(docs, target, longest, 97, percent, 5)


def test_resample_repeated_rows_and_empty_tables(docs_of):
    rows = resampling.resample(docs_of([(4, "a b c d e f")] * 10 + [(9, "a b")]), docs_of([]), percent=30, least_words=3).collect()
    assert sorted(x["rank"] for x in rows if x["rank"]) == [1, 2, 3] and len({x.score for x in rows if x.doc_id == 4}) == 1
    assert resampling.resample(docs_of([]), docs_of([(1, "a")])).count() == 0
    assert [x["rank"] for x in resampling.resample(docs_of([(1, "a b c")]), docs_of([]), percent=0, least_words=1).collect()] == [None]


@pytest.mark.parametrize("probes", [2, 15])
def test_cutoff(spark, probes):
    r = random.Random(3)
    rows = [(r.randint(-5, 5), r.choice([-(1 << 30), -1, 0, 7, 1 << 62]), i) for i in range(300)]
    df = stage(spark.createDataFrame(rows, "a long, b long, c long"))
    order = sorted(rows)
    for k in (1, 77, 300):
        at = resampling.cutoff(df, ["a", "b", "c"], k, probes)
        assert [x for x in order if tuple(x) <= tuple(at)] == order[:k]
    assert resampling.cutoff(df, ["a", "b", "c"], 0, probes) is None


# ---- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=v, x="own", n=1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")


def plain_whiten(rows, k=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("spread", [1.0, 1e-4])
def test_whiten(spark, spread):
    r = np.random.default_rng(4)
    # from wide to narrow directions, the narrow ones far below the wide: ill-conditioned
    x = (r.normal(size=(700, 9)) * np.r_[np.linspace(40, 20, 5), spread * np.ones(4)]) @ np.linalg.qr(r.normal(size=(9, 9)))[0] + 3
    x[100:350] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [None] * 9), (5002, [float("nan")] * 9), (5003, [float("inf")] + [0.0] * 8), (5004, [])]
    got = whitening.whiten(vectors_of(spark, rows + bad + [(None, rows[0][1]), rows[1]]).repartition(5)).toPandas()
    n, dev, white, share = plain_whiten(rows)
    assert len(got) == 4 * 702 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.vec_id.isna().sum() == 4
    for c in range(4):
        own = got[(got.component == c + 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id")
        assert own.deviation.tolist() == dev.tolist() and np.allclose(own.explained, share[c], rtol=1e-9)
        sign = np.sign(own.whitened.iloc[0] * white[0, c])
        assert np.abs(own.whitened * sign - white[:, c]).max() < 1e-7


def test_whiten_flat_directions_lengths_and_empty(spark):
    r = np.random.default_rng(1)
    plane = [(i, [float(a), float(b), float(a + b), 7.0]) for i, (a, b) in enumerate(r.integers(-9, 9, (60, 2)))]
    other = [(100 + i, [float(i), 0.0]) for i in range(5)] + [(200, [1.5])]
    got = whitening.whiten(vectors_of(spark, plane + other)).toPandas()
    assert got.groupby("vec_id").component.max().to_dict() == {i: 2 for i in range(60)} | {100 + i: 1 for i in range(5)}
    n, dev, white, share = plain_whiten(plane, 2)
    own = got[got.vec_id < 60].sort_values(["vec_id", "component"])
    assert np.allclose(np.abs(own.whitened.to_numpy().reshape(-1, 2)), np.abs(white), atol=1e-8) and np.allclose(own.explained.to_numpy()[:2], share) and own.identity_error.max() < 1e-9
    assert whitening.whiten(vectors_of(spark, [])).count() == 0


def test_whiten_large_entries(spark):
    rows = [(i, [2.0**40 * i, float(i % 3)]) for i in range(5)]
    got = whitening.whiten(vectors_of(spark, rows)).where("component = 1").orderBy("vec_id").collect()
    x = [(2**48 * i, 256 * (i % 3)) for i in range(5)]
    s = [sum(c) for c in zip(*x)]
    want = [sum((5 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    assert [g.deviation for g in got] == [w if w < 1 << 63 else None for w in want] and {g.n for g in got} == {5}


def test_orthonormal_factors_of_an_ill_conditioned_matrix(spark):
    r = np.random.default_rng(8)
    x = r.integers(-(1 << 40), 1 << 40, (400, 1)) + r.integers(-2, 3, (400, 6))  # condition number about 1e11: its square is beyond doubles
    w = whitening.fit(stage(spark.createDataFrame([Row(x=[int(c) for c in v]) for v in x], "x array<long>")), 6, 1)
    centred = x - x.mean(0)
    sigma = np.linalg.svd(centred, compute_uv=False)
    assert abs(w.values[0] * 400 / sigma[0] ** 2 - 1) < 1e-12 and w.passes > 2
