"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quotelake.llm import ngram_join
from quotelake.llm.common import words_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words_of((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs, threshold):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def case(seed):
    """Families of edited copies, a passage that most documents share, short, empty and very long texts, and exact copies."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for _ in range(6):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([8, 45, 160]))]
        for _ in range(22):
            w = list(base)
            for _ in range(r.randint(0, r.choice([1, 3, 6]))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.choice([3, 9, 40]))) for _ in range(60)]
    long = [f"l{r.randint(0, 10**5)}" for _ in range(40_000)]
    texts += [" ".join(long), " ".join(long[:37_000]), " ".join(long[:20_000]), "Y" * 200_000, "a b", "A  B", "a\tb c", "", None, "   ", "one"] + [texts[3]] * 25 + [passage] * 2
    r.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,threshold,page,stars", [(1, 80, 2048, 3), (2, 60, 7, 1), (3, 95, 16, 0)])
def test_join(docs_of, seed, threshold, page, stars):
    docs = case(seed)
    got = ngram_join.join_sets(docs_of([*docs, (None, docs[0][1])]).repartition(3), threshold=threshold, page=page, stars=stars, groups=32).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(docs) + 1 and by.pop(None)[1] is None and by == plain(docs, threshold)


def test_repeated_rows_and_empty_table(docs_of):
    got = ngram_join.join_sets(docs_of([(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (4, "another text of five words"), (7, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (4, 4), (7, 7), (9, 4)]
    assert ngram_join.join_sets(docs_of([])).count() == 0


def test_frequent_shingles_come_last(docs_of, monkeypatch):
    """The passage that all documents share is in no prefix, so it fills no bucket; without that table the result is the same."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 1 << 10)
    r = random.Random(0)
    s = [np.unique(np.r_[np.arange(1, 20, dtype=np.uint64) << np.uint64(40), np.array([r.getrandbits(48) for _ in range(80)], np.uint64)]) for _ in range(50)]
    late = np.zeros(1 << ngram_join.COUNTER_BITS, np.int64)
    late[(np.arange(1, 20) << 40) >> (48 - ngram_join.COUNTER_BITS)] = 50
    for x in s:
        p = ngram_join.prefix_of(x, late, 80)
        assert len(p) == len(x) - -(-len(x) * 80 // 100) + 1 and not (p & np.uint64((1 << 40) - 1) == 0).any()


def test_counts_fold_to_fewer_groups():
    r = np.random.default_rng(1)
    for n, groups in ((3, 64), (255, 64), (600, 128), (5000, 1024), (10**5, 4096)):
        s = r.integers(0, 1 << 48, n, np.uint64)
        c = ngram_join.counts_of(s)
        assert len(c) == groups and c.sum() == n
        assert (ngram_join.folded(c, 32) == np.bincount((s % np.uint64(32)).astype(int), minlength=32)).all()


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 700])
def test_count_tree(n):
    """The tree finds exactly the points whose summed minima reach the threshold, and looks at few boxes for that."""
    r = np.random.default_rng(n)
    base = r.poisson(4, (12, 16))
    x = (base[r.integers(0, 12, n)] + r.poisson(0.3, (n, 16))).astype(np.int32)
    q = np.concatenate([x[:40], r.poisson(4, (10, 16)).astype(np.int32)])
    tree = ngram_join.CountTree(x)
    assert sorted(tree.place.tolist()) == list(range(n))
    who, point = tree.search(q, 80)
    size = lambda a: a.sum(axis=1)
    want = {(i, j) for i in range(len(q)) for j in range(n) if np.minimum(q[i], x[j]).sum() * 180 >= 80 * (size(q)[i] + size(x)[j])}
    assert set(zip(who.tolist(), point.tolist())) == want and len(who) == len(want)
    for (high, least), (top, low) in zip(tree.levels, tree.levels[1:]):
        assert (top.max(axis=0) == high.max(axis=0)).all() and low.min() == least.min()


def test_odd_sketches_bound_what_is_not_shared():
    """Differing bits never outnumber the shingles that one set alone has, and tell sets apart that count vectors do not."""
    r = np.random.default_rng(5)
    for n in (1, 40, 330, 3000, 30_000):
        s = np.unique(r.integers(0, 1 << 48, 2 * n, np.uint64))
        a, b = s[:n], s[n // 4 : n // 4 + n]
        x, y = ngram_join.odd_sketch(a), ngram_join.odd_sketch(b)
        assert len(x) == len(y) and 64 * len(x) <= ngram_join.ODD_BITS
        differ = sum(int(w).bit_count() for w in (x ^ y).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))
        if n == 330:  # three quarters shared: the count vectors let them through, the sketches do not
            assert ngram_join.may_link(ngram_join.counts_of(a)[None], ngram_join.counts_of(b)[None], n, n, 80) and (2 * n - differ) * 180 < 160 * 2 * n


def test_leaf_buckets_are_not_expanded(spark):
    """Members of a bucket that share no more than its shingle make no pair; the two that are alike make theirs."""
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 1 << 48, 300, np.uint64)) for _ in range(20)]
    sets[7] = np.r_[sets[3][:-3], sets[7][:3]]
    kinds = "uid long, label long, size int, counts array<int>, brief array<long>"
    brief = [np.bitwise_xor.reduce(ngram_join.odd_sketch(x).reshape(-1, ngram_join.BRIEF_BITS // 64)).tolist() for x in sets]
    near = spark.createDataFrame([(i, i, len(x), ngram_join.counts_of(x).tolist(), brief[i]) for i, x in enumerate(sets)], kinds)
    rest = near.select("uid", "label", "size", "brief", F.lit(1).alias("bucket"), F.lit(20).alias("many"), (F.col("uid") == 0).alias("inside"))
    assert [tuple(p) for p in ngram_join._bucket_pairs(rest, near, 80, 2048).collect()] == [(3, 7)]
