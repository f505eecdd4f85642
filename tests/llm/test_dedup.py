"""Near-duplicates and repeated substrings against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from quotelake.llm import near_dups, rolling, substrings
from quotelake.session import stage
from quotelake.llm.common import words_of
from quotelake.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words_of((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def family(r, n_words, copies, edits):
    base = [f"w{r.randint(0, 500)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base) if r.random() < 0.6 else out[-1].split(" ")
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def near_case(seed):
    r = random.Random(seed)
    texts = [t for _ in range(6) for t in family(r, r.choice([8, 40, 150]), 25, r.choice([1, 4, 9]))]
    texts += [" ".join(f"u{r.randint(0, 10**6)}" for _ in range(30)) for _ in range(20)] + ["a b", "A  B", "a\tb c", "", None, "   ", "one"] * 2
    texts += [texts[3]] * 30
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(docs_of, seed):
    docs = near_case(seed)
    want = plain_components(docs)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs_of([*docs, (None, docs[0][1])]).repartition(3)).collect()}
    assert got[None].kept and got[None].component_id is None
    assert {i: (got[i].n_shingles, got[i].component_id) for i, _ in docs} == want
    assert all(r.kept == (r.doc_id == r.component_id) for i, r in got.items() if i is not None)


def test_keep_first(docs_of):
    docs = near_case(5)[:60]
    want = {i for i, (_, c) in plain_components(docs).items() if i == c}
    kept = near_dups.keep_first(docs_of(docs))
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs_of([]).columns


def test_keep_first_goes_by_rows(docs_of):
    x, y = "a b c d e f g h", "q r s t u v w x"
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, x), (2, x), (2, y), (3, y), (4, None), (4, ""), (None, x), (5, y), (5, y), (6, long), (6, long + " more"), (6, "Z" * 200_000)]
    kept = near_dups.keep_first(docs_of(rows).repartition(3))
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    assert [(i, t) for i, t in got if t == x] == [(0, x), (1, x)] and [(i, t) for i, t in got if t == y] == [(2, y)]
    assert len(got) == 7 and sum(t is not None and t.startswith("l0 ") for _, t in got) == 1 and (6, "Z" * 200_000) in got
    assert kept.columns == docs_of([]).columns and near_dups.keep_first(docs_of([])).count() == 0


def test_repeated_rows_and_empty_table(docs_of):
    got = near_dups.near_duplicates(docs_of([(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (4, "another text of five words")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (4, 4), (9, 4)]
    assert near_dups.near_duplicates(docs_of([])).count() == 0


def test_odd_sketches_tell_similar_from_different():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 400, np.uint64)
    bits = {}
    for share in (0.9, 0.75, 0.3):
        n = int(300 * share / (1 + share) * 2)
        a, b = np.unique(pool[:300]), np.unique(np.r_[pool[:n], r.integers(0, 1 << 63, 300 - n, np.uint64)])
        _, s = near_dups._signatures([a, b], 32, 4, 512)
        bits[share] = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1])
    assert bits[0.9] < bits[0.75] <= near_dups.MOST_BITS < bits[0.3]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1005), (1005, 1003)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1003: 1000, 1005: 1000}


# ---- substrings


def plain_substrings(docs, k):
    first = {}
    rows = sorted(docs, key=lambda d: d[0])
    for i, t in rows:
        w = words_of(t)
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (i, s))
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (i, s):
                gone.update(range(s, s + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_words,part_bytes", [(1 << 20, 1 << 24), (60, 300)])
def test_substrings(docs_of, block_words, part_bytes):
    for seed in (1, 2):
        r = random.Random(seed)
        letters = ["a", "b", "é"]
        passage = " ".join(r.choice(letters) for _ in range(9))
        texts = [" \t".join([" ".join(r.choice(letters) for _ in range(r.randint(0, 12))), passage if r.random() < 0.4 else "z", "\n".join(r.choice(letters) for _ in range(r.randint(0, 8)))]) for _ in range(70)]
        texts += [None, "", "  ", "a b", "a " * 4000, texts[0], texts[1]]
        docs = [(i * 3, t) for i, t in enumerate(texts)]
        r.shuffle(docs)
        got = substrings.deduplicate(docs_of(docs).repartition(3), window=6, block_words=block_words, part_bytes=part_bytes)
        rows = got.collect()
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in rows} == plain_substrings(docs, 6)
        assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 and sum(s.end - s.start for s in x.removed) == x.n_removed for x in rows)


def test_substrings_of_rows_that_share_an_id(docs_of):
    text = "a b c d e f g"
    got = substrings.deduplicate(docs_of([(1, text), (1, text), (None, text), (2, text)]), window=6).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.n_removed)
    assert by == {None: [0], 1: [7, 7], 2: [7]}
    got = substrings.deduplicate(docs_of([(1, text), (1, text), (1, "z " + text)]), window=6).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    assert substrings.deduplicate(docs_of([])).count() == 0


def test_window_hashes():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50, np.uint64)
    for k in (1, 2, 3, 7, 20, 31, 60):
        want = [sum(int(h[i + j]) * pow(int(rolling.BASE), k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(len(h) - k + 1)]
        assert rolling.window_hashes(h, k).tolist() == want
    assert rolling.from_planes(rolling.planes(h), np.uint64).tolist() == h.tolist()


def test_buckets_are_counted_in_plain_numbers(docs_of, monkeypatch):
    """A bucket of one member costs the shuffle two numbers and its name: hashed, not sorted, and without a nested value."""
    plans = []

    def noted(df):
        if df.columns == ["bucket", "centre", "size"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(near_dups, "stage", noted)
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(40)]
    got = near_dups.near_duplicates(docs_of([*docs, (90, docs[5][1] + " more"), (3, docs[9][1] + " more")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted([(i, i) for i in range(40) if i != 9] + [(90, 5), (3, 3), (9, 3)])
    assert len(plans) == 1 and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0] and "named_struct" not in plans[0] and "struct(" not in plans[0]


def test_sets_move_only_for_pairs_that_may_link(docs_of, monkeypatch):
    """A set that is in no pair is not shuffled for pairs; what sketches of whole sets rule out is not compared."""
    compared, plans = [], []
    real = near_dups._confirm

    def noted(pairs, sets):
        out = real(pairs, sets)
        compared.append([(r.both, r.either) for r in out.collect()])
        return out

    def staged(df):
        if df.columns == ["a", "b", "both", "either"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    monkeypatch.setattr(near_dups, "_confirm", noted)
    monkeypatch.setattr(near_dups, "stage", staged)
    r = random.Random(3)
    shared = [f"s{k}" for k in range(170)]
    docs = [(i, " ".join([*shared, *(f"d{i}w{k}" for k in range(40))])) for i in range(40)]  # alike at 0.67: none links
    docs += [(100 + i, " ".join([*shared[: 168 - i], *(f"e{k}" for k in range(40))])) for i in range(3)]
    r.shuffle(docs)
    got = {x.doc_id: x.component_id for x in near_dups.near_duplicates(docs_of(docs)).collect()}
    assert got == {i: c for i, (_, c) in plain_components(docs).items()}
    assert len(compared) == 3 and sum(100 * b < 72 * e for b, e in compared[1] + compared[2]) < 40  # of 780 pairs
    assert len(plans) == 3 and all(p.count("getbit") >= 2 for p in plans)
