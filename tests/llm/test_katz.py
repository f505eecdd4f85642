"""Katz backoff against a plain dictionary version, and its sums."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from quotelake.llm import katz
from quotelake.llm.common import words_of


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*words_of((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None]


class Plain:
    def __init__(self, docs):
        self.c1, self.c2, self.ch = Counter(), Counter(), Counter()
        for i, text in docs:
            if not held(i):
                before = "<s>"
                for w in tokens(text):
                    self.c1[w] += 1
                    self.c2[before, w] += 1
                    self.ch[before] += 1
                    before = w
        n_of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, katz.FIT_COUNTS + 1)])
        self.d1, self.d2 = katz.Discount(n_of(self.c1)), katz.Discount(n_of(self.c2))
        self.n = sum(self.c1.values())
        self.unknown = 1 - sum(float(self.d1(np.array([c]))[0]) * c / self.n for c in self.c1.values())

    def single(self, w):
        c = self.c1[w]
        return float(self.d1(np.array([c]))[0]) * c / self.n if c else self.unknown

    def p(self, h, w):
        if not self.ch[h]:
            return self.single(w)
        d = lambda x: float(self.d2(np.array([self.c2[h, x]]))[0]) * self.c2[h, x] / self.ch[h]
        if self.c2[h, w]:
            return d(w)
        seen = [x for g, x in self.c2 if g == h]
        return (1 - sum(map(d, seen))) / (1 - sum(map(self.single, seen))) * self.single(w)


def case(seed=3, n=60):
    r = random.Random(seed)
    words = [f"w{int(r.expovariate(0.12))}" for _ in range(80)]
    docs = [(i, " ".join(r.choice(words) if r.random() < 0.9 else f"Rare{r.randint(0, 99)}É" for _ in range(r.randint(0, 40)))) for i in range(n)]
    return docs + [(200, None), (201, ""), (202, "only unseen words here"), (7, docs[7][1]), (None, "w1 w2 w3"), (203, "the same " * 3000)]


@pytest.mark.parametrize("block_tokens,part_tokens", [(1 << 20, 1 << 20), (50, 100)])
def test_scores(docs_of, block_tokens, part_tokens):
    docs = case()
    model, got = Plain(docs), katz.score(docs_of(docs).repartition(4), block_tokens=block_tokens, part_tokens=part_tokens).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    for i, text in docs:
        r, t = by_id[i], tokens(text)
        base = sum(math.log10((model.c1[w] + 1) / (model.n + len(model.c1) + 1)) for w in t)
        want = sum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)) if len(t) < 1000 else None
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(model.c1[w] > 0 for w in t), model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if want is not None:
            assert r.score == pytest.approx(want, rel=1e-9)


def test_every_history_sums_to_one():
    model = Plain(case())
    for h in [*model.ch, "never seen"]:
        assert sum(model.p(h, w) for w in model.c1) + model.p(h, "an unknown word") == pytest.approx(1, abs=1e-9)


def test_discounts_give_something_up():
    for n_of in (np.zeros(256), np.r_[5, np.zeros(255)], np.r_[1, 5, 9, np.zeros(253)], np.arange(256), 1000 // np.arange(1, 257) ** 2):
        d = katz.Discount(np.asarray(n_of, float))(np.arange(1, 5000))
        assert ((d > 0) & (d < 1)).all()


def test_held_out_text_is_foreseen_better(docs_of):
    r = random.Random(1)
    follows = {f"a{k}": [f"a{(k * 7 + j) % 40}" for j in (1, 2)] for k in range(40)}

    def text():
        w = ["a0"]
        for _ in range(60):
            w.append(r.choice(follows[w[-1]]))
        return " ".join(w)

    got = [x for x in katz.score(docs_of([(i, text()) for i in range(300)])).collect() if x.held_out]
    assert got and sum(x.score for x in got) > 0.5 * sum(x.base_score for x in got)


def test_empty_tables(docs_of):
    assert katz.score(docs_of([])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = katz.score(docs_of([(only, "a b")])).first()
    assert (r.n_known, r.train_tokens, r.score, r.base_score) == (0, 0, 0.0, 0.0)
