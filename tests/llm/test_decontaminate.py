"""Suffix-automaton hits against a plain search for every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row
from quotelake.llm import decontaminate as dc

WORD = re.compile(dc.WORD)


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(text, items, k):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(k, len(x))
        for j in range(len(x) - n + 1) if x else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def random_case(seed, letters):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(letters) for _ in range(n))
    items = [(i, text(r.randint(0, 14))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 12))]
        for _ in range(r.randint(0, 2)):
            x = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(x) - 3))
            parts += [" ".join(x[a : a + r.randint(1, 14)]).upper(), text(r.randint(0, 5))]
        docs.append((i, ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize("letters", [["a", "b"], ["a", "b", "é", "Ü2", "漢"], list("abcdefghijklmnop")])
def test_automaton_is_the_plain_search(letters):
    for seed in range(25):
        docs, items = random_case(seed, letters)
        a = dc.Automaton([(str(i), words(t)) for i, t in items], 4)
        for _, t in docs:
            spans, found, _ = a.match(words(t))
            assert (len(words(t)), sum(e - s for s, e in spans), sorted(found)) == plain(t, items, 4)


def bench_of(spark, items):
    return spark.createDataFrame([Row(item_id=i, text=t, found="x") for i, t in items], "item_id long, text string, found string")


@pytest.mark.parametrize("automaton_words", [100_000, 25])
def test_digest(spark, docs_of, automaton_words):
    docs, items = random_case(99, ["a", "b", "c", "é"])
    docs += [(100, None), (101, ""), (102, "a b " * 20000), (5, docs[5][1])]
    items += [(50, None), (51, ""), (52, " ".join("abcc"[i * i % 4] for i in range(70)))]
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.digest(dc.scan(docs_of(docs), bench_of(spark, items), automaton_words=automaton_words)).collect()}
    want = set()
    for i, t in docs:
        n, hit, found = plain(t, items, 10) if i != 102 else (40000, None, None)
        if i != 102:
            want.add((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert {x for x in got if x[0] != 102} == want and any(x[0] == 102 and x[1] == 40000 for x in got)


@pytest.mark.parametrize("automaton_words", [100_000, 8])
def test_remove(spark, docs_of, automaton_words):
    item = "one two three four five six seven eight nine ten eleven"
    nested = "clean start here one two three four one two three four five six seven eight nine ten eleven five six seven eight nine ten eleven and a clean end of this document goes on"
    docs = [(1, "nothing here, at all"), (2, f"before it. {item.upper()}; after " + "x " * 30), (3, item), (4, None), (5, nested + " y" * 30)]
    got = {r.doc_id: r for r in dc.remove(docs_of(docs), bench_of(spark, [(1, item), (2, "short item")]), automaton_words=automaton_words).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == docs[0][1] and got[4].text is None and got[2].score == "x"
    assert "TWO" not in got[2].text and got[2].text.startswith("before it. \n; after x") and got[2].n_chars == len(got[2].text)
    assert plain(got[5].text, [(1, item)], 10)[1] == 0 and "clean start" in got[5].text


@pytest.mark.parametrize("automaton_words", [100_000, 26, 12])
def test_remove_over_automata(spark, docs_of, automaton_words):
    """Items that overlap in the text or share its coverage, whichever automaton holds them, and a passage that closes up around a cut."""
    items, docs, want = [], [], {}
    for k in range(8):
        w = [f"w{k}x{i}" for i in range(40)]
        items += [(10 * k, " ".join(w[:12])), (10 * k + 1, " ".join(w[7:20])), (10 * k + 2, " ".join(w[20:32]))]
        rest = " ".join(f"own{k}y{i}" for i in range(25))
        docs += [(10 * k, f"before {' '.join(w[:20])} {rest}"), (10 * k + 1, f"{' '.join(w[:12])} some words {' '.join(w[20:32])} {' '.join(rest.split()[:20])}"),
                 (10 * k + 2, f"start {' '.join(w[:5] + w[20:32] + w[5:12])} {rest}")]
        want |= {10 * k: f"before \n {rest}", 10 * k + 2: f"start \n {rest}"}
    got = dc.remove(docs_of(docs), bench_of(spark, items), automaton_words=automaton_words).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_empty_tables(spark, docs_of):
    assert dc.digest(dc.scan(docs_of([]), bench_of(spark, [(1, "a")]))).count() == 0
    assert dc.remove(docs_of([(1, "a b")]), bench_of(spark, [])).count() == 1
    assert not dc.digest(dc.scan(docs_of([(1, "a b")]), bench_of(spark, []))).first().contaminated
