"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all benchmark items answers, while a document's words stream through it, how long the longest stretch ending
at each word is that also stands in one item. A stretch of at least ``window`` words is contamination; an item shorter than
that counts when it stands there as a whole. Spans so found are cut out, and a document of which they cover too much is dropped.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.session import stage

from .common import lower_ascii, lower_ascii_text

WINDOW = 10
MAX_COVERAGE = 0.5

#: Fixed value: words are runs of digits, letters and anything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)

#: Words of items in one automaton: bounds its memory in the driver and in each task. More items are matched in further passes.
AUTOMATON_WORDS = 100_000


class Automaton:
    """Generalised suffix automaton of (item, words) pairs."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.size = max(1, len(self.vocab))
        self.next: dict[int, int] = {}
        self.link, self.length = [0], [0]
        children: list[list[int]] = [[]]  # word ids that leave each state, for copies
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocab[w], children)
        self._mark(items)

    def _state(self, length: int, link: int, children, leaving=()) -> int:
        self.length.append(length)
        self.link.append(link)
        children.append(list(leaving))
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int, children) -> int:
        """The state of p's longest string and w, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], children, children[q])
        for c in children[q]:
            self.next[copy * self.size + c] = self.next[q * self.size + c]
        while self.next.get(p * self.size + w) == q:
            self.next[p * self.size + w] = copy
            if not p:
                break
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int, children) -> int:
        q = self.next.get(last * self.size + w)
        if q is not None:
            return self._split(last, q, w, children)
        new, p = self._state(self.length[last] + 1, 0, children), last
        while (q := self.next.get(p * self.size + w)) is None:
            self.next[p * self.size + w] = new
            children[p].append(w)
            if not p:
                return new
            p = self.link[p]
        self.link[new] = self._split(p, q, w, children)
        return new

    def _mark(self, items) -> None:
        """Which items each window stands in, under the state that holds it; short items under theirs."""
        n = len(self.length)
        self.holds: dict[int, set[str]] = {}
        own_short: dict[int, dict[int, set[str]]] = {}
        self.window_state = [0] * n
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= self.window:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < self.window else self.window_state[up]
        for item, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v * self.size + self.vocab[w]]
                if i + 1 >= self.window:
                    self.holds.setdefault(self.window_state[v], set()).add(item)
            if 0 < len(words) < self.window:
                own_short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        self.short: dict[int, tuple] = {}
        for v in order:
            up = self.short.get(self.link[v], ())
            if v in own_short or up:
                self.short[v] = up + tuple((k, v) for k in sorted(own_short.get(v, ())))
        self.short_items = {(k, v): x for v, by in own_short.items() for k, x in by.items()}

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged hit spans as word positions (end exclusive), the items hit, and the longest match."""
        step, link, length, size, window = self.next.get, self.link, self.length, self.size, self.window
        short, window_state = self.short, self.window_state
        spans: list[list[int]] = []
        states, shorts, best = set(), set(), 0
        v = n = 0
        for i, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                v = n = 0
                continue
            to = step(v * size + w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = step(v * size + w)
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            if n > best:
                best = n
            reach = 0
            if n >= window:
                reach = window
                states.add(window_state[v])
            if v in short:
                for x in short[v]:
                    if x[0] <= n:
                        shorts.add(x)
                        reach = max(reach, x[0])
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        items = set().union(*(self.holds[s] for s in states), *(self.short_items[x] for x in shorts))
        return [tuple(s) for s in spans], items, best


def _item_parts(benchmark: DataFrame, window: int, words_each: int) -> tuple[DataFrame, int]:
    """The items' words, and how many automata of bounded size they take. A longer item is cut into overlapping parts, which keeps all its windows."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.when(F.size("words") <= words_each, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1), F.lit(words_each)))
    parts = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, words_each + window - 1))).alias("words"))
    n = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    return parts, -(-n // words_each)


def _automata(parts: DataFrame, blocks: int, window: int):
    """The automata one after the other; a single empty one for no items."""
    for k in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else parts
        yield Automaton([(r.item or "", r.words) for r in own.orderBy("item", "words").toLocalIterator()], window)
    if not blocks:
        yield Automaton([], window)


_FOUND = "struct<n_words:long,hits:array<struct<start:long,end:long>>,items:array<string>,longest:long>"


def _merged(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _match_pass(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """Add one automaton's finds to those of the passes before."""
    columns = ["row", "text", "found"]
    kind = rows.schema

    def run(batches):
        for batch in batches:
            found = []
            for text, before in zip(batch["text"].to_pylist(), batch["found"].to_pylist(), strict=True):
                words = _WORD.findall(lower_ascii_text(text))
                spans, items, longest = automaton.match(words)
                if before is not None:
                    spans = _merged([*spans, *((s["start"], s["end"]) for s in before["hits"])])
                    items, longest = items | set(before["items"]), max(longest, before["longest"])
                found.append({"n_words": len(words), "hits": [{"start": a, "end": b} for a, b in spans], "items": sorted(items), "longest": longest})
            at = batch.schema.get_field_index("found")
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return rows.select(*columns).mapInArrow(run, kind)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """All columns of docs in a struct ``row``, and ``found``: n_words, hits (word positions, end exclusive, merged), items and
    the longest match in words. A null or empty text has no words; repeated rows are each answered; an empty benchmark finds nothing."""
    return _scan(docs, *_item_parts(benchmark, window, automaton_words), window)


def _scan(docs: DataFrame, parts: DataFrame, blocks: int, window: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    for k, automaton in enumerate(_automata(parts, blocks, window)):
        rows = _match_pass(stage(rows) if k else rows, automaton)
    return rows


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (item ids sorted as strings, comma-joined), contaminated, longest_match."""
    hits = F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"), F.col("found.n_words").alias("n_words"), hits.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"), F.col("found.longest").alias("longest_match"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without benchmark passages, with the same columns.

    Every hit span is cut out, from its first word's first character to its last word's last, and a line break put in its place;
    this is repeated until nothing is found, since what closes up may spell an item anew. A document of whose words more than
    ``max_coverage`` are hit is dropped. Clean documents, null texts among them, come out as they were. ``n_chars``, where there
    is one, follows the text.
    """
    parts, blocks = _item_parts(benchmark, window, automaton_words)
    if blocks <= 1:
        return _cut_pass(docs, next(_automata(parts, blocks, window)), max_coverage)
    # spans and coverage are those of all automata on the same text: a document is cut once all of them have seen it, then seen by all again
    clean, left, share = [], docs, max_coverage
    while True:
        found = stage(_scan(left, parts, blocks, window))
        clean.append(found.where(F.size("found.hits") == 0).select("row.*"))
        hit = found.where(F.size("found.hits") > 0)
        if hit.isEmpty():
            return functools.reduce(DataFrame.unionByName, clean)
        left, share = _cut_found(hit, docs.schema, share), None


def _cut(text: str, places: list[tuple[int, int]], spans) -> str:
    """The text without the words of the spans, a line break in the place of each."""
    parts, end = [], 0
    for a, b in spans:
        parts.append(text[end : places[a][0]])
        end = places[b - 1][1]
    return "\n".join([*parts, text[end:]])


def _places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(lower_ascii_text(text))]


def _with_texts(batch: pa.RecordBatch, changed: dict[int, str]) -> pa.RecordBatch:
    """The batch with these rows' texts, and ``n_chars`` after them where there is one."""
    for name, of in (("text", str), ("n_chars", len)):
        at = batch.schema.get_field_index(name)
        if changed and at >= 0:
            values = [of(changed[i]) if i in changed else x for i, x in enumerate(batch.column(at).to_pylist())]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
    return batch


def _cut_found(found: DataFrame, schema, max_coverage: float | None) -> DataFrame:
    """Scanned rows without their hits. Without ``max_coverage`` none is dropped: coverage is of a text before anything was cut."""

    def run(batches):
        for batch in batches:
            changed, keep = {}, []
            for i, (text, found) in enumerate(zip(batch["text"].to_pylist(), batch["__found"].to_pylist(), strict=True)):
                spans = [(s["start"], s["end"]) for s in found["hits"]]
                keep.append(max_coverage is None or sum(b - a for a, b in spans) <= max_coverage * found["n_words"])
                if keep[-1]:
                    changed[i] = _cut(text, _places(text), spans)
            batch = _with_texts(batch.drop_columns(["__found"]), changed)
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return found.select("row.*", F.col("found").alias("__found")).mapInArrow(run, schema)


def _cut_pass(docs: DataFrame, automaton: Automaton, max_coverage: float) -> DataFrame:
    """What one automaton that holds all items makes of the documents, cut until it finds nothing."""

    def run(batches):
        for batch in batches:
            changed, keep = {}, []
            for i, text in enumerate(batch["text"].to_pylist()):
                own, dropped = text, False
                while own:
                    spans, _, _ = automaton.match(_WORD.findall(lower_ascii_text(own)))
                    if not spans:
                        break
                    places = _places(own)
                    if own is text and sum(b - a for a, b in spans) > max_coverage * len(places):
                        dropped = True
                        break
                    own = _cut(own, places, spans)
                if own is not text:
                    changed[i] = own
                keep.append(not dropped)
            batch = _with_texts(batch, changed)
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
parts AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest([array_to_string(list_slice(w, i, i + 9), ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS words FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM parts),
seen AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(list_slice(w, i, i + n - 1), ' ') FOR i IN range(1, len(w) - n + 2)]) AS words FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM seen JOIN parts USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "BINARY") AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
