"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights, packed partitioned tables.

p(w | h) is the discounted share d(c) * c(h, w) / c(h) where the pair was seen, and otherwise alpha(h) * p(w); p(w) is the discounted
share of the word, or, for a word never seen, all the mass that the discounts of single words have freed. alpha(h) is what the
seen pairs of h leave over, divided by what single words give to all words not seen after h, so every history sums to one over
the vocabulary and the unknown word. A history that was never seen passes on to p(w) as it is. A text begins after a start mark,
which is never predicted, and ends with an end token, which is.

How it runs. Texts become blocks of about a million tokens, written once. Each block asks, for its distinct words and pairs, the parts
that own their hashes: a part adds up what the blocks counted, keeps the table of its n-grams, and answers each block in the order
it asked. With the counts known a block scores every seen pair at once. For alpha, one block per pair (the first that has it)
hands the pair's shares to the part that owns the history, and blocks ask there for the histories of unseen pairs. A frequent
word or pair costs a part one entry per block. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.session import stage

from .common import fold_remainder, lower_ascii_text, words_of
from .rolling import WordHashes, pack, unpack

BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1_500_000
#: Counts up to this one are in the Good-Turing fit; larger ones are discounted by the fitted line.
FIT_COUNTS = 256
#: Counts up to this one take the Turing estimate itself where it is sound.
TURING_COUNTS = 5
END, START = np.uint64(0x3C0F5A7E11D2B96D), np.uint64(0x85A308D313198A2E)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Discount:
    """Good-Turing: a count r becomes r * d(r). The Turing estimate (r + 1) n(r + 1) / n(r) serves for the smallest counts while it lies
    between 0 and r; a line through log n(r) serves for all others, its slope below -1 so that every count gives something up."""

    def __init__(self, n_of: np.ndarray):
        """n_of[r - 1]: how many n-grams were seen r times."""
        r = np.flatnonzero(n_of) + 1
        slope = -1.5
        if len(r) > 2:
            gap = np.r_[r[1] - r[0], (r[2:] - r[:-2]) / 2, r[-1] - r[-2]]  # spreads what few large counts there are
            slope = np.polyfit(np.log(r), np.log(n_of[r - 1] / gap), 1)[0]
        self.power = min(slope, -1.05) + 1
        self.small = np.ones(TURING_COUNTS + 1)
        for k in range(1, TURING_COUNTS + 1):
            turing = (k + 1) * n_of[k] / n_of[k - 1] if n_of[k - 1] else 0.0
            self.small[k] = turing / k if 0 < turing < k else (1 + 1 / k) ** self.power

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """d of each count; 1 for 0."""
        c = np.asarray(c)
        out = (1 + 1 / np.maximum(c, 1)) ** self.power
        few = c <= TURING_COUNTS
        out[few] = self.small[c[few].astype(np.int64)]
        return out


# ---- blocks

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("vocab", pa.binary()), ("ids", pa.binary()), ("tokens", pa.int64())])
_BLOCK_SQL = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, vocab binary, ids binary, tokens long"


def _make_blocks(block_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        hashes = WordHashes()
        block = TaskContext.get().partitionId() << 12
        held, ids, tokens, n = [], [], [], 0

        def close():
            lengths = np.array([len(t) for t in tokens], np.int32)
            vocab, at = np.unique(np.concatenate(tokens), return_inverse=True)
            row = (block, ids, held, lengths, pack(vocab), pack(at.astype(np.uint32)), int(lengths.sum()))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc_id, own, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["text"], strict=True):
                t = np.append(hashes.of(words_of(lower_ascii_text(text.as_py() or ""))), END)
                ids.append(doc_id)
                held.append(own)
                tokens.append(t)
                n += len(t)
                if n >= block_tokens:
                    yield close()
                    block += 1
                    held, ids, tokens, n = [], [], [], 0
        if tokens:
            yield close()

    return run


class _Tokens:
    """A block's tokens, its distinct words and pairs, and how often its learning documents have them."""

    def __init__(self, row):
        self.block = row["block"].as_py()
        self.doc_ids = row["doc_ids"].as_py()
        self.held = np.array(row["held"].as_py(), bool)
        self.lengths = np.array(row["lengths"].as_py(), np.int64)
        self.vocab = unpack(row["vocab"], np.uint64)
        self.ids = unpack(row["ids"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.r_[0, self.ids[:-1]]
        self.before[self.starts] = len(self.vocab)
        self.histories = np.append(self.vocab, START)
        keys = _pair_keys(self.histories[self.before], self.vocab[self.ids])
        self.pairs, self.first, self.pair_of = np.unique(keys, return_index=True, return_inverse=True)
        self.learns = np.repeat(~self.held, self.lengths)

    def counts(self):
        return np.bincount(self.ids[self.learns], minlength=len(self.vocab)), np.bincount(self.pair_of[self.learns], minlength=len(self.pairs))


def _rows(table):
    """The rows of a pyarrow table or batch as dicts of scalars."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            yield {name: c[i] for name, c in columns.items()}


_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])


def _ask(parts: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                t = _Tokens(row)
                c1, c2 = t.counts()
                e1, e2 = (np.searchsorted(_part(k, parts), np.arange(parts + 1)) for k in (t.vocab, t.pairs))
                out = []
                for p in range(parts):
                    a, b = slice(e1[p], e1[p + 1]), slice(e2[p], e2[p + 1])
                    if a.stop > a.start or b.stop > b.start:
                        out.append((p, t.block, pack(t.vocab[a]), pack(c1[a].astype(np.uint64)), pack(t.pairs[b]), pack(c2[b].astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ASK, strict=True)], schema=_ASK)

    return run


_ANSWER = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary()), ("mine", pa.binary()), ("n_words", pa.list_(pa.int64())), ("n_pairs", pa.list_(pa.int64())), ("vocab", pa.int64()), ("tokens", pa.int64())])
_ANSWER_SQL = "part int, block long, words binary, word_counts binary, pairs binary, pair_counts binary, mine binary, n_words array<long>, n_pairs array<long>, vocab long, tokens long"
#: The row of a part's own n-gram table.
TABLE = -1


def _total(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys, their totals, the total of each entry, and whether an entry is the first of its key with a count."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    ks, cs = k[order], c[order]
    new = np.r_[True, ks[1:] != ks[:-1]] if len(ks) else np.empty(0, bool)
    at = np.flatnonzero(new)
    if not len(ks):
        return ks, cs, cs, new
    sums, group = np.add.reduceat(cs, at), np.cumsum(new) - 1
    place = np.where(cs > 0, np.arange(len(cs)), len(cs))
    first = np.minimum.reduceat(place, at)
    total, mine = np.empty(len(k), np.int64), np.zeros(len(k), bool)
    total[order] = sums[group]
    mine[order[first[first < len(cs)]]] = True
    return ks[at], sums, total, mine


def _answer(key, asked):
    rows = sorted(_rows(asked), key=lambda r: r["block"].as_py())
    words, word_counts, pairs, pair_counts = ([unpack(r[n], np.uint64) for r in rows] for n in ("words", "word_counts", "pairs", "pair_counts"))
    k1, s1, t1, _ = _total(words, word_counts)
    k2, s2, t2, mine = _total(pairs, pair_counts)
    part, out, a, b = key[0].as_py(), [], 0, 0
    for r, w, p in zip(rows, words, pairs, strict=True):
        own = np.packbits(mine[b : b + len(p)])
        out.append((part, r["block"].as_py(), None, pack(t1[a : a + len(w)].astype(np.uint64)), None, pack(t2[b : b + len(p)].astype(np.uint64)), pack(own), None, None, None, None))
        a, b = a + len(w), b + len(p)
    k1, s1, k2, s2 = k1[s1 > 0], s1[s1 > 0], k2[s2 > 0], s2[s2 > 0]
    n_of = lambda s: np.bincount(s[s <= FIT_COUNTS], minlength=FIT_COUNTS + 1)[1:]
    out.append((part, TABLE, pack(k1), pack(s1.astype(np.uint64)), pack(k2), pack(s2.astype(np.uint64)), None, n_of(s1), n_of(s2), len(k1), int(s1.sum())))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


class Model:
    """What all tasks need to know of the corpus: a few hundred numbers."""

    def __init__(self, n_words: np.ndarray, n_pairs: np.ndarray, vocab: int, tokens: int, texts: int):
        self.words, self.pairs = Discount(n_words), Discount(n_pairs)
        self.vocab, self.tokens, self.texts, self.unknown = vocab, tokens, texts, 1.0

    def single(self, c: np.ndarray) -> np.ndarray:
        """p(w) of words with these counts."""
        return np.where(c > 0, self.words(c) * c / max(self.tokens, 1), self.unknown)


_SHARE = pa.schema([("part", pa.int32()), ("histories", pa.binary()), ("given", pa.binary()), ("covered", pa.binary()), ("wanted", pa.binary()), ("wanted_uid", pa.binary()), ("wanted_n", pa.binary()),
                    ("uid", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("partial", pa.list_(pa.float64()))])
_SHARE_SQL = "part int, histories binary, given binary, covered binary, wanted binary, wanted_uid binary, wanted_n binary, uid long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, partial array<double>"


def _share(model: Model, parts: int):
    def run(key, block, answers):
        t = _Tokens(next(_rows(block)))
        c1, c2, mine = np.zeros(len(t.vocab), np.int64), np.zeros(len(t.pairs), np.int64), np.zeros(len(t.pairs), bool)
        e1, e2 = (np.searchsorted(_part(k, parts), np.arange(parts + 1)) for k in (t.vocab, t.pairs))
        for r in _rows(answers):
            p = r["part"].as_py()
            a, b = slice(e1[p], e1[p + 1]), slice(e2[p], e2[p + 1])
            c1[a], c2[b] = unpack(r["word_counts"], np.uint64), unpack(r["pair_counts"], np.uint64)
            mine[b] = np.unpackbits(unpack(r["mine"], np.uint8), count=b.stop - b.start)
        p1 = model.single(c1)
        seen_before = np.append(c1, model.texts)
        h_of, w_of = t.before[t.first], t.ids[t.first]  # of each distinct pair
        share = np.where(c2 > 0, model.pairs(c2) * c2 / np.maximum(seen_before[h_of], 1), 0)
        log_pair = np.where(c2 > 0, np.log10(np.where(c2 > 0, share, 1)), np.log10(p1[w_of]))
        add = lambda x: np.add.reduceat(x, t.starts)
        uid = t.block << 21
        fields = (uid, t.doc_ids, t.held.tolist(), t.lengths, add((c1[t.ids] > 0).astype(np.int64)), add(np.log10((c1 + 1) / (model.tokens + model.vocab + 1))[t.ids]), add(log_pair[t.pair_of]))
        own = np.flatnonzero(mine)
        n = len(t.histories)
        has = np.flatnonzero(np.bincount(h_of[own], minlength=n))
        given, covered = (np.bincount(h_of[own], x[own], n)[has] for x in (share, p1[w_of]))
        doc = np.repeat(np.arange(len(t.lengths)), t.lengths)
        back = (c2[t.pair_of] == 0) & (seen_before[t.before] > 0)
        want, want_n = np.unique(np.stack([t.before[back], doc[back]]), axis=1, return_counts=True)
        by = np.argsort(t.histories[has])
        has, given, covered = has[by], given[by], covered[by]
        by = np.argsort(t.histories[want[0]], kind="stable")
        want, want_n = want[:, by], want_n[by]
        hk, wk = t.histories[has], t.histories[want[0]]
        e1, e2 = (np.searchsorted(_part(k, parts), np.arange(parts + 1)) for k in (hk, wk))
        out = []
        for p in range(parts):
            a, b = slice(e1[p], e1[p + 1]), slice(e2[p], e2[p + 1])
            mark = fields if p == t.block % parts else (None,) * 7
            if a.stop > a.start or b.stop > b.start or mark[0] is not None:
                out.append((p, pack(hk[a]), pack(given[a]), pack(covered[a]), pack(wk[b]), pack((want[1][b] + uid).astype(np.uint64)), pack(want_n[b].astype(np.uint32)), *mark))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SHARE, strict=True)], schema=_SHARE)

    return run


_SCORE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("add", pa.float64())])
_SCORE_SQL = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, add double"


def _back_off(unknown: float):
    """Add up alpha in a history's part and apply it to who asked."""

    def run(key, shares):
        rows = list(_rows(shares))
        h, given, covered = (np.concatenate([unpack(r[n], kind) for r in rows]) for n, kind in (("histories", np.uint64), ("given", np.float64), ("covered", np.float64)))
        wanted, uid, n = (np.concatenate([unpack(r[n], kind) for r in rows]) for n, kind in (("wanted", np.uint64), ("wanted_uid", np.uint64), ("wanted_n", np.uint32)))
        known, at = np.unique(h, return_inverse=True)
        alpha = (1 - np.bincount(at, given, len(known))) / np.maximum(1 - np.bincount(at, covered, len(known)), unknown)
        docs, to = np.unique(uid, return_inverse=True)
        add = np.bincount(to, n * np.log10(alpha[np.searchsorted(known, wanted)]), len(docs)) if len(docs) else np.empty(0)
        out = [pa.table([docs.astype(np.int64), *(pa.nulls(len(docs), f.type) for f in list(_SCORE)[1:-1]), add], schema=_SCORE)]
        for r in rows:
            if r["uid"].is_valid:
                ids = r["doc_ids"].as_py()
                out.append(pa.table([pa.array(range(r["uid"].as_py(), r["uid"].as_py() + len(ids)), pa.int64()), pa.array(ids, pa.int64()), *(pa.array(r[c].as_py(), f.type) for c, f in zip(("held", "n_tokens", "n_known", "base", "partial"), list(_SCORE)[2:], strict=True))], schema=_SCORE))
        return pa.concat_tables(out)

    return run


def _sum_of_shares(model: Model):
    """Of a part's word table: how much of p(w) the words seen take."""

    def run(batches):
        for batch in batches:
            sums = [float((model.words(c) * c).sum() / max(model.tokens, 1)) for c in (unpack(v, np.uint64).astype(np.int64) for v in batch["word_counts"])]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64())], names=["share"])

    return run


def count_tables(docs: DataFrame, modulus: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame, int]:
    """The blocks, the answers with the n-gram tables (rows with block = -1: ascending hashes and counts of a part's words and pairs), and the
    number of parts. Both are written."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = stage(rows.mapInArrow(_make_blocks(block_tokens), _BLOCK_SQL))
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(-(-tokens // part_tokens), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = blocks.mapInArrow(_ask(parts), "part int, block long, words binary, word_counts binary, pairs binary, pair_counts binary")
    return blocks, stage(asked.groupBy("part").applyInArrow(_answer, _ANSWER_SQL)), parts


def score(docs: DataFrame, modulus: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) modulo ``modulus`` is not ``held`` and score all: doc_id, held_out, n_tokens (words and the
    end), n_known, train_tokens, base_score (add-one single words) and score, both log10 of the whole text's probability.

    A null text counts as empty: its one token is the end. A row without a doc_id is learned from. Repeated rows count and are scored as often
    as they stand. If nothing is learned from, every token is unknown with probability 1. Only doc_id and text are read.
    """
    blocks, answers, parts = count_tables(docs, modulus, held, block_tokens, part_tokens)
    tables = answers.where(F.col("block") == TABLE)
    n_of = {}
    for name in ("n_words", "n_pairs"):
        n_of[name] = np.zeros(FIT_COUNTS)
        for r in tables.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
            n_of[name][r.pos] = r.n
    vocab, tokens = (x or 0 for x in tables.agg(F.sum("vocab"), F.sum("tokens")).first())
    texts = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    model = Model(n_of["n_words"], n_of["n_pairs"], vocab, tokens, texts)
    if tokens:
        model.unknown = 1 - tables.select("word_counts").mapInArrow(_sum_of_shares(model), "share double").agg(F.sum("share")).first()[0]
    shares = blocks.groupBy("block").cogroup(answers.where(F.col("block") != TABLE).select("part", "block", "word_counts", "pair_counts", "mine").groupBy("block")).applyInArrow(_share(model, parts), _SHARE_SQL)
    scored = shares.groupBy("part").applyInArrow(_back_off(model.unknown), _SCORE_SQL)
    first = lambda c: F.max(c).alias(c)  # noqa: E731  one row of a uid has them
    return scored.groupBy("uid").agg(*map(first, ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), F.sum("add").alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
