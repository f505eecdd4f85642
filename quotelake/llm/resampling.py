"""Target-distribution importance resampling: draw the documents that look most like a target text collection.

Texts become hashed features, runs of one or more words. A bucket's gain is the scaled log ratio of its share among the target's
features and its share among all documents' features, both smoothed by one. A document's weight is the sum of its features' gains,
looked up in one array of a fixed number of buckets, and its score adds Gumbel noise that depends on its id alone: the highest scores
are a draw without replacement in proportion to exp(weight / scale).

The draw needs no global sort. Scores are written once; the cutoff is found by bisection: each step is one job that counts, exactly,
the rows on the near side of a few thresholds between the bounds still open. Rows tied at the cutoff score are cut by doc_id in the
same way, and rows that also share their doc_id by the number they were written under. Only the rows drawn are then range-partitioned
for their ranks. The driver sees counts and thresholds, and one gain per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.session import stage

from .common import lower_ascii

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Thresholds counted in one job: each leaves a sixteenth of the open range.
PROBES = 15
#: Drawn rows of one range partition.
RANK_ROWS = 1 << 20

#: Fixed value: what separates words, after lower-casing A-Z; words are runs of digits, letters and anything beyond ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), lambda w: w != "")


def features_column(words: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats kept."""
    runs = [words]
    for n in range(2, longest + 1):
        # each run takes one more word; the last one finds none and is null
        more = F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(1)))
        runs.append(F.filter(F.zip_with(runs[-1], more, lambda a, b: F.concat(a, F.lit(" "), b)), lambda f: f.isNotNull()))
    return runs[0] if longest == 1 else F.concat(*runs)


def bucket_of(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """bucket, n: how many features of ``texts`` (column text) fall into each bucket. At most ``buckets`` rows a task are shuffled."""
    features = texts.select(F.explode(features_column(words_column(F.col("text")), longest)).alias("feature"))
    return features.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, scale: int = SCALE) -> DataFrame:
    """bucket, gain of the buckets that either side has: floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    both = bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s").join(bucket_counts(target, buckets, longest).withColumnRenamed("n", "t"), "bucket", "full")
    both = stage(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    num = lambda c: c.cast("double")
    share = num(F.col("t") + 1) * num(F.lit(totals.S + buckets)) / (num(F.col("s") + 1) * num(F.lit(totals.T + buckets)))
    return both.select("bucket", F.floor(scale * F.ln(share)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight. The gains travel as one array, whose length is ``buckets`` whatever the corpus holds."""
    of = dict(gain.collect())
    array = F.split(F.lit(",".join(str(of.get(b, 0)) for b in range(buckets))), ",").cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_column(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), features_column(F.col("words"), longest).alias("features"))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + F.get(array, bucket_of(f, buckets)))
    return rows.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), total.alias("weight"))


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise of an id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.ln(-F.ln((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, keys: list[str], k: int, probes: int = PROBES) -> list[int] | None:
    """The ``k``-th row's values of the integer columns ``keys``, smallest first in each, found by counting; None where k is 0.

    ``rows`` must stand written, have no null in ``keys`` and at least k rows. Where no tie is cut the later keys are their largest values.
    """
    found: list[int] = []
    if k <= 0:
        return None
    for key in keys:
        tied = rows.where(F.lit(True)) if not found else rows.where(" and ".join(f"{c} = {v}" for c, v in zip(keys, found)))
        low, high, n = tied.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n == k:
            found.append(high)
            continue
        while low < high:  # the k-th value lies in [low, high]
            at = sorted({low + (high - low) * i // (probes + 1) for i in range(1, probes + 1)} | {low + (high - low) // 2})
            counted = tied.agg(*[F.count(F.when(F.col(key) <= t, 1)) for t in at]).first()
            for t, c in zip(at, counted):
                if c >= k:
                    high = t
                    break
                low = t + 1
        found.append(low)
        k -= tied.where(F.col(key) < low).count()
    return found


def _up_to(keys: list[str], found: list[int]) -> Column:
    """Rows at or before ``found`` in the order of ``keys``."""
    test = F.lit(True)
    for key, v in reversed(list(zip(keys, found))):
        test = (F.col(key) < v) | ((F.col(key) == v) & test)
    return test


def ranked(rows: DataFrame, keys: list[str], n: int, per_part: int = RANK_ROWS) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... along ``keys``: range partitions, written once, each numbered from the rows before it."""
    parts = max(1, -(-n // per_part))
    place = F.monotonically_increasing_id()
    sorted_ = stage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", place))
    part, own = F.shiftright(F.col("__at"), 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # one row a range partition
    return sorted_.withColumn("__part", part).join(F.broadcast(bases) if parts <= 100_000 else bases, "__part").withColumn("rank", (F.col("__base") + own + 1).cast("long")).drop("__at", "__part", "__base")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, scale: int = SCALE, probes: int = PROBES, per_part: int = RANK_ROWS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank counts the drawn ones from the highest score, others have null.

    Of the N documents with at least ``least_words`` words floor(percent * N / 100) are drawn, ties to the smaller doc_id. Equal rows of one
    doc_id tie altogether; each is drawn or not by itself. A null or empty text, or one without words, has no feature, weight 0, and is never
    drawn. A row without a doc_id counts in the corpus but has no score and is not drawn. An empty table gives no row; with an empty target every
    gain compares with the flat share. Only doc_id and text are read, of the target only text.
    """
    w = weights(docs, gains(docs, target, buckets, longest, scale), buckets, longest)
    # the negative score, so that the order of all keys ascends
    rows = stage(w.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale)).withColumn("__late", -F.col("score")).withColumn("__row", F.monotonically_increasing_id()))
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    keys, out = ["__late", "doc_id", "__row"], ["doc_id", "n_features", "weight", "score", "rank"]
    k = rows.where(able).count() * percent // 100
    last = cutoff(rows.where(able), keys, k, probes)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.withColumn("rank", none).select(*out)
    drawn = able & _up_to(keys, last)
    rest = rows.where(~F.coalesce(drawn, F.lit(False))).withColumn("rank", none).select(*out)
    return ranked(rows.where(drawn), keys, k, per_part).select(*out).unionByName(rest)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 is written out: its table follows from the polynomial, and each distinct word is hashed once.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT {_SQL_WORDS} AS w FROM benchmark),
items AS (SELECT doc_id, unnest(w) AS f FROM d), goals AS (SELECT unnest(w) AS f FROM b),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM items UNION SELECT f FROM goals)),
numbers AS (SELECT f, [CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT) FOR i IN range(len(h) // 2)] AS n FROM bytes),
hashed AS (SELECT f, CAST(xor(list_reduce(n, lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) % 10000 AS bucket FROM numbers, crc_table),
s AS (SELECT bucket, count(*) AS s FROM items JOIN hashed USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM goals JOIN hashed USING (f) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM items) AS big_s, (SELECT count(*) FROM goals) AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS g FROM s FULL JOIN t USING (bucket), totals),
weighed AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM items JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || left(sha256('2024:' || d.doc_id), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
