"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups are taken by falling size, each to the shard that is least
loaded so far, found in a heap. So that the heap never holds the corpus, a group below a small share of the total joins others in
one of a fixed number of lots by its hash, and lots are scheduled like groups: at most ``2 * lots`` items are scheduled at any
corpus size, and the loads end within about one lot of each other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.session import stage

SHARDS = 40
LOTS = 20_000
OVERHEAD = 16
SLOT_ROWS = 100_000


def longest_first(items: list[tuple[int, object]], shards: int) -> dict:
    """Item -> shard: by falling size (ties by item), each to the least loaded shard (ties to the smaller number).

    >>> longest_first([(5, "a"), (3, "b"), (3, "c"), (2, "d")], 2)
    {'a': 0, 'b': 1, 'c': 1, 'd': 0}
    """
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out[item] = k
    return out


def assign(docs: DataFrame, shards: int = SHARDS, lots: int = LOTS) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of its text plus 16), text_crc32 (unsigned), law, shard, slot (gapless from 0 in a
    shard), grown_shard (null: with another number of shards a new schedule is due) and group_rows.

    A null text counts as empty and goes with the empty ones. Repeated rows are one group. Slots follow doc_id inside blocks of a shard;
    an empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).select(
        "doc_id", (F.length("data") + OVERHEAD).cast("long").alias("size"), F.crc32("data").alias("text_crc32"), F.unhex(F.sha2("data", 256)).alias("group"))
    rows = stage(rows)
    lot = F.pmod(F.xxhash64("group"), F.lit(lots)).cast("int")
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("group_rows")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * lots >= total  # at most ``lots`` groups are
    big = [(r["bytes"], bytes(r["group"])) for r in groups.where(large).select("group", "bytes").collect()]
    small = [(r["bytes"], r["lot"]) for r in groups.where(~large).groupBy(lot.alias("lot")).agg(F.sum("bytes").alias("bytes")).collect()]
    where = longest_first([(n, ("group", g)) for n, g in big] + [(n, ("lot", str(k).encode())) for n, k in small], shards)
    big_table = spark.createDataFrame([(bytearray(g), where["group", g]) for _, g in big], "group binary, big_shard int")
    lot_table = spark.createDataFrame([(k, where["lot", str(k).encode()]) for _, k in small], "lot int, lot_shard int")
    # both tables have at most ``lots`` rows
    placed = rows.withColumn("lot", lot).join(F.broadcast(big_table), "group", "left").join(F.broadcast(lot_table), "lot", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("big_shard", "lot_shard").alias("shard"), "group")
    blocks = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = stage(placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "group"), F.lit(blocks)).cast("int")))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "group")
    return placed.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
