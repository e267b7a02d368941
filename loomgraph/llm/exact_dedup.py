"""Exact dedup over an extendible-hash index; DataFrame operations only.

The index is a table of (key, doc_id, digest) in the shared folder. Its directory is a table too: a slot for each prefix of
the keys, and the bucket that owns it. The directory doubles for as long as a bucket holds more distinct keys than its
capacity, and only overfull buckets are split. A bucket is a range of keys with one owner. Texts whose key occurs once are
done; those of repeated keys go to the owners, which compare their bytes and chain what differs under one key. A
document's group, its size and the document that stays are those of its chain link.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SPACE, Scratch, column, cut, slots

#: Keys that repeat are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_KEYS = 250_000
#: Copies of a text are summed up in so many parts before they reach its owner, which compares them.
PARTS = 4


def prefix(key, bits):
    """The leading bits of a key; 0 for none. A shift by 64 is one by 0, so it is done in two."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 1), 63 - bits)


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((slot, bucket, local), depth): the bucket that owns each slot, named by its first slot, and its own depth.

    keys: the distinct keys. A slot is a prefix of `depth` bits; slots without keys are left out."""
    total = keys.count()
    depth = math.ceil(math.log2(total / capacity)) + 2 if total > capacity else 0
    while True:
        count = cut(keys.groupBy(prefix("key", depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
        if depth >= 63 or not count.where(F.col("n") > capacity).take(1):
            break
        depth += 1
    out = count.select("slot", F.lit(depth).alias("local"))
    for local in range(depth - 1, -1, -1):  # the shortest prefix that isn't overfull
        above = count.groupBy(F.shiftright("slot", depth - local).alias("above")).agg(F.sum("n").alias("n")).where(F.col("n") <= capacity)
        if not above.take(1):
            break
        fits = above.select("above", F.lit(True).alias("fits"))
        out = out.join(fits, F.shiftright("slot", depth - local) == F.col("above"), "left")
        out = out.select("slot", F.when(F.col("fits"), F.lit(local)).otherwise(F.col("local")).alias("local"))
    first = F.expr(f"shiftleft(shiftright(slot, {depth} - local), {depth} - local)")
    return out.select("slot", first.alias("bucket"), "local"), depth


def chained(texts: DataFrame) -> DataFrame:
    """(bucket, key, norm, keep, size, link) of parts (bucket, key, norm, keep, size): what each owner finds.

    Under one key texts are compared byte by byte with the one before; a text that differs opens the next link."""
    of_key = W.partitionBy("bucket", "key").orderBy("norm")
    differs = F.coalesce(F.lag("norm").over(of_key) != F.col("norm"), F.lit(True))
    links = texts.withColumn("link", F.sum(differs.cast("int")).over(of_key.rowsBetween(W.unboundedPreceding, 0)))
    return links.groupBy("bucket", "key", "link").agg(F.first("norm").alias("norm"), F.min("keep").alias("keep"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 15) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain_link.

    Texts are equal when identical after each run of white space became one space; a null text equals an empty
    one. The smallest id of equal texts stays; an id that occurs in several rows is one document, so all its
    rows say kept. Rows without an id are dropped in favour of one with, and stay where none has one. Empty
    input gives an empty result; other columns are not looked at. Every text is compared whole. bucket is the owner's first
    slot, and chain_link the place in the key's chain; they are null and 1 where the key occurs once."""
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(column(docs, text_col), F.lit("")), SPACE, " ")
    rows = docs.select(column(docs, id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("key"))
    index = Scratch(spark).save(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "index")
    keys = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    owners, depth = directory(keys, capacity)
    repeated = keys.where("n > 1").select("key").withColumn("slot", prefix("key", depth)).join(owners, "slot").select("key", "bucket")
    repeated = cut(repeated)
    few = repeated.count() <= BROADCAST_KEYS
    texts = rows.join(F.broadcast(repeated) if few else repeated, "key")
    # sums over the parts meet the copies where they are read, so that a text of many documents is few rows at its owner
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    parts = texts.groupBy("bucket", "key", "norm", part.alias("part")).agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")).drop("part")
    owned = chained(parts.repartition(slots(spark), "bucket"))
    owned = owned.select("bucket", "key", "link", "keep", "size", F.unhex(F.sha2("norm", 256)).alias("digest"))
    out = index.join(owned, ["key", "digest"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        F.coalesce("link", F.lit(1)).cast("int").alias("chain_link"),
    )
