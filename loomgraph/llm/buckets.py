"""Rows that share a bucket of one of several hash tables, dealt to blocks of bounded size for exact comparison.

A pair is compared where it meets first: `earlier` lists a row's keys in the buckets that come before this one, and a pair
that agrees in one of them has met there. Rows that have met all others of their bucket before are left out, and of a
bucket too large for one block the rows that have all met one another meet the others only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, slots

#: Bits of a long that say in which earlier buckets a row agrees with the first row of a large bucket; more save no more work.
BITS = 62


def dealt(rows: DataFrame, rows_of_block: int, weight_of_block: int) -> DataFrame:
    """(tree, key, bi, bj, node, block, earlier) of rows (tree, key, node, weight, earlier): each row once for each pair of blocks."""
    spark, bucket = rows.sparkSession, ["tree", "key"]
    rows = rows.select(*bucket, "node", F.col("weight").cast("long").alias("weight"), "earlier").repartition(slots(spark), *bucket).sortWithinPartitions(*bucket)
    schema = "tree int, key long, node long, weight long, earlier array<long>, large boolean"
    rows = cut(rows.withColumn("tree", F.col("tree").cast("int")).mapInArrow(small(rows_of_block, weight_of_block), schema))
    zero = F.lit(0)
    out = rows.where("not large").select(*bucket, zero.alias("bi"), zero.alias("bj"), "node", zero.alias("block"), "earlier")
    return out.unionByName(_large(rows.where("large").drop("large"), rows_of_block, weight_of_block))


def small(rows_of_block: int, weight_of_block: int):
    """For mapInArrow over rows sorted by bucket: those with a pair that meets first here; large: their bucket is more than one block,
    and passed on as it is read."""

    def kept(b, last: bool):
        """(rows of whole buckets that stay, which of them are of large ones, first row of the bucket that may go on)."""
        tree, key, weight = (np.asarray(b.column(k)) for k in ("tree", "key", "weight"))
        cuts = np.concatenate(([0], np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1])) + 1, [len(key)]))
        if not last:
            cuts = cuts[:-1]
        at, size = cuts[:-1], np.diff(cuts)
        heavy = np.concatenate(([0], np.cumsum(weight)))
        large = (size > rows_of_block) | ((heavy[cuts[1:]] - heavy[at] > weight_of_block) & (size > 1))
        flat, ends = np.asarray(b.column("earlier").values), np.asarray(b.column("earlier").offsets)
        stay = np.repeat(large, size)
        for k in np.flatnonzero(~large & (size > 1)).tolist():
            x, n = int(at[k]), int(size[k])
            keys = flat[ends[x] : ends[x + n]].reshape(n, -1)
            stay[x : x + n] = apart(keys).any(1) if keys.shape[1] else True
        rows = np.flatnonzero(stay)
        return rows, np.repeat(large, size)[rows], int(cuts[-1]), int(len(key) - cuts[-1]), int(heavy[-1] - heavy[cuts[-1]])

    def marked(b, rows, large):
        t = b.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*t.columns, pa.array(large)], names=[*t.schema.names, "large"])

    def run(batches):
        held, going = None, None  # rows of a bucket that may go on; a large one, passed on as it is read
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                held = None
            if not b.num_rows:
                continue
            if going is not None:
                more = (np.asarray(b.column("tree")) == going[0]) & (np.asarray(b.column("key")) == going[1])
                n = int(more.sum())  # sorted: they are the first ones
                if n:
                    yield marked(b, np.arange(n), np.ones(n, bool))
                    b = b.slice(n)
                if not b.num_rows:
                    continue
                going = None
                b = pa.RecordBatch.from_arrays([c if c.offset == 0 else pa.concat_arrays([c]) for c in b.columns], schema=b.schema)
            rows, large, begin, left, weight = kept(b, False)
            if len(rows):
                yield marked(b, rows, large)
            if left > rows_of_block or (weight > weight_of_block and left > 1):
                going = (b.column("tree")[begin].as_py(), b.column("key")[begin].as_py())
                yield marked(b, np.arange(begin, b.num_rows), np.ones(left, bool))
            else:
                held = b.take(pa.array(np.arange(begin, b.num_rows)))
        if held is not None and held.num_rows:
            rows, large, *_ = kept(held, True)
            if len(rows):
                yield marked(held, rows, large)

    return run


def _large(rows: DataFrame, rows_of_block: int, weight_of_block: int) -> DataFrame:
    """The same for rows of buckets of more than one block."""
    bucket = ["tree", "key"]
    head = rows.groupBy(*bucket).agg(F.min_by("earlier", "node").alias("head"))
    agree = f"aggregate(transform(slice(earlier, 1, {BITS}), (x, i) -> if(x = head[i], shiftleft(1L, i), 0L)), 0L, (a, x) -> a + x)"
    rows = cut(rows.join(head, bucket).withColumn("agree", F.expr(agree)).drop("head"))
    places = F.expr(f"filter(sequence(0, {BITS - 1}), i -> (agree & shiftleft(1L, i)) != 0)")
    often = rows.select(*bucket, F.explode(places).alias("place")).groupBy(*bucket, "place").agg(F.count(F.lit(1)).alias("often"))
    best = often.groupBy(*bucket).agg(F.max_by("place", "often").alias("place"))
    rows = rows.join(best, bucket, "left").withColumn("met", F.coalesce(F.expr("(agree & shiftleft(1L, place)) != 0"), F.lit(False)))
    size = rows.groupBy(*bucket, "met").agg(F.count(F.lit(1)).alias("m"), F.sum("weight").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / rows_of_block), F.ceil(F.col("w") / weight_of_block)).cast("int")
    size = size.groupBy(*bucket).agg(F.sum(F.when(~F.col("met"), blocks).otherwise(0)).alias("own"), F.sum(F.when(F.col("met"), blocks).otherwise(0)).alias("rest"))
    rows = rows.join(size.where("own > 0"), bucket)
    at = F.xxhash64("node")
    block = F.when(F.col("met"), F.col("own") + F.pmod(at, "rest")).otherwise(F.pmod(at, "own")).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("met"), F.col("own") - 1).otherwise(F.col("own") + F.col("rest") - 1).cast("int"))
    pair = F.transform(others, lambda j: F.struct(F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj")))
    rows = rows.withColumn("block", block).select(*bucket, "node", "block", "earlier", F.explode(pair).alias("pair"))
    return rows.select(*bucket, "pair.bi", "pair.bj", "node", "block", "earlier")


def first_met(earlier, block: np.ndarray, one: bool) -> np.ndarray:
    """Which pairs of rows meet here and in no bucket before. one: the rows are of one block, else of two."""
    n = len(block)
    new = ~np.eye(n, dtype=bool) if one else block[:, None] != block[None, :]
    return new & apart(np.asarray(earlier.flatten()).reshape(n, -1)) if n else new


def apart(keys: np.ndarray) -> np.ndarray:
    """Which rows have no key in common, place by place."""
    n = len(keys)
    if n <= 48:
        return (keys[:, None, :] != keys[None, :, :]).all(2)
    new = np.ones((n, n), bool)
    for k in range(keys.shape[1]):
        new &= keys[:, k][:, None] != keys[:, k][None, :]
    return new


def roots(node: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each row the least node that it is joined with."""
    root = np.empty(len(node), np.int64)
    order = np.argsort(node, kind="stable")
    root[order] = np.arange(len(node))  # rank by node, so that the least root is the least node
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(node)).min(1, initial=len(node)))
        if (low == root).all():
            return node[order][root]
        root = low
