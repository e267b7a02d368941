"""Sparse postings, stored: lists by slot, highest weight first, cut into blocks of which an upper bound is kept.

A search reads the first block of each of its slots and has a score that the last of the k best reaches. With m slots, a node that
reaches it gains an m-th of it in some slot, so blocks whose bound times the query's weight is less are not read in the second pass;
nodes that could still reach the score are looked up in them at the end, if there are such blocks. The answer is exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import drop_others, exists, publish
from . import rank

BLOCK = 512
#: Partition folders: a search opens those of its slots.
FOLDERS = 64
#: Slots of a query that are broadcast; a longer query is joined by a shuffle.
QUERY_SLOTS = 100_000
#: Sums of the same numbers in another order differ by less, relatively.
SLACK = 1e-9


@dataclass(frozen=True)
class Postings:
    spark: SparkSession
    path: str
    stamp: str

    def _read(self, name: str, slots: list[int] | None) -> DataFrame:
        t = self.spark.read.parquet(f"{self.path}/{name}")
        if slots is not None:
            t = t.where(F.col("folder").isin(sorted({s % FOLDERS for s in slots})) & F.col("slot").isin(slots))
        return t

    def of(self, slots: list[int] | None = None) -> DataFrame:
        """(node_id, slot, weight) of some slots: their folders alone are opened."""
        return self._read("lists", slots).select("node_id", "slot", "weight")

    def search(self, query: DataFrame, k: int) -> DataFrame:
        """(id, score): the k best sums of weight times query weight over (slot, weight); weights are 0 or more. Scores tie by rank.DIGITS."""
        asked = query.where("weight > 0").groupBy("slot").agg(F.sum("weight").alias("q"))
        some = asked.limit(QUERY_SLOTS + 1).collect()
        few = len(some) <= QUERY_SLOTS
        slots = sorted(r["slot"] for r in some) if few else None
        terms = F.broadcast(asked) if few else asked
        m = max(len(some) if few else asked.count(), 1)
        sums = lambda t: t.groupBy(F.col("node_id").alias("id")).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
        last = lambda t: t.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        bounds = self._read("bounds", slots).join(terms, "slot").withColumn("most", F.col("most") * F.col("q"))
        lists = self._read("lists", slots).join(terms, "slot")
        first = last(sums(lists.where("head")))
        # scores that round alike tie, so one a little below the least of the best may come before it
        bound = (first["least"] if first["n"] == k else 0.0) * (1 - SLACK) - 10.0**-rank.DIGITS
        unread = bounds.where(F.col("most") < F.lit(bound / m))
        if bound <= 0 or not unread.take(1):
            return rank.top(sums(lists), k, rank.DIGITS)
        rests = F.broadcast(unread.groupBy("slot").agg(F.max("most").alias("rest"))) if few else unread.groupBy("slot").agg(F.max("most").alias("rest"))
        rest = unread.groupBy("slot").agg(F.max("most").alias("rest")).agg(F.sum("rest")).first()[0]
        read = lists.where(F.col("block_most") * F.col("q") >= F.lit(bound / m)).join(rests, "slot", "left")
        met = read.groupBy(F.col("node_id").alias("id")).agg(F.sum(F.col("weight") * F.col("q")).alias("score"), F.sum(F.coalesce("rest", F.lit(0.0))).alias("seen"))
        able = met.where(F.col("score") + F.lit(rest) - F.col("seen") >= F.lit(bound))
        more = lists.where(F.col("block_most") * F.col("q") < F.lit(bound / m)).join(able.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        return rank.top(sums(more).unionByName(able.select("id", "score")).groupBy("id").agg(F.sum("score").alias("score")), k, rank.DIGITS)


def build(vectors: DataFrame, path: str, stamp: str) -> Postings:
    """Stores (node_id, slot, weight): one row for each node and slot, weights 0 or more. A frequent slot's list spans several
    partitions, each with blocks of its own. The head that `load` looks for is written last."""
    spark, path = vectors.sparkSession, f"{path}/{stamp}"
    order = ("folder", "slot", F.desc("weight"), "node_id")
    own = vectors.where("weight > 0").withColumn("folder", F.pmod("slot", F.lit(FOLDERS)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(bounded, f"{kinds}, block_most double, head boolean")
    own.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    bounds = lists.groupBy("folder", "slot", F.col("block_most").alias("most")).agg(F.count(F.lit(1)).alias("n"))
    bounds.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/bounds")
    spark.createDataFrame([(stamp,)], "stamp string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return Postings(spark, path, stamp)


def bounded(batches):
    """For mapInArrow over partitions sorted by slot and falling weight: rows with the greatest weight of their block, and whether it
    is the slot's first block of this partition."""
    slot, at, most = None, 0, 0.0
    for b in batches:
        if not b.num_rows:
            continue
        slots, weight = np.asarray(b.column("slot")), np.asarray(b.column("weight"))
        cuts = np.concatenate(([0], np.flatnonzero(slots[1:] != slots[:-1]) + 1, [len(slots)]))
        bound, head = np.empty(len(slots)), np.empty(len(slots), bool)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if slots[begin] != slot:
                slot, at, most = slots[begin], 0, weight[begin]
            place = at + np.arange(end - begin)
            heads = np.flatnonzero(place % BLOCK == 0)  # falling weights: the first of a block is its greatest
            values = np.concatenate(([most], weight[begin + heads]))
            bound[begin:end] = values[np.searchsorted(heads, np.arange(end - begin), "right")]
            head[begin:end] = place < BLOCK
            at, most = at + end - begin, bound[end - 1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(head)], names=[*b.schema.names, "block_most", "head"])


def load(spark: SparkSession, path: str, stamp: str) -> Postings | None:
    """The stored postings of that snapshot; none if there are none, or only another one's."""
    return Postings(spark, f"{path}/{stamp}", stamp) if exists(spark, f"{path}/{stamp}/head/_SUCCESS") else None


def opened(vectors, path: str, stamp: str, spark: SparkSession) -> Postings:
    """The stored postings of that snapshot, built first if they are not there; vectors: a function that makes them. Postings of other
    snapshots under the path are removed then."""
    found = load(spark, path, stamp)
    if found is None:
        building = f"{path}/building-{uuid.uuid4().hex}"
        build(vectors(), building, stamp)
        publish(spark, f"{building}/{stamp}", f"{path}/{stamp}")
        drop_others(spark, path, stamp)
        found = load(spark, path, stamp)
    return found
