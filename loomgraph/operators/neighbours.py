"""Nearest neighbours of all vectors by neighbour descent: neighbours of neighbours are tried until few edges change.

The first lists come from runs of vectors that stand together in a random order by signs. In each round every node brings together
the nodes that it lists or that list it, at most 2 k of them, and compares those that have not met there before. A round compares some
k^2 pairs for each node, whatever the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Vectors of one run of the start, all of whose pairs are compared; and how many orders there are.
RUN, ORDERS = 64, 3


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keys(dim: int, bits: int, orders: int, seed: int):
    """For mapInArrow: (id, v, order, key, along) of (id, v): sign bits of a random projection, and a place along one more."""

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, orders * (bits + 1)))
        for b in batches:
            if b.num_rows:
                x = (_matrix(b.column(1)) @ planes).reshape(b.num_rows, orders, bits + 1)
                key = (x[:, :, :bits] >= 0) @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(orders):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key[:, t]), pa.array(x[:, t, bits])], names=["id", "v", "order", "key", "along"])

    return run


def _met(k: int):
    """For mapInArrow over sorted (order, id, v): (src, dst, weight) of the k best of each row within its run. A partition may hold the
    end of one order and the begin of the next one: a run is of one order, so a vector stands in it once."""

    def run(batches):
        for b in batches:
            order = b.column("order").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(order[1:] != order[:-1]) + 1, [b.num_rows])).tolist()
            for at, end in ((at, min(at + RUN, end)) for begin, end in zip(cuts[:-1], cuts[1:]) for at in range(begin, end, RUN)):
                part = b.slice(at, end - at)
                m = _matrix(part.column("v"))
                s = m @ m.T
                np.fill_diagonal(s, -np.inf)
                n = min(k, len(m) - 1)
                if n > 0:
                    near = np.argpartition(-s, n - 1, 1)[:, :n]
                    src = np.repeat(np.arange(len(m)), n)
                    ids = part.column("id")
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(near.ravel())), pa.array(s[src, near.ravel()])], names=["src", "dst", "weight"])

    return run


def _introduced(compared):
    """For mapInArrow over (at, id, v, fresh, worst) sorted by at: pairs of a node's circle that would enter a list of either."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            at = b.column("at").dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
            end = int(cuts[-1]) if len(cuts) else 0
            held = b.slice(end)
            if end:
                yield from circles(b.slice(0, end), np.concatenate(([0], cuts)))
        if held is not None and held.num_rows:
            yield from circles(held, np.array([0, held.num_rows]))

    def circles(b, cuts):
        m, ids = _matrix(b.column("v")), b.column("id")
        fresh, worst = b.column("fresh").to_numpy(zero_copy_only=False), b.column("worst").to_numpy()
        left, right, weight, pairs = [], [], [], 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s = m[x:y] @ m[x:y].T
            new = np.triu(fresh[x:y, None] | fresh[None, x:y], 1)
            pairs += int(new.sum())
            i, j = np.nonzero(new & ((s > worst[x:y, None]) | (s > worst[None, x:y])))
            left.append(i + x)
            right.append(j + x)
            weight.append(s[i, j])
        if compared is not None:
            compared.add(pairs)
        if left:
            a, c, w = pa.array(np.concatenate(left)), pa.array(np.concatenate(right)), pa.array(np.concatenate(weight))
            yield pa.RecordBatch.from_arrays([ids.take(a), ids.take(c), w], names=["src", "dst", "weight"])

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.round("weight", 12).desc(), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def descend(embeddings: DataFrame, k: int, rounds: int = 12, change: float = 0.002, seed: int = 7, compared=None) -> DataFrame:
    """(src, dst, weight): of each vector of (node_id, vector) about its k nearest others by cosine, ties to the smaller id.

    Vectors of one dimension; those that are null or zero, or hold nulls, have no neighbours. Rounds end when fewer than the share `change`
    of all edges is new, or after `rounds`. A node that many list meets the 2 k nearest of them only. compared: an accumulator that counts
    the pairs compared in rounds. Lists may miss some true neighbours: tests hold the recall to 0.9 at least."""
    own = embeddings.where("vector is not null").where(~F.exists("vector", lambda x: x.isNull())).select(F.col("node_id").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = cut(own.withColumn("length", length).where("length > 0").select("id", F.transform("v", lambda x: x / F.col("length")).alias("v")))
    n, first = own.count(), own.select(F.size("v").alias("dim")).first()
    kind = own.schema["id"].dataType.simpleString()
    out = f"src {kind}, dst {kind}, weight double"
    if first is None:
        return own.sparkSession.createDataFrame([], out)
    bits = min(62, max(1, math.ceil(math.log2(max(2, n / RUN)))))
    runs = own.mapInArrow(_keys(first["dim"], bits, ORDERS, seed), f"id {kind}, v array<double>, order int, key long, along double")
    runs = runs.repartitionByRange("order", "key", "along").sortWithinPartitions("order", "key", "along").select("order", "id", "v")
    keep = max(k, 10)  # short lists descend badly
    lists = cut(_best(runs.mapInArrow(_met(keep), out).distinct(), keep).withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        mine = lists.select(F.col("src").alias("at"), F.col("dst").alias("id"), "weight", "fresh")
        other = lists.select(F.col("dst").alias("at"), F.col("src").alias("id"), "weight", "fresh")
        near = F.row_number().over(W.partitionBy("at").orderBy(F.col("weight").desc(), "id"))
        other = other.withColumn("nth", near).where(F.col("nth") <= keep).drop("nth")
        circle = mine.unionByName(other).groupBy("at", "id").agg(F.bool_or("fresh").alias("fresh"))
        worst = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= keep, F.min("weight")).otherwise(-2.0).alias("worst"))
        members = circle.join(own.join(worst, "id", "left"), "id").select("at", "id", "v", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        tried = members.repartition("at").sortWithinPartitions("at").mapInArrow(_introduced(compared), out)
        tried = tried.unionByName(tried.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct().withColumn("fresh", F.lit(True))
        every = lists.select("src", "dst", "weight", F.lit(False).alias("fresh")).unionByName(tried)
        every = every.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.bool_and("fresh").alias("fresh"))  # what was listed before is not fresh
        lists = cut(_best(every, keep))
        if lists.where("fresh").count() <= change * n * keep:
            break
    return lists.where(F.col("rank") <= k).select("src", "dst", "weight")
