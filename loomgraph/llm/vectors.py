"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors are one node. A node falls into one bucket of each table; buckets are made of ids and codes alone, and only
what shares one with others is compared, with its vector, in double precision: large buckets in blocks, each pair in
the first table that brings it together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch, by_key
from .buckets import dealt, first_met, roots
from .shared import column, components, cut, least_ids, mix, numbers, slots

BLOCK = 512


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """How many tables find a pair at the threshold with that recall."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def hashed(bits: int, tables: int, seed: int):
    """For mapInArrow: (vec_id, unit, s1, s2, codes); unit is null where the vector links with nothing."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for b in batches:
            vectors = b.column(1).to_pylist()
            units: list = [None] * len(vectors)
            codes: list = [None] * len(vectors)
            s = np.zeros((2, len(vectors)), np.uint64)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                m = np.array([vectors[i] for i in at], np.float64)
                good = np.isfinite(m).all(1) & (m != 0).any(1)
                at, m = np.array(at)[good], m[good]
                if not len(at):
                    continue
                m = m / np.abs(m).max(1, keepdims=True)
                m = m / np.linalg.norm(m, axis=1, keepdims=True) + 0.0
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, bits * tables))
                sign = (m @ planes[size] >= 0).reshape(len(at), tables, bits)
                code = mix(sign @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)) + numbers(23, size)[-1]).view(np.int64)  # the length too
                word = m.view(np.uint64)
                with np.errstate(over="ignore"):
                    for k in (0, 1):
                        s[k, at] = mix((mix(word + np.uint64(k)) * (numbers(21 + k, size) | np.uint64(1))).sum(1) + np.uint64(size))
                for i, u, c in zip(at.tolist(), m, code):
                    units[i], codes[i] = u.tobytes(), c.tolist()
            yield batch(vec_id=b.column(0), unit=pa.array(units, pa.binary()), s1=pa.array(s[0].view(np.int64)), s2=pa.array(s[1].view(np.int64)), codes=pa.array(codes, pa.list_(pa.int64())))

    return run


def compare(threshold: float):
    """For by_key over (tree, key, bi, bj): partial link counts and a forest of the pairs first met in this table."""

    def one(key, c):
        node, mult, block = (np.asarray(c[k]).astype(np.int64) for k in ("node", "mult", "block"))
        m = np.frombuffer(b"".join(c["unit"].to_pylist()), np.float64).reshape(len(node), -1)  # a code tells the length too
        near = (m @ m.T >= threshold) & first_met(c["earlier"], block, key[2] == key[3])
        hit = near.any(1)
        if hit.any():
            yield batch(node=pa.array(node[hit]), links=pa.array((near @ mult)[hit]), root=pa.array(roots(node, near)[hit]))

    return one


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99, bits: int | None = None, seed: int = 5) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Pairs found with a cosine of at least the threshold are linked; a pair at the threshold itself is found with the recall
    asked for, closer ones more often. Vectors of other lengths are never linked; a vector that is null, empty or zero or
    holds null or non-finite components links with nothing. Equal rows are one vector; different vectors under one id are several, each
    with its own links, and component ids are the smallest of the rows that are joined. Rows without an id get no links and a null component. bits defaults to what leaves few vectors that are not near ones in a bucket, however many there are."""
    spark = vectors.sparkSession
    base = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vec_col).cast("array<double>").alias("v"))
    if bits is None:
        bits = min(62, max(6, math.ceil(math.log2(max(1, base.count()))) + 2))  # a signature is a long; 2^60 vectors fill it
    tables = tables_for(bits, threshold, recall)
    made = cut(base.mapInArrow(hashed(bits, tables, seed), "vec_id long, unit binary, s1 long, s2 long, codes array<long>"))
    usable = made.where("unit is not null and vec_id is not null")
    # a node is a content: one id may stand on several, so nodes are named by hashes and get ids at the end
    same = usable.groupBy("s1", "s2").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("mult"), F.any_value("unit").alias("unit"), F.any_value("codes").alias("codes"))
    same = cut(same.withColumn("node", F.xxhash64("s1", "s2")))
    hung = same.select("node", F.posexplode("codes").alias("tree", "key"))
    full = hung.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("tree", "key")
    rows = hung.join(full, ["tree", "key"]).join(same.select("node", "codes"), "node")
    rows = rows.select("tree", "key", "node", F.lit(1).alias("weight"), F.slice("codes", 1, F.col("tree")).alias("earlier"))
    shipped = cut(dealt(rows, BLOCK, BLOCK)).join(same.select("node", "mult", "unit"), "node").select("tree", "key", "bi", "bj", "node", "mult", "block", "unit", "earlier")
    sorted_ = shipped.repartition(slots(spark), "tree", "key", "bi", "bj").sortWithinPartitions("tree", "key", "bi", "bj")
    found = cut(sorted_.mapInArrow(by_key(4, compare(threshold)), "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = same.join(counts, "node", "left").join(least_ids(classes, same), "node", "left")
    nodes = nodes.select("s1", "s2", "mult", "links", F.coalesce("component_id", "least").alias("component_id"))
    linked = usable.select("vec_id", "s1", "s2").join(nodes, ["s1", "s2"])
    linked = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
    alone = made.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
