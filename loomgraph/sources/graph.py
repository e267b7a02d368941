"""The property graph over relational tables: nodes by label, typed edges, vectors, sparse vectors, tombstones.

Each label is a projection of its own table, so a filter on the label leaves one scan, and one on a property reaches it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ANCHOR, tag

#: The hashed vocabulary: functions.token_slot and token_weight say which slot and weight a token has.
SLOTS = 1024


def node_id(label: str, key: str | Column) -> Column:
    """Keys padded with zeros, so that ids sort as the keys do."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(label.lower() + ":"), F.lpad(key.cast("string"), 10, "0"))


#: label: (table, key, summary, properties with their kinds)
LABELS = {
    "Doc": ("documents", "doc_id", "substring(text, 1, 200)", {"lang": "s", "source": "s", "n_chars": "i"}),
    "Customer": ("customer", "c_custkey", "c_name", {"c_mktsegment": "s", "c_acctbal": "f"}),
    "Order": ("orders", "o_orderkey", "o_orderpriority", {"o_orderstatus": "s", "o_orderpriority": "s"}),
    "Supplier": ("supplier", "s_suppkey", "s_name", {"s_acctbal": "f"}),
    "Part": ("part", "p_partkey", "p_name", {"p_brand": "s", "p_type": "s", "p_size": "i"}),
    "Nation": ("nation", "n_nationkey", "n_name", {}),
    "Region": ("region", "r_regionkey", "r_name", {}),
    "Event": ("events", "event_id", "event_type", {"event_type": "s"}),
}


class Graph:
    """The tables of a snapshot as DataFrames, or as functions that make them; nothing is opened before a query asks for it."""

    def __init__(self, nodes, edges, embeddings=None, sparse=None, tombstones=None, spark: SparkSession | None = None):
        self.spark = spark or nodes.sparkSession
        self._tables = {"nodes": nodes, "edges": edges, "embeddings": embeddings, "sparse": sparse, "tombstones": tombstones}

    def _table(self, name: str) -> DataFrame | None:
        if callable(self._tables[name]) and not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    nodes = property(lambda self: self._table("nodes"))
    edges = property(lambda self: self._table("edges"))
    embeddings = property(lambda self: self._table("embeddings"))
    sparse = property(lambda self: self._table("sparse"))
    tombstones = property(lambda self: self._table("tombstones"))

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("ntype").isin(*labels))


def label_nodes(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    table, key, summary, props = LABELS[label]
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    pairs = [x for p, kind in props.items() for x in (F.lit(p), tag(p, kind))]
    created = F.unix_micros(F.col("ts").cast("timestamp")) if label == "Event" else F.lit(None).cast("bigint")
    bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return t.select(node_id(label, key).alias("id"), F.lit(label).alias("ntype"), F.expr(summary).alias("summary"), bag.alias("props"), created.alias("created_at"))


def anchor_node(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(ANCHOR).alias("id"), F.lit("Doc").alias("ntype"), F.lit("anchor").alias("summary"), F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("bigint").alias("created_at"))


def edge(df: DataFrame, etype: str, src: Column, dst: Column) -> DataFrame:
    return df.select(F.concat(F.lit(etype + ":"), src, F.lit(">"), dst).alias("id"), F.lit(etype).alias("etype"), src.alias("src"), dst.alias("dst"))


def edges(spark: SparkSession, sf_dir: str, etypes: tuple[str, ...] | None = None) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    makers = {
        "placed": lambda: edge(read("orders"), "placed", node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey")),
        "contains": lambda: edge(read("lineitem").select("l_orderkey", "l_partkey").distinct(), "contains", node_id("Order", "l_orderkey"), node_id("Part", "l_partkey")),
        "supplied_by": lambda: edge(read("lineitem").select("l_partkey", "l_suppkey").distinct(), "supplied_by", node_id("Part", "l_partkey"), node_id("Supplier", "l_suppkey")),
        "in_nation": lambda: edge(read("customer"), "in_nation", node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey")).unionByName(edge(read("supplier"), "in_nation", node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey"))),
        "in_region": lambda: edge(read("nation"), "in_region", node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey")),
    }
    return reduce(DataFrame.unionByName, [makers[t]() for t in etypes or makers])


def hashed_tokens(batches):
    """For mapInArrow: (doc_id, slot, weight) of (doc_id, lower-cased text); each word of a step is hashed once."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            lists = pc.split_pattern_regex(part.column(1).cast(pa.large_string()).fill_null(""), r"[ \t\n\x0b\f\r]+")
            coded = pc.list_flatten(lists).dictionary_encode()
            words = [w.encode() for w in coded.dictionary.to_pylist()]
            slot = np.array([int(hashlib.md5(w).hexdigest()[:8], 16) % SLOTS for w in words], np.int64)
            weight = np.array([1.0 / (1.0 + len(w)) if w else 0.0 for w in words])
            row, code = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy()), coded.indices.to_numpy()
            key, weight = row * SLOTS + slot[code], weight[code]
            key, weight = key[weight > 0], weight[weight > 0]
            order = np.lexsort((-weight, key))
            first = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))] if len(order) else order
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key[first] // SLOTS)), pa.array((key[first] % SLOTS).astype(np.int32)), pa.array(weight[first])], names=["doc_id", "slot", "weight"])


def sparse_vectors(docs: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """One posting row per (node, slot): the greatest weight of the tokens that fall there. slots: only these (slot) are kept; there are
    no more of them than the vocabulary has slots, so they are broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(hashed_tokens, f"doc_id {kind}, slot int, weight double")
    if slots is not None:
        made = made.join(F.broadcast(slots.select("slot").distinct()), "slot", "left_semi")
    return made.groupBy("doc_id", "slot").agg(F.max("weight").alias("weight")).select(node_id("Doc", "doc_id").alias("node_id"), "slot", "weight")


def tpch_graph(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] | None = None, etypes: tuple[str, ...] | None = None) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nodes = lambda: reduce(DataFrame.unionByName, [label_nodes(spark, sf_dir, x) for x in labels or LABELS])

    def vectors():
        return read("embeddings").select(node_id("Vec", "vec_id").alias("node_id"), F.lit("m64").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"), F.col("label").alias("vec_label"))

    def gone():
        own = graph.nodes.where(F.substring("id", -4, 4).cast("int") % 17 == 0)
        return own.select(F.col("id").alias("node_id"), F.lit("rule").alias("reason"), F.lit(0).cast("bigint").alias("tombstoned_at"))

    graph = Graph(nodes, lambda: edges(spark, sf_dir, etypes), vectors, lambda: sparse_vectors(read("documents")), gone, spark)
    return graph
