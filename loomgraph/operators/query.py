"""Structured queries: a label, one equality predicate, attached adjacency, limits and paging.

A query is a lazy DataFrame. Ordering is by id, and only applied where a limit makes it observable.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ANCHOR, tagged
from ..sources.graph import Graph

INCOMING_CAP = 10_000


class NotFound(LookupError):
    pass


class AmbiguousMatch(LookupError):
    pass


def without_tombstones(nodes: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    return nodes if tombstones is None else nodes.join(tombstones.select(F.col("node_id").alias("id")), "id", "left_anti")


def without_system(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("id") != ANCHOR)


def temporal(nodes: DataFrame, created_from: int | None = None, created_before: int | None = None, updated_from: int | None = None, updated_before: int | None = None) -> DataFrame:
    """Lower bounds inclusive, upper bounds exclusive; a node without the time passes."""
    for name, low, high in (("created_at", created_from, created_before), ("updated_at", updated_from, updated_before)):
        if low is not None:
            nodes = nodes.where(F.col(name).isNull() | (F.col(name) >= low))
        if high is not None:
            nodes = nodes.where(F.col(name).isNull() | (F.col(name) < high))
    return nodes


def outgoing(edges: DataFrame, etypes: tuple[str, ...] | None = None) -> DataFrame:
    """(id, etype, src, dst, rank): rank is the place among the edges of the source, by type and id."""
    if etypes is not None:
        edges = edges.where(F.col("etype").isin(*etypes))
    return edges.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("etype", "id")))


def incoming(edges: DataFrame, etypes: tuple[str, ...] | None = None, cap: int | None = INCOMING_CAP) -> DataFrame:
    """(id, etype, src, dst, rank), by type, source and id; the cap counts edges of these types only."""
    if etypes is not None:
        edges = edges.where(F.col("etype").isin(*etypes))
    edges = edges.withColumn("rank", F.row_number().over(W.partitionBy("dst").orderBy("etype", "src", "id")))
    return edges if cap is None else edges.where(F.col("rank") <= cap)


def attached(nodes: DataFrame, edges: DataFrame, side: str, etypes: tuple[str, ...], cap: int, drop_loops: bool = False) -> DataFrame:
    """nodes with `<side>`, an array of (etype, src, dst, id), and `<side>_truncated`; nodes without edges stay.

    Edges are met by the nodes of the query first, so ranks are counted for these alone."""
    key = "src" if side == "outgoing" else "dst"
    order = ("etype", "id") if side == "outgoing" else ("etype", "src", "id")
    own = edges.where(F.col("etype").isin(*etypes)) if etypes else edges.where(F.lit(False))
    if drop_loops:
        own = own.where("src <> dst")
    own = own.join(nodes.select(F.col("id").alias(key)), key, "left_semi")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    lists = ranked.where(F.col("rank") <= cap + 1).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "etype", "src", "dst", F.col("id").alias("edge_id")))).alias("all"))
    out = nodes.join(lists, "id", "left")
    kept = F.transform(F.slice(F.coalesce("all", F.array()), 1, cap), lambda e: F.struct(e["etype"].alias("etype"), e["src"].alias("src"), e["dst"].alias("dst"), e["edge_id"].alias("id")))
    return out.withColumn(side, kept).withColumn(f"{side}_truncated", F.coalesce(F.size("all") > cap, F.lit(False))).drop("all")


@dataclass(frozen=True)
class Query:
    """Immutable builder. A second `where_eq` replaces the first; predicates are not combined."""

    graph: Graph
    of_label: str | None = None
    prop: tuple[str, object] | None = None
    out_types: tuple[str, ...] = ()
    in_types: tuple[str, ...] = ()
    any_types: tuple[str, ...] = ()
    cap: int = 100
    tombstoned: bool = False
    system: bool = False
    most: int | None = None
    skip: int = 0
    #: "all": every match; "last": the single winner of a property index that keeps one node per value
    index: str = "all"

    def label(self, label: str) -> Query:
        return replace(self, of_label=label)

    def where_eq(self, name: str, value) -> Query:
        """`ntype` and `label` name the label; any other name a property, compared with its type."""
        return self.label(value) if name in ("ntype", "label") else replace(self, prop=(name, value))

    def with_outgoing(self, *etypes: str) -> Query:
        return replace(self, out_types=self.out_types + etypes)

    def with_incoming(self, *etypes: str) -> Query:
        return replace(self, in_types=self.in_types + etypes)

    def with_any_direction(self, *etypes: str) -> Query:
        return replace(self, any_types=self.any_types + etypes)

    def adjacency_cap(self, n: int) -> Query:
        return replace(self, cap=n)

    def include_tombstoned(self, on: bool = True) -> Query:
        return replace(self, tombstoned=on)

    def include_system(self, on: bool = True) -> Query:
        return replace(self, system=on)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def nodes(self) -> DataFrame:
        df = self.graph.nodes
        if self.of_label is not None:
            df = df.where(F.col("ntype") == self.of_label)
        if self.prop is not None:
            name, value = self.prop
            df = df.where(F.col("props")[name] == tagged(value))
            if self.index == "last" and self.of_label is not None:
                # one node for each value, the last by id; if that is hidden, nothing is found
                df = df.orderBy(F.col("id").desc()).limit(1)
        if not self.tombstoned:
            df = without_tombstones(df, self.graph.tombstones)
        if not self.system:
            df = without_system(df)
        if self.skip or self.most is not None:
            df = df.orderBy("id")
            df = df.offset(self.skip) if self.skip else df
            df = df.limit(self.most) if self.most is not None else df
        return df

    def execute(self) -> DataFrame:
        df = self.nodes()
        if self.out_types or self.any_types:
            df = attached(df, self.graph.edges, "outgoing", self.out_types + self.any_types, self.cap)
        if self.in_types or self.any_types:
            # a loop is listed once, among the outgoing
            df = attached(df, self.graph.edges, "incoming", self.in_types + self.any_types, self.cap, drop_loops=bool(self.any_types))
        return df

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def one(self):
        rows = self.limit(2).execute().collect()
        if not rows:
            raise NotFound("no node matches")
        if len(rows) > 1:
            raise AmbiguousMatch("more than one node matches")
        return rows[0]


def traverse(graph: Graph, node: str, etypes: tuple[str, ...] | None = None, direction: str = "out", limit: int = 25) -> DataFrame:
    """Edges of one node by direction; a limit of 0 is no limit."""
    own = graph.edges if etypes is None else graph.edges.where(F.col("etype").isin(*etypes))
    parts = []
    if direction in ("out", "both"):
        parts.append(own.where(F.col("src") == node).select(F.lit("out").alias("direction"), "etype", "src", "dst", "id"))
    if direction in ("in", "both"):
        loops = F.lit(True) if direction == "in" else F.col("src") != F.col("dst")
        parts.append(own.where((F.col("dst") == node) & loops).select(F.lit("in").alias("direction"), "etype", "src", "dst", "id"))
    if not parts:
        raise ValueError(f"unknown direction {direction}")
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df if limit == 0 else df.orderBy(F.col("direction").desc(), "etype", "src", "id").limit(limit)


def rendered(nodes: DataFrame, cap: int = 2000) -> DataFrame:
    """(id, text): label, id, context, summary and properties in the order of their names, a line each."""
    from ..functions import clip_text, sorted_props
    from ..model import untagged

    lines = F.concat(
        F.array(F.concat(F.lit("ntype: "), F.col("ntype")), F.concat(F.lit("id: "), F.col("id"))),
        F.when(F.col("summary").isNotNull(), F.array(F.concat(F.lit("summary: "), clip_text(F.col("summary"), cap)))).otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce(sorted_props(F.col("props")), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.concat(e["key"], F.lit(": "), untagged(e["value"]))),
    )
    return nodes.select("id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def rendered_with_adjacency(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(id, text): the rendering, and `cap` edges of each direction with the number of the rest."""
    text = rendered(nodes)
    for side, key, other, arrow in (("Outgoing", "src", "dst", "->"), ("Incoming", "dst", "src", "<-")):
        own = edges.join(nodes.select(F.col("id").alias(key)), key, "left_semi")
        order = ("etype", "id") if key == "src" else ("etype", "src", "id")
        ranked = own.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
        line = F.concat(F.lit("  "), "etype", F.lit(f" {arrow} "), other)
        block = ranked.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= cap, F.struct("rank", line.alias("line"))))).alias("lines"), F.count(F.lit(1)).alias("total"))
        shown = F.array_join(F.transform("lines", lambda e: e["line"]), "\n")
        more = F.when(F.col("total") > cap, F.concat(F.lit("  ... (+"), (F.col("total") - cap).cast("string"), F.lit(" more)\n"))).otherwise(F.lit(""))
        text = text.join(block, "id", "left").select("id", F.concat("text", F.when(F.col("total") > 0, F.concat(F.lit(f"{side}:\n"), shown, F.lit("\n"), more)).otherwise(F.lit(""))).alias("text"))
    return text


def schema_of(graph: Graph) -> DataFrame:
    """(ntype, n, props): what labels there are, how many nodes, which properties."""
    counts = graph.nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))
    names = graph.nodes.select("ntype", F.explode(F.map_keys("props")).alias("prop")).groupBy("ntype").agg(F.array_join(F.array_sort(F.collect_set("prop")), ",").alias("props"))
    return counts.join(names, "ntype", "left").select("ntype", "n", F.coalesce("props", F.lit("")).alias("props"))


def stats(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("ntype").alias("labels"))
    return n.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("etype").alias("etypes")))  # one row each
