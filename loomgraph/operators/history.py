"""Long histories: what heads come from, by ranges of the history or by segments, without a walk of one join for each generation.

Ranges: commits are dealt along their time (or id) to clusters of at most CLUSTER. In a cluster only the entries matter to the others:
commits that a link from another cluster leads to, and heads. Their shortest ways to the next clusters' entries are the links of a core,
which is solved in the same way until one worker can walk it; then each cluster takes its entries' depths to all its commits. That is
exact in any order, and pays where most links stay within a cluster. Where they don't, the history is cut into segments.

Segments: commits that follow one another without a branch are one. A link is inner if it is its commit's only parent and that parent's only child. Segments are the paths of inner links, found by pointers
that double their reach, so a chain of n commits takes log n joins. All other links lead from a segment's oldest commit to the
youngest of another one, so a walk goes over segments alone, and commits come in once at the end.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .order import numbered

#: Links of a core or between segments up to so many are walked by one task for each head, which holds them all.
WALK_LINKS = 50_000
#: Commits of a cluster, which one task holds, and heads that a task takes through it.
CLUSTER, HEADS = 20_000, 16
#: A core must have at most this share of the links that it stands for; and the entries of a cluster walk it, this many on average.
CORE_SHARE, ENTRIES = 0.5, 64


def segments(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cid, segment, place), (segment, parent, length)) of (cid, parents).

    A segment is named by its oldest commit; place counts links down to that one. The second table has the segments' links: each leads to
    the youngest commit of the parent segment, `length` links from the youngest commit of its own. Parents that are not among the commits
    are commits without parents."""
    links = cut(commits.select("cid", F.explode("parents").alias("parent")).distinct())
    single = links.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("cid")
    alone = links.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("parent")
    inner = cut(links.join(single, "cid").join(alone, "parent").select("cid", F.col("parent").alias("at"), F.lit(1).cast("long").alias("place")))
    going, done = inner, None
    while True:  # a pointer that does not lead to another one has arrived
        ahead = going.select(F.col("cid").alias("at"), F.col("at").alias("next"), F.col("place").alias("more"), F.lit(False).alias("final"))
        if done is not None:
            ahead = ahead.unionByName(done.select(F.col("cid").alias("at"), F.col("at").alias("next"), F.col("place").alias("more"), F.lit(True).alias("final")))
        step = cut(going.join(ahead, "at", "left").select("cid", F.coalesce("next", "at").alias("at"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("final", F.lit(True)).alias("final")))
        arrived = step.where("final").drop("final")
        done = arrived if done is None else cut(done.unionByName(arrived))
        going = step.where("not final").drop("final")
        if going.isEmpty():
            break
    every = commits.select("cid").unionByName(links.select(F.col("parent").alias("cid"))).distinct()
    placed = every.join(done, "cid", "left").select("cid", F.coalesce("at", "cid").alias("segment"), F.coalesce("place", F.lit(0)).alias("place"))
    placed = cut(placed)
    length = placed.groupBy("segment").agg((F.max("place") + 1).alias("length"))
    outer = links.join(inner.select("cid"), "cid", "left_anti")  # from a segment's oldest commit
    outer = outer.join(placed.select(F.col("cid").alias("parent"), F.col("segment").alias("to")), "parent")
    return placed, cut(outer.join(length.withColumnRenamed("segment", "cid"), "cid").select(F.col("cid").alias("segment"), F.col("to").alias("parent"), "length"))


def _nearest(up: dict, first: list) -> dict:
    """The least depth of each node that (depth, node) reach over up: {node: [(parent, length)]}."""
    best: dict = {}
    for d, s in first:
        best[s] = min(d, best.get(s, d))
    todo = [(d, s) for s, d in best.items()]
    heapq.heapify(todo)
    while todo:
        d, s = heapq.heappop(todo)
        if d > best[s]:
            continue
        for parent, length in up.get(s, ()):
            if d + length < best.get(parent, 1 << 62):
                best[parent] = d + length
                heapq.heappush(todo, (d + length, parent))
    return best


def _ways(cids, parents, lengths) -> dict:
    up: dict = {}
    for cid, parent, length in zip(cids.tolist(), parents.tolist(), lengths.tolist()):
        up.setdefault(cid, []).append((parent, int(length)))
    return up


def _walk(links: list):
    """For applyInPandas over one head's (head, cid, depth): the least depth of each node that it reaches."""
    up: dict = {}
    for cid, parent, length in links:
        up.setdefault(cid, []).append((parent, length))

    def one(t: pd.DataFrame) -> pd.DataFrame:
        best = _nearest(up, list(zip(t["depth"].tolist(), t["cid"].tolist())))
        return pd.DataFrame({"head": t["head"].iat[0], "cid": list(best), "depth": np.array(list(best.values()), np.int64)})

    return one


def _by_joins(links: DataFrame, start: DataFrame) -> DataFrame:
    """(head, cid, depth) that start (head, cid, depth) reaches over (cid, parent, length): as many turns as links lie on a way."""
    far = front = cut(start)
    while not front.isEmpty():
        step = front.join(links, "cid").groupBy("head", F.col("parent").alias("cid")).agg(F.min(F.col("depth") + F.col("length")).alias("new"))
        front = cut(step.join(far, ["head", "cid"], "left").where("depth is null or new < depth").select("head", "cid", F.col("new").alias("depth")))
        far = cut(far.unionByName(front).groupBy("head", "cid").agg(F.min("depth").alias("depth")))
    return far


def _walked(links: DataFrame, start: DataFrame) -> DataFrame | None:
    """The same by one task for each head; none if there are too many links for that."""
    if links.limit(WALK_LINKS + 1).count() > WALK_LINKS:
        return None
    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    return start.groupBy("head").applyInPandas(_walk([tuple(x) for x in links.select("cid", "parent", "length").collect()]), f"head {kinds['head']}, cid {kinds['cid']}, depth long")


def _across(t: pd.DataFrame) -> pd.DataFrame:
    """Of a cluster's links (cid, parent, length, leaves) and entries (cid, no parent): from each entry the shortest ways out."""
    entries, links = t.loc[t["parent"].isna(), "cid"].tolist(), t[t["parent"].notna()]
    inside, outside = (_ways(x["cid"], x["parent"], x["length"]) for x in (links[~links["leaves"].astype(bool)], links[links["leaves"].astype(bool)]))
    rows = []
    for e in entries:
        out: dict = {}
        for x, d in _nearest(inside, [(0, e)]).items():
            for parent, length in outside.get(x, ()):
                out[parent] = min(d + length, out.get(parent, 1 << 62))
        rows += [(e, parent, d) for parent, d in out.items()]
    return pd.DataFrame(rows, columns=["cid", "parent", "length"])


def _within(links: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For cogroups of a cluster's inner links and its entries' (head, cid, depth): the depths of all its commits that are reached."""
    inside = _ways(links["cid"], links["parent"], links["length"])
    heads, cids, depths = [], [], []
    for head, t in known.groupby("head", sort=False):
        best = _nearest(inside, list(zip(t["depth"].tolist(), t["cid"].tolist())))
        heads += [head] * len(best)
        cids += best
        depths += best.values()
    return pd.DataFrame({"head": pd.Series(heads, dtype=object), "cid": pd.Series(cids, dtype=object), "depth": np.array(depths, np.int64)})


def _by_clusters(nodes: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame | None:
    """(head, cid, depth) that start (head, cid, depth) reaches over links (cid, parent, length) between nodes (cid, at), by clusters along
    `at`; none where too few links stay within them."""
    kinds = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    kind = kinds["cid"]
    placed = numbered(nodes, "at", "cid").select("cid", "at", F.floor((F.col("place") - 1) / CLUSTER).cast("int").alias("cluster"))
    placed = cut(placed)
    own = placed.select("cid", "cluster")
    links = links.join(own, "cid").join(own.select(F.col("cid").alias("parent"), F.col("cluster").alias("to")), "parent")
    links = cut(links.select("cluster", "cid", "parent", "length", (F.col("cluster") != F.col("to")).alias("leaves")))
    entries = links.where("leaves").select(F.col("parent").alias("cid")).unionByName(start.select("cid")).distinct()
    entries = cut(placed.join(entries, "cid"))
    # each entry may have a way to each node outside, and walks the links of its cluster
    counts = links.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("leaves"), F.col("parent"))).alias("exits"))
    counts = counts.join(entries.groupBy("cluster").agg(F.count(F.lit(1)).alias("entries")), "cluster")
    n, core, work = counts.agg(F.sum("n"), F.sum(F.col("entries") * F.col("exits")), F.sum(F.col("entries") * F.col("n"))).first()
    if n and (core > CORE_SHARE * n or work > ENTRIES * n):
        return None
    clusters = placed.agg(F.max("cluster") + 1).first()[0] or 1
    dealt = lambda t, *key: t.repartition(max(1, min(clusters, 4096)), *key)  # noqa: E731  # small groups that take long: not coalesced
    marked = entries.select("cluster", "cid", F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("long").alias("length"), F.lit(False).alias("leaves"))
    ways = cut(dealt(links.unionByName(marked), "cluster").groupBy("cluster").applyInPandas(_across, f"cid {kind}, parent {kind}, length long"))
    known = cut(_solved(entries.select("cid", "at"), ways, start).join(own, "cid"))
    groups = max(1, math.ceil(start.select("head").distinct().count() / HEADS))
    known = dealt(known.withColumn("group", F.pmod(F.xxhash64("head"), F.lit(groups)).cast("int")), "cluster", "group")
    inner = links.where("not leaves").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    inner = dealt(inner.select("cluster", "group", "cid", "parent", "length"), "cluster", "group")
    return inner.groupBy("cluster", "group").cogroup(known.groupBy("cluster", "group")).applyInPandas(_within, f"head {kinds['head']}, cid {kind}, depth long")


def _solved(nodes: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame:
    """(head, cid, depth) by one worker where the links are few, else by clusters, else by joins."""
    for way in (lambda: _walked(links, start), lambda: _by_clusters(nodes, links, start)):
        if (found := way()) is not None:
            return found
    return _by_joins(links, start)


def reached(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, cid, depth) of everything that the heads (head, cid) come from, themselves at depth 0; depth is the shortest.

    commits: (cid, parents), and `time` if there is one: commits that are near in time, or without it in cid, should be near in history."""
    at = F.col("time") if "time" in commits.columns else F.col("cid")
    links = cut(commits.select("cid", at.alias("at"), F.explode("parents").alias("parent")).groupBy("cid", "parent").agg(F.min("at").alias("at")))
    # parents that are not among the commits stand beside their children
    nodes = commits.select("cid", at.alias("at"), F.lit(0).alias("order")).unionByName(links.select(F.col("parent").alias("cid"), "at", F.lit(1).alias("order")))
    nodes = nodes.groupBy("cid").agg(F.min_by("at", F.struct("order", "at")).alias("at"))
    start = cut(heads.select("head", "cid").distinct().join(nodes.select("cid"), "cid").select("head", "cid", F.lit(0).cast("long").alias("depth")))
    out = _by_clusters(nodes, links.select("cid", "parent", F.lit(1).cast("long").alias("length")), start)
    out = _by_segments(commits, heads) if out is None else out
    out = out.unionByName(heads.select("head", "cid", F.lit(0).cast("long").alias("depth")))
    return out.groupBy("head", "cid").agg(F.min("depth").cast("int").alias("depth"))


def _by_segments(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, cid, depth) where no order is near to the history: over its segments."""
    placed, links = segments(commits)
    tops = placed.groupBy("segment").agg(F.max("place").alias("top"))
    # depths are those of a segment's youngest commit: below 0 where a head stands further down in it
    start = heads.select("head", "cid").join(placed, "cid").join(tops, "segment").select("head", F.col("segment").alias("cid"), (F.col("place") - F.col("top")).cast("long").alias("depth"))
    links = links.select(F.col("segment").alias("cid"), "parent", F.col("length").cast("long").alias("length"))
    far = _walked(links, start)
    far = (_by_joins(links, start) if far is None else far).withColumnRenamed("cid", "segment")
    out = placed.join(tops, "segment").join(far, "segment").select("head", "cid", (F.col("depth") + F.col("top") - F.col("place")).cast("long").alias("depth"))
    return out.where("depth >= 0")
