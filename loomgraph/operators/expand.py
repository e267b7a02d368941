"""Graph expansion: hop decay, personalized PageRank, community members; adjacency from edges and from vectors."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .order import numbered

#: Beyond so many nodes PageRank is left out unless it is asked for.
PPR_NODES = 250_000


def authored(edges: DataFrame, weight: float = 1.0) -> DataFrame:
    return edges.select("src", "dst", F.lit(weight).alias("weight"), F.lit("authored").alias("provenance"))


def hybrid(authored_edges: DataFrame, knn: DataFrame) -> DataFrame:
    """Authored edges, and the nearest-neighbour edges that none of them covers."""
    extra = knn.join(authored_edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return authored_edges.unionByName(extra)


def fallback(authored_edges: DataFrame, knn: DataFrame) -> DataFrame:
    """Nearest-neighbour edges only where there are no authored ones at all."""
    return knn if authored_edges.isEmpty() else authored_edges


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(etype, src, dst, id) so that src is where a walk comes from."""
    back = edges.select("id", "etype", F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead = edges.select("id", "etype", "src", "dst")
    return {"out": lambda: ahead, "in": lambda: back, "both": lambda: ahead.unionByName(back)}[direction]()


def expand_decay(seeds: DataFrame, edges: DataFrame, max_expand: int = 20, decay: float = 0.7, depth: int = 1, etypes: dict[str, float] | None = None, direction: str = "out", max_per_seed: int | None = None, max_frontier: int = 5000) -> DataFrame:
    """(id, score) of nodes that the seeds (id, score) reach: score of the parent * decay * weight of the edge type.

    All seeds are walked from. In a hop the greatest score of a node wins, and a node is closed once a hop has found it. A
    hop beyond max_frontier nodes ends the walk, with its nodes kept. The max_expand best are returned. depth is 1 to 4:
    the frontier is a table, met with the edges by a join for each hop."""
    depth = min(4, max(1, depth))
    walk = directed(edges, direction)
    if etypes is not None:
        walk = walk.where(F.col("etype").isin(*etypes))
    factor = reduce(lambda c, kv: c.when(F.col("etype") == kv[0], F.lit(float(kv[1]))), (etypes or {}).items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    frontier, seen, parts = seeds.select("id", "score"), seeds.select("id"), []
    for hop in range(depth):
        step = walk.join(frontier.select(F.col("id").alias("src"), "score"), "src")
        if max_per_seed is not None:
            step = step.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("etype", "id"))).where(F.col("rank") <= max_per_seed)
        reached = step.groupBy(F.col("dst").alias("id")).agg(F.max(F.col("score") * decay * factor).alias("score"))
        reached = reached.join(seen, "id", "left_anti")
        if hop + 1 < depth:
            reached = cut(reached)
            parts.append(reached)
            if reached.count() > max_frontier:
                break
            seen = seen.unionByName(reached.select("id"))
            frontier = reached
        else:
            parts.append(reached)
    found = reduce(DataFrame.unionByName, parts)
    return found.orderBy(F.col("score").desc(), "id").limit(max_expand)


def transition(adjacency: DataFrame) -> DataFrame:
    """(src, dst, p): parallel weights added up, what isn't positive and finite left out, each row to sum 1."""
    own = adjacency.where((F.col("weight") > 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight"))
    pairs = own.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    rows = pairs.groupBy("src").agg(F.sum("w").alias("of"))
    return pairs.join(rows, "src").select("src", "dst", (F.col("w") / F.col("of")).alias("p"))


def too_many_nodes(adjacency: DataFrame, most: int = PPR_NODES) -> bool:
    return adjacency.select(F.col("src").alias("n")).union(adjacency.select("dst")).distinct().count() > most


def pagerank(adjacency: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, iterations: int = 15, eps: float | None = 1e-6, check_every: int = 5) -> DataFrame:
    """(id, score), of mass 1: r = (1 - d + d * dangling) * p + d * r M, rescaled in each round.

    seeds: (id, weight) with weights above 0; none: uniform. Rounds are joins on the edges; lineage is cut, and the
    change compared with eps, every few rounds."""
    d = min(0.999, max(0.0, damping))
    m = cut(transition(adjacency))
    nodes = cut(adjacency.select(F.col("src").alias("id")).union(adjacency.select("dst")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("score"))
    start = nodes.select("id", F.lit(1.0 / n).alias("p"))
    if seeds is not None:
        own = seeds.where("weight > 0").join(nodes, "id").groupBy("id").agg(F.sum("weight").alias("w"))
        total = own.agg(F.sum("w")).first()[0]
        if total:
            start = nodes.join(own, "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / total).alias("p"))
    ends = m.select(F.col("src").alias("id")).distinct()
    state = cut(start.join(ends.withColumn("flows", F.lit(True)), "id", "left").select("id", "p", F.col("p").alias("r"), F.coalesce("flows", F.lit(False)).alias("flows")))
    last = state
    for k in range(iterations):
        moved = m.join(state.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("came"))
        # the mass of nodes without a way out, on one row
        loose = state.agg(F.coalesce(F.sum(F.when(~F.col("flows"), F.col("r"))), F.lit(0.0)).alias("loose"), F.sum("r").alias("mass"))
        state = state.join(moved, "id", "left").crossJoin(F.broadcast(loose)).select("id", "p", ((F.lit(1 - d) + d * F.col("loose")) * F.col("p") + d * F.coalesce("came", F.lit(0.0))).alias("r"), "flows")
        if (k + 1) % check_every == 0 or k + 1 == iterations:
            state = cut(state)
            total = state.agg(F.sum("r")).first()[0]
            if eps is not None:
                change = state.join(last.select("id", F.col("r").alias("before")), "id").agg(F.sum(F.abs(F.col("r") - F.col("before")))).first()[0]
                last = state
                if change < eps:
                    break
    return state.select("id", (F.col("r") / total).alias("score"))


def expand_pagerank(seeds: DataFrame, adjacency: DataFrame, max_expand: int = 20, damping: float = 0.85, iterations: int = 15, eps: float = 1e-6) -> DataFrame:
    """(id, score): the best unseen nodes by PageRank from the seeds' scores (below 0: 0)."""
    ranks = pagerank(adjacency, seeds.select("id", F.greatest("score", F.lit(0.0)).alias("weight")), damping, iterations, eps)
    return ranks.join(seeds.select("id"), "id", "left_anti").where("score > 0").orderBy(F.col("score").desc(), "id").limit(max_expand)


def expand_community(candidates: DataFrame, membership: DataFrame, seeds: int = 10, per_community: int = 5, decay: float = 0.5) -> DataFrame:
    """(id, score, place): the candidates as they are, then members of the best seeds' communities at score * decay.

    membership: (id, community). Members come by id; candidates are neither dropped nor moved."""
    ranked = numbered(candidates.select("id", "score"), F.col("score").desc(), "id")
    best = ranked.where(F.col("place") <= seeds).join(membership, "id").groupBy("community").agg(F.max("score").alias("best"))
    members = membership.join(F.broadcast(best), "community").join(candidates.select("id"), "id", "left_anti")  # as many rows as seeds
    members = members.withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy("id"))).where(F.col("rank") <= per_community)
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    added = members.crossJoin(F.broadcast(n)).select("id", (F.col("best") * decay).alias("score"), (F.col("n") + F.row_number().over(W.orderBy(F.col("best").desc(), "community", "rank"))).cast("int").alias("place"))
    return ranked.unionByName(added)


#: Rows of a tile of products, and bytes of vectors that a block holds in memory.
TILE, BLOCK_BYTES = 2048, 32_000_000
#: Tasks of a comparison, if there are fewer blocks.
TASKS = 64


class _Block:
    """Vectors of a block (ids, rows of x) and of each the k best that it has met."""

    def __init__(self, ids: list, x: np.ndarray, k: int, metric: str):
        self.ids, self.k, self.metric = np.array(ids, object), k, metric
        self.x, self.worst = self.ready(x), np.full(len(ids), -np.inf)
        self.best = pd.DataFrame({"row": np.array([], np.int64), "s": np.array([], np.float64), "dst": np.array([], object)})
        self.at: dict = {}
        for i, name in enumerate(ids):
            self.at.setdefault(name, []).append(i)

    def ready(self, x: np.ndarray) -> np.ndarray:
        return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) if self.metric == "cosine" else x

    def meet(self, ids: list, y: np.ndarray) -> None:
        y, others, found = self.ready(y), np.array(ids, object), []
        own = np.array([(i, j) for j, name in enumerate(ids) for i in self.at.get(name, ())], np.int64).reshape(-1, 2)
        for a in range(0, len(self.x), TILE):
            x = self.x[a : a + TILE]
            s = x @ y.T
            if self.metric == "l2":
                s = 1 / (1 + np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * s, 0)))
            mine = own[(own[:, 0] >= a) & (own[:, 0] < a + TILE)]
            s[mine[:, 0] - a, mine[:, 1]] = -np.inf
            s[~np.isfinite(s)] = -np.inf
            least = self.worst[a : a + TILE]
            if s.shape[1] > self.k and not np.isfinite(least).all():  # nothing to compare with yet
                least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((s >= least[:, None] - 1e-11) & (s > -np.inf))  # scores tie when they round alike at 12 digits
            found.append(pd.DataFrame({"row": i + a, "s": s[i, j], "dst": others[j]}))
        new = pd.concat(found)
        if len(new):
            touched = self.best["row"].isin(new["row"].unique())
            t = pd.concat([self.best[touched], new])
            t = t.assign(r=-np.round(t["s"], 12)).sort_values(["row", "r", "dst"], kind="stable")
            t = t[t.groupby("row").cumcount() < self.k].drop(columns="r")
            full = t.groupby("row")["s"].agg(["size", "min"])
            full = full[full["size"] == self.k]
            self.worst[full.index] = full["min"]
            self.best = pd.concat([self.best[~touched], t], ignore_index=True)

    def edges(self) -> pa.RecordBatch:
        kept = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[kept["row"]].tolist()), pa.array(kept["dst"].tolist()), pa.array(kept["s"].to_numpy())], names=["src", "dst", "weight"])


def _compared(k: int, metric: str):
    """For mapInArrow over (task, side, id, v) sorted by task and side: (src, dst, weight) of the k best that each vector of side 0 has
    among those of side 1 of its task. Side 0 is held, side 1 passes by."""

    def run(batches):
        task, ids, held, block = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("task").to_numpy() * 2 + b.column("side").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if key[begin] // 2 != task:
                    if block is not None and len(block.best):
                        yield block.edges()
                    task, ids, held, block = key[begin] // 2, [], [], None
                part = b.slice(begin, end - begin)
                name, column = part.column("id").to_pylist(), part.column("v")
                x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
                if key[begin] % 2 == 0:
                    ids += name
                    held.append(x)
                elif ids:
                    block = block or _Block(ids, np.concatenate(held), k, metric)
                    for at in range(0, len(name), TILE):
                        block.meet(name[at : at + TILE], x[at : at + TILE])
        if block is not None and len(block.best):
            yield block.edges()

    return run


def knn(embeddings: DataFrame, k: int, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(src, dst, weight): of each vector the k nearest others, ties to the smaller id.

    All pairs, exactly: a task holds a block of vectors, as many as BLOCK_BYTES allow (or `block`), and a stripe of the others passes by; only
    the k best per row leave it. Vectors are sent as they are given, once for each block and stripe, so what is sent grows with the
    square of their number, slowly. cosine expects vectors of any length and normalises them."""
    own = embeddings.where("vector is not null").select(F.col("node_id").alias("id"), F.col("vector").alias("v"))
    kind = own.schema["id"].dataType.simpleString()
    n, dim = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = block or max(TILE, BLOCK_BYTES // (8 * max(1, dim or 1)))
    tasks = max(1, min(TASKS, (n // TILE + 1) ** 2))
    blocks = max(1, -(-n // size), math.isqrt(tasks))
    stripes = -(-tasks // blocks)
    place = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = own.select(place(blocks, 1).alias("bi"), each(stripes).alias("bj"), F.lit(0).alias("side"), "id", "v")
    right = own.select(each(blocks).alias("bi"), place(stripes, 2).alias("bj"), F.lit(1).alias("side"), "id", "v")
    both = left.unionByName(right).select((F.col("bi") * stripes + F.col("bj")).cast("int").alias("task"), "side", "id", "v")
    both = both.repartition(blocks * stripes, "task").sortWithinPartitions("task", "side")
    near = both.mapInArrow(_compared(k, metric), f"src {kind}, dst {kind}, weight double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.round("weight", 12).desc(), "dst"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "weight")


def explain_paths(edges: DataFrame, target: str, depth: int = 8, per_node: int = 256) -> DataFrame:
    """(id, hop, via): what reaches the target along edges, walking them backwards; via is the next node on the way."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(target, 0, None)], "id string, hop int, via string")
    frontier = seen
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("dst")), "dst")
        step = step.withColumn("rank", F.row_number().over(W.partitionBy("dst").orderBy("etype", "src", "id"))).where(F.col("rank") <= per_node)
        found = step.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("via")).join(seen.select("id"), "id", "left_anti")
        frontier = cut(found.select("id", F.lit(hop).alias("hop"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def answer_hops(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hop, path): what the seeds (id) reach along edges, by the hop that finds it first, and the least path there."""
    found = seeds.select("id", F.lit(0).alias("hop"), F.col("id").alias("path"))
    frontier = found
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("src"), "path"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.lit(">"), "dst")).alias("path"))
        frontier = cut(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "path"))
        found = found.unionByName(frontier)
    return found


def knn_approximate(index: DataFrame, embeddings: DataFrame, k: int, bands: int = 24, width: int | None = None) -> DataFrame:
    """(src, dst, weight): of each vector the k nearest of those that share a band of sign codes with it, by exact cosine.

    index: (node_id, code) of rank.sign_index. `bands` groups of `width` signs are buckets; buckets and their pairs are joined by
    id, vectors fetched once for each candidate pair. The width grows with the table, so that buckets don't, and fewer bands fit in a
    code then: neighbours.descend keeps its recall at any size."""
    from ..functions import cosine

    first = index.where("code is not null").select(F.size("code")).first()
    bits = 63 * first[0] if first else 63
    width = width or min(bits, max(10, math.ceil(math.log2(max(1, index.count()))) - 4))
    bands = min(bands, bits // width)

    bit = lambda i: F.shiftright(F.get("code", F.lit(i // 63)), i % 63).bitwiseAND(F.lit(1).cast("long"))
    keys = [reduce(lambda a, b: a * 2 + b, [bit(t * width + j) for j in range(width)]) for t in range(bands)]
    own = index.where("code is not null").select("node_id", F.posexplode(F.array(*keys)).alias("band", "key"))
    pairs = own.join(own.withColumnRenamed("node_id", "other"), ["band", "key"]).where("node_id <> other").select("node_id", "other").distinct()
    a = embeddings.select("node_id", F.col("vector").alias("v"))
    b = embeddings.select(F.col("node_id").alias("other"), F.col("vector").alias("w"))
    scored = pairs.join(a, "node_id").join(b, "other").select(F.col("node_id").alias("src"), F.col("other").alias("dst"), cosine(F.col("v"), F.col("w")).alias("weight"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.round("weight", 12).desc(), "dst"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "weight")


def stored_knn(edges: DataFrame, path: str) -> DataFrame:
    """The edges, written to a path and read again: a later session reads them there."""
    edges.write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path)
