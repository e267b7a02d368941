"""Hybrid retrieval: lanes, fusion, communities, filters, graph expansion, reranking, packing. A builder; nothing runs before `items`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import token_estimate
from ..model import tagged
from ..operators import expand, rank
from ..operators.postings import Postings
from ..operators.query import Query, rendered, temporal, without_system, without_tombstones
from ..operators.vector_index import VectorIndex
from ..sources.graph import Graph
from .lineage import cut


#: Candidates of a lane are broadcast up to this cap (some 40 bytes each).
BROADCAST_CANDIDATES = 100_000


class RetrievalEmpty(ValueError):
    pass


@dataclass(frozen=True)
class GraphExpand:
    max_expand: int = 20
    decay: float = 0.7
    depth: int = 1
    max_frontier: int = 5000
    max_per_seed: int | None = None
    etypes: tuple[tuple[str, float], ...] | None = None
    direction: str = "out"
    #: "decay", or "pagerank", which needs an adjacency and looks at neither types, direction nor depth
    mode: str = "decay"
    damping: float = 0.85
    iterations: int = 15
    #: PageRank over graphs of more nodes than expand.PPR_NODES only if it is asked for; else decay takes its place
    large: bool = False


@dataclass(frozen=True)
class Retriever:
    graph: Graph
    dense: tuple[tuple[float, ...], str | None, float] | None = None
    sparse: tuple[DataFrame, float] | None = None
    fusion: str = "scores"
    rrf_k: float = 60.0
    vector_cap: int = 256
    label: str | None = None
    prop: tuple[str, object] | None = None
    times: dict = field(default_factory=dict)
    tombstoned: bool = False
    community: tuple[DataFrame, int, int, float] | None = None
    expansion: GraphExpand | None = None
    adjacency: DataFrame | None = None
    rerank: tuple[Callable[[Column], Column], int] | None = None
    budget: int | None = None
    limit: int | None = None
    #: Stored indexes that the lanes search in place of the graph's vectors
    vector_index: VectorIndex | None = None
    postings: Postings | None = None

    def with_(self, **changes) -> Retriever:
        return replace(self, **changes)

    def vector(self, query: list[float], model: str | None = None, weight: float = 1.0) -> Retriever:
        return self.with_(dense=(tuple(query), model, weight))

    def sparse_query(self, query: DataFrame, weight: float = 1.0) -> Retriever:
        return self.with_(sparse=(query, weight))

    def indexed(self, stamp: str, vectors: VectorIndex | None = None, postings: Postings | None = None) -> Retriever:
        """Searches stored indexes; ValueError where one is of another snapshot than `stamp` says."""
        for index in (vectors, postings):
            if index is not None and index.stamp != stamp:
                raise ValueError(f"an index of snapshot {index.stamp}, not {stamp}")
        return self.with_(vector_index=vectors, postings=postings)

    def lanes(self) -> list[tuple[str, DataFrame, float]]:
        out = []
        if self.dense:
            q, model, weight = self.dense
            index = self.vector_index if self.vector_index is not None and model in (None, self.vector_index.model) else None
            lane = index.search(list(q), self.vector_cap) if index else rank.dense(self.graph.embeddings, list(q), self.vector_cap, model)
            out.append(("vector", lane, weight))
        if self.sparse:
            query, weight = self.sparse
            lane = self.postings.search(query, self.vector_cap) if self.postings else rank.sparse(self.graph.sparse, query, self.vector_cap)
            out.append(("sparse", lane, weight))
        return out

    def fused(self) -> DataFrame:
        """(id, score): one lane keeps its own scores; several are fused. Without a lane, every node of the query scores 1."""
        lanes = self.lanes()
        if not lanes:
            if self.label is None and self.prop is None:
                raise RetrievalEmpty("neither a filter nor a ranker")
            q = Query(self.graph, of_label=self.label, prop=self.prop, tombstoned=True)
            return q.nodes().select("id", F.lit(1.0).alias("score"))
        if len(lanes) == 1:
            return lanes[0][1]
        pairs = [(df, w) for _, df, w in lanes]
        return rank.fuse_ranks(pairs, self.rrf_k) if self.fusion == "ranks" else rank.fuse_scores(pairs)

    def filtered(self, ranked: DataFrame) -> DataFrame:
        """Candidates that are nodes and pass; the filters stand above the cut of the lanes and don't refill it."""
        # then the candidates are few and meet the nodes where those are read
        t = self.graph.nodes.join(F.broadcast(ranked) if self.bounded() else ranked, "id")
        if self.label is not None:
            t = t.where(F.col("ntype") == self.label)
        if self.prop is not None:
            t = t.where(F.col("props")[self.prop[0]] == tagged(self.prop[1]))
        if not self.tombstoned:
            t = without_tombstones(t, self.graph.tombstones)
        return temporal(without_system(t), **self.times)

    def bounded(self) -> bool:
        """Whether candidates come from lanes, which end in a top-k, and from what is expanded from them, which does too."""
        return bool(self.dense or self.sparse) and self.vector_cap <= BROADCAST_CANDIDATES

    def by_pagerank(self) -> bool:
        e = self.expansion
        return e is not None and e.mode == "pagerank" and self.adjacency is not None and (e.large or not expand.too_many_nodes(self.adjacency))

    def warnings(self) -> list[str]:
        """What a result does not show: stages that were asked for and did not run; at most eight."""
        e, out = self.expansion, []
        if e is not None and e.mode == "pagerank" and self.adjacency is None:
            out.append("pagerank_without_adjacency")
        elif e is not None and e.mode == "pagerank" and not self.by_pagerank():
            out.append("pagerank_skipped_by_size")
        if not self.dense and not self.sparse:
            out.append("no_ranker")
        if self.budget is not None and self.budget <= 0:
            out.append("empty_budget")
        return out[:8]

    def candidates(self) -> DataFrame:
        t = self.fused()
        if self.community:
            membership, seeds, per, decay = self.community
            t = expand.expand_community(t, membership, seeds, per, decay).select("id", "score")
        t = self.filtered(t)
        e = self.expansion
        if e is None:
            return t
        t = cut(t) if self.bounded() else t  # read as seeds and as results
        seeds = t.select("id", "score")
        if self.by_pagerank():
            new = expand.expand_pagerank(seeds, self.adjacency, e.max_expand, e.damping, e.iterations)
        else:
            new = expand.expand_decay(seeds, self.graph.edges, e.max_expand, e.decay, e.depth, dict(e.etypes) if e.etypes else None, e.direction, e.max_per_seed, e.max_frontier)
        # what expansion finds is held to label and time, but not to the property
        return t.unionByName(self.with_(prop=None).filtered(new))

    def items(self) -> DataFrame:
        """(place, id, score, tokens_used, dropped): what fits the budget, best first."""
        t = self.candidates()
        t = cut(t) if self.bounded() else t
        texts = rendered(t)
        t = t.select("id", "score").join(texts, "id")
        if self.rerank:
            f, k = self.rerank
            t = rank.rerank_head(t, f(F.col("text")), k).select("id", (-F.col("place")).cast("double").alias("score"), "text")
        t = t.select("id", "score", token_estimate(F.col("text")).alias("tokens"))
        packed = rank.pack_budget(t, self.budget if self.budget is not None else 2**31 - 1, self.limit)
        return packed.join(t.select("id", "score"), "id").select("place", "id", "score", "tokens_used", "dropped")

    def lane_scores(self) -> DataFrame:
        """(id, lanes): each candidate's own score in each lane, lanes in their fixed order."""
        parts = [df.select("id", F.struct(F.lit(i).alias("order"), F.lit(name).alias("lane"), "score").alias("s")) for i, (name, df, _) in enumerate(self.lanes())]
        t = parts[0]
        for p in parts[1:]:
            t = t.unionByName(p)
        return t.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s["lane"], F.lit(":"), F.round(s["score"], 6).cast("string"))).alias("lanes"))


def with_passage(query: Column, generate: Callable[[Column], Column] | None) -> Column:
    """The query, and a passage that a generator writes for it, to be embedded together; without a generator the query alone."""
    return query if generate is None else F.concat_ws("\n\n", query, generate(query))


def over_graphs(graphs: list[tuple[str, Retriever]], limit: int) -> DataFrame:
    """(graph, id, score): the best of several graphs' candidates, each with the graph it is from."""
    parts = [r.candidates().select(F.lit(name).alias("graph"), "id", "score") for name, r in graphs]
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    return t.where(~F.isnan("score")).orderBy(F.col("score").desc(), "id", "graph").limit(limit)


#: The greatest numbers that a request may ask for.
REQUEST_CAPS = {"limit": 1000, "vector_cap": 100_000, "iterations": 100}


def checked(name: str, value: int) -> int:
    """value, if a request may ask for it; ValueError else."""
    if not 0 <= value <= REQUEST_CAPS[name]:
        raise ValueError(f"{name} must be between 0 and {REQUEST_CAPS[name]}")
    return value


def multi_query(retrievers: list[Retriever], limit: int, k: float = 60.0) -> DataFrame:
    """(id, score): several phrasings, each retrieved deeper than asked for, fused by rank."""
    depth = max(30, 3 * limit)
    return rank.top(rank.fuse_ranks([(rank.top(r.candidates().select("id", "score"), depth), 1.0) for r in retrievers], k), limit)
