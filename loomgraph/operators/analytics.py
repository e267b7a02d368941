"""Graph analytics and statistics of scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import Steps, cut
from .order import numbered, with_next

#: Edges that community detection takes into one worker; it is sequential by design. Beyond that, use label propagation.
COMMUNITY_EDGES = 2_000_000


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    return edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def undirected(adjacency: DataFrame) -> DataFrame:
    """(a, b, weight): the greatest weight of each unordered pair, not below 0; loops left out."""
    own = adjacency.where("src <> dst")
    return own.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("weight"))


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row, modularity: sum over communities of e / 2m - (a / 2m)^2."""
    pairs = cut(pairs)  # read three times
    ends = pairs.select(F.col("a").alias("id"), "weight").unionAll(pairs.select("b", "weight"))
    total = ends.agg(F.sum("weight").alias("m2"))
    a = ends.join(membership, "id").groupBy("community").agg(F.sum("weight").alias("a"))
    left = membership.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    right = membership.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = pairs.join(left, "a").join(right, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg((2 * F.sum("weight")).alias("e"))
    parts = a.join(e, "community", "left").crossJoin(F.broadcast(total))  # one row
    return parts.agg(F.sum(F.coalesce("e", F.lit(0.0)) / F.col("m2") - F.pow(F.col("a") / F.col("m2"), 2)).alias("modularity"))


def _partition(a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int, loops: np.ndarray | None = None) -> np.ndarray:
    """Communities by greedy moves and aggregation, each split into connected parts; nodes are 0..n-1, with loops of these weights."""
    n = len(loops) if loops is not None else int(max(a.max(), b.max())) + 1
    home = np.arange(n)
    ea, eb, ew = a.copy(), b.copy(), w.astype(float).copy()
    loops = np.zeros(n) if loops is None else loops.astype(float)
    m2 = 2 * ew.sum() + 2 * loops.sum()
    for _ in range(rounds):
        k = len(loops)
        near: list[dict[int, float]] = [{} for _ in range(k)]
        for x, y, z in zip(ea.tolist(), eb.tolist(), ew.tolist()):
            near[x][y] = near[x].get(y, 0.0) + z
            near[y][x] = near[y].get(x, 0.0) + z
        deg = np.array([sum(v.values()) for v in near]) + 2 * loops
        of, total = list(range(k)), deg.tolist()
        moved_any = False
        while True:
            moved = False
            for x in range(k):
                own = of[x]
                links: dict[int, float] = {}
                for y, z in near[x].items():
                    links[of[y]] = links.get(of[y], 0.0) + z
                total[own] -= deg[x]
                best, gain = own, links.get(own, 0.0) - total[own] * deg[x] / m2
                for c in sorted(links):
                    g = links[c] - total[c] * deg[x] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += deg[x]
                if best != own:
                    of[x], moved, moved_any = best, True, True
            if not moved:
                break
        # a community whose parts aren't joined within it is split
        part, seen = [-1] * k, 0
        for x in range(k):
            if part[x] < 0:
                todo, part[x] = [x], seen
                while todo:
                    u = todo.pop()
                    for v in near[u]:
                        if part[v] < 0 and of[v] == of[u]:
                            part[v] = seen
                            todo.append(v)
                seen += 1
        of = np.array(part)
        home = of[home]
        if not moved_any or seen == k:
            break
        inner = of[ea] == of[eb]
        new_loops = np.zeros(seen)
        np.add.at(new_loops, of, loops)
        np.add.at(new_loops, of[ea[inner]], ew[inner])
        ca, cb = of[ea[~inner]], of[eb[~inner]]
        key, at = np.unique(np.minimum(ca, cb) * seen + np.maximum(ca, cb), return_inverse=True)
        ew, ea, eb, loops = np.bincount(at, weights=ew[~inner], minlength=len(key)), key // seen, key % seen, new_loops
        if not len(ew):
            break
    return home


def communities(pairs: DataFrame, rounds: int = 8, most_edges: int = COMMUNITY_EDGES) -> DataFrame:
    """(id, community): greedy modularity in rounds of local moves, refinement into connected parts and aggregation.

    Moves depend on their order, so the edges (a, b, weight) meet in one worker; above most_edges that is refused and
    spread_communities is the way to go. Communities are numbered by their least node."""
    pairs = cut(pairs)
    if pairs.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"more than {most_edges} edges; use spread_communities")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t[t["weight"] > 0]
        ids = np.unique(np.concatenate((t["a"], t["b"]))) if len(t) else np.array([], object)
        if not len(ids):
            return pd.DataFrame({"id": pd.Series([], dtype=str), "community": pd.Series([], dtype="int32")})
        t = t.sort_values(["a", "b"])
        home = _partition(np.searchsorted(ids, t["a"]), np.searchsorted(ids, t["b"]), t["weight"].to_numpy(), rounds)
        _, first, at = np.unique(home, return_index=True, return_inverse=True)
        return pd.DataFrame({"id": ids, "community": np.argsort(np.argsort(first))[at].astype("int32")})

    return pairs.groupBy(F.lit(0).alias("all")).applyInPandas(lambda t: one(t), "id string, community int")


def _moved(both: DataFrame, state: DataFrame, m2: float, turn: int) -> DataFrame:
    """state (id, degree, community) after the half of the nodes whose turn it is has moved to where it gains most, if it gains at all."""
    links = both.join(state.select(F.col("id").alias("y"), F.col("community").alias("to")), "y").groupBy(F.col("x").alias("id"), "to").agg(F.sum("w").alias("w"))
    totals = state.groupBy(F.col("community").alias("to")).agg(F.sum("degree").alias("total"), F.count(F.lit(1)).alias("size"))
    movers = state.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
    # staying counts as well, also where no link leads home
    stay = movers.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    options = links.join(movers.select("id"), "id", "left_semi").unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w"))
    options = options.join(totals, "to").join(movers, "id")
    home = F.col("to") == F.col("community")
    gain = F.col("w") - (F.col("total") - F.when(home, F.col("degree")).otherwise(0.0)) * F.col("degree") / m2
    options = options.withColumn("gain", gain)
    choice = F.min_by(F.struct("to", "size"), F.struct((-F.col("gain")).alias("g"), "to"))
    best = options.groupBy("id", "community").agg(choice.alias("best"), F.max("gain").alias("gain"), F.max(F.when(home, F.col("gain"))).alias("now"), F.max(F.when(home, F.col("size"))).alias("size"))
    # of two nodes alone the one with the greater name moves, so they don't change places
    swap = (F.col("size") == 1) & (F.col("best.size") == 1) & (F.col("best.to") > F.col("community"))
    best = best.where((F.col("gain") > F.col("now") + 1e-12) & ~swap).select("id", F.col("best.to").alias("best"))
    return state.join(best, "id", "left").select("id", "degree", F.coalesce("best", "community").alias("community"), F.col("best").isNotNull().alias("moved"))


def _connected(both: DataFrame, state: DataFrame, steps: Steps) -> DataFrame:
    """(id, part): the least node of the connected part of its community that each node is in."""
    home = state.select("id", "community")
    inner = both.join(home.select(F.col("id").alias("x"), F.col("community").alias("cx")), "x").join(home.select(F.col("id").alias("y"), F.col("community").alias("cy")), "y")
    inner = steps.save(inner.where("cx = cy").select("x", "y"), "inner")
    part = state.select("id", F.col("id").alias("part"))
    while True:
        near = inner.join(part.select(F.col("id").alias("y"), "part"), "y").groupBy(F.col("x").alias("id")).agg(F.min("part").alias("near"))
        new = part.join(near, "id", "left").select("id", "part", F.least("part", F.coalesce("near", "part")).alias("new"))
        # the least node found may know a smaller one
        far = new.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = steps.save(new.join(far, "new").select("id", "part", F.least("new", "far").alias("new")), "part")
        part = step.select("id", F.col("new").alias("part"))
        if step.where("part <> new").isEmpty():
            return part


def spread_communities(pairs: DataFrame, turns: int = 16, levels: int = 12, gather: int = COMMUNITY_EDGES, rounds: int = 8) -> DataFrame:
    """(id, community): greedy modularity without an edge limit: local moves and aggregation as joins.

    In each turn the half of the nodes that a hash picks may move, so neighbours seldom swap; a level ends when two turns move next to
    none. Communities are split into connected parts, and these are the nodes of the next level. A level of at most `gather` edges
    is finished by one worker, as `communities` does it. Communities are numbered by their least node."""
    own = pairs.where("weight > 0 and a <> b")
    steps = Steps(pairs.sparkSession)
    both = own.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").cast("double").alias("w"))
    both = steps.save(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")), "both")
    m2 = both.agg(F.sum("w")).first()[0]
    kind = own.schema["a"].dataType.simpleString()
    if not m2:
        return own.sparkSession.createDataFrame([], f"id {kind}, community int")
    nodes = steps.save(both.groupBy(F.col("x").alias("id")).agg(F.sum("w").alias("degree")), "nodes")
    home = nodes.select("id", F.col("id").alias("at"))
    for _ in range(levels):
        if both.count() <= 2 * gather:
            home = home.join(_gathered(both, nodes, rounds).select(F.col("id").alias("at"), "to"), "at").select("id", F.col("to").alias("at"))
            break
        state, quiet, n = nodes.withColumn("community", F.col("id")), 0, nodes.count()
        for turn in range(turns):
            step = steps.save(_moved(both, state, m2, turn), "state")
            state = step.drop("moved")
            quiet = quiet + 1 if step.where("moved").count() <= n // 1000 else 0
            if quiet == 2:
                break
        part = _connected(both, state, steps)
        if part.where("id <> part").isEmpty():
            break
        home = steps.save(home.join(part.select(F.col("id").alias("at"), "part"), "at").select("id", F.col("part").alias("at")), "home")
        nodes = steps.save(nodes.join(part, "id").groupBy(F.col("part").alias("id")).agg(F.sum("degree").alias("degree")), "nodes")
        to = part.select(F.col("id").alias("x"), F.col("part").alias("px"))
        both = both.join(to, "x").join(to.select(F.col("x").alias("y"), F.col("px").alias("py")), "y")
        both = steps.save(both.where("px <> py").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("w").alias("w")), "both")
        if both.isEmpty():
            break
    least = home.groupBy("at").agg(F.min("id").alias("least"))
    number = numbered(least, "least", name="n").select("at", (F.col("n") - 1).cast("int").alias("community"))
    return home.join(number, "at").select("id", "community")


def _gathered(both: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(id, to): the communities that one worker finds of the edges both ways and of nodes (id, degree); `to` is one of their nodes."""
    kind = nodes.schema["id"].dataType.simpleString()
    rows = both.where("x < y").select("x", "y", "w").unionByName(nodes.select(F.col("id").alias("x"), F.lit(None).cast(kind).alias("y"), F.col("degree").alias("w")))

    def one(t: pd.DataFrame) -> pd.DataFrame:
        own, links = t[t["y"].isna()].sort_values("x"), t[t["y"].notna()].sort_values(["x", "y"])
        ids = own["x"].to_numpy()
        a, b, w = np.searchsorted(ids, links["x"]), np.searchsorted(ids, links["y"]), links["w"].to_numpy()
        outside = np.bincount(a, w, len(ids)) + np.bincount(b, w, len(ids))
        loops = (own["w"].to_numpy() - outside) / 2  # what lies within a node
        at = _partition(a, b, w, rounds, loops) if len(links) else np.arange(len(ids))
        return pd.DataFrame({"id": ids, "to": ids[np.unique(at, return_index=True)[1]][np.unique(at, return_inverse=True)[1]]})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda t: one(t), f"id {kind}, to {kind}")


def label_propagation(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) without a size gate: each node takes the community of the greatest weight around it, the least on ties."""
    both = cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight")))
    labels = both.select(F.col("x").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("y"), "community"), "y").groupBy("x", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("x").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("community"))
        labels = cut(best.withColumnRenamed("x", "id"))
    return labels


# --- statistics of scores -------------------------------------------------------------------------------------


def shape(scores: DataFrame, least: int = 8) -> DataFrame:
    """One row (n, low, high, median, q1, q3, iqr, shape) of (score): quartiles by position, not interpolated.

    bimodal: a gap wider than half the range, with two scores at least on either side; long-tail: the greatest lies more than
    twice the iqr above the median; else uniform. Below `least` scores: insufficient."""
    t = numbered(with_next(scores.select("score"), "score", of=F.col("score")), "score", name="below")
    n = t.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).where("n > 0")
    place = lambda part, of: (F.floor(F.col("n") * part / of) + 1).cast("int")
    t = t.join(F.broadcast(n))  # one row
    span = F.col("high") - F.col("low")
    wide = (F.col("below") >= 2) & (F.col("n") - F.col("below") >= 2) & (F.col("next") - F.col("score") > span * 0.5)
    at = lambda part, of: F.max(F.when(F.col("below") == place(part, of), F.col("score")))
    t = t.groupBy("n", "low", "high").agg(F.bool_or(F.coalesce(wide, F.lit(False))).alias("wide"), at(1, 2).alias("median"), at(1, 4).alias("q1"), at(3, 4).alias("q3"))
    t = t.withColumn("span", span)
    iqr = F.col("q3") - F.col("q1")
    name = F.when(F.col("n") < least, "insufficient").when((F.col("n") >= 4) & (F.col("span") > 0) & F.col("wide"), "bimodal").when(F.col("high") - F.col("median") > 2 * iqr, "long-tail").otherwise("uniform")
    return t.select("n", "low", "high", "median", "q1", "q3", iqr.alias("iqr"), name.alias("shape"))


def quantiles(ranked: DataFrame) -> DataFrame:
    """(id, quantile): (k - 1 - i) / (k - 1) by place; 1 for a single item."""
    k = ranked.agg(F.count(F.lit(1)).alias("k"))  # one row
    t = numbered(ranked.select("id", "score"), F.col("score").desc(), "id").join(F.broadcast(k))
    return t.select("id", F.when(F.col("k") == 1, F.lit(1.0)).otherwise((F.col("k") - F.col("place")) / (F.col("k") - 1)).alias("quantile"))


def entropy(scores: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Normalised entropy of the scores shifted to 0: -sum p ln p / ln k; 1 if flat, 0 below two scores."""
    group = key or [F.lit(0).alias("all")]
    w = W.partitionBy(*(key or [F.lit(0)]))
    low = F.min("score").over(w)
    t = scores.withColumn("x", F.col("score") - low)
    t = t.withColumn("p", F.when(F.sum("x").over(w) > 0, F.col("x") / F.sum("x").over(w)))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.lit(0.0)))
    n = F.count(F.lit(1))
    return t.groupBy(*group).agg(F.when(n < 2, F.lit(0.0)).when(F.sum("x") <= 0, F.lit(1.0)).otherwise(h / F.ln(n)).alias("entropy"))


def margins(ranked: DataFrame) -> DataFrame:
    """(place, gap): how far each score lies above the next, relative to itself and not below 0."""
    order = (F.col("score").desc(), "id")
    t = numbered(with_next(ranked.select("id", "score"), *order, of=F.col("score")), *order)
    gap = F.greatest(F.lit(0.0), (F.col("score") - F.col("next")) / F.greatest(F.abs("score"), F.lit(1e-9)))
    return t.where("next is not null").select("place", gap.alias("gap"))


def median_margin(ranked: DataFrame, k: int) -> DataFrame:
    """One row, margin: the median of the first k margins; an even count averages the middle two; 0 where there are none."""
    return margins(ranked).where(F.col("place") <= k).agg(F.coalesce(F.percentile("gap", 0.5), F.lit(0.0)).alias("margin"))


def rank_agreement(ranked: DataFrame, least: int = 5) -> DataFrame:
    """One row, agreement. high: the first margin is twice the median one and the entropy below 1 - 2 * median; medium: it
    is above the median; else low; insufficient below `least` scores."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    first = margins(ranked).agg(F.coalesce(F.max(F.when(F.col("place") == 1, F.col("gap"))), F.lit(0.0)).alias("first"), F.coalesce(F.percentile("gap", 0.5), F.lit(0.0)).alias("middle"))
    t = n.crossJoin(first).crossJoin(entropy(ranked).select("entropy"))  # a row each
    ceiling = F.least(F.lit(0.999), F.greatest(F.lit(0.0), 1 - 2 * F.col("middle")))
    name = F.when(F.col("n") < least, "insufficient").when(F.col("middle") < 1e-9, "low").when((F.col("first") >= 2 * F.col("middle")) & (F.col("entropy") < ceiling), "high").when(F.col("first") > F.col("middle"), "medium").otherwise("low")
    return t.select(name.alias("agreement"))


def confidence(ranked: DataFrame) -> DataFrame:
    """One row, confidence: 1 - last / first between 0 and 1; 0 below two items or without a positive first."""
    t = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("first"), F.min("score").alias("last"))
    return t.select(F.when((F.col("n") < 2) | (F.col("first") <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("last") / F.col("first")))).alias("confidence"))


def pmi(occurrences: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(doc, a, b, pmi) of (doc, sentence, entity): ln(p_ab / (p_a p_b)) above the threshold, over a document's sentences.

    `sentences`, how many the document has, comes with each row; pairs stay within a sentence."""
    own = occurrences.select("doc", "sentence", "entity", "sentences").distinct()
    one = own.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("c"), F.max("sentences").alias("total"))
    pairs = own.select("doc", "sentence", F.col("entity").alias("a")).join(own.select("doc", "sentence", F.col("entity").alias("b")), ["doc", "sentence"]).where("a < b").groupBy("doc", "a", "b").agg(F.count(F.lit(1)).alias("cab"))
    t = pairs.join(one.select("doc", F.col("entity").alias("a"), F.col("c").alias("ca"), "total"), ["doc", "a"]).join(one.select("doc", F.col("entity").alias("b"), F.col("c").alias("cb")), ["doc", "b"])
    return t.select("doc", "a", "b", F.ln(F.col("cab") * F.col("total") / (F.col("ca") * F.col("cb"))).alias("pmi")).where(F.col("pmi") > threshold)


def mmr(candidates: DataFrame, k: int, balance: float | None = 0.5, penalty: float = 0.5, group: str = "group") -> DataFrame:
    """(group, id, place, score) of (group, id, score, vector): greedy picks by relevance less redundancy.

    balance None: score - likeness * penalty, as for keywords; else (1 - balance) * score - balance * likeness. likeness is the greatest
    cosine to what is picked, 0 at least. Ties go to the smaller id. A group is one task: bound it by a top-k before."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("id").reset_index(drop=True)
        v = np.array(t["vector"].tolist(), float)
        v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
        base, red, left, rows = t["score"].to_numpy(float), np.zeros(len(t)), np.ones(len(t), bool), []
        for place in range(min(k, len(t))):
            s = np.where(left, base - penalty * red if balance is None else (1 - balance) * base - balance * red, -np.inf)
            i = int(np.argmax(np.round(s, 12)))
            rows.append((t[group].iat[0], t["id"].iat[i], place + 1, float(s[i])))
            left[i] = False
            red = np.maximum(red, v @ v[i])
        return pd.DataFrame(rows, columns=[group, "id", "place", "score"])

    kinds = candidates.schema
    return candidates.groupBy(group).applyInPandas(one, f"{group} {kinds[group].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, place int, score double")


def summary_scores(sentences: DataFrame, query: list[float] | None = None, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """(group, id, score, vector) of (group, id, vector, centrality): likeness to the centre of the group, to the query, and centrality."""
    from ..functions import cosine

    alpha, beta, gamma = weights or ((0.5, 0.3, 0.2) if query else (0.8, 0.0, 0.2))
    dims = sentences.select("group", F.posexplode("vector").alias("i", "x")).groupBy("group", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = dims.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centre"))
    most = sentences.groupBy("group").agg(F.max("centrality").alias("most"))
    t = sentences.join(centre, "group").join(most, "group")
    asked = cosine(F.col("vector"), F.array(*[F.lit(float(q)) for q in query])) if query else F.lit(0.0)
    central = F.when(F.col("most") > 0, F.col("centrality") / F.col("most")).otherwise(F.lit(0.0))
    return t.select("group", "id", (alpha * cosine(F.col("vector"), F.col("centre")) + beta * asked + gamma * central).alias("score"), "vector")


def community_count(membership: DataFrame) -> DataFrame:
    """One row, n: the greatest community number and one; 0 for none."""
    return membership.agg((F.coalesce(F.max("community"), F.lit(-1)) + 1).cast("long").alias("n"))


def histogram(samples: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """(key, le, n, total): how many samples are at most each bound, the last bound being infinite, and their sum."""
    le = [*map(float, bounds), float("inf")]
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(le)]
    t = samples.groupBy(key).agg(*counts, F.sum(value).alias("total"))
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(le)]))
    return t.select(key, "total", rows.alias("b")).select(key, "b.le", "b.n", "total")
