"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies, target / source size: the whole part is
taken outright and the rest is an inclusion probability. The flight phase moves the probabilities of three documents at a
time along the null space of two constraints, the source's words and its documents, so both totals stay
as they are while one probability after another becomes 0 or 1. Groups of bounded size fly on their own, what each
leaves (two documents at most) flies on in the next round, and the last dozen in each source land by the rounding
that is nearest to the words asked for.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, column, cut

#: Sources are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_SOURCES = 100_000
TINY = 1e-9
#: Documents of a source that the landing decides, besides the two that the flight leaves; it looks at 2 to that power of roundings.
LANDING = 10


def fly(size: np.ndarray, p: np.ndarray, seed: str) -> np.ndarray:
    """The probabilities after the flight: all 0 or 1 but two at most; sums of p and of p * size are kept."""
    rng, p = random.Random(seed), p.astype(float).tolist()
    size = size.tolist()
    wait = iter([i for i in range(len(p)) if TINY < p[i] < 1 - TINY])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(wait, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return np.array(p)
        up = min(((1 - p[i]) / v if v > 0 else -p[i] / v) for i, v in zip(active, u) if v)
        down = min((p[i] / v if v > 0 else (p[i] - 1) / v) for i, v in zip(active, u) if v)
        move = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u):
            p[i] += move * v
        for i in active:
            p[i] = 0.0 if p[i] <= TINY else 1.0 if p[i] >= 1 - TINY else p[i]
        active = [i for i in active if 0 < p[i] < 1]


def held_back(p: np.ndarray, n: int = LANDING) -> np.ndarray:
    """Some of the open probabilities, of rows sorted by size, evenly spread: the last flight leaves them to the landing."""
    left = np.flatnonzero((p > TINY) & (p < 1 - TINY))
    return left if len(left) <= n else left[np.linspace(0, len(left) - 1, n).astype(int)]


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last fractions become 0 or 1: the rounding with the least error in words, then in documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    error = np.abs((choices - p[left]) @ size[left].astype(float)), np.abs((choices - p[left]).sum(1))
    out = p.copy()
    out[left] = choices[np.lexsort((error[1], error[0]))[0]]
    return out


def targets(sizes: DataFrame, share: float, weights: tuple, cap: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, filled up to cap times the size.

    One row for each source, so the windows below see as many rows as there are sources."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    level = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", level).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("height", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # from the first source that isn't filled up, the height falls: its height is the water's
    t = t.withColumn("water", F.max(F.when(F.col("ratio") > F.col("height"), F.col("height"))).over(whole))
    full = F.col("ratio") <= F.col("height")
    return t.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("water"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, weights: tuple = (5, 2, 1), cap: float = 2.0, group: int = 20_000, seed: int = 7, keep: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken (and the columns of `keep`).

    size counts the words of the text (null: 0). The sources, null among them as one source, share `share` of all words by their
    weights; none gets more than cap times its size. copies is how often the mix takes the document, at most
    cap rounded up and never more than cap times; a source without words takes none of its documents. The same rows give the same
    mix; rows without an id take part like others; rows that repeat are documents of their own. Empty input: empty result."""
    words = F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long")
    ids = column(docs, id_col)
    # the text as well, so that rows without an id are spread over groups too
    place = F.xxhash64(ids, column(docs, text_col), F.lit(seed))
    rows = docs.select(ids.alias("doc_id"), column(docs, source_col).alias("source"), words.alias("size"), place.alias("place"), *[column(docs, k).alias(f"keep_{i}") for i, k in enumerate(keep)])
    rows = cut(rows)
    held = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, cap).withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source")))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    held = held.join(counts, held["source"].eqNullSafe(counts["source"])).select(held["source"].alias("of"), "source_size", "target", "source_no", F.ceil(F.col("docs") / group).cast("int").alias("groups"))
    held = cut(held)  # a row for each source
    held = F.broadcast(held) if held.count() <= BROADCAST_SOURCES else held
    drawn = rows.join(held, rows["source"].eqNullSafe(held["of"])).drop("of")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = drawn.withColumn("per", per).withColumn("whole", F.floor("per")).withColumn("p", F.col("per") - F.col("whole")).drop("per")
    drawn = drawn.withColumn("part", F.pmod("place", F.col("groups")).cast("int"))
    schema = drawn.schema

    def flight(last: bool):
        def one(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(["size", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)
            size, p = t["size"].to_numpy(), t["p"].to_numpy(dtype=float, copy=True)
            up = np.ones(len(p), bool)
            if last:
                up[held_back(p)] = False
            p[up] = fly(size[up], p[up], f"{seed}:{t['source_no'].iat[0]}:{t['part'].iat[0]}:{last}")
            return t.assign(p=land(size, p) if last else p)

        return one

    most = held.agg(F.max("groups")).first()[0] or 1
    settled = []
    rest = drawn
    while most > 1:
        flown = cut(rest.groupBy("source_no", "part").applyInPandas(flight(False), schema))
        settled.append(flown.where("p = 0 or p = 1"))
        # each group leaves two documents at most, so the groups shrink by a factor of group / 2
        rest = flown.where("p > 0 and p < 1").withColumn("groups", F.ceil(F.col("groups") * 2 / group).cast("int")).withColumn("part", F.pmod("place", F.col("groups")).cast("int"))
        most = -(-most * 2 // group)
    out = rest.groupBy("source_no", "part").applyInPandas(flight(True), schema)
    for s in settled:
        out = out.unionByName(s)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)])
