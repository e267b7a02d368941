"""Ranking lanes and their fusion: exact dense top-k, learned-sparse top-k, rank and score fusion, packing.

A lane is a DataFrame (id, score). Ties go to the smaller id everywhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered


#: Sums of the same products in another order differ in later digits; sparse lanes hold scores equal to this one to be ties.
DIGITS = 9


def top(lane: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best; NaN scores are left out, for Spark holds them to be the largest. digits: scores that round alike tie."""
    score = F.col("score") if digits is None else F.round("score", digits)
    return lane.where(~F.isnan("score")).orderBy(score.desc(), "id").limit(k)


def dense(embeddings: DataFrame, query: list[float], k: int, model: str | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Cosine of every vector of the query's dimension; 0 where a norm is 0, none where a component is null. Hidden nodes take no place
    only if they are given. Vectors are scored in Arrow batches, one product each, and a batch gives its k best alone."""
    own = embeddings if model is None else embeddings.where(F.col("model") == model)
    own = own.where(F.size("vector") == len(query))
    if hidden is not None:
        own = own.join(hidden.select("node_id"), "node_id", "left_anti")
    kind = own.schema["node_id"].dataType.simpleString()
    return top(own.select("node_id", "vector").mapInArrow(scored([float(x) for x in query], k), f"id {kind}, score double"), k)


def scored(query: list[float], k: int):
    """For mapInArrow: (id, score) of the k best of each batch of (id, vector), and those that tie with them."""
    q = np.array(query, np.float64)
    norm = np.sqrt(q @ q)

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(b.num_rows, len(q))
                length = np.sqrt((m * m).sum(1)) * norm
                score = np.divide((m * q).sum(1), length, out=np.where(np.isnan(length), np.nan, 0.0), where=length > 0)
                keep = np.flatnonzero(~np.isnan(score))
                if len(keep) > k > 0:
                    keep = keep[score[keep] >= np.partition(score[keep], -k)[-k] - 1e-12]
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(score[keep])], names=["id", "score"])

    return run


def sparse(postings: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Sum over shared slots of document weight times query weight; query: (slot, weight), a bounded number of terms. Scores tie by DIGITS."""
    terms = F.broadcast(query.select("slot", F.col("weight").alias("q")))
    return top(postings.join(terms, "slot").groupBy(F.col("node_id").alias("id")).agg(F.sum(F.col("weight") * F.col("q")).alias("score")), k, DIGITS)


def _lanes(lanes: list[tuple[DataFrame, float]]) -> DataFrame | None:
    own = [df.select("id", "score").withColumn("lane", F.lit(i)).withColumn("weight", F.lit(float(w))) for i, (df, w) in enumerate(lanes) if w]
    return reduce(DataFrame.unionByName, own) if own else None


def fuse_ranks(lanes: list[tuple[DataFrame, float]], k: float = 60.0) -> DataFrame:
    """Weighted reciprocal-rank fusion: sum of weight / (k + place)."""
    place = F.row_number().over(W.partitionBy("lane").orderBy(F.col("score").desc(), "id"))
    return _lanes(lanes).withColumn("place", place).groupBy("id").agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("place"))).alias("score"))


def fuse_scores(lanes: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of min-max normalised scores; a lane without a spread gives 0.5."""
    lane = W.partitionBy("lane")
    low, high = F.min("score").over(lane), F.max("score").over(lane)
    scaled = F.when(high - low < 1e-12, F.lit(0.5)).otherwise((F.col("score") - low) / (high - low))
    return _lanes(lanes).withColumn("scaled", scaled).groupBy("id").agg(F.sum(F.col("scaled") * F.col("weight")).alias("score"))


def rerank_head(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """(id, score, place): the first k by the new score, then the rest in the order they had."""
    df = numbered(ranked, F.col("score").desc(), "id", name="old")
    head = df.where(F.col("old") <= k).withColumn("new", score)  # k rows at most
    head = head.withColumn("place", F.row_number().over(W.orderBy(F.col("new").desc_nulls_last(), "old")))
    rest = df.where(F.col("old") > k).withColumn("new", F.lit(None).cast(head.schema["new"].dataType)).withColumn("place", F.col("old"))
    return head.unionByName(rest)


def pack_budget(ranked: DataFrame, budget: int, limit: int | None = None) -> DataFrame:
    """Items (id, score, tokens) that fit, in order: one that overflows is left out, later ones may still fit.

    A fold in the order of the ranking: what can fit is in one list. An item of more tokens than the budget never fits, and of those of
    equal size only as many as the budget holds can, so the list is bounded by the budget, however many are ranked."""
    own = F.row_number().over(W.partitionBy("tokens").orderBy(F.col("score").desc(), "id"))
    seen = ranked.agg(F.count(F.lit(1)).alias("all"))
    some = ranked.where(F.col("tokens") <= budget).withColumn("_own", own)
    # items without tokens all fit, so only a limit bounds them
    ranked = some.where((F.col("_own") - 1) * F.col("tokens") <= budget)
    if limit is not None:
        ranked = ranked.where(F.col("_own") <= limit)
    item = F.struct((-F.col("score")).alias("s"), "id", F.col("tokens").cast("long").alias("tokens"))
    rows = ranked.agg(F.array_sort(F.collect_list(item)).alias("items"))
    most = limit if limit is not None else 2_147_483_647

    def take(acc, x):
        fits = (acc["used"] + x["tokens"] <= budget) & (F.size(acc["kept"]) < most)
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["id"]))).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    packed = rows.crossJoin(seen).select(F.aggregate("items", start, take).alias("p"), F.col("all").cast("int").alias("seen"))  # one row each
    return packed.select(F.posexplode("p.kept").alias("place", "id"), F.col("p.used").alias("tokens_used"), (F.col("seen") - F.size("p.kept")).alias("dropped"))


def suggested_neighbours(ranked: DataFrame, preview: int = 200) -> DataFrame:
    """Places 4 to 6, with the head of their text."""
    best = ranked.orderBy(F.col("score").desc(), "id").limit(6)
    place = F.row_number().over(W.orderBy(F.col("score").desc(), "id"))
    return best.withColumn("place", place).where("place between 4 and 6").select("id", "place", F.substring("text", 1, preview).alias("preview"))


def text_rank(texts: DataFrame, query: str, k: int) -> DataFrame:
    """By where the lower-cased query stands in the text, in bytes: 1 / (1 + offset); ties by length in bytes, then id."""
    low = F.lower("text")
    at = F.instr(low, query.lower())
    offset = F.octet_length(F.substring(low, F.lit(1), at - 1))
    hit = texts.where(at > 0).select("id", (F.lit(1.0) / (1 + offset)).alias("score"), F.octet_length("text").alias("size"))
    return hit.orderBy(F.col("score").desc(), "size", "id").limit(k).select("id", "score")


# --- approximate dense top-k ----------------------------------------------------------------------------------


def sign_index(embeddings: DataFrame, words: int = 4, seed: int = 11) -> DataFrame:
    """(node_id, code): signs of `words` * 63 random projections of each vector, as longs. Built once for a snapshot, it is a
    sixteenth of the vectors at 64 dimensions and the only thing that a search scans."""
    def run(batches):
        planes: dict = {}
        for b in batches:
            codes = []
            for v in b.column(1).to_pylist():
                if v and None not in v:
                    if len(v) not in planes:
                        planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((len(v), words * 63))
                    bits = (np.asarray(v, float) @ planes[len(v)] >= 0).reshape(words, 63)
                    codes.append((bits @ (1 << np.arange(63, dtype=np.int64))).tolist())
                else:
                    codes.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["node_id", "code"])

    return embeddings.select("node_id", "vector").mapInArrow(run, "node_id string, code array<bigint>")


def dense_approximate(index: DataFrame, embeddings: DataFrame, query: list[float], k: int, candidates: int = 200, seed: int = 11, hidden: DataFrame | None = None) -> DataFrame:
    """The k best by cosine among the `candidates` whose signs differ least from the query's; hidden nodes take no place."""
    if hidden is not None:
        index = index.join(hidden.select("node_id"), "node_id", "left_anti")
    words = index.where("code is not null").select(F.size("code")).limit(1).collect()
    if not words:
        return embeddings.limit(0).select(F.col("node_id").alias("id"), F.lit(0.0).alias("score"))
    planes = np.random.default_rng([seed, len(query)]).standard_normal((len(query), words[0][0] * 63))
    code = (np.asarray(query) @ planes >= 0).reshape(-1, 63) @ (1 << np.arange(63, dtype=np.int64))
    apart = F.aggregate(F.zip_with("code", F.array(*[F.lit(int(c)) for c in code]), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    near = index.where("code is not null").select("node_id", apart.alias("apart")).orderBy("apart", "node_id").limit(candidates)
    return dense(embeddings.join(F.broadcast(near.select("node_id")), "node_id"), query, k)  # as many rows as candidates
