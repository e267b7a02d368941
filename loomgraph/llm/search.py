"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

Postings are stored by term, highest impact first. The heads of an item's lists name candidates, whose exact scores give a bound
that the item's last answer reaches. With m lists, a document that reaches it stands in some list with at least an m-th of the bound,
so lists are read down to that; what a document could still gain in the lists it was not met in is at most that m-th in each.
Documents that can reach the bound are looked up exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import batch
from .shared import Scratch, column, cut, slots
from .terms import counted, terms

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of an item and a term that are searched at once; more items are searched block by block. What is broadcast is no larger.
BLOCK_TERMS = 250_000


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of one item_id are one item."""
    lower = F.translate(F.coalesce(column(items, text_col), F.lit("")), UPPER, UPPER.lower())
    found = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))))
    return items.select(column(items, item_col).alias("item_id"), found.alias("term")).distinct()


def forward(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, n, terms, times): of every row its number of terms, and which of the vocabulary occur in it how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        values = pa.array(known.value, pa.large_string())
        for b in batches:
            for at, sizes, flat in terms(b.column("text"), digits=True):
                codes = pc.index_in(flat, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, code, times = counted(sizes, codes, len(values))
                ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((code, pa.int32()), (times, pa.int64())))
                yield batch(doc_id=b.column("doc_id").slice(at, len(sizes)), n=pa.array(sizes, pa.int64()), **dict(zip(("terms", "times"), lists)))

    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, times array<long>")
    return out.withColumn("rid", F.monotonically_increasing_id())


def impact(weight: Column, tf: Column, n: Column, docs: int, total: int) -> Column:
    """weight * ((10^9 tf) div (1000 tf + 8 m)), where m = 10 + (90 n docs) div total; 64-bit integers throughout."""
    m = F.lit(10) + F.call_function("div", F.lit(90) * n * F.lit(docs), F.lit(max(total, 1)))
    return weight * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


def rank_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k rows of docs with the highest score above 0, equal scores by doc_id.

    Every row of docs is a document, also where ids repeat; a null id comes after all others. Items without an id are one item. Null and empty texts have no terms, and
    items without terms no answer. Items are searched in blocks of at most about 250,000 terms in all (BLOCK_TERMS; an item with
    more is not split), each over all documents; no posting is left out but by the bounds. Other columns are not looked at."""
    spark = docs.sparkSession
    pairs = cut(item_terms(items, item_col, item_text))
    blocks = math.ceil(pairs.count() / BLOCK_TERMS)
    found = [_searched(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    found = [f for f in found if f is not None]
    out = found[0] if found else spark.createDataFrame([], f"item_id {pairs.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.select(column(docs, id_col)).schema[0].dataType.simpleString()}, score long")
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _searched(docs: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = pairs.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull()))  # an item may lack an id
    names = F.broadcast(named.select("item", "item_id").distinct())
    pairs = named.select(F.col("item").alias("item_id"), "term")
    vocabulary = sorted(r["term"] for r in pairs.select("term").distinct().collect())
    if not vocabulary:
        return None
    ahead = scratch.save(forward(docs, vocabulary, id_col, text_col), "forward")
    size = ahead.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = {r["term"]: r["df"] for r in ahead.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = [(i, t, math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * df.get(i, 0) + 1)))) for i, t in enumerate(vocabulary)]
    weights = F.broadcast(spark.createDataFrame(weights, "term int, word string, weight long"))
    wanted = cut(pairs.withColumnRenamed("term", "word").join(weights, "word").select("item_id", "term", "weight"))

    # postings by term, highest impact first; ranges of (term, impact), so a frequent term's list spans many files
    listed = ahead.select("rid", "n", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("rid", "n", "p.terms", "p.times")
    listed = listed.withColumnRenamed("terms", "term").join(weights.drop("word"), "term")
    listed = listed.select("term", impact(F.col("weight"), F.col("times"), F.col("n"), size["docs"], size["total"]).alias("impact"), "rid").where("impact > 0")
    order = ("term", F.desc("impact"), "rid")
    lists = scratch.save(listed.repartitionByRange(slots(spark), *order).sortWithinPartitions(*order), "postings")

    def scores(of: DataFrame) -> DataFrame:
        """(item_id, doc_id, rid, score) of pairs (item_id, rid): looked up in the documents' own terms."""
        rows = of.join(ahead, "rid").select("item_id", "rid", "doc_id", "n", F.explode(F.arrays_zip("terms", "times")).alias("p"))
        rows = rows.select("item_id", "rid", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.times").alias("times")).join(F.broadcast(wanted), ["item_id", "term"])
        total = F.sum(impact(F.col("weight"), F.col("times"), F.col("n"), size["docs"], size["total"]))
        return rows.groupBy("item_id", "rid", "doc_id").agg(total.alias("score"))

    # 1: the heads of the lists
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("impact"), "rid"))
    heads = lists.withColumn("at", rank).where(F.col("at") <= k).select("term", "rid")
    heads = heads.join(F.broadcast(wanted), "term").select("item_id", "rid").distinct()
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "rid"))
    bound = scores(heads).withColumn("at", best).where(F.col("at") == k).select("item_id", F.col("score").alias("bound"))
    # what a document not met in a list down to the threshold can gain there: nothing, if the list ends above it
    ends = lists.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least"))
    wanted_lists = wanted.join(ends, "term").join(bound, "item_id", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    m = F.count(F.lit(1)).over(W.partitionBy("item_id"))
    low = F.greatest(F.lit(1), F.call_function("div", F.col("bound") + m - 1, m))
    wanted_lists = wanted_lists.withColumn("low", low).withColumn("rest", F.when(F.col("least") >= F.col("low"), 0).otherwise(F.least(F.col("low") - 1, "most")))
    wanted_lists = cut(wanted_lists.withColumn("rests", F.sum("rest").over(W.partitionBy("item_id"))).select("item_id", "term", "bound", "low", "rest", "rests"))

    # 2: all lists down to the threshold
    floors = wanted_lists.groupBy("term").agg(F.min("low").alias("floor"))
    lowest = floors.agg(F.min("floor")).first()[0]
    if lowest is None:  # no document holds any of the terms
        return None
    met = lists.where(F.col("impact") >= F.lit(lowest)).join(F.broadcast(floors), "term").where("impact >= floor").select("term", "impact", "rid")
    met = met.repartition(slots(spark), "rid").join(F.broadcast(wanted_lists), "term").where("impact >= low")
    sums = met.groupBy("rid", "item_id").agg(F.sum("impact").alias("least"), (F.sum(F.col("impact") - F.col("rest")) + F.first("rests")).alias("most"), F.first("bound").alias("bound"))
    able = cut(sums.where("most >= bound").select("item_id", "rid", "least", "most"))
    second = able.withColumn("at", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("least"), "rid"))).where(F.col("at") == k)
    able = able.join(second.select("item_id", F.col("least").alias("second")), "item_id", "left").where("second is null or most >= second")

    # 3: exact scores of what is left
    last = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid"))
    found = scores(able.select("item_id", "rid")).withColumn("rank", last).where(F.col("rank") <= k).withColumnRenamed("item_id", "item")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
