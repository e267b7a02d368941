"""Evaluation of retrieval: hits and recall at k, per question type and overall; lexical boosts; session scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import asks_for_date, asks_for_number, has_date, has_digit, word_set


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ranked, 1, k), gold)


def found_share(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold items among the first k; 1 where there is no gold."""
    n = F.size(gold)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / n)


def report(results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(qtype, questions, hit_at_k...) by type and, with qtype `all`, overall: (qid, qtype, ranked, gold)."""
    t = results.select("qtype", *[hit_at(F.col("ranked"), F.col("gold"), k).cast("int").alias(f"hit_at_{k}") for k in ks])
    out = t.rollup("qtype").agg(F.count(F.lit(1)).alias("questions"), *[F.avg(f"hit_at_{k}").alias(f"hit_at_{k}") for k in ks])
    return out.withColumn("qtype", F.coalesce("qtype", F.lit("all")))


def first_occurrences(hits: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """Hits by rank with only the first of each item, ranked anew."""
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy(key, item).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order)))


def by_session(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(qid, session, score, place): turns (qid, id, score) as sessions (id, session) with the best score of their turns."""
    t = hits.join(sessions, "id").groupBy("qid", "session").agg(F.max("score").alias("score"))
    return t.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "session")))


def evidence_found(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, found, of, recall): evidence texts that a retrieved text of the question contains, or is contained in, lower-cased."""
    e = evidence.select("qid", F.monotonically_increasing_id().alias("eid"), F.lower("evidence").alias("e")) if "eid" not in evidence.columns else evidence.select("qid", "eid", F.lower("evidence").alias("e"))
    t = e.join(hits.select("qid", F.lower("text").alias("t")), "qid", "left")
    each = t.groupBy("qid", "eid").agg(F.max(F.coalesce(F.contains("t", "e") | F.contains("e", "t"), F.lit(False))).alias("ok"))
    return each.groupBy("qid").agg(F.sum(F.col("ok").cast("int")).alias("found"), F.count(F.lit(1)).alias("of"), F.avg(F.col("ok").cast("double")).alias("recall"))


def lexical_boost(score: Column, question: Column, text: Column, weight: float = 0.3, date: float = 0.10, number: float = 0.05) -> Column:
    """score + weight * share of the question's words in the text, and bonuses where dates or numbers are asked for and given."""
    q, t = F.lower(question), F.lower(text)
    words = word_set(q)
    overlap = F.size(F.array_intersect(words, word_set(t))) / F.greatest(F.size(words), F.lit(1))
    bonus = F.when(asks_for_date(question) & has_date(t), F.lit(date)).otherwise(F.lit(0.0)) + F.when(asks_for_number(question) & has_digit(t), F.lit(number)).otherwise(F.lit(0.0))
    return score + weight * overlap + bonus
