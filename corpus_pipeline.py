"""The corpus pipeline: language, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Decisions are made by doc_id, so documents without one leave in the first stage; rows of one id are one document, and rows
equal in text too are one row after the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.jaccard import jaccard_join
from loomgraph.llm.language import identify, train, training_rows
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.packing import pack
from loomgraph.llm.shared import SPACE, Scratch, column, cut


def staying(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; the ids' side is hashed, so texts are not sorted."""
    return docs.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter (`und`) go, and those without an id. Ambiguous ones stay: most
    are sound texts in two languages."""
    columns = docs.columns
    out = identify(docs.where("doc_id is not null"), train(training_rows(docs)), keep=tuple(c for c in columns if c != "doc_id"))
    return out.where("lang_pred <> 'und'").select(*[column(out, c) for c in columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id. Of rows that have that id and text too, one stays."""
    kept = cut(exact_dedup(docs).where("kept and doc_id is not null").select("doc_id", "text_sha256"))
    several = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    out = staying(docs, kept.join(several, "doc_id", "left_anti"))
    norm = F.regexp_replace(F.coalesce(column(docs, "text"), F.lit("")), SPACE, " ")
    marked = docs.withColumn("__text", F.sha2(norm, 256)).join(several, "doc_id", "left_semi")
    wanted = kept.select("doc_id", F.col("text_sha256").alias("__text"))
    again = marked.join(wanted, ["doc_id", "__text"], "left_semi").dropDuplicates(["doc_id", "__text"])
    return out.select(*[column(out, c) for c in docs.columns]).unionByName(again.select(*[column(again, c) for c in docs.columns]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return staying(docs, jaccard_join(docs).where("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mix_sources(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    rows = docs.join(taken.select(F.col("doc_id").alias("taken_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).hint("shuffle_hash"), F.col("doc_id") == F.col("taken_id"))
    return rows.select(*[column(docs, c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences."""
    return pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mixing), ("packing", packing)]

#: No SQL: the language model, the mix and the packing can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
