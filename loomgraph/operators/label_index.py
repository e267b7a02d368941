"""Nodes stored by label. A commit rewrites the labels it touches and no others, so their files keep their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, remove
from .versions import committed


def build(nodes: DataFrame, path: str) -> None:
    """Stores (id, ntype, ...) in a partition for each label."""
    nodes.repartition("ntype", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("ntype").parquet(path)


def read(spark: SparkSession, path: str, *labels: str) -> DataFrame:
    """The stored nodes, or those of some labels: other partitions are not opened."""
    t = spark.read.parquet(path)
    return t.where(F.col("ntype").isin(*labels)) if labels else t


def append(spark: SparkSession, path: str, added: DataFrame, removed: DataFrame) -> list[str]:
    """Applies a commit: nodes added or replaced (in the columns of the store), and nodes (id, ntype) removed. A node that changes its label is
    removed under the old one. Returns the labels it touched, of which there are few; what they hold is computed before it is
    overwritten, and a label that loses all its nodes loses its partition."""
    touched = [r["ntype"] for r in added.select("ntype").unionByName(removed.select("ntype")).distinct().orderBy("ntype").collect()]
    if not touched:
        return []
    stored = read(spark, path)
    old = stored.where(F.col("ntype").isin(*touched))
    # an id stands once under each label, so the key is both
    key = F.concat_ws("\n", "ntype", "id")
    gone = removed.select(key.alias("id"))
    own = lambda t: t.select(*stored.columns).withColumn("_id", F.col("id")).withColumn("id", key)
    new = cut(committed(own(old), own(added), gone).withColumn("id", F.col("_id")).drop("_id"))
    new.repartition("ntype", F.pmod(F.xxhash64("id"), F.lit(8))).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("ntype").parquet(path)
    left = {r["ntype"] for r in new.select("ntype").distinct().collect()}
    for label in set(touched) - left:
        remove(spark, f"{path}/ntype={label}")
    return touched
