"""A stored vector index: coarse cells in a folder, named by the snapshot they were made of.

Every vector stands in the cell of its nearest centre. The cells are parquet partitions, so a search reads those that it probes and no
others, and ranks what is in them exactly. How many to probe is measured when the index is built, against all vectors. A stamp says
which snapshot an index is of: `load` returns none for another one, `opened` builds it anew.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import drop_others, exists, publish
from . import rank

#: Bounds of what the driver fits: vectors of the sample that centres come from, and questions that the recall is measured with.
SAMPLE = 20_000
QUESTIONS = 64
#: Partition folders of an index at most; a folder holds several cells where there are more of them, sorted by cell.
FOLDERS = 256


def stamp_of(df: DataFrame) -> str:
    """A stamp of the files that a DataFrame reads: their names, sizes and times."""
    spark = df.sparkSession
    seen = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(length > 0, length, 1)


def centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors starts anew at the vector that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = sample @ out.T
        own = near.argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        total[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        out = unit(total)
    return out


def folder_of(path: str, stamp: str, model: str | None) -> str:
    return f"{path}/{stamp}-{hashlib.sha256((model or '').encode()).hexdigest()[:8]}"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class VectorIndex:
    """An index of one model's vectors of one dimension, as `build` or `load` give it."""

    spark: SparkSession
    #: The folder of this index.
    path: str
    stamp: str
    model: str | None
    middle: np.ndarray
    probes: int
    recall: float
    schema: object

    @property
    def folders(self) -> int:
        return min(FOLDERS, len(self.middle))

    def cells(self, query: list[float], probes: int | None = None) -> list[int]:
        """The cells that a search reads, nearest first."""
        near = self.middle @ unit(np.asarray(query, np.float64))
        return np.argsort(-near, kind="stable")[: probes or self.probes].tolist()

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """(node_id, vector, cell) of some cells, or of all; other folders are not opened."""
        t = self.spark.read.schema(self.schema).parquet(f"{self.path}/cells")
        if cells is None:
            return t.drop("folder")
        return t.where(F.col("folder").isin(sorted({c % self.folders for c in cells})) & F.col("cell").isin(cells)).drop("folder")

    def search(self, query: list[float], k: int, probes: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
        """(id, score): the k best by cosine in the probed cells; hidden nodes take no place. Fewer than k only if these hold fewer."""
        if len(query) != self.middle.shape[1]:
            return self.vectors([]).select(F.col("node_id").alias("id"), F.lit(0.0).alias("score"))
        return rank.dense(self.vectors(self.cells(query, probes)), query, k, hidden=hidden)


def build(embeddings: DataFrame, path: str, stamp: str, model: str | None = None, dim: int | None = None, cells: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex | None:
    """Indexes every vector of (node_id, model, vector) that has the model and dimension (by default that of the most vectors), and
    no null component; zero vectors stand in some cell. None if there are no such vectors.

    cells defaults to the square root of their number. Centres are fitted on at most SAMPLE vectors. The probes are the fewest with
    which QUESTIONS of the vectors find `recall` of their true k nearest, all vectors compared. Cells are written before the head that
    names them, so an index that was not finished is not found."""
    spark, path = embeddings.sparkSession, folder_of(path, stamp, model)
    own = embeddings if model is None else embeddings.where(F.col("model") == model)
    if dim is None:
        most = own.groupBy(F.size("vector").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
        if most is None:
            return None
        dim = most["dim"]
    own = own.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())).select("node_id", "vector")
    n = own.count()
    if not n:
        return None
    some = own.orderBy(F.xxhash64("node_id"), "node_id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    sample = unit(_matrix(some))
    cells = min(cells or math.ceil(math.sqrt(n)), len(sample))
    middle = centres(sample, cells)

    def placed(batches):
        for b in batches:
            if b.num_rows:
                near = unit(_matrix(b.column(1))) @ middle.T
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(1).astype(np.int32))], names=[*b.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    folders = min(FOLDERS, cells)
    table = own.mapInArrow(placed, f"{kinds}, cell int").withColumn("folder", F.col("cell") % folders)
    table.repartitionByRange("folder", "cell", "node_id").sortWithinPartitions("folder", "cell").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/cells")
    made = VectorIndex(spark, path, stamp, model, middle, cells, 1.0, table.schema)
    probes, reached = _measured(made, own, sample[:QUESTIONS], k, recall)
    head = spark.createDataFrame([(stamp, model, middle.tolist(), probes, reached)], "stamp string, model string, middle array<array<double>>, probes int, recall double")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return VectorIndex(spark, path, stamp, model, middle, probes, reached, table.schema)


def _measured(index: VectorIndex, own: DataFrame, questions: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """The fewest probes that find the share `recall` of the true k nearest of the questions, and the share they find."""
    order = np.argsort(-(questions @ index.middle.T), 1, kind="stable")
    place = np.argsort(order, 1)  # of each cell among a question's probes

    def best(batches):
        for b in batches:
            if b.num_rows:
                score = questions @ unit(_matrix(b.column("vector"))).T
                cell = np.asarray(b.column("cell"))
                top = np.argsort(-score, 1, kind="stable")[:, : k + 1]
                asked = np.repeat(np.arange(len(questions)), top.shape[1])
                at = top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), pa.array(score[asked, at]), pa.array(place[asked, cell[at]].astype(np.int32))], names=["asked", "score", "place"])

    found = index.vectors().mapInArrow(best, "asked int, score double, place int")
    lists = found.groupBy("asked").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "place")), False), 2, k).alias("best"))  # without the question itself
    places = np.array([p["place"] for r in lists.collect() for p in r["best"]])
    for probes in range(1, len(index.middle) + 1):
        if not len(places) or (places < probes).mean() >= recall:
            break
    return probes, float((places < probes).mean()) if len(places) else 1.0


def load(spark: SparkSession, path: str, stamp: str, model: str | None = None) -> VectorIndex | None:
    """The stored index of that stamp and model; none if there is none, or only one of another snapshot or model."""
    path = folder_of(path, stamp, model)
    if not exists(spark, f"{path}/head/_SUCCESS"):
        return None
    head = spark.read.parquet(f"{path}/head").first()
    if head is None or head["stamp"] != stamp or head["model"] != model:
        return None
    schema = spark.read.parquet(f"{path}/cells").schema
    return VectorIndex(spark, path, stamp, model, np.array(head["middle"]), head["probes"], head["recall"], schema)


def opened(embeddings: DataFrame, path: str, stamp: str, model: str | None = None, **how) -> VectorIndex | None:
    """The stored index of that snapshot, built first if it is not there. Indexes of other snapshots under the path are removed then."""
    spark = embeddings.sparkSession
    found = load(spark, path, stamp, model)
    if found is not None:
        return found
    building = f"{path}/building-{uuid.uuid4().hex}"
    if build(embeddings, building, stamp, model, **how) is None:
        return None
    publish(spark, folder_of(building, stamp, model), folder_of(path, stamp, model))
    drop_others(spark, path, f"{stamp}-")
    return load(spark, path, stamp, model)
