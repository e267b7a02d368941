"""What the operators share: cut lineage, tables in the shared folder, vectorised word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes at once, some 50 times that in memory; a longer document is one step of its own.
STEP_BYTES = 1 << 19

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


# --- lineage -------------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; on one machine (tests), where that is unset, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and own.isDefined():
        return own.get()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """What runs inside removes its shuffle files when it is done: its result is written, so nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder. Where spark.cleaner.referenceTracking.cleanCheckpoints is true, Spark
    removes it when nothing refers to it any more; else it stays until the folder is emptied."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder, for what is too large for row checkpoints.

    drop() removes one; those that a lazy result still reads are removed when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/loomgraph/{uuid.uuid4().hex}"
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with tidy(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # a stopped session leaves nobody to ask
            with contextlib.suppress(Exception):
                self.drop()


def column(df: DataFrame, name: str):
    """A column by its exact name, also if the name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing -------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = numbers(1, 256)
_PLACES = numbers(2, 64) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        _PLACES = numbers(2, 2 * n) | np.uint64(1)
    return _PLACES


def steps(texts: pa.Array, limit: int = STEP_BYTES):
    """(first row, offsets, bytes) of consecutive rows of a string column, about limit bytes each; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def words(offsets: np.ndarray, data: np.ndarray, between: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: start and end byte, and for each document the index of its first word (one more at the end).

    between: for each byte, whether it stands between words."""
    word = ~between[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = word[cuts]
    inner = cuts[cuts > 0]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A uint64 for each word, from its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    flat = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        value = _BYTES[data[flat + np.repeat(starts, sizes)]] * _places(int(sizes.max()))[flat]
        return mix(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one document, and the first shingle of each document (one more at the end).

    A document of fewer words, but at least one, has one shingle: all its words."""
    counts = np.diff(first)
    out = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    begin = np.concatenate(([0], np.cumsum(out)))
    at = np.arange(int(begin[-1])) - np.repeat(begin[:-1], out) + np.repeat(first[:-1], out)
    factors = numbers(3, size) | np.uint64(1)
    end = np.repeat(first[1:], out)
    padded = np.concatenate((hashes, np.zeros(1, np.uint64)))
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for j in range(size):
            total += padded[np.where(at + j < end, at + j, len(hashes))] * factors[j]
        return mix(total), begin


# --- components ----------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of every node of the undirected edges (a, b), the smallest node it is joined with.

    Alternates large and small stars; a node's neighbours are met in joins and sums, never in one list."""
    spark = edges.sparkSession
    size = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = stars.agg(*size).first()
    while before["n"]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that both sides of the join come from a shuffle that is split where one node has many neighbours
        least = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m")))
        large = cut(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(small, "a")
        new = cut(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        after = new.agg(*size).first()
        stars = new
        if after == before:
            break
        before = after
    if not before["n"]:
        return spark.createDataFrame([], "node long, component long")
    inner = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def least_ids(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component_id): of every node of the classes (node, component), the smallest `least` among the nodes of its component."""
    members = cut(classes.join(nodes.select("node", "least"), "node"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return members.join(least, "component").select("node", "component_id")
