"""Queries over stored indexes, long histories, and neighbours by descent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics, label_index, neighbours, postings, vector_index, versions
from ..sources.graph import sparse_vectors
from .lineage import folder
from .queries import CID, SPARSE, TOP, commit_name, first_vector, graph, nid, query, r6, read, sparse_query
from .retrieve import Retriever


def stored_vectors(spark, sf_dir) -> vector_index.VectorIndex | None:
    """The index of all embeddings, stored under the shared folder by the stamp of their files."""
    stamp = vector_index.stamp_of(read(spark, sf_dir, "embeddings"))
    return vector_index.opened(graph(spark, sf_dir).embeddings, f"{folder(spark)}/indexes/vectors", stamp)


def stored_postings(spark, sf_dir) -> postings.Postings:
    """The postings of all documents, stored likewise."""
    docs = read(spark, sf_dir, "documents")
    return postings.opened(lambda: sparse_vectors(docs), f"{folder(spark)}/indexes/postings", vector_index.stamp_of(docs), spark)


@query(f"WITH {SPARSE} SELECT id, round(score, 6) AS score FROM sparse")
def stored_sparse_top_k(spark, sf_dir):
    """The sparse top-k by stored postings: a search opens the folders of its slots and prunes blocks by their bounds."""
    t = stored_postings(spark, sf_dir).search(sparse_query(spark, sf_dir), 50)
    return t.select("id", r6("score").alias("score"))


@query(f"SELECT {nid('Vec', 'vec_id')} AS id FROM embeddings")
def indexed_vectors(spark, sf_dir):
    """What the stored vector index holds: every vector once."""
    return stored_vectors(spark, sf_dir).vectors().select(F.col("node_id").alias("id"))


@query(f"WITH {SPARSE} SELECT id, round(score, 6) AS score FROM sparse JOIN documents d ON id = {nid('Doc', 'd.doc_id')} WHERE d.lang = 'en'")
def retrieve_over_postings(spark, sf_dir):
    """Retrieval whose sparse lane is a prebuilt index in place of the graph's own vectors."""
    stored = stored_postings(spark, sf_dir)
    r = Retriever(graph(spark, sf_dir, "Doc"), vector_cap=50, prop=("lang", "en"), tombstoned=True).sparse_query(sparse_query(spark, sf_dir))
    return r.indexed(stored.stamp, postings=stored).candidates().select("id", r6("score").alias("score"))


@query()
def dense_approximate(spark, sf_dir):
    """The ten nearest by the stored vector index: the cells that the search probes are read, no others; tests measure the recall."""
    return stored_vectors(spark, sf_dir).search(first_vector(spark, sf_dir), 10).select("id", r6("score").alias("score"))


@query()
def knn_approximate(spark, sf_dir):
    """The ten nearest of each vector by neighbour descent; tests measure its recall."""
    return neighbours.descend(graph(spark, sf_dir).embeddings, 10).select("src", "dst", r6("weight").alias("weight"))


def late_fork(spark, sf_dir):
    """A history over the parts that is one line for three fifths of its length, and two branches after that."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey") + 1
    at = F.floor(F.col("top") * 3 / 5)
    t = part.crossJoin(part.agg((F.max("p_partkey") + 1).alias("top")))  # one row
    before = F.when(k <= 1, F.array().cast("array<string>")).when(k <= at + 1, F.array(commit_name(k - 1)))
    return t.select(commit_name(k).alias("cid"), before.when(k == at + 2, F.array(commit_name(at))).otherwise(F.array(commit_name(k - 2))).alias("parents"))


@query(f"SELECT {CID.format(f'{TOP} * 3 // 5')} AS cid")
def late_common_ancestor(spark, sf_dir):
    """The common ancestor of the last commits of two branches that part late: nothing is walked for each of the many common ones."""
    t = late_fork(spark, sf_dir)
    heads = [r[0] for r in t.orderBy(F.col("cid").desc()).select("cid").limit(2).collect()]
    return versions.lowest_common_ancestor(t, heads)


@query()
def spread_communities(spark, sf_dir):
    """Communities of the graph of near vectors by local moves as joins, at every size; tests compare its modularity."""
    near = knn_approximate(spark, sf_dir).where("weight > 0")
    return analytics.spread_communities(analytics.undirected(near))


@query(f"""SELECT {nid('Part', 'p_partkey')} AS id, 'Part' AS ntype, CASE WHEN p_partkey % 9 = 1 THEN 'new ' || p_name ELSE p_name END AS summary FROM part WHERE p_partkey % 4 <> 2 OR p_partkey % 9 = 1
    UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'Supplier', s_name FROM supplier""")
def label_index_append(spark, sf_dir):
    """A store of two labels after a commit that adds to one of them and removes from it: that label alone is written anew."""
    path = f"{folder(spark)}/indexes/labels-{uuid.uuid4().hex}"
    nodes = graph(spark, sf_dir, "Part", "Supplier").nodes.select("id", "ntype", "summary")
    label_index.build(nodes, path)
    parts, key = nodes.where("ntype = 'Part'"), F.substring("id", -10, 10).cast("long")
    added = parts.where(key % 9 == 1).withColumn("summary", F.concat(F.lit("new "), "summary"))
    label_index.append(spark, path, added, parts.where((key % 4 == 2) & (key % 9 != 1)).select("id", "ntype"))
    return label_index.read(spark, path).select("id", "ntype", "summary")
