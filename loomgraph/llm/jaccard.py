"""Word-shingle Jaccard join by a MinHash LSH forest, verified on the whole texts.

Each document has in each of `trees` tries a string of `max_depth` min-hashes; documents under one node of a trie are
candidates. Matching begins at the longest prefixes. After each level the recall of every document is measured: a
link of similarity s is met at depth d with probability p(s) = 1 - (1 - s^d)^trees, so the links found stand for the sum
of 1 / p(s) links. A document whose recall is below the target goes on with prefixes shorter by one, and so do those
without links for as long as one at the threshold could be missed. Candidates of one node are compared exactly, each pair
where it meets first, and only verified links are joined into classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch, by_key
from .buckets import dealt, first_met, roots
from .shared import column, components, cut, least_ids, mix, numbers, shingles, slots, steps, word_hashes, words

#: A block of a node holds about so many texts and shingles; larger nodes are compared block by block.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 400_000


def forest_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The depth at which pairs at the threshold are found with that recall, so that no document needs a shorter prefix."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(trees: int, depth: int, size: int):
    """For mapInArrow: (doc_id, h, s1, s2, n, prefixes) of (doc_id, text, h); s1 and s2 are of the words in order, prefixes has the
    keys of the nodes at depth 1 of all trees, then those at depth 2 and so on."""
    places = numbers(11, trees * depth), numbers(12, trees * depth) | np.uint64(1)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                ids = b.column(0)
                for at, offsets, data in steps(b.column(1)):
                    starts, ends, first = words(offsets, data)
                    hashes = word_hashes(starts, ends, data)
                    rows = len(offsets) - 1
                    counts = np.diff(first)
                    order = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], counts).astype(np.uint64)
                    full = np.flatnonzero(counts)
                    seq = np.zeros((2, rows), np.uint64)
                    for k in (0, 1):
                        if len(full):
                            seq[k, full] = np.add.reduceat(mix(hashes + mix(order + np.uint64(77 + k))), first[:-1][full])
                    sh, begin = shingles(hashes, first, size)
                    keys = np.zeros((rows, depth, trees), np.uint64)
                    for t in range(trees):
                        for d in range(depth if len(full) else 0):
                            j = t * depth + d
                            low = np.minimum.reduceat((sh ^ places[0][j]) * places[1][j], begin[:-1][full])
                            above = keys[full, d - 1, t] if d else np.uint64(0)
                            keys[full, d, t] = mix(above * np.uint64(31) + low + np.uint64(t + 1))
                    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * (trees * depth))
                    yield batch(
                        doc_id=ids.slice(at, rows), h=b.column(2).slice(at, rows), s1=pa.array(seq[0].view(np.int64)), s2=pa.array(seq[1].view(np.int64)), n=pa.array(np.diff(begin).astype(np.int64)),
                        prefixes=pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64))),
                    )

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sorted sets."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if n <= 4:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    total, step = np.zeros((n, n), np.float64), 4096
    cuts = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else -1) + step + 1, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            m = np.zeros((n, step), np.float32)
            m[owner[a:b], code[a:b] - k * step] = 1
            total += m @ m.T
    return np.rint(total).astype(np.int64)


def found_at(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """The probability that a pair is met at that depth."""
    return 1 - (1 - similarity**depth) ** trees


def links(one: bool, group: dict, threshold: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a new candidate, which of them are linked, similarity) of one pair of blocks. one: the blocks are the same."""
    block, active = (np.asarray(group[k]) for k in ("block", "active"))
    new = first_met(group["earlier"], block, one) & (active[:, None] | active[None, :])
    rows = np.flatnonzero(new.any(1))
    sets = []
    for _, offsets, data in steps(group["text"].take(pa.array(rows))):
        starts, ends, first = words(offsets, data)
        sh, begin = shingles(word_hashes(starts, ends, data), first, size)
        sets += [np.unique(sh[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    both = overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    near = new[np.ix_(rows, rows)] & (both > 0) & (both >= threshold * union - 1e-9)
    return rows, near, both / np.maximum(union, 1)


def verify(threshold: float, size: int, depth: int, trees: int):
    """For by_key over (tree, key, bi, bj): (node, links, root, shares) for each linked row; shares: the links that these stand for,
    at each depth."""

    def one(key, group):
        rows, near, similarity = links(key[2] == key[3], group, threshold, size)
        hit = near.any(1)
        if hit.any():
            node, mult = (np.asarray(group[k])[rows] for k in ("node", "mult"))
            root = roots(node, near)
            at, to = np.nonzero(near)
            shares = np.stack([np.bincount(at, mult[to] / found_at(similarity[at, to], d, trees), len(rows)) for d in range(1, depth + 1)], 1)
            ends = pa.array(np.arange(int(hit.sum()) + 1, dtype=np.int32) * depth)
            yield batch(
                node=pa.array(node[hit]), links=pa.array((near @ mult)[hit].astype(np.int64)), root=pa.array(root[hit]),
                shares=pa.ListArray.from_arrays(ends, pa.array(shares[hit].reshape(-1))),
            )

    return by_key(4, one)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, trees: int = 10, max_depth: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, rep_id, kept, depth.

    Two documents are linked when the sets of their word 5-grams (a document of fewer words: all its words) have a
    Jaccard similarity of at least the threshold; class_id is the smallest doc_id reachable by links, n_links the
    number of other rows linked directly. Texts of the same words are one node, rep_id, and linked with
    each other. Texts that are null or without words link with nothing. Different texts under one id are several
    documents, each with its own links; rows without an id get null classes and no links. Whole texts are compared; other columns are not looked at.
    depth: the length of the prefix at which the document's recall was reached."""
    spark = docs.sparkSession
    least = forest_depth(trees, max_depth, threshold, recall)
    base = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = cut(base.mapInArrow(signatures(trees, max_depth, size), "doc_id long, h long, s1 long, s2 long, n long, prefixes array<long>"))
    usable = signed.where("n > 0 and doc_id is not null")
    # a node is a content, named by its hash; its text is read from the row (doc_id, h) that is its least one
    same = usable.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count(F.lit(1)).alias("mult"), F.max("n").alias("n"), F.any_value("prefixes").alias("prefixes"))
    same = cut(same.select(F.xxhash64("s1", "s2").alias("node"), "s1", "s2", F.col("rep.doc_id").alias("least"), F.col("rep.h").alias("h"), "mult", "n", "prefixes"))
    repeated = cut(usable.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "h"))
    texts = base
    if repeated.take(1):  # of equal rows one is read
        texts = base.join(repeated, ["doc_id", "h"], "left_anti").unionByName(base.join(repeated, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]))
    state = same.select("node", F.lit(True).alias("active"), F.lit(max_depth).alias("depth"), F.lit(0).cast("long").alias("links"), F.array(*[F.lit(0.0)] * max_depth).alias("shares"))
    edges = None
    for d in range(max_depth, least - 1, -1):
        level = lambda k: F.slice("prefixes", (k - 1) * trees + 1, trees)
        met = F.slice(level(d), 1, F.col("tree")) if d == max_depth else F.concat(F.slice(level(d), 1, F.col("tree")), F.slice(level(d + 1), F.col("tree") + 1, trees))
        hung = same.join(state.select("node", "active"), "node").select("node", "active", F.posexplode(level(d)).alias("tree", "key"))
        full = hung.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m"), F.max("active").alias("any")).where("m > 1 and any").select("tree", "key")
        rows = hung.select("node", "tree", "key").join(full, ["tree", "key"]).join(same.select("node", F.col("n").alias("weight"), "prefixes"), "node")
        rows = rows.select("tree", "key", "node", "weight", met.alias("earlier"))
        pairs = cut(dealt(rows, BLOCK_TEXTS, BLOCK_SHINGLES)).join(same.select("node", "mult", F.col("least").alias("doc_id"), "h"), "node").join(state.select("node", "active"), "node")
        shipped = texts.join(pairs, ["doc_id", "h"]).select("tree", "key", "bi", "bj", "node", "mult", "block", "active", "earlier", "text")
        sorted_ = shipped.repartition(slots(spark), "tree", "key", "bi", "bj").sortWithinPartitions("tree", "key", "bi", "bj")
        found = cut(sorted_.mapInArrow(verify(threshold, size, max_depth, trees), "node long, links long, root long, shares array<double>"))
        new = found.groupBy("node").agg(F.sum("links").alias("more"), *[F.sum(F.col("shares")[k]).alias(f"s{k}") for k in range(max_depth)])
        state = state.join(new, "node", "left")
        count = F.col("links") + F.coalesce("more", F.lit(0))
        shares = F.array(*[F.col("shares")[k] + F.coalesce(f"s{k}", F.lit(0.0)) for k in range(max_depth)])
        # besides the links found, one at the threshold may be there
        chance = float(found_at(np.float64(threshold), d, trees))
        reached = (count + chance) / (shares[d - 1] + 1) >= recall
        depth = F.when(F.col("active"), F.lit(d)).otherwise(F.col("depth"))
        state = cut(state.select("node", (F.col("active") & ~reached).alias("active"), depth.alias("depth"), count.cast("long").alias("links"), shares.alias("shares")))
        joined = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        edges = joined if edges is None else edges.unionByName(joined)
    nodes = same.join(state, "node").join(least_ids(components(edges), same), "node", "left")
    nodes = nodes.select("s1", "s2", "least", "mult", "links", "depth", F.coalesce("component_id", "least").alias("class_id"))
    linked = usable.select("doc_id", "s1", "s2").join(nodes, ["s1", "s2"]).select(
        "doc_id", "class_id", (F.col("links") + F.col("mult") - 1).cast("long").alias("n_links"), F.col("least").alias("rep_id"), F.col("class_id").eqNullSafe(F.col("doc_id")).alias("kept"), "depth"
    )
    alone = signed.where("not (n > 0 and doc_id is not null)").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep_id"), F.lit(True).alias("kept"), F.lit(max_depth).alias("depth")
    )
    return linked.unionByName(alone)
