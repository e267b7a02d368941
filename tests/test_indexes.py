"""Stored indexes, neighbour descent, history segments and order helpers against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analytics, chunk, expand, history, label_index, neighbours, order, postings, rank, vector_index, versions
from loomgraph.plans.retrieve import GraphExpand, RetrievalEmpty, Retriever, checked
from loomgraph.sources.graph import Graph


def clustered(n, dim, seed=2):
    rng = np.random.default_rng(seed)
    k = max(1, n // 50)
    return rng.standard_normal((k, dim))[rng.integers(0, k, n)] + rng.standard_normal((n, dim)) * 0.6


def table(spark, m):
    return spark.createDataFrame([(f"v{i:05d}", "m", [float(x) for x in r]) for i, r in enumerate(m)], "node_id string, model string, vector array<double>")


def files_read(df):
    """How many files the one scan of a DataFrame opens."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


# --- the vector index -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    m = clustered(2000, 16)
    return m, table(spark, m).cache()


def test_vector_index_finds_the_nearest(spark, vectors, tmp_path):
    m, e = vectors
    index = vector_index.opened(e, str(tmp_path), "one")
    assert index.recall >= 0.95 and sorted(r.node_id for r in index.vectors().collect()) == [f"v{i:05d}" for i in range(2000)]
    found = []
    for i in range(0, 2000, 200):
        q = [float(x) for x in m[i]]
        found.append(len({r.id for r in index.search(q, 10).collect()} & {r.id for r in rank.dense(e, q, 10).collect()}))
    assert sum(found) >= 0.9 * 10 * len(found)
    full = index.search([float(x) for x in m[7]], 10, probes=len(index.middle)).collect()
    assert [(r.id, round(r.score, 9)) for r in full] == [(r.id, round(r.score, 9)) for r in rank.dense(e, [float(x) for x in m[7]], 10).collect()]


def test_a_search_reads_its_cells_alone(spark, vectors, tmp_path):
    m, e = vectors
    index = vector_index.opened(e, str(tmp_path), "one")
    cells = index.cells([float(x) for x in m[3]])
    assert 0 < len(cells) < len(index.middle)
    read = index.vectors(cells)
    assert {r.cell for r in read.select("cell").distinct().collect()} <= set(cells)
    assert "PartitionFilters: [folder" in read._jdf.queryExecution().executedPlan().toString()
    assert files_read(read) == len(cells) < files_read(index.vectors())  # a folder for each cell here


def test_a_stale_stamp_gives_none_and_rebuilds(spark, vectors, tmp_path):
    m, e = vectors
    path = str(tmp_path)
    first = vector_index.opened(e, path, "one")
    assert vector_index.load(spark, path, "two") is None and vector_index.load(spark, path, "one", "m") is None
    again = vector_index.opened(e.limit(0), path, "one")  # found, so nothing is built of the empty table
    assert again.probes == first.probes and np.array_equal(again.middle, first.middle)
    new = vector_index.opened(e.where("node_id < 'v00500'"), path, "two")
    assert new.vectors().count() == 500 and vector_index.load(spark, path, "one") is None
    with pytest.raises(ValueError):
        Retriever(Graph(e, e)).indexed("one", vectors=new)


def test_vector_index_edges(spark, tmp_path):
    kinds = "node_id string, model string, vector array<double>"
    rows = [("a", "m", [1.0, 0.0]), ("b", "m", [0.0, 0.0]), ("c", "m", None), ("d", "m", [1.0, None]), ("e", "m", []), ("f", "n", [1.0, 2.0, 3.0]), ("a", "m", [1.0, 0.0])]
    index = vector_index.opened(spark.createDataFrame(rows, kinds), str(tmp_path), "s")
    assert sorted(r.node_id for r in index.vectors().collect()) == ["a", "a", "b"]
    assert [r.id for r in index.search([2.0, 0.0], 2).collect()] == ["a", "a"] and index.search([1.0, 2.0, 3.0], 2).collect() == []
    assert vector_index.opened(spark.createDataFrame([], kinds), str(tmp_path), "t") is None


def test_a_file_s_change_changes_the_stamp(spark, tmp_path):
    one = spark.range(5)
    one.write.parquet(str(tmp_path / "t"))
    read = lambda: vector_index.stamp_of(spark.read.parquet(str(tmp_path / "t")))
    before = read()
    assert read() == before
    one.write.mode("append").parquet(str(tmp_path / "t"))
    assert read() != before


# --- postings -------------------------------------------------------------------------------------------------


def test_stored_postings_give_the_exact_best(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(f"n{i:04d}", s, rng.random() ** 3 + 0.001) for i in range(1500) for s in rng.sample(range(100), 6)]
    v = spark.createDataFrame(rows, "node_id string, slot int, weight double")
    p = postings.opened(lambda: v, str(tmp_path), "a", spark)
    assert p.of().count() == len(rows)
    for query in ([(1, 1.0), (2, 0.5)], [(1, 100.0), (2, 0.001)], [(s, rng.random()) for s in range(40)], [(500, 1.0)], []):
        q = spark.createDataFrame(query, "slot int, weight double")
        assert [(r.id, round(r.score, 9)) for r in p.search(q, 10).collect()] == [(r.id, round(r.score, 9)) for r in rank.sparse(v, q, 10).collect()]
    assert postings.load(spark, str(tmp_path), "b") is None
    assert postings.opened(lambda: v.limit(7), str(tmp_path), "b", spark).of().count() == 7 and postings.load(spark, str(tmp_path), "a") is None


def test_sparse_scores_that_round_alike_are_ties(spark, tmp_path):
    rows = [("a", 1, 0.3), ("b", 2, 0.1), ("b", 3, 0.2), ("c", 1, 0.05)]  # 0.1 + 0.2 is above 0.3 in doubles
    v = spark.createDataFrame(rows, "node_id string, slot int, weight double")
    q = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "slot int, weight double")
    for lane in (rank.sparse(v, q, 1), postings.opened(lambda: v, str(tmp_path), "a", spark).search(q, 1)):
        assert [r.id for r in lane.collect()] == ["a"]


def test_postings_of_a_query_open_its_folders(spark, tmp_path):
    v = spark.createDataFrame([("n", s, 1.0) for s in range(100)], "node_id string, slot int, weight double")
    p = postings.opened(lambda: v, str(tmp_path), "a", spark)
    assert [r.slot for r in p.of([3, 70]).orderBy("slot").collect()] == [3, 70]
    assert "PartitionFilters: [folder" in p.of([3, 70])._jdf.queryExecution().executedPlan().toString() and files_read(p.of([3, 70])) == 2 < files_read(p.of())


# --- neighbours -----------------------------------------------------------------------------------------------


def test_neighbour_descent(spark):
    work = {}
    for n in (600, 2400):
        m = clustered(n, 16)
        met = spark.sparkContext.accumulator(0)
        got: dict = {}
        for r in neighbours.descend(table(spark, m), 10, compared=met).collect():
            got.setdefault(r.src, set()).add(r.dst)
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -9)
        true = np.argsort(-s, 1)[:, :10]
        assert np.mean([len(got[f"v{i:05d}"] & {f"v{j:05d}" for j in true[i]}) / 10 for i in range(n)]) >= 0.9
        work[n] = met.value / n
    assert work[2400] < 2 * work[600]  # for each node: four times the vectors take about four times the pairs


def test_neighbour_descent_edges(spark):
    kinds = "node_id string, vector array<double>"
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [0.0, 1.0])]
    got = {(r.src, r.dst) for r in neighbours.descend(spark.createDataFrame(rows, kinds), 1).collect()}
    assert got == {("a", "b"), ("b", "a"), ("f", "b")}
    assert neighbours.descend(spark.createDataFrame([], kinds), 3).collect() == []


def test_a_run_of_neighbours_is_of_one_order():
    unit = np.eye(3)
    rows = [(0, "a", 0), (0, "b", 1), (1, "a", 0), (1, "c", 2)]  # a partition with the end of one order and the begin of the next
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([unit[r[2]].tolist() for r in rows])], names=["order", "id", "v"])
    got = {(e["src"], e["dst"]) for out in neighbours._met(3)([b]) for e in out.to_pylist()}
    assert got == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_in_blocks_and_stripes(spark, monkeypatch, metric):
    monkeypatch.setattr(expand, "TILE", 7)
    m = np.random.default_rng(5).standard_normal((60, 4)).astype(np.float32)
    m[40:50] = m[:10]  # ties
    m[59] = 0
    rows = [(f"v{i:02d}", x.tolist()) for i, x in enumerate(m)]
    df = spark.createDataFrame([*rows, ("w", None), ("x", [1.0, None, 0.0, 0.0])], "node_id string, vector array<float>")
    y = m.astype(float)
    if metric == "cosine":
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        s = y @ y.T
    else:
        s = 1 / (1 + np.linalg.norm(y[:, None] - y[None], axis=2))
    np.fill_diagonal(s, -9)
    order = np.argsort(-np.round(s, 7), 1, kind="stable")[:, :3]
    assert {(r.src, r.dst) for r in expand.knn(df, 3, metric, block=25).collect()} == {(f"v{i:02d}", f"v{j:02d}") for i in range(60) for j in order[i]}


# --- history --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("walked", [10**6, 0])
def test_reached_over_segments(spark, monkeypatch, walked):
    monkeypatch.setattr(history, "WALK_LINKS", walked)
    rng = random.Random(walked + 4)
    up = {i: sorted({rng.randrange(max(0, i - 3), i) for _ in range(1 if rng.random() < 0.75 else 2)}) if i else [] for i in range(60)}
    commits = spark.createDataFrame([(str(i), [str(p) for p in ps]) for i, ps in up.items()], "cid string, parents array<string>")
    heads = spark.createDataFrame([("a", "59"), ("b", "41"), ("c", "7"), ("d", "unknown")], "head string, cid string")
    want = {("d", "unknown"): 0}
    for head, at in (("a", 59), ("b", 41), ("c", 7)):
        depth, now, k = {at: 0}, [at], 0
        while now:
            k += 1
            now = [p for p in {p for x in now for p in up[x]} if p not in depth]
            depth.update(dict.fromkeys(now, k))
        want |= {(head, str(c)): d for c, d in depth.items()}
    assert {(r.head, r.cid): r.depth for r in history.reached(commits, heads).collect()} == want


@pytest.mark.parametrize("share", [10**6, -1])  # by clusters of clusters; by segments
def test_reached_by_clusters(spark, monkeypatch, share):
    for name, value in {"WALK_LINKS": 4, "CLUSTER": 8, "HEADS": 2, "CORE_SHARE": share, "ENTRIES": 10**6}.items():
        monkeypatch.setattr(history, name, value)
    name = lambda k: f"k{k:03d}"
    up = {k: [p for p in (k - 1, k - 10) if p >= 0 and (p == k - 1 or k % 5 == 0)] for k in range(30)} | {30: [14, 99]}  # 99 is no commit
    commits = spark.createDataFrame([(name(k), [name(p) for p in ps], k) for k, ps in up.items()], "cid string, parents array<string>, time long")
    heads = {"a": 29, "b": 21, "c": 30, "d": 77}
    want = set()
    for head, at in heads.items():
        depth, now, k = {at: 0}, [at], 0
        while now:
            k += 1
            now = [p for p in {p for x in now for p in up.get(x, ())} if p not in depth]
            depth.update(dict.fromkeys(now, k))
        want |= {(head, name(c), d) for c, d in depth.items()}
    joins = []
    plain = history._by_joins
    monkeypatch.setattr(history, "_by_joins", lambda *x: joins.append(1) or plain(*x))
    asked = spark.createDataFrame([(h, name(k)) for h, k in heads.items()], "head string, cid string")
    assert {(r.head, r.cid, r.depth) for r in history.reached(commits, asked).collect()} == want
    assert bool(joins) == (share != 10**6)


def test_a_long_chain_is_one_segment(spark, monkeypatch):
    monkeypatch.setattr(versions, "WALK_LINKS", 10)
    n, k = 100_000, F.col("id")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    commits = spark.range(n).select(name(k).alias("cid"), F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(name(k - 1))).alias("parents"))
    placed, links = history.segments(commits)
    assert placed.select("segment").distinct().count() == 1 and links.count() == 0
    branches = commits.unionByName(spark.createDataFrame([("x", ["000090000"])], commits.schema))
    assert versions.lowest_common_ancestor(branches, ["000099999", "x"]).first()[0] == "000090000"


def test_criss_cross_and_unrelated(spark, monkeypatch):
    links = [("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("e", ["c", "b"]), ("z", [])]
    commits = spark.createDataFrame(links, "cid string, parents array<string>")
    for walked in (10**6, 0):
        monkeypatch.setattr(versions, "WALK_LINKS", walked)
        lca = lambda *h: versions.lowest_common_ancestor(commits, list(h)).first()[0]
        assert lca("d", "e") == "b" and lca("d", "b") == "b" and lca("b", "c") == "a" and lca("a", "z") is None and lca("d", "d") == "d"


# --- orders ---------------------------------------------------------------------------------------------------


def test_orders(spark):
    rows = {i * 7 % 101: i % 5 for i in range(101)}
    df = spark.createDataFrame(list(rows.items()), "k long, v int")
    total = np.cumsum([rows[k] for k in range(101)])
    assert {r.k: r.place for r in order.numbered(df, "k").collect()} == {k: k + 1 for k in range(101)}
    assert {r.k: r.previous for r in order.with_previous(df, "k", of=F.col("v")).collect()} == {k: rows.get(k - 1) for k in range(101)}
    assert {r.k: r.next for r in order.with_next(df, "k", of=F.col("v")).collect()} == {k: rows.get(k + 1) for k in range(101)}
    assert {r.k: r.running for r in order.running_sum(df, "k", of=F.col("v")).collect()} == {k: int(total[k]) for k in range(101)}
    assert {r.k: r.recent for r in order.recent(df, "k", 10).collect()} == {k: min(k + 1, 10) for k in range(101)}
    for f in (order.numbered, lambda d, o: order.with_next(d, o, of=F.col("v")), lambda d, o: order.running_sum(d, o, of=F.col("v"))):
        assert f(df.limit(0), "k").collect() == []


# --- communities ----------------------------------------------------------------------------------------------


def planted(groups, size, inside, across, seed=1):
    rng = np.random.default_rng(seed)
    n = groups * size
    a, b = np.triu_indices(n, 1)
    on = rng.random(len(a)) < np.where(a // size == b // size, inside, across)
    return [(f"n{x:04d}", f"n{y:04d}", 1.0) for x, y in zip(a[on], b[on])]


def test_spread_communities_reach_the_modularity(spark):
    edges = planted(5, 20, 0.4, 0.02)
    g = spark.createDataFrame(edges, "a string, b string, weight double").coalesce(1).cache()
    quality = lambda c: analytics.modularity(g, c).first()[0]
    spread = analytics.spread_communities(g, turns=6, gather=200).cache()  # the first level is of joins, the next one is gathered
    rows = {r.id: r.community for r in spread.collect()}
    assert quality(spread) >= 0.98 * quality(analytics.communities(g))
    least = {}
    for i, c in sorted(rows.items()):
        least.setdefault(c, i)
    assert [c for c, _ in sorted(least.items(), key=lambda x: x[1])] == list(range(len(least)))
    near: dict = {}
    for x, y, _ in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    for c in least:  # each is connected
        members = {i for i in rows if rows[i] == c}
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x] & members
        assert seen == members


def test_spread_communities_edges(spark):
    kinds = "a string, b string, weight double"
    assert analytics.spread_communities(spark.createDataFrame([], kinds)).collect() == []
    g = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.0), ("e", "f", 0.0), ("a", "a", 5.0)], kinds)
    for gather in (0, 100):
        assert {r.id: r.community for r in analytics.spread_communities(g, turns=3, gather=gather).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_spread_communities_estimates_stay_small(spark, monkeypatch):
    """The planner's estimate of what a turn has made must not grow with the turns: it had three times the digits after each."""
    g = spark.createDataFrame(planted(4, 10, 0.4, 0.05), "a string, b string, weight double").coalesce(1)
    sizes, moved = [], analytics._moved

    def watched(both, state, m2, turn):
        sizes.append(int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return moved(both, state, m2, turn).withColumn("moved", F.lit(True))  # no turn counts as quiet

    monkeypatch.setattr(analytics, "_moved", watched)
    assert analytics.spread_communities(g, turns=4, levels=1, gather=0).count() == 40
    assert len(sizes) == 4 and max(sizes) < 10**7


# --- labels ---------------------------------------------------------------------------------------------------


def test_a_commit_rewrites_the_labels_it_touches(spark, tmp_path):
    kinds, path = "id string, ntype string, summary string", str(tmp_path / "nodes")
    rows = {("A", f"a{i}"): "old" for i in range(20)} | {("B", f"b{i}"): "old" for i in range(20)} | {("C", "c0"): "old", ("B", "a1"): "other"}
    frame = lambda d: spark.createDataFrame([(i, t, x) for (t, i), x in d.items()], kinds)
    label_index.build(frame(rows), path)
    names = lambda t: {p.name for p in (tmp_path / "nodes" / f"ntype={t}").glob("*.parquet")}
    before = {t: names(t) for t in "ABC"}
    added, removed = {("A", "a1"): "new", ("D", "d0"): "new"}, [("A", "a2"), ("C", "c0")]
    assert label_index.append(spark, path, frame(added), spark.createDataFrame([(i, t) for t, i in removed], "id string, ntype string")) == ["A", "C", "D"]
    want = {k: v for k, v in (rows | added).items() if k not in removed}
    assert {(r.ntype, r.id): r.summary for r in label_index.read(spark, path).collect()} == want
    assert names("B") == before["B"] and not names("A") & before["A"] and not names("C")
    assert label_index.read(spark, path, "D").count() == 1
    none = frame({("X", "x"): ""}).limit(0)
    assert label_index.append(spark, path, none, none.select("id", "ntype")) == [] and label_index.read(spark, path).count() == len(want)


# --- requests -------------------------------------------------------------------------------------------------


def test_refused_requests_and_warnings(spark):
    nodes = spark.createDataFrame([("a", "Nation", "x")], "id string, ntype string, summary string")
    g = Graph(nodes, nodes)
    with pytest.raises(ValueError):
        checked("limit", 1001)
    with pytest.raises(RetrievalEmpty):
        Retriever(g).fused()
    with pytest.raises(ValueError):
        chunk.chunk(nodes, "text", "none")
    assert checked("limit", 1000) == 1000
    assert Retriever(g, label="Nation", expansion=GraphExpand(mode="pagerank")).warnings() == ["pagerank_without_adjacency", "no_ranker"]
