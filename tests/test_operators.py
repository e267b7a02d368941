"""Operators on small fixtures: the cases that change answers silently."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import functions as fn
from loomgraph.model import EDGES, tagged
from loomgraph.operators import analytics, chunk, evaluate, expand, extract, query, rank, versions
from loomgraph.plans.retrieve import GraphExpand, RetrievalEmpty, Retriever
from loomgraph.sources import readers
from loomgraph.sources.graph import Graph
from loomgraph.streaming import rate_windows, rolling_median, session_reservoir

NODE = "id string, ntype string, summary string, props map<string,string>, created_at bigint, updated_at bigint"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, s, {k: tagged(v) for k, v in p.items()}, None, None) for i, t, s, p in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(f"{t}:{a}>{b}", t, a, b, {}) for t, a, b in rows], EDGES)


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, ("a", "P", "Ann", {"k": 1, "f": 1.0}), ("b", "P", "Bob", {"k": 1}), ("c", "Q", "Cy", {"k": 2}), ("d", "P", "Di", {"k": "1"}))
    e = edges(spark, ("knows", "a", "b"), ("knows", "b", "c"), ("likes", "a", "c"), ("knows", "c", "c"))
    gone = spark.createDataFrame([("b", "old", 0)], "node_id string, reason string, tombstoned_at bigint")
    return Graph(n, e, tombstones=gone)


def ids(df):
    return [r.id for r in df.orderBy("id").collect()]


# --- queries --------------------------------------------------------------------------------------------------


def test_equality_is_typed(small):
    q = query.Query(small).include_tombstoned()
    assert ids(q.where_eq("k", 1).execute()) == ["a", "b"] and ids(q.where_eq("k", "1").execute()) == ["d"] and ids(q.where_eq("f", 1).execute()) == []


def test_second_where_replaces_the_first(small):
    assert ids(query.Query(small).where_eq("k", 1).where_eq("k", 2).execute()) == ["c"]


def test_property_index_keeps_the_last(small):
    q = query.Query(small, index="last").label("P").where_eq("k", 1)
    assert ids(q.include_tombstoned().execute()) == ["b"] and ids(q.execute()) == []


def test_first_and_one(small):
    q = query.Query(small)
    assert ids(q.first()) == ["a"] and q.label("Q").one().id == "c"
    with pytest.raises(query.NotFound):
        q.label("X").one()
    with pytest.raises(query.AmbiguousMatch):
        q.label("P").one()


def test_adjacency(small):
    t = query.Query(small).with_any_direction("knows").execute()
    got = {r.id: ([e.dst for e in r.outgoing], [e.src for e in r.incoming]) for r in t.collect()}
    assert got == {"a": (["b"], []), "c": (["c"], ["b"]), "d": ([], [])}  # a loop is listed once
    r = query.Query(small).label("P").with_outgoing("knows", "likes").adjacency_cap(1).execute().where("id = 'a'").first()
    assert [e.dst for e in r.outgoing] == ["b"] and r.outgoing_truncated
    assert [e.dst for e in query.Query(small).with_outgoing("none").execute().first().outgoing] == []


def test_temporal_passes_what_has_no_time(spark):
    n = spark.createDataFrame([("a", 5), ("b", 10), ("c", None)], "id string, created_at bigint")
    assert ids(query.temporal(n, created_from=5, created_before=10)) == ["a", "c"]


def test_rendering(small):
    t = {r.id: r.text for r in query.rendered(small.nodes).collect()}
    assert t["a"] == "ntype: P\nid: a\nsummary: Ann\nf: 1.0\nk: 1\n"


# --- ranking --------------------------------------------------------------------------------------------------


def lane(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, score double")


def test_fusion(spark):
    a, b = lane(spark, ("x", 3.0), ("y", 1.0), ("z", 1.0)), lane(spark, ("y", 9.0))
    got = {r.id: r.score for r in rank.fuse_ranks([(a, 1.0), (b, 1.0)]).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 63})
    got = {r.id: r.score for r in rank.fuse_scores([(a, 1.0), (b, 1.0)]).collect()}
    assert got == pytest.approx({"x": 1.0, "y": 0.5, "z": 0.0})
    assert {r.id for r in rank.fuse_scores([(a, 1.0), (b, 0.0)]).collect()} == {"x", "y", "z"}


def test_packing_skips_what_overflows(spark):
    t = spark.createDataFrame([("a", 4.0, 50), ("b", 3.0, 60), ("c", 2.0, 40), ("d", 1.0, 10)], "id string, score double, tokens int")
    rows = rank.pack_budget(t, 100).orderBy("place").collect()
    assert [r.id for r in rows] == ["a", "c", "d"] and rows[0].tokens_used == 100 and rows[0].dropped == 1
    assert [r.id for r in rank.pack_budget(t, 100, limit=2).collect()] == ["a", "c"]


def test_rerank_head_keeps_the_tail(spark):
    t = rank.rerank_head(lane(spark, ("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)), -F.col("score"), 2)
    assert [r.id for r in t.orderBy("place").collect()] == ["b", "a", "c", "d"]


def test_nan_is_not_the_best(spark):
    assert ids(rank.top(lane(spark, ("a", float("nan")), ("b", 1.0)), 5)) == ["b"]


def test_text_rank_counts_bytes(spark):
    t = spark.createDataFrame([("a", "éé needle"), ("b", "xxxx needle")], "id string, text string")
    assert {r.id: r.score for r in rank.text_rank(t, "NEEDLE", 5).collect()} == pytest.approx({"a": 1 / 6, "b": 1 / 6})


# --- expansion ------------------------------------------------------------------------------------------------

FIVE = [(0, 1), (0, 2), (1, 0), (2, 0), (2, 3), (3, 0), (3, 4), (4, 0)]


def adjacency(spark, pairs):
    return spark.createDataFrame([(str(a), str(b), 1.0, "authored") for a, b in pairs], "src string, dst string, weight double, provenance string")


def test_personalized_pagerank(spark):
    seeds = spark.createDataFrame([("0", 1.0)], "id string, weight double")
    got = {r.id: r.score for r in expand.pagerank(adjacency(spark, FIVE), seeds, 0.85, 60, 1e-9).collect()}
    assert got == pytest.approx({"0": 0.4745, "1": 0.2017, "2": 0.2017, "3": 0.0857, "4": 0.0364}, abs=0.01)
    assert sum(got.values()) == pytest.approx(1)
    zero = spark.createDataFrame([("0", 0.0)], "id string, weight double")
    uniform = {r.id: r.score for r in expand.pagerank(adjacency(spark, FIVE), zero, iterations=10).collect()}
    assert uniform == pytest.approx({r.id: r.score for r in expand.pagerank(adjacency(spark, FIVE), iterations=10).collect()})
    assert expand.pagerank(adjacency(spark, FIVE).limit(0)).collect() == []
    assert expand.too_many_nodes(adjacency(spark, FIVE), 4) and not expand.too_many_nodes(adjacency(spark, FIVE), 5)


def test_decay_walk(spark, small):
    seeds = lane(spark, ("a", 1.0))
    got = {r.id: round(r.score, 6) for r in expand.expand_decay(seeds, small.edges, depth=2).collect()}
    assert got == {"b": 0.7, "c": 0.7}  # c is closed by the first hop
    got = {r.id: round(r.score, 6) for r in expand.expand_decay(seeds, small.edges, depth=2, etypes={"knows": 0.5}).collect()}
    assert got == {"b": 0.35, "c": 0.1225}
    assert ids(expand.expand_decay(seeds, small.edges, depth=4, max_per_seed=1, max_frontier=0)) == ["b"]


def test_hybrid_and_fallback(spark):
    own = adjacency(spark, [(1, 2)])
    near = adjacency(spark, [(1, 2), (2, 3)]).withColumn("provenance", F.lit("knn"))
    assert {(r.src, r.dst, r.provenance) for r in expand.hybrid(own, near).collect()} == {("1", "2", "authored"), ("2", "3", "knn")}
    assert expand.fallback(own, near).count() == 1 and expand.fallback(own.limit(0), near).count() == 2


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_is_exact(spark, block):
    v = np.random.default_rng(1).standard_normal((40, 5))
    df = spark.createDataFrame([(f"v{i:02d}", x.tolist()) for i, x in enumerate(v)], "node_id string, vector array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"v{i:02d}", f"v{j:02d}") for i in range(40) for j in np.argsort(-s[i])[:3]}
    assert {(r.src, r.dst) for r in expand.knn(df, 3, block=block).collect()} == want


def test_community_expansion_only_adds(spark):
    cand = lane(spark, ("a", 2.0), ("b", 1.0))
    member = spark.createDataFrame([("a", 1), ("c", 1), ("d", 1), ("e", 2)], "id string, community int")
    rows = expand.expand_community(cand, member, 1, 1, 0.5).orderBy("place").collect()
    assert [(r.id, r.score) for r in rows] == [("a", 2.0), ("b", 1.0), ("c", 1.0)]


# --- analytics ------------------------------------------------------------------------------------------------


def test_communities_of_two_cliques(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    g = analytics.undirected(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double"))
    got = {r.id: r.community for r in analytics.communities(g).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a0"] == 0 and got["b0"] == 1
    q = analytics.modularity(g, analytics.communities(g)).first()[0]
    alone = g.select(F.col("a").alias("id")).union(g.select("b")).distinct().withColumn("community", F.col("id"))
    assert q > 0.4 > analytics.modularity(g, alone).first()[0]
    with pytest.raises(ValueError):
        analytics.communities(g, most_edges=3)


def test_shape_and_margins(spark):
    t = spark.createDataFrame([(float(x),) for x in (0, 0.1, 0.2, 0.3, 9.7, 9.8, 9.9, 10)], "score double")
    assert analytics.shape(t).first()["shape"] == "bimodal"
    assert analytics.shape(t.limit(3)).first()["shape"] == "insufficient"
    flat = lane(spark, *[(str(i), 1.0) for i in range(6)])
    assert analytics.entropy(flat).first()["entropy"] == 1.0 and analytics.rank_agreement(flat).first()[0] == "low"
    assert analytics.confidence(lane(spark, ("a", 4.0), ("b", 1.0))).first()[0] == pytest.approx(0.75)


def test_mmr_leaves_out_the_like(spark):
    rows = [(0, "a", 1.0, [1.0, 0.0]), (0, "b", 0.99, [1.0, 0.001]), (0, "c", 0.5, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "group int, id string, score double, vector array<double>")
    assert [r.id for r in analytics.mmr(t, 2).orderBy("place").collect()] == ["a", "c"]


# --- versions -------------------------------------------------------------------------------------------------


def snap(spark, **kv):
    return spark.createDataFrame(list(kv.items()), "id string, cid string")


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "outcome", "cid"),
    [
        ({"x": "1"}, {"x": "1"}, {"x": "1"}, "same", "1"), ({"x": "1"}, {"x": "2"}, {"x": "1"}, "ours", "2"), ({"x": "1"}, {"x": "1"}, {"x": "2"}, "theirs", "2"), ({"x": "1"}, {"x": "2"}, {"x": "2"}, "both", "2"),
        ({"x": "1"}, {"x": "2"}, {"x": "3"}, "divergent", "3"), ({"x": "1"}, {}, {"x": "3"}, "delete-modify", "3"), ({"x": "1"}, {}, {"x": "1"}, "ours", None), ({}, {"x": "2"}, {"x": "3"}, "divergent", "3"),
    ],
)
def test_three_way(spark, base, ours, theirs, outcome, cid):
    mk = lambda d: snap(spark, **d) if d else snap(spark, y="0").limit(0)
    r = versions.three_way(mk(base), mk(ours), mk(theirs)).where("id = 'x'").first()
    assert (r.outcome, r.cid) == (outcome, cid)


def test_settling(spark):
    m = versions.three_way(snap(spark, x="1", y="1"), snap(spark, x="2", y="1"), snap(spark, x="3", y="5"))
    as_dict = lambda df: {r.id: r.cid for r in df.collect()}
    assert as_dict(versions.settled(m, "ours")) == {"x": "2", "y": "5"} and as_dict(versions.settled(m)) == {"x": "3", "y": "5"}
    picks = spark.createDataFrame([("x", "ours")], "id string, side string")
    assert as_dict(versions.settled(m, "theirs", picks)) == {"x": "2", "y": "5"}


def test_history(spark):
    c = spark.createDataFrame([("1", []), ("2", ["1"]), ("3", ["2"]), ("4", ["2"]), ("5", ["3", "4"]), ("9", [])], "cid string, parents array<string>")
    assert versions.lowest_common_ancestor(c, ["3", "4"]).first()[0] == "2" and versions.lowest_common_ancestor(c, ["5", "3"]).first()[0] == "3" and versions.lowest_common_ancestor(c, ["5", "9"]).first()[0] is None
    blocks, links = c.select("cid"), c.select("cid", F.explode("parents").alias("parent"))
    assert [r.cid for r in versions.unreachable(blocks, links, spark.createDataFrame([("5",)], "cid string")).collect()] == ["9"]


def test_long_history(spark, monkeypatch):
    """The jobs don't grow with the length of a history, and both ways of walking it agree."""
    c = spark.createDataFrame([(str(k), [str(p) for p in (k - 1, k - 10) if p >= 0 and (p == k - 1 or k % 5 == 0)]) for k in range(60)], "cid string, parents array<string>")
    heads = spark.createDataFrame([("59", "59"), ("7", "7"), ("x", "x")], "head string, cid string")
    calls, plain = [], versions.cut
    monkeypatch.setattr(versions, "cut", lambda df: calls.append(1) or plain(df))
    got = {tuple(r) for r in versions.ancestors(c, heads).collect()}
    assert len(got) == 60 + 8 + 1 and len(calls) <= 2
    monkeypatch.setattr(versions, "WALK_LINKS", 0)
    assert {tuple(r) for r in versions.ancestors(c, heads).collect()} == got


def test_refs(spark):
    r = spark.createDataFrame([("refs/heads/main", "1"), ("refs/tags/main", "2")], "name string, target string")
    assert versions.set_ref(r, "refs/heads/main", "3", "1").where("name = 'refs/heads/main'").first().target == "3"
    with pytest.raises(versions.Stale):
        versions.set_ref(r, "refs/heads/main", "3", "2")
    c = spark.createDataFrame([("7", [])], "cid string, parents array<string>")
    assert versions.resolve_commitish(r, c, "main").first()[0] == "1" and versions.resolve_commitish(r, c, "7").first()[0] == "7" and versions.resolve_commitish(r, c, "no").first()[0] is None


def test_commit_and_embeddings(spark):
    base = snap(spark, a="1", b="1")
    assert {(r.id, r.cid) for r in versions.committed(base, snap(spark, b="2", c="3"), snap(spark, a="1", c="0")).collect()} == {("b", "2"), ("c", "3")}
    staged = spark.createDataFrame([("a", "m", "v1", 1), ("a", "m", "v2", 2)], "node string, model string, vector string, seq int")
    old = spark.createDataFrame([("a", "m", "v0"), ("b", "m", "w")], "node string, model string, vector string")
    assert {(r.node, r.vector) for r in versions.upserted(old, staged, ["node", "model"], "seq").collect()} == {("a", "v2"), ("b", "w")}


# --- sources, chunks, extraction ------------------------------------------------------------------------------


def test_markdown():
    got = readers.markdown_sections("intro\n# A\ntext  \n```\n# not a heading\n```\n### B ##\nmore\n")
    assert got == [(None, 0, "intro"), ("A", 1, "text  \n```\n# not a heading\n```"), ("B", 3, "more")]


def test_plain_text_and_code():
    assert readers.text_sections("CHAPTER 1\nonly one") == [(None, 0, "CHAPTER 1\nonly one")]
    assert [s[0] for s in readers.text_sections("lead\nCHAPTER 1\na\nSection 2.1\nb\nSection 3 x")] == [None, "CHAPTER 1", "Section 2.1"]
    assert [s[0] for s in readers.code_sections("def f():\n    pass\nclass C:\n    x = 1\n", "python")] == ["function:f", "class:C"]
    assert readers.code_sections("def (", "python") == [(None, 0, "def (")]
    assert [s[0] for s in readers.code_sections("pub fn a() {}\nstruct B;\n", "rust")] == ["fn:a", "struct:B"]


def test_conversations(spark):
    claude = '{"conversation": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": " "}]}'
    gpt = '[{"mapping": {"k2": {"message": {"author": {"role": "assistant"}, "create_time": 2.0, "content": {"parts": ["a", "b"]}}}, "k1": {"message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"parts": ["q"]}}}, "k0": {"message": null}}}]'
    generic = '[{"role": "system", "content": "be kind"}]'
    got = readers.conversations(spark.createDataFrame([("c", claude), ("g", gpt), ("x", generic)], "doc string, text string")).orderBy("doc", "idx").collect()
    assert [(r.doc, r.heading, r.text) for r in got] == [("c", "[user]", "hi"), ("g", "[user]", "q"), ("g", "[assistant]", "a\n\nb"), ("x", "[system]", "be kind")]


def test_source_kinds(spark):
    t = spark.createDataFrame([("a/b.MD",), ("x.pdf",), ("y.rs",), ("z.jsonl",), ("none",)], "p string").select(readers.source_kind(F.col("p")).alias("k"))
    assert [r.k for r in t.collect()] == ["markdown", "pdf", "code", "conversation", "text"]


def sections(spark, *rows):
    return spark.createDataFrame([("d", i, h, n, t) for i, (h, n, t) in enumerate(rows)], readers.SECTIONS)


def test_section_path_and_chunks(spark):
    s = sections(spark, ("A", 1, "one\n\ntwo"), ("B", 2, "three"), ("C", 1, "four"))
    got = [(r.section_path, r.text) for r in chunk.chunk(s, "markdown").orderBy("idx").collect()]
    assert got == [(["A"], "one"), (["A"], "two"), (["A", "B"], "three"), (["C"], "four")]
    s = sections(spark, (None, 0, "a b c d e f g"))
    assert [r.text for r in chunk.chunk_recursive(s, 3, 1).orderBy("idx").collect()] == ["a b c", "c d e", "e f g"]
    with pytest.raises(ValueError):
        chunk.chunk(s, "text", "nonsense")


def test_sentences_always_advance():
    assert chunk.packed_sentences("One two three. Four five. Six.", 3, 2) == ["One two three.", "Four five. Six."]
    assert chunk.packed_sentences("a b c d e. f.", 2, 9) == ["a b c d e.", "f."]


def test_session_chunks(spark):
    s = sections(spark, ("[user]", 2, "1"), ("[assistant]", 2, "2"), ("[user]", 2, "3"), ("[user]", 2, "4"), ("[assistant]", 2, " "), ("[assistant]", 2, "5"))
    assert [r.messages for r in chunk.chunk_session(s, 10).orderBy("idx").collect()] == [2, 3]
    assert [r.messages for r in chunk.chunk_session(s, 2).orderBy("idx").collect()] == [2, 2, 1]


def test_entities_and_relations(spark):
    text = "Alice Johnson founded Acme Corp. in town. The Bob Lee é Carl Maria Weber"
    got = extract.named(text)
    assert [(k.split(":")[1], t) for k, t, _, _ in got] == [("Person", "Alice Johnson"), ("Organization", "Acme Corp."), ("Person", "Bob Lee"), ("Person", "Carl Maria Weber")]
    assert all(text.encode()[a:b].decode() == t for _, t, a, b in got)
    t = spark.createDataFrame([("d", text)], "doc string, text string")
    rel = {(r.subject, r.object): r.kind for r in extract.relations(extract.entities(t), t).collect()}
    assert rel[(0, 1)] == "acts_on" and rel[(1, 2)] == "co_occurs_with"


def test_ingest_is_idempotent(spark):
    d = spark.createDataFrame([("f", "# T\n\nAlice Johnson met Bob Lee.\n\nAlice Johnson left.")], "doc string, text string")
    a, b = (readers.ingest(d, "markdown") for _ in range(2))
    for k in a:
        assert sorted(map(str, a[k].collect())) == sorted(map(str, b[k].collect()))
    assert a["entities"].count() == 2 and a["edges"].where("etype = 'chunk_of'").count() == a["chunks"].count() == 2


def test_blocks_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(b"x",), (b"x",), (b"yy",)], "content binary").select(F.sha2("content", 256).alias("cid"), "content")
    readers.export_blocks(b, str(tmp_path / "out"))
    assert {bytes(r.content) for r in readers.import_blocks(spark, str(tmp_path / "out")).collect()} == {b"x", b"yy"}


# --- functions ------------------------------------------------------------------------------------------------


def test_scalars(spark):
    t = spark.createDataFrame([("héllo wörld",)], "t string")
    one = lambda c: t.select(c.alias("x")).first().x
    assert one(fn.token_estimate(F.lit(""))) == 0 and one(fn.token_estimate(F.col("t"))) == 3 + 2
    assert one(fn.clip_text(F.col("t"), 4)) == "héll <...+7 chars>" and one(fn.clip_text(F.col("t"), 40)) == "héllo wörld"
    assert one(fn.short_summary(F.lit("é" * 150))) == "é" * 100 + "…" and one(fn.short_summary(F.lit(" ok "))) == "ok"
    assert one(fn.short_summary(F.lit("a" + "é" * 150))) == "a" + "é" * 99 + "…"
    assert one(fn.parse_kv(F.lit("k=12"))["value"]) == "i:12" and one(fn.parse_kv(F.lit("k=1.5"))["value"]) == "f:1.5" and one(fn.parse_kv(F.lit("k=x=y"))["value"]) == "s:x=y" and one(fn.parse_kv(F.lit("k=true"))["value"]) == "b:true"
    assert one(fn.micros_to_rfc3339(F.lit(1_700_000_000_000_001).cast("long"))) == "2023-11-14T22:13:20.000001Z"
    assert one(fn.sample_size(F.lit(0.18))) == 30
    assert one(fn.has_date(F.lit("in 2023"))) and not one(fn.has_date(F.lit("in 20x and 2024"))) and one(fn.has_date(F.lit("3/4")))
    assert one(fn.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert one(fn.sparse_dot(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(3), F.lit(4)), F.array(F.lit(5.0), F.lit(9.0)))) == 5.0
    pairs = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(v).alias("value")) for i, v in ((4, 0.5), (2, 0.0), (4, 0.7), (1, 0.1))])
    assert [(p["index"], p["value"]) for p in one(fn.sparse_from_unsorted(pairs))] == [(1, 0.1), (4, 0.7)]
    assert one(fn.fill_template("say {q}!", q=F.lit("it"))) == "say it!"


# --- evaluation, retrieval, time ------------------------------------------------------------------------------


def test_recall(spark):
    t = spark.createDataFrame([("q1", "x", ["a", "b"], ["b"]), ("q2", "y", ["c"], ["z"])], "qid string, qtype string, ranked array<string>, gold array<string>")
    got = {r.qtype: (r.hit_at_1, r.hit_at_2) for r in evaluate.report(t, (1, 2)).collect()}
    assert got == {"x": (0.0, 1.0), "y": (0.0, 0.0), "all": (0.0, 0.5)}
    assert t.select(evaluate.found_share(F.col("ranked"), F.array().cast("array<string>"), 5).alias("x")).first().x == 1.0


def test_retriever(spark, small):
    with pytest.raises(RetrievalEmpty):
        Retriever(small).candidates()
    g = Graph(small.nodes, small.edges, spark.createDataFrame([("a", "m", 2, [1.0, 0.0]), ("b", "m", 2, [0.9, 0.1]), ("c", "m", 2, [0.0, 1.0])], "node_id string, model string, dim int, vector array<double>"), None, small.tombstones)
    r = Retriever(g, vector_cap=2).vector([1.0, 0.0])
    assert ids(r.candidates()) == ["a"]  # b takes a place among the two and is hidden afterwards
    assert ids(r.with_(expansion=GraphExpand(), prop=("k", 1)).candidates()) == ["a", "c"]  # expansion doesn't ask for the property
    assert [x.id for x in r.with_(expansion=GraphExpand(), budget=12).items().orderBy("place").collect()] == ["a"]


def test_rolling_and_rates(spark):
    rows = [("s", i, float(i)) for i in range(15)]
    t = rolling_median(spark.createDataFrame(rows, "s string, i int, v double"), "s", ["i"], "v", size=3, warm=2)
    assert [r["median"] for r in t.orderBy("i").collect()][:4] == [None, 0.5, 1.0, 2.0]
    e = spark.createDataFrame([("a", i) for i in (0, 10, 59, 60)], "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.n, r.admitted) for r in rate_windows(e, "who", "ts", 60, 2).collect()) == [(1, 1), (3, 2)]


def test_reservoir_stream_equals_batch(spark, tmp_path):
    rows = [("s", float(i)) for i in range(20)] + [("t", 1.0)]
    spark.createDataFrame(rows, "session string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, v double").parquet(str(tmp_path / "in"))
    out = session_reservoir(stream, "session", "v", size=8, warm=5)
    run = out.writeStream.outputMode("append").format("memory").queryName("reservoir").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.session: (r.n, r["median"]) for r in spark.table("reservoir").collect()}
    assert got["s"] == (8, float(np.median(range(12, 20)))) and got["t"][0] == 1 and (got["t"][1] is None or np.isnan(got["t"][1]))


def test_package_stands_without_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "loomgraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_approximate_top_k_finds_most(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 16))
    e = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "node_id string, vector array<double>")
    index, hits = rank.sign_index(e).cache(), 0
    for i in range(5):
        exact = {r.id for r in rank.dense(e, v[i].tolist(), 10).collect()}
        hits += len(exact & {r.id for r in rank.dense_approximate(index, e, v[i].tolist(), 10, 100).collect()})
    assert hits >= 45
    gone = spark.createDataFrame([("v000",)], "node_id string")
    assert "v000" not in {r.id for r in rank.dense_approximate(index, e, v[0].tolist(), 10, 100, hidden=gone).collect()}


# --- requests, sources and versions ---------------------------------------------------------------------------


def test_headings_are_nothing_but_headings():
    for line in ("CHAPTER 4", "PART IX:", "  Section 2.1.3  ", "SECTION 3.", "IV. T", "METHODS & DATA", "RESULTS-A", "END."):
        assert readers.is_heading(line) or line == "END.", line
    for line in ("CHAPTER 1 was long", "Chapter 1", "METHODS of", "ABC", "IV. Title", "section 2", "", "A B"):
        assert not readers.is_heading(line), line


def test_ingest_relates_entities_and_reads_code(spark):
    out = readers.ingest(spark.createDataFrame([("d", "Then Anna Maier joined Acme Corp. today.")], "doc string, text string"), "text")
    edges_ = {(r.etype, r.n) for r in out["edges"].groupBy("etype").count().withColumnRenamed("count", "n").collect()}
    assert edges_ == {("chunk_of", 1), ("chunk_mentions", 2), ("acts_on", 1)}
    again = readers.ingest(spark.createDataFrame([("f", "def g():\n    return 1\n")], "doc string, text string"), "code")
    assert [r.section_path for r in again["chunks"].collect()] == [["function:g"]]


def test_import_refuses_other_content(spark, tmp_path):
    good = spark.createDataFrame([(bytearray(b"one"),)], "content binary").select(F.sha2("content", 256).alias("cid"), "content")
    readers.export_blocks(good, str(tmp_path / "a"))
    assert readers.import_blocks(spark, str(tmp_path / "a")).count() == 1
    readers.export_blocks(good.withColumn("content", F.lit(b"two")), str(tmp_path / "b"))
    with pytest.raises(Exception, match="has other content"):
        readers.import_blocks(spark, str(tmp_path / "b")).collect()


def test_pagerank_gate_falls_back_to_decay(small, monkeypatch):
    near = expand.authored(small.edges)
    e = small.spark.createDataFrame([("a", "m", 2, [1.0, 0.0])], "node_id string, model string, dim int, vector array<double>")
    r = Retriever(Graph(small.nodes, small.edges, e), tombstoned=True, adjacency=near, expansion=GraphExpand(mode="pagerank")).vector([1.0, 0.0])
    assert r.by_pagerank() and r.warnings() == []
    by_rank = {x.id: x.score for x in r.candidates().collect()}
    monkeypatch.setattr(expand, "PPR_NODES", 2)
    monkeypatch.setattr(expand.too_many_nodes, "__defaults__", (2,))
    assert not r.by_pagerank() and r.warnings() == ["pagerank_skipped_by_size"]
    assert {x.id: x.score for x in r.candidates().collect()} == {"a": 1.0, "b": pytest.approx(0.7), "c": pytest.approx(0.7)} != by_rank
    assert r.with_(expansion=GraphExpand(mode="pagerank", large=True)).by_pagerank()


def test_packing_reads_no_more_than_can_fit(spark):
    rows = [(f"{i:03d}", 1.0 / (i + 1), 1 + i % 5) for i in range(300)] + [("big", 9.0, 500)]
    got = [r.id for r in rank.pack_budget(spark.createDataFrame(rows, "id string, score double, tokens int"), 40).orderBy("place").collect()]
    used, want = 0, []
    for i, _, t in sorted(rows, key=lambda r: -r[1]):
        if used + t <= 40:
            used, want = used + t, [*want, i]
    assert got == want


def test_have_set_has_few_false_members(spark):
    own = spark.range(2000).selectExpr("concat('x', id) as cid")
    have = versions.have_set(own)
    assert versions.not_had(own, have).count() == 0
    assert versions.not_had(spark.range(2000).selectExpr("concat('y', id) as cid"), have).count() > 1900


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((40, 16)).repeat(10, 0) + 0.4 * rng.standard_normal((400, 16))
    e = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(m)], "node_id string, vector array<double>")
    exact = {(r.src, r.dst) for r in expand.knn(e, 5).collect()}
    near = {(r.src, r.dst) for r in expand.knn_approximate(rank.sign_index(e), e, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_views_and_heads(spark):
    view = lambda *rows: spark.createDataFrame(list(rows), "kind string, name string, value string")
    base, a, b = view(("ref", "x", "1"), ("ref", "y", "1")), view(("ref", "x", "2"), ("ref", "y", "1")), view(("ref", "x", "1"), ("head", "h", "2"))
    assert sorted((r.kind, r.name, r.value) for r in versions.merged_views(base, [a, b]).collect()) == [("head", "h", "2"), ("ref", "x", "2")]
    ops = spark.createDataFrame([("p",), ("q",)], "cid string")
    heads = [versions.merged_heads(ops, spark.createDataFrame(h, "cid string")).first() for h in ([("q",), ("p",)], [("p",), ("q",)], [("q",)])]
    assert heads[0] == heads[1] and heads[0].parents == ["p", "q"] and heads[2].cid == "q"


def test_keywords_against_brute_force(spark):
    import hashlib

    import numpy as np

    from loomgraph.functions import STOPWORDS

    def embed(text):
        v = np.zeros(32)
        for w in text.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % 32] += 1 if h // 32 % 2 == 0 else -1
        return v

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0

    def best(text, most):
        w = "".join(c if c.isalnum() or c in "_'" else " " for c in text).lower().split()
        grams = sorted({" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i] not in STOPWORDS and w[i + n - 1] not in STOPWORDS})
        base, picked = {g: cosine(embed(g), embed(text)) for g in grams}, []
        while len(picked) < min(most, len(grams)):
            value = {g: base[g] - 0.5 * max([0.0] + [cosine(embed(g), embed(p)) for p, _ in picked]) for g in grams if g not in {p for p, _ in picked}}
            g = min(value, key=lambda k: (-round(value[k], 12), k))
            picked.append((g, value[g]))
        return picked

    texts = [(1, "Graph engines rank the nodes of a graph, and graph engines keep versions"), (2, "one word"), (3, "the of and"), (4, ""), (5, None), (6, "red red red blue")]
    got = extract.keywords(spark.createDataFrame(texts, "doc long, text string"), extract.hashed_embedding(), 4).collect()
    for doc, text in texts:
        own = sorted((r.place, r.gram, round(r.score, 9)) for r in got if r.doc == doc)
        assert own == [(i + 1, g, round(s, 9)) for i, (g, s) in enumerate(best(text or "", 4))]
