"""Further queries over the driver's tables: sources, lookups by content and model, requests, versions, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import analytics, chunk, expand, extract, versions
from ..operators import query as q
from ..sources import readers
from ..sources.graph import Graph, anchor_node, edges, node_id
from ..streaming import state
from .queries import CID, EDGES, GONE, NODES, TOP, VECTORS, commit_name, commit_table, first_vector, graph, last_commit, nid, query, r6, read
from .retrieve import Retriever, checked, over_graphs, with_passage

# --- lookups by content and model -----------------------------------------------------------------------------

# a vector belongs to a node's content, so nodes of equal content share it
OF_CONTENT = "c AS (SELECT n_nationkey AS k, sha256(n_name) AS cid FROM nation), v AS (SELECT vec_id AS k, 'm' || (vec_id % 2) AS model, embedding[1] AS x FROM embeddings)"


def vectors_of_content(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").join(read(spark, sf_dir, "nation"), F.col("vec_id") == F.col("n_nationkey"))
    return e.select(F.sha2("n_name", 256).alias("cid"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), F.col("embedding").alias("vector"))


@query(f"WITH {OF_CONTENT} SELECT cid, round(x::DOUBLE, 6) AS first FROM c JOIN v USING (k) WHERE model = 'm1'")
def embedding_by_content(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("cid"))
    return nodes.join(vectors_of_content(spark, sf_dir).where("model = 'm1'"), "cid").select("cid", r6(F.col("vector")[0].cast("double")).alias("first"))


SPARSE = "s AS (SELECT doc_id, lang AS vocab, n_chars AS w FROM documents WHERE lang IS NOT NULL)"


def sparse_sidecar(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("lang is not null")
    return d.select(F.col("doc_id").alias("node_id"), F.col("lang").alias("vocab_id"), F.array(F.lit(1)).alias("indices"), F.array("n_chars").alias("values"))


@query(f"WITH {SPARSE} SELECT doc_id AS node_id, w AS weight FROM s WHERE vocab = 'en'")
def sparse_by_vocabulary(spark, sf_dir):
    return sparse_sidecar(spark, sf_dir).where("vocab_id = 'en'").select("node_id", F.col("values")[0].alias("weight"))


@query(f"WITH {SPARSE} SELECT vocab AS vocab_id, count(*) AS nodes FROM s GROUP BY vocab")
def sparse_vocabularies(spark, sf_dir):
    return sparse_sidecar(spark, sf_dir).groupBy("vocab_id").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def nodes_to_embed(spark, sf_dir):
    """What a backfill embeds: nodes whose content has no vector yet."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return d.join(d.where("id % 3 = 0").select("id"), "id", "left_anti")


@query(f"WITH {NODES} SELECT ntype, count(*) AS n, min(id) AS first, max(id) AS last FROM nodes GROUP BY ntype")
def label_index(spark, sf_dir):
    return graph(spark, sf_dir).nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE ntype = 'Nation' UNION ALL SELECT 'region:new'")
def index_append(spark, sf_dir):
    """An index that a commit adds to has the rows that a rebuilt one would have."""
    g = graph(spark, sf_dir, "Nation")
    added = anchor_node(spark).select(F.lit("region:new").alias("id"))
    return versions.committed(g.nodes.select("id"), added)


# --- requests -------------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT id FROM nodes WHERE ntype = 'Supplier' AND NOT {GONE} ORDER BY id LIMIT 1")
def first_node(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).label("Supplier").limit(1).execute().select("id")


@query(f"WITH {NODES} SELECT id, ntype FROM nodes WHERE ntype = 'Part' AND list_contains(props, 'p_size=i:9') AND NOT {GONE} ORDER BY id LIMIT 10")
def search_request(spark, sf_dir):
    """A search by label and the first property given, ten results."""
    return q.Query(graph(spark, sf_dir)).label("Part").where_eq("p_size", 9).limit(checked("limit", 10)).execute().select("id", "ntype")


@query(f"WITH {EDGES}, p AS (SELECT * FROM edges WHERE etype = 'placed') SELECT (SELECT count(*) FROM (SELECT src FROM p UNION SELECT dst FROM p)) > 1000 AS skipped")
def pagerank_gate(spark, sf_dir):
    """Whether PageRank over the orders is left out beyond 1000 nodes."""
    skipped = expand.too_many_nodes(expand.authored(edges(spark, sf_dir, ("placed",))), 1000)
    return spark.createDataFrame([(skipped,)], "skipped boolean")


@query(f"WITH {EDGES}, s AS (SELECT {nid('Nation', 'n_nationkey')} AS id FROM nation), h1 AS (SELECT src AS id, max(0.7) AS score FROM edges WHERE etype = 'in_nation' AND dst IN (SELECT id FROM s) GROUP BY src) SELECT id, round(score, 6) AS score FROM h1 ORDER BY score DESC, id LIMIT 20")
def expand_incoming(spark, sf_dir):
    seeds = read(spark, sf_dir, "nation").select(node_id("Nation", "n_nationkey").alias("id"), F.lit(1.0).alias("score"))
    return expand.expand_decay(seeds, edges(spark, sf_dir, ("in_nation",)), 20, direction="in").select("id", r6("score").alias("score"))


@query(f"WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY etype, id) AS k FROM edges WHERE etype = 'placed') SELECT dst AS id, 0.7 AS score FROM r WHERE k <= 2")
def expand_capped_by_seed(spark, sf_dir):
    seeds = read(spark, sf_dir, "customer").select(node_id("Customer", "c_custkey").alias("id"), F.lit(1.0).alias("score"))
    n = read(spark, sf_dir, "orders").count()
    return expand.expand_decay(seeds, edges(spark, sf_dir, ("placed",)), n, max_per_seed=2).select("id", r6("score").alias("score"))


HOPS = f"{EDGES}, w AS (SELECT * FROM edges WHERE etype IN ('in_nation', 'in_region')), s AS (SELECT {nid('Supplier', 's_suppkey')} AS id FROM supplier)"


@query(f"""WITH {HOPS}, h1 AS (SELECT dst AS id, min(src || '>' || dst) AS path FROM w JOIN s ON w.src = s.id GROUP BY dst), h2 AS (SELECT dst AS id, min(path || '>' || dst) AS path FROM w JOIN h1 ON w.src = h1.id GROUP BY dst)
    SELECT id, 0 AS hop, id AS path FROM s UNION ALL SELECT id, 1, path FROM h1 UNION ALL SELECT id, 2, path FROM h2""")
def traverse_answer(spark, sf_dir):
    seeds = read(spark, sf_dir, "supplier").select(node_id("Supplier", "s_suppkey").alias("id"))
    return expand.answer_hops(seeds, edges(spark, sf_dir, ("in_nation", "in_region")), 2)


@query(f"WITH {EDGES} SELECT src, dst, 'authored' AS provenance FROM edges WHERE etype = 'in_region' UNION ALL SELECT 'a', 'b', 'knn'")
def fallback_adjacency(spark, sf_dir):
    """Nearest-neighbour edges take the place of authored ones only where there are none."""
    own = expand.authored(edges(spark, sf_dir, ("in_region",)))
    near = spark.createDataFrame([("a", "b", 1.0, "knn")], own.schema)
    return expand.fallback(own, near).unionByName(expand.fallback(own.limit(0), near)).select("src", "dst", "provenance")


@query(f"WITH {VECTORS}, l AS (SELECT id, vec_label, row_number() OVER (PARTITION BY vec_label ORDER BY id) AS k FROM vecs) SELECT id, vec_label::BIGINT AS label FROM l WHERE k = 1")
def snapshot_round_trip(spark, sf_dir):
    """A derived table, stored and read again."""
    from .lineage import folder

    t = graph(spark, sf_dir).embeddings.groupBy("vec_label").agg(F.min("node_id").alias("id")).select("id", F.col("vec_label").cast("long").alias("label"))
    return expand.stored_knn(t, f"{folder(spark)}/snapshot_round_trip")


@query(f"WITH {VECTORS}, f AS (SELECT arg_min(v, id) AS q FROM vecs), d AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, f), two AS (SELECT 'a' AS graph, * FROM d WHERE right(id, 1)::INT % 2 = 0 UNION ALL SELECT 'b', * FROM d WHERE right(id, 1)::INT % 2 = 1) SELECT graph, id, round(score, 6) AS score FROM two ORDER BY two.score DESC, id, graph LIMIT 10")
def global_retrieve(spark, sf_dir):
    """The best of two graphs, each with the graph it is from."""
    g, v = graph(spark, sf_dir, "Nation"), first_vector(spark, sf_dir)
    parts = []
    for name, rest in (("a", 0), ("b", 1)):
        own = g.embeddings.where(F.substring("node_id", -1, 1).cast("int") % 2 == rest)
        nodes = own.select(F.col("node_id").alias("id"), F.lit("Vec").alias("ntype"), F.lit("v").alias("summary"), F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("bigint").alias("created_at"))
        parts.append((name, Retriever(Graph(nodes, g.edges, own), tombstoned=True).vector(v)))
    return over_graphs(parts, 10).select("graph", "id", r6("score").alias("score"))


@query("SELECT n_nationkey AS id, n_name || chr(10) || chr(10) || 'about ' || lower(n_name) AS query FROM nation")
def query_with_passage(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), with_passage(F.col("n_name"), lambda c: F.concat(F.lit("about "), F.lower(c))).alias("query"))


@query("SELECT count(DISTINCT label) AS n FROM embeddings")
def community_count(spark, sf_dir):
    return analytics.community_count(read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("community")))


@query("""WITH b AS (SELECT unnest([100.0, 500.0, 'infinity'::DOUBLE]) AS le) SELECT event_type, le, count(*) FILTER (value <= le) AS n, round(sum(value), 4) AS total FROM events, b GROUP BY event_type, le""")
def histogram_buckets(spark, sf_dir):
    t = analytics.histogram(read(spark, sf_dir, "events"), "event_type", "value", [100.0, 500.0])
    return t.select("event_type", "le", "n", F.round("total", 4).alias("total"))


# --- sources --------------------------------------------------------------------------------------------------

DOC = "SELECT n_nationkey::VARCHAR AS doc,"


@query(f"""{DOC} 0 AS idx, NULL AS heading, 0 AS depth, 'lead of ' || n_name AS text FROM nation UNION ALL {DOC} 1, 'INTRODUCTION', 1, 'first' FROM nation
    UNION ALL {DOC} 2, 'METHODS AND DATA:', 1, 'CHAPTER 1 was long' || chr(10) || 'second' FROM nation UNION ALL {DOC} 3, 'Section ' || n_regionkey || '.2', 1, '' FROM nation UNION ALL {DOC} 4, 'CHAPTER IV.', 1, 'last' FROM nation""")
def plain_text_sections(spark, sf_dir):
    text = F.concat(
        F.lit("lead of "), "n_name", F.lit("\n\nINTRODUCTION\nfirst\n METHODS AND DATA: \nCHAPTER 1 was long\nsecond\nSection "), F.col("n_regionkey").cast("string"), F.lit(".2\nCHAPTER IV.\nlast\n")
    )
    return readers.plain_text(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), text.alias("text")))


@query("SELECT doc_id::VARCHAR AS doc, k - 1 AS idx, 'Page ' || k AS heading, trim(page, ' ') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(page, ' ') <> ''")
def paged_sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return readers.paged_text(d).select("doc", "idx", "heading", "text")


@query("SELECT conv_id, ['claude', 'chatgpt', 'generic', 'generic'][conv_id % 4 + 1] AS format FROM (SELECT DISTINCT conv_id FROM conversations)")
def conversation_formats(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    kinds = F.array(F.lit('{"conversation": [1]}'), F.lit('[{"mapping": {"a": 1}}]'), F.lit('[{"role": "user"}]'), F.lit("no json"))
    return c.select("conv_id", readers.conversation_format(F.get(kinds, F.col("conv_id") % 4)).alias("format"))


@query("SELECT conv_id::VARCHAR AS doc, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, '[' || role || ']' AS heading, text FROM conversations WHERE trim(text, ' ') <> ''")
def mapped_conversations(spark, sf_dir):
    """Exports that hold a map of messages, keyed against their order in time."""
    message = F.struct(F.struct("role").alias("author"), F.col("turn").cast("double").alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content"))
    c = read(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("m"), F.lpad((1000 - F.col("turn")).cast("string"), 5, "0")).alias("key"), F.struct(message.alias("message")).alias("node"))
    c = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "node"))).alias("mapping"))
    raw = c.select(F.col("conv_id").alias("doc"), F.to_json(F.array(F.struct("mapping"))).alias("text"))
    return readers.conversations(raw).select("doc", "idx", "heading", "text")


@query("SELECT n_nationkey::VARCHAR AS doc, 0 AS idx, 'function:f' || n_nationkey AS heading, 1 AS depth FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 1, 'class:C' || n_regionkey, 1 FROM nation")
def code_items(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    text = F.concat(F.lit("x = 1\ndef f"), F.col("n_nationkey").cast("string"), F.lit("(a):\n    return a\n\nclass C"), F.col("n_regionkey").cast("string"), F.lit(":\n    pass\n"))
    return readers.code(n.select(F.col("n_nationkey").alias("doc"), text.alias("text")), "python").select("doc", "idx", "heading", "depth")


ENDINGS = ["md", "PDF", "jsonl", "rs", "txt", "py"]


@query("SELECT p_partkey, ['markdown', 'pdf', 'conversation', 'code', 'text', 'code'][p_partkey % 6 + 1] AS kind FROM part")
def source_kinds(spark, sf_dir):
    path = F.concat(F.lit("/data/x.y/"), "p_name", F.lit("."), F.get(F.array(*[F.lit(e) for e in ENDINGS]), F.col("p_partkey") % 6))
    return read(spark, sf_dir, "part").select("p_partkey", readers.source_kind(path).alias("kind"))


@query("SELECT count(*) AS files, 'text' AS kind, 25::BIGINT AS lines FROM (SELECT DISTINCT n_regionkey FROM nation)")
def directory_walk(spark, sf_dir):
    """Files below a folder, written first: one for each region, a line for each nation."""
    from .lineage import folder

    path = f"{folder(spark)}/directory_walk"
    read(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("region")).repartition(1, "region").write.mode("overwrite").partitionBy("region").text(path)
    files = readers.read_files(spark, path).where(F.col("path").endswith(".txt"))
    lines = F.size(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n"))
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"))


@query("SELECT s_suppkey AS id, 1 + count(*) FILTER (new) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) - 1 AS run FROM (SELECT s_suppkey, (s_suppkey // 3 % 2) IS DISTINCT FROM lag(s_suppkey // 3 % 2) OVER (ORDER BY s_suppkey) AS new FROM supplier)")
def bulk_insert_runs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.floor(F.col("s_suppkey") / 3) % 2).alias("author"))
    return readers.author_runs(s, "id", "author").select("id", "run")


SECTIONS = f"{DOC} 0 AS idx, n_name AS heading, 1 AS depth FROM nation UNION ALL {DOC} 1, 'Part', 2 FROM nation UNION ALL {DOC} 2, NULL, 0 FROM nation UNION ALL {DOC} 3, 'More', 2 FROM nation"


def nation_sections(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), h.alias("heading"), F.lit(d).alias("depth"), F.lit(f"text {i}").alias("text")) for i, (h, d) in enumerate(((F.col("n_name"), 1), (F.lit("Part"), 2), (F.lit(None).cast("string"), 0), (F.lit("More"), 2)))])
    return n.select(F.col("n_nationkey").cast("string").alias("doc"), F.inline(rows))


@query(f"SELECT doc, idx, CASE idx WHEN 0 THEN name WHEN 1 THEN name || '/Part' WHEN 2 THEN '' ELSE name || '/More' END AS path FROM ({SECTIONS}) s JOIN (SELECT n_nationkey::VARCHAR AS doc, n_name AS name FROM nation) USING (doc)")
def section_path(spark, sf_dir):
    return chunk.section_paths(nation_sections(spark, sf_dir)).select("doc", "idx", F.array_join("section_path", "/").alias("path"))


@query(f"SELECT doc, idx, 2 AS tokens FROM ({SECTIONS})")
def chunk_structural(spark, sf_dir):
    return chunk.chunk(nation_sections(spark, sf_dir), "code").select("doc", "idx", "tokens")


@query("SELECT kind, count(*) * n AS chunks FROM nation, (SELECT * FROM (VALUES ('markdown', 4), ('text', 4), ('pdf', 4), ('code', 4), ('conversation', 1)) t(kind, n)) GROUP BY kind, n")
def chunk_auto(spark, sf_dir):
    s = nation_sections(spark, sf_dir)
    parts = [chunk.chunk(s, kind).agg(F.count(F.lit(1)).alias("chunks")).withColumn("kind", F.lit(kind)) for kind in chunk.AUTO]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH s AS ({SECTIONS}) SELECT doc, idx AS section, idx AS chunk FROM s WHERE heading IS NOT NULL UNION ALL SELECT doc, 2, unnest([0, 1, 2, 3]) FROM s WHERE idx = 2")
def sections_in_chunks(spark, sf_dir):
    s = nation_sections(spark, sf_dir)
    return chunk.sections_in_chunks(s, chunk.chunk_structural(s))


@query("SELECT 0::BIGINT AS n")
def null_entities(spark, sf_dir):
    return extract.entities(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), None).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS src, c_nationkey AS dst, 'in' AS predicate, 0.5 AS confidence, 'statistical' AS provenance FROM customer")
def typed_relations(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit("in").alias("predicate"), F.lit(0.5).alias("confidence"))
    return extract.typed_relations(c, "statistical")


@query("""WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 200 THEN t
        ELSE substr(t, 1, list_max(list_filter(range(1, 201), lambda k: octet_length(encode(substr(t, 1, k))) <= 200))::INT) || '…' END AS summary FROM t""")
def short_summaries(spark, sf_dir):
    """Texts of at most 200 bytes are their own summary; longer ones are cut at whole characters."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.short_summary(F.col("text")).alias("summary"))


# --- versions -------------------------------------------------------------------------------------------------


@query(f"SELECT {TOP} - p_partkey - 1 AS depth, {CID.format('p_partkey + 1')} AS cid, p_name AS description FROM part ORDER BY p_partkey DESC LIMIT 7")
def recent_operations(spark, sf_dir):
    t = commit_table(spark, sf_dir).withColumnRenamed("message", "description")
    return versions.recent_operations(t, last_commit(t), 7).select(F.col("depth").cast("long").alias("depth"), "cid", "description")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 = 1")
def time_travel(spark, sf_dir):
    """The rows of one of four commits."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 4).cast("string")).alias("commit"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return versions.at(s, "c1")


def refs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select(F.concat(F.when(F.col("n_regionkey") == 1, "refs/heads/").otherwise("refs/tags/"), "n_name").alias("name"), commit_name(F.col("n_nationkey") + 1).alias("target"))


@query(f"SELECT n_name AS name, {CID.format('n_nationkey + 1')} AS target FROM nation WHERE n_regionkey <> 1")
def tag_list(spark, sf_dir):
    return versions.refs_named(refs(spark, sf_dir), "refs/tags/")


@query(f"SELECT * FROM (SELECT 'stale' AS name, NULL AS target UNION ALL SELECT name, target FROM (SELECT CASE WHEN n_regionkey = 1 THEN 'refs/heads/' ELSE 'refs/tags/' END || n_name AS name, {CID.format('n_nationkey + 1')} AS target FROM nation WHERE n_nationkey > 1) UNION ALL SELECT 'refs/heads/new', 'k2')")
def compare_and_swap(spark, sf_dir):
    """Refs after one is made, two are deleted and a stale change is refused."""
    r = refs(spark, sf_dir)
    first = {row.target: row.name for row in r.where(F.col("target").isin("k000000001", "k000000002")).collect()}
    r = versions.set_ref(r, "refs/heads/new", "k2", None)
    r = versions.set_ref(r, first["k000000001"], None, "k000000001")
    r = versions.set_ref(r, first["k000000002"], None)
    try:
        versions.set_ref(r, "refs/heads/new", "k3", "k1")
        refused = []
    except versions.Stale:
        refused = [("stale", None)]
    return r.unionByName(spark.createDataFrame(refused, "name string, target string"))


@query(f"SELECT 'tag' AS asked, {CID.format('min(n_nationkey) + 1')} AS cid FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'commit', {CID.format('5')} UNION ALL SELECT 'none', NULL")
def commitish(spark, sf_dir):
    r, c = refs(spark, sf_dir), commit_table(spark, sf_dir)
    tag = read(spark, sf_dir, "nation").where("n_regionkey <> 1").agg(F.min_by("n_name", "n_nationkey")).first()[0]
    parts = [versions.resolve_commitish(r, c, text).withColumn("asked", F.lit(name)) for name, text in (("tag", tag), ("commit", "k000000005"), ("none", "nothing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


VIEW = "SELECT 'ref' AS kind, s_name AS name, 't' || (s_suppkey % 4) AS value FROM supplier"


@query(f"{VIEW} WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 UNION ALL SELECT 'head', s_name, 'a' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'tombstone', s_name, 'b' FROM supplier WHERE s_suppkey % 7 = 0")
def view_merge(spark, sf_dir):
    """One head drops every fifth ref and adds heads, the other every seventh and adds tombstones."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    base = s.select(F.lit("ref").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("value"), k.alias("k"))
    a = base.where("k % 5 <> 0").unionByName(base.where("k % 5 = 0").withColumn("kind", F.lit("head")).withColumn("value", F.lit("a"))).drop("k")
    b = base.where("k % 7 <> 0").unionByName(base.where("k % 7 = 0").withColumn("kind", F.lit("tombstone")).withColumn("value", F.lit("b"))).drop("k")
    return versions.merged_views(base.drop("k"), [a, b])


HEADS = f"h AS (SELECT {CID.format('p_partkey + 1')} AS cid FROM part ORDER BY p_partkey DESC LIMIT 3)"


@query(f"WITH {HEADS} SELECT 'merge:' || substr(sha256(string_agg(cid, ',' ORDER BY cid)), 1, 32) AS cid, string_agg(cid, ',' ORDER BY cid) AS parents FROM h")
def operation_heads(spark, sf_dir):
    t = commit_table(spark, sf_dir)
    heads = t.orderBy(F.col("cid").desc()).limit(3).select("cid").repartition(3)
    return versions.merged_heads(t, heads).select("cid", F.array_join("parents", ",").alias("parents"))


@query("SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0")
def untombstone(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_suppkey").alias("id"))
    return versions.untombstoned(s.where("node_id % 3 = 0").select("node_id"), s.where("id % 2 = 0").select("id"))


@query(f"SELECT n_name AS branch, {CID.format('n_nationkey + 1')} AS cid, 'a' || ((n_nationkey + 1) % 3) AS author, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS branches, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS tags FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 1")
def branch_status(spark, sf_dir):
    name = read(spark, sf_dir, "nation").where("n_regionkey = 1").agg(F.min("n_name")).first()[0]
    return versions.status(refs(spark, sf_dir), commit_table(spark, sf_dir), name).drop("time")


@query("SELECT sha256(n_name) AS cid, octet_length(encode(n_name)) AS size, n_name AS content FROM nation WHERE n_nationkey = 3")
def block_by_id(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    wanted = n.where("n_nationkey = 3").select(F.sha2("n_name", 256)).first()[0]
    blocks = n.select(F.sha2("n_name", 256).alias("cid"), F.col("n_name").cast("binary").alias("content"))
    return versions.block(blocks, wanted).withColumn("content", F.col("content").cast("string"))


@query("SELECT n_nationkey::VARCHAR AS cid, sha256(r_name) AS link FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey::VARCHAR, sha256(n_name) FROM nation")
def block_links(spark, sf_dir):
    t = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = F.sha2("r_name", 256), F.sha2("n_name", 256)
    text = F.concat(F.lit('{"up": "'), a, F.lit('", "own": ["'), b, F.lit('", "'), a, F.lit('"], "n": 1}'))
    return versions.links_in(t.select(F.col("n_nationkey").cast("string").alias("cid"), text.cast("binary").alias("content")))


@query("SELECT count(*) FILTER (p_partkey % 2 = 0) AS had, 0 AS had_and_sent, true AS most_others_sent FROM part")
def have_set(spark, sf_dir):
    """What a Bloom have-set leaves to be sent: nothing that the other side has, and of what it lacks all but a few that seem to be there."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("cid"), (F.col("p_partkey") % 2 == 0).alias("had"))
    sent = versions.not_had(p.select("cid"), versions.have_set(p.where("had").select("cid"))).withColumn("sent", F.lit(True))
    t = p.join(sent, "cid", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))
    others = F.count_if(~F.col("had") & F.col("sent")) >= 0.95 * F.count_if(~F.col("had"))
    return t.agg(F.count_if("had").alias("had"), F.count_if(F.col("had") & F.col("sent")).cast("int").alias("had_and_sent"), others.alias("most_others_sent"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'fetch,push' ELSE 'fetch' END AS both FROM nation")
def capabilities(spark, sf_dir):
    own = F.array(F.lit("fetch"), F.lit("push"), F.lit("old"))
    theirs = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("new"), F.lit("push"), F.lit("fetch"))).otherwise(F.array(F.lit("fetch")))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(F.array_sort(F.array_intersect(own, theirs)), ",").alias("both"))


# --- scalar functions -----------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, greatest(1, ceil(pow(1.96 / (p_size / 100.0), 2) * 0.25))::BIGINT AS n, greatest(20, p_partkey // 2) AS cooccurrence, greatest(5, greatest(20, p_partkey // 2) // greatest(p_size, 1)) AS knn FROM part")
def budgets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    own = fn.cooccurrence_budget_ms(F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("id"), fn.sample_size(F.col("p_size") / 100.0).alias("n"), own.alias("cooccurrence"), fn.knn_budget_ms(own, F.col("p_size")).alias("knn"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN '1:' || greatest(p_size, 2)::VARCHAR || ',' ELSE '1:2,' END || '4:' || (p_size + 1) AS kept, round(p_size * 2.0 + (p_size + 1) * 3.0, 6) AS product FROM part")
def sparse_functions(spark, sf_dir):
    """The greatest value of each index, without what is not above 0; and a product over shared indices."""
    size = F.col("p_size").cast("double")
    pair = lambda i, v: F.struct(F.lit(i).alias("index"), v.cast("double").alias("value"))
    pairs = F.array(pair(4, size + 1), pair(1, F.when(F.col("p_size") % 3 > 0, size).otherwise(-size)), pair(1, F.lit(2)), pair(9, F.lit(0)))
    kept = F.transform(fn.sparse_from_unsorted(pairs), lambda p: F.concat(p["index"].cast("string"), F.lit(":"), p["value"].cast("int").cast("string")))
    product = fn.sparse_dot(F.array(F.lit(1), F.lit(4)), F.array(size, size + 1), F.array(F.lit(1), F.lit(4), F.lit(7)), F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(kept, ",").alias("kept"), r6(product).alias("product"))


@query("SELECT n_nationkey AS id, 'Say ' || n_name || ' in {place}.' AS prompt, substr(sha256(n_name), 1, 12) AS short, substr(sha256('s:' || n_name), 1, 32) AS value_hash FROM nation")
def prompt_and_ids(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    prompt = fn.fill_template("Say {name} in {place}.", name=F.col("n_name"))
    return n.select(F.col("n_nationkey").alias("id"), prompt.alias("prompt"), fn.short_id(F.sha2("n_name", 256)).alias("short"), fn.value_hash(F.concat(F.lit("s:"), "n_name")).alias("value_hash"))


@query("SELECT count(DISTINCT n_name || n_regionkey) AS ids FROM nation")
def content_ids(spark, sf_dir):
    """Equal bodies have one id, whatever the order of their properties."""
    n = read(spark, sf_dir, "nation")
    a, b = F.create_map(F.lit("a"), F.col("n_regionkey").cast("string"), F.lit("b"), F.lit("x")), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("n_regionkey").cast("string"))
    ids = [n.select(fn.node_content_id(F.lit("Nation"), F.col("n_name"), props).alias("cid")) for props in (a, b)]
    return ids[0].unionByName(ids[1]).agg(F.count_distinct("cid").alias("ids"))


@query("SELECT vec_id, (vec_id % 4) <> 3 AS valid, CASE WHEN (vec_id % 4) <> 3 THEN vec_id % 100 + 0.5 END AS x, CASE WHEN (vec_id % 4) <> 3 THEN -2.0 END AS y FROM embeddings")
def embedding_decode(spark, sf_dir):
    """Vectors of two numbers in bytes: as 4-byte floats, and as ones that are too short."""
    import struct

    table = [(k, struct.pack("<2f", k + 0.5, -2.0)) for k in range(100)]
    t = F.broadcast(spark.createDataFrame(table, "k int, bytes binary"))  # a hundred rows
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 100).cast("int").alias("k")).join(t, "k")
    content = F.when(F.col("vec_id") % 4 == 3, F.substring("bytes", F.lit(1), F.lit(7))).otherwise(F.col("bytes"))
    v = fn.decode_embedding(content, F.lit("f32"), F.lit(2))
    return e.select("vec_id", fn.encoded_valid(content, F.lit("f32"), F.lit(2)).alias("valid"), v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))


@query("SELECT p_partkey AS id, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || ',\"p_type\":\"' || p_type || '\"}' AS body FROM part")
def properties_as_json(spark, sf_dir):
    g = graph(spark, sf_dir, "Part").nodes
    return g.select(F.substring("id", 6, 10).cast("long").alias("id"), fn.props_json(F.col("props")).alias("body"))


@query("SELECT event_id, 'OBJECT' AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_values(spark, sf_dir):
    v = fn.json_value(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.when(F.schema_of_variant(v).startswith("OBJECT"), "OBJECT").alias("kind"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'content' ELSE 'Part p_size=' || p_size END AS text FROM part")
def texts_to_index(spark, sf_dir):
    k = F.col("p_partkey") % 3
    summary, content = F.when(k == 0, F.col("p_name")).otherwise(F.lit(" ")), F.when(k == 1, F.lit("content"))
    props = F.create_map(F.lit("p_size"), F.concat(F.lit("i:"), F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fn.text_to_index(F.lit("Part"), summary, content, props).alias("text"))


@query("SELECT event_id, lpad(lower(hex(epoch_us(ts) // 1000)), 12, '0') AS time, true AS shaped FROM events")
def time_ordered_ids(spark, sf_dir):
    u = fn.time_ordered_id(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id").cast("string"))
    shaped = u.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return read(spark, sf_dir, "events").select("event_id", F.replace(F.substring(u, 1, 13), F.lit("-"), F.lit("")).alias("time"), shaped.alias("shaped"))


@query("SELECT user_id, count(*) AS n, count(*) >= 12 AS warm FROM events GROUP BY user_id")
def session_reservoir(spark, sf_dir):
    """The reservoir of each session as the last batch left it; test_operators runs it as a stream."""
    t = state.rolling_median(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count("median") > 0).alias("warm"))
