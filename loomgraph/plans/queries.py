"""Queries over the driver's tables, one for each operator, with equivalent SQL. Scores are rounded to six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import analytics, chunk, evaluate, expand, extract, rank, versions
from ..operators import query as q
from ..sources import readers
from ..sources.graph import Graph, anchor_node, edges, label_nodes, node_id, sparse_vectors, tpch_graph
from ..streaming import state
from .lineage import cut
from .retrieve import GraphExpand, Retriever, multi_query

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(column):
    return F.round(column, 6)


# --- SQL pieces -----------------------------------------------------------------------------------------------


def nid(label: str, key: str) -> str:
    return f"'{label.lower()}:' || lpad({key}::VARCHAR, 10, '0')"


NODES = f"""nodes AS (
    SELECT {nid('Customer', 'c_custkey')} AS id, 'Customer' AS ntype, c_name AS summary, ['c_mktsegment=s:' || c_mktsegment] AS props, NULL::BIGINT AS created_at FROM customer
    UNION ALL SELECT {nid('Order', 'o_orderkey')}, 'Order', o_orderpriority, ['o_orderpriority=s:' || o_orderpriority, 'o_orderstatus=s:' || o_orderstatus], NULL FROM orders
    UNION ALL SELECT {nid('Supplier', 's_suppkey')}, 'Supplier', s_name, [], NULL FROM supplier
    UNION ALL SELECT {nid('Part', 'p_partkey')}, 'Part', p_name, ['p_brand=s:' || p_brand, 'p_size=i:' || p_size, 'p_type=s:' || p_type], NULL FROM part
    UNION ALL SELECT {nid('Nation', 'n_nationkey')}, 'Nation', n_name, [], NULL FROM nation
    UNION ALL SELECT {nid('Region', 'r_regionkey')}, 'Region', r_name, [], NULL FROM region
    UNION ALL SELECT {nid('Event', 'event_id')}, 'Event', event_type, ['event_type=s:' || event_type], epoch_us(ts) FROM events
    UNION ALL SELECT {nid('Doc', 'doc_id')}, 'Doc', substr(text, 1, 200), ['lang=s:' || lang, 'n_chars=i:' || n_chars, 'source=s:' || source], NULL FROM documents)"""
GONE = "right(id, 4)::INT % 17 = 0"
EDGES = f"""edge_rows AS (
    SELECT 'placed' AS etype, {nid('Customer', 'o_custkey')} AS src, {nid('Order', 'o_orderkey')} AS dst FROM orders
    UNION ALL SELECT DISTINCT 'contains', {nid('Order', 'l_orderkey')}, {nid('Part', 'l_partkey')} FROM lineitem
    UNION ALL SELECT DISTINCT 'supplied_by', {nid('Part', 'l_partkey')}, {nid('Supplier', 'l_suppkey')} FROM lineitem
    UNION ALL SELECT 'in_nation', {nid('Customer', 'c_custkey')}, {nid('Nation', 'c_nationkey')} FROM customer
    UNION ALL SELECT 'in_nation', {nid('Supplier', 's_suppkey')}, {nid('Nation', 's_nationkey')} FROM supplier
    UNION ALL SELECT 'in_region', {nid('Nation', 'n_nationkey')}, {nid('Region', 'n_regionkey')} FROM nation),
edges AS (SELECT etype || ':' || src || '>' || dst AS id, * FROM edge_rows)"""
VECTORS = "vecs AS (SELECT 'vec:' || lpad(vec_id::VARCHAR, 10, '0') AS id, embedding::DOUBLE[] AS v, label AS vec_label FROM embeddings)"
#: The query vector: that of the smallest vec_id.
FIRST = "first AS (SELECT arg_min(v, id) AS q FROM vecs)"
DENSE = f"{VECTORS}, {FIRST}, dense AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 50)"


def first_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def graph(spark, sf_dir, *labels, etypes=None) -> Graph:
    return tpch_graph(spark, sf_dir, labels or None, etypes)


# --- scans and lookups ----------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT id, ntype, summary FROM nodes")
def node_scan(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("id", "ntype", "summary")


@query(f"WITH {EDGES} SELECT id, etype, src, dst FROM edges")
def edge_scan(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {NODES} SELECT id, summary FROM nodes WHERE ntype = 'Supplier' AND NOT {GONE} ORDER BY id LIMIT 50")
def label_scan(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).label("Supplier").limit(50).execute().select("id", "summary")


@query(f"WITH {NODES} SELECT id, summary FROM nodes WHERE ntype = 'Part' AND list_contains(props, 'p_size=i:7')")
def prop_lookup(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).where_eq("ntype", "Part").where_eq("p_size", 7).include_tombstoned().execute().select("id", "summary")


@query("SELECT 0::BIGINT AS n")
def prop_lookup_is_typed(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).label("Part").where_eq("p_size", "7").execute().agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, w AS (SELECT max(id) AS id FROM nodes WHERE ntype = 'Customer' AND list_contains(props, 'c_mktsegment=s:BUILDING')) SELECT id FROM w WHERE NOT {GONE}")
def prop_index_last_wins(spark, sf_dir):
    return q.Query(graph(spark, sf_dir), index="last").label("Customer").where_eq("c_mktsegment", "BUILDING").execute().select("id")


@query(f"WITH {NODES} SELECT id FROM nodes WHERE ntype = 'Customer' AND list_contains(props, 'c_mktsegment=s:MACHINERY') AND NOT {GONE}")
def repeated_where_replaces(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).label("Customer").where_eq("c_mktsegment", "BUILDING").where_eq("c_mktsegment", "MACHINERY").execute().select("id")


@query(f"WITH {NODES} SELECT id, ntype, summary FROM nodes WHERE id = 'part:0000000017'")
def node_by_id(spark, sf_dir):
    return graph(spark, sf_dir).nodes.where("id = 'part:0000000017'").select("id", "ntype", "summary")


@query(f"WITH {EDGES} SELECT etype, src, dst FROM edges WHERE id = (SELECT min(id) FROM edges WHERE etype = 'in_region')")
def edge_by_id(spark, sf_dir):
    t = edges(spark, sf_dir)
    found = edges(spark, sf_dir, ("in_region",)).agg(F.min("id")).first()[0]
    return t.where(F.col("id") == found).select("etype", "src", "dst")


@query(f"WITH {VECTORS} SELECT id, 'm64' AS models, len(v) AS dim FROM vecs")
def embedding_models(spark, sf_dir):
    t = graph(spark, sf_dir).embeddings
    return t.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.max("dim").cast("long").alias("dim"))


@query(f"WITH {NODES} SELECT id, summary FROM nodes WHERE ntype = 'Order' AND NOT {GONE} ORDER BY id LIMIT 20 OFFSET 40")
def paged_nodes(spark, sf_dir):
    return q.Query(graph(spark, sf_dir)).label("Order").offset(40).limit(20).execute().select("id", "summary")


@query(f"WITH {NODES} SELECT count(*) AS n FROM nodes WHERE ntype IN ('Nation', 'Region') AND NOT {GONE}")
def system_filter(spark, sf_dir):
    g = graph(spark, sf_dir, "Nation", "Region")
    g = Graph(g.nodes.unionByName(anchor_node(spark).withColumn("ntype", F.lit("Nation"))), g.edges, tombstones=g.tombstones)
    return q.Query(g).execute().agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, b AS (SELECT min(created_at) AS lo, max(created_at) AS hi FROM nodes WHERE ntype = 'Event') SELECT ntype, count(*) AS n FROM nodes, b WHERE ntype IN ('Event', 'Nation') AND (created_at IS NULL OR (created_at >= lo + (hi - lo) // 4 AND created_at < lo + (hi - lo) // 2)) GROUP BY ntype")
def temporal_filter(spark, sf_dir):
    g = graph(spark, sf_dir, "Event", "Nation")
    lo, hi = g.nodes.agg(F.min("created_at"), F.max("created_at")).first()
    return q.temporal(g.nodes, lo + (hi - lo) // 4, lo + (hi - lo) // 2).groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))


# --- adjacency ------------------------------------------------------------------------------------------------

OUT_SQL = f"""WITH {NODES}, {EDGES}, own AS (SELECT * FROM nodes WHERE ntype = 'Nation' AND NOT {GONE}),
    r AS (SELECT dst, src, id, row_number() OVER (PARTITION BY dst ORDER BY etype, src, id) AS k, count(*) OVER (PARTITION BY dst) AS n FROM edges WHERE etype = 'in_nation')
    SELECT own.id, coalesce(string_agg(r.src, ',' ORDER BY k), '') AS incoming, coalesce(max(n) > 5, false) AS truncated FROM own LEFT JOIN r ON r.dst = own.id AND k <= 5 GROUP BY own.id"""


@query(OUT_SQL)
def with_incoming(spark, sf_dir):
    t = q.Query(graph(spark, sf_dir)).label("Nation").with_incoming("in_nation").adjacency_cap(5).execute()
    return t.select("id", F.array_join(F.transform("incoming", lambda e: e["src"]), ",").alias("incoming"), F.col("incoming_truncated").alias("truncated"))


@query(f"""WITH {NODES}, {EDGES}, own AS (SELECT * FROM nodes WHERE ntype = 'Customer' AND NOT {GONE}),
    r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY etype, id) AS k, count(*) OVER (PARTITION BY src) AS n FROM edges WHERE etype IN ('placed', 'in_nation'))
    SELECT own.id, coalesce(string_agg(r.dst, ',' ORDER BY k), '') AS outgoing, coalesce(max(n) > 4, false) AS truncated FROM own LEFT JOIN r ON r.src = own.id AND k <= 4 GROUP BY own.id""")
def with_outgoing(spark, sf_dir):
    t = q.Query(graph(spark, sf_dir)).label("Customer").with_outgoing("placed", "in_nation").adjacency_cap(4).execute()
    return t.select("id", F.array_join(F.transform("outgoing", lambda e: e["dst"]), ",").alias("outgoing"), F.col("outgoing_truncated").alias("truncated"))


@query(f"""WITH {NODES}, {EDGES}, own AS (SELECT * FROM nodes WHERE ntype = 'Nation' AND NOT {GONE})
    SELECT own.id, (SELECT count(*) FROM edges e WHERE e.src = own.id) AS n_out, least((SELECT count(*) FROM edges e WHERE e.dst = own.id AND e.src <> e.dst), 50) AS n_in FROM own""")
def with_any_direction(spark, sf_dir):
    t = q.Query(graph(spark, sf_dir)).label("Nation").with_any_direction("in_nation", "in_region").adjacency_cap(50).execute()
    return t.select("id", F.size("outgoing").cast("long").alias("n_out"), F.size("incoming").cast("long").alias("n_in"))


@query(f"WITH {EDGES} SELECT 'out' AS direction, etype, src, dst FROM edges WHERE src = 'nation:0000000002' UNION ALL SELECT 'in', etype, src, dst FROM edges WHERE dst = 'nation:0000000002'")
def node_edges_both(spark, sf_dir):
    return q.traverse(graph(spark, sf_dir), "nation:0000000002", direction="both", limit=0).select("direction", "etype", "src", "dst")


@query(f"WITH {EDGES} SELECT etype, dst FROM edges WHERE src = 'customer:0000000010' ORDER BY etype, id LIMIT 25")
def traverse_out(spark, sf_dir):
    return q.traverse(graph(spark, sf_dir), "customer:0000000010").select("etype", "dst")


@query(f"WITH {NODES}, {EDGES} SELECT count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE ntype <> 'Order') OR dst NOT IN (SELECT id FROM nodes WHERE ntype <> 'Order')")
def dangling_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    return versions.dangling(g.edges, g.nodes.where("ntype <> 'Order'")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT etype, count(*) AS n FROM edges WHERE right(src, 4)::INT % 17 <> 0 AND right(dst, 4)::INT % 17 <> 0 GROUP BY etype")
def cascade_delete(spark, sf_dir):
    g = graph(spark, sf_dir)
    return versions.cascaded(g.edges, g.tombstones.select(F.col("node_id").alias("id"))).groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES} SELECT ntype, count(*) AS n FROM nodes WHERE NOT {GONE} GROUP BY ntype")
def tombstone_filter(spark, sf_dir):
    g = graph(spark, sf_dir)
    return versions.live_export(g.nodes, g.tombstones).groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT ntype) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT etype) FROM edges) AS etypes")
def graph_stats(spark, sf_dir):
    return q.stats(graph(spark, sf_dir))


@query(f"WITH {NODES}, p AS (SELECT ntype, unnest(props) AS p FROM nodes), names AS (SELECT ntype, string_agg(DISTINCT split_part(p, '=', 1), ',' ORDER BY split_part(p, '=', 1)) AS props FROM p GROUP BY ntype) SELECT n.ntype, n.n, coalesce(props, '') AS props FROM (SELECT ntype, count(*) AS n FROM nodes GROUP BY ntype) n LEFT JOIN names USING (ntype)")
def schema_inference(spark, sf_dir):
    g = graph(spark, sf_dir)
    # amounts are left out: their text differs between engines
    return q.schema_of(Graph(g.nodes.withColumn("props", F.map_filter("props", lambda k, v: ~k.endswith("acctbal"))), g.edges))


@query(f"""WITH {NODES} SELECT id, 'ntype: ' || ntype || chr(10) || 'id: ' || id || chr(10) || 'summary: ' || summary || chr(10)
    || coalesce(array_to_string(list_transform(props, lambda p: split_part(p, '=', 1) || ': ' || substr(p, strpos(p, '=') + 3)), chr(10)) || chr(10), '') AS text
    FROM nodes WHERE ntype = 'Part'""")
def render_nodes(spark, sf_dir):
    return q.rendered(graph(spark, sf_dir, "Part").nodes)


@query(f"""WITH {NODES}, {EDGES}, i AS (SELECT dst, src, etype, row_number() OVER (PARTITION BY dst ORDER BY etype, src, id) AS k, count(*) OVER (PARTITION BY dst) AS n FROM edges),
    o AS (SELECT src, dst, etype, row_number() OVER (PARTITION BY src ORDER BY etype, id) AS k, count(*) OVER (PARTITION BY src) AS n FROM edges)
    SELECT id, 'ntype: Nation' || chr(10) || 'id: ' || id || chr(10) || 'summary: ' || summary || chr(10)
        || coalesce((SELECT 'Outgoing:' || chr(10) || string_agg('  ' || etype || ' -> ' || dst, chr(10) ORDER BY k) || chr(10) || CASE WHEN max(n) > 3 THEN '  ... (+' || (max(n) - 3) || ' more)' || chr(10) ELSE '' END FROM o WHERE o.src = nodes.id AND k <= 3), '')
        || coalesce((SELECT 'Incoming:' || chr(10) || string_agg('  ' || etype || ' <- ' || src, chr(10) ORDER BY k) || chr(10) || CASE WHEN max(n) > 3 THEN '  ... (+' || (max(n) - 3) || ' more)' || chr(10) ELSE '' END FROM i WHERE i.dst = nodes.id AND k <= 3), '') AS text
    FROM nodes WHERE ntype = 'Nation'""")
def render_adjacency(spark, sf_dir):
    g = graph(spark, sf_dir, "Nation")
    return q.rendered_with_adjacency(g.nodes.withColumn("props", F.create_map().cast("map<string,string>")), g.edges, 3)


# --- lanes and fusion -----------------------------------------------------------------------------------------


@query(f"WITH {DENSE} SELECT id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, id LIMIT 10")
def dense_top_k(spark, sf_dir):
    t = rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 10)
    return t.select("id", r6("score").alias("score"))


TOKENS = "toks AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''))) AS token FROM documents)"
SLOT = "(('0x' || substr(md5(token), 1, 8))::BIGINT % 1024)::INT"
SPARSE = f"""{TOKENS}, post AS (SELECT doc_id, {SLOT} AS slot, max(1.0::DOUBLE / (1 + strlen(token))) AS weight FROM toks GROUP BY ALL),
    sq AS (SELECT slot, weight AS qw FROM post WHERE doc_id = (SELECT min(doc_id) FROM documents)),
    sparse AS (SELECT {nid('Doc', 'doc_id')} AS id, sum(weight * qw) AS score FROM post JOIN sq USING (slot) GROUP BY doc_id ORDER BY round(score, 9) DESC, id LIMIT 50)"""


def sparse_query(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sparse_vectors(docs.join(docs.agg(F.min("doc_id").alias("doc_id")), "doc_id")).select("slot", "weight")


def sparse_lane(spark, sf_dir, k=50) -> DataFrame:
    query = sparse_query(spark, sf_dir)
    t = rank.sparse(sparse_vectors(read(spark, sf_dir, "documents"), query), query, 2**31 - 1)
    return t.orderBy(F.round("score", 9).desc(), "id").limit(k)


@query(f"WITH {TOKENS} SELECT {nid('Doc', 'doc_id')} AS node_id, {SLOT} AS slot, round(max(1.0::DOUBLE / (1 + strlen(token))), 6) AS weight FROM toks GROUP BY ALL")
def sparse_index(spark, sf_dir):
    return sparse_vectors(read(spark, sf_dir, "documents")).select("node_id", "slot", r6("weight").alias("weight"))


@query(f"WITH {SPARSE} SELECT id, round(score, 6) AS score FROM sparse")
def sparse_top_k(spark, sf_dir):
    return sparse_lane(spark, sf_dir).select("id", r6("score").alias("score"))


LANES = f"""{VECTORS}, {FIRST}, lane_a AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 40),
    last AS (SELECT arg_max(v, id) AS q FROM vecs), lane_b AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, last ORDER BY score DESC, id LIMIT 40)"""


def two_lanes(spark, sf_dir, k=40):
    e = graph(spark, sf_dir).embeddings
    last = [float(x) for x in read(spark, sf_dir, "embeddings").orderBy(F.col("vec_id").desc()).select("embedding").first()[0]]
    return rank.dense(e, first_vector(spark, sf_dir), k), rank.dense(e, last, k)


@query(f"""WITH {LANES}, u AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM lane_a UNION ALL SELECT id, 0.5 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM lane_b)
    SELECT id, round(sum(s)::DOUBLE, 6) AS score FROM u GROUP BY id""")
def fuse_ranks(spark, sf_dir):
    a, b = two_lanes(spark, sf_dir)
    return rank.fuse_ranks([(a, 1.0), (b, 0.5)]).select("id", r6("score").alias("score"))


@query(f"""WITH {LANES}, u AS (SELECT 1.0 AS w, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s, id FROM lane_a UNION ALL SELECT 0.25, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), id FROM lane_b)
    SELECT id, round(sum(w * s)::DOUBLE, 6) AS score FROM u GROUP BY id""")
def fuse_scores(spark, sf_dir):
    a, b = two_lanes(spark, sf_dir)
    return rank.fuse_scores([(a, 1.0), (b, 0.25)]).select("id", r6("score").alias("score"))


@query(f"WITH {VECTORS}, {FIRST}, one AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 1) SELECT id, 0.5::DOUBLE AS score FROM one")
def fuse_scores_without_spread(spark, sf_dir):
    a, _ = two_lanes(spark, sf_dir, 1)
    return rank.fuse_scores([(a, 1.0)])


@query(f"WITH {DENSE}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS old FROM dense), r AS (SELECT *, CASE WHEN old <= 10 THEN -old END AS new FROM p) SELECT id, row_number() OVER (ORDER BY new DESC NULLS LAST, old)::INT AS place FROM r")
def rerank_head(spark, sf_dir):
    t = rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)
    return rank.rerank_head(t, -F.col("old"), 10).select("id", "place")


@query(f"""WITH RECURSIVE {DENSE}, item AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k, 20 + right(id, 4)::INT % 90 AS tokens FROM dense),
    fold(k, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, []::VARCHAR[] UNION ALL
        SELECT item.k, CASE WHEN used + tokens <= 700 AND len(kept) < 12 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 700 AND len(kept) < 12 THEN list_append(kept, id) ELSE kept END FROM fold JOIN item ON item.k = fold.k + 1)
    SELECT unnest(kept) AS id, used AS tokens_used, (50 - len(kept))::INT AS dropped FROM fold WHERE k = 50""")
def pack_budget(spark, sf_dir):
    t = rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)
    t = t.withColumn("tokens", 20 + F.substring("id", -4, 4).cast("int") % 90)
    return rank.pack_budget(t, 700, 12).select("id", "tokens_used", "dropped")


@query(f"WITH {DENSE}, p AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM dense) SELECT id, place, substr('vector ' || id, 1, 10) AS preview FROM p WHERE place BETWEEN 4 AND 6")
def suggested_neighbours(spark, sf_dir):
    t = rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)
    return rank.suggested_neighbours(t.withColumn("text", F.concat(F.lit("vector "), "id")), 10)


@query("""WITH t AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) SELECT doc_id AS id, round(1.0::DOUBLE / (1 + strlen(substr(lower(text), 1, p - 1))), 6) AS score FROM t WHERE p > 0
    ORDER BY strlen(substr(lower(text), 1, p - 1)), strlen(text), doc_id LIMIT 20""")
def text_rank(spark, sf_dir):
    t = rank.text_rank(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "License", 20)
    return t.select("id", r6("score").alias("score"))


# --- expansion ------------------------------------------------------------------------------------------------


def nation_seeds(g: Graph) -> DataFrame:
    return g.nodes.where("ntype = 'Nation' and substring(id, -1) in ('1', '4')").select("id", (F.lit(1.0) / (1 + F.substring("id", -2, 2).cast("int"))).alias("score"))


SEEDS = f"seeds AS (SELECT {nid('Nation', 'n_nationkey')} AS id, 1.0::DOUBLE / (1 + n_nationkey) AS score FROM nation WHERE n_nationkey % 10 IN (1, 4))"


@query(f"""WITH {EDGES}, {SEEDS}, s AS (SELECT e.src AS id, max(score * 0.7) AS score FROM edges e JOIN seeds ON seeds.id = e.dst WHERE e.etype = 'in_nation' GROUP BY e.src)
    SELECT id, round(score, 6) AS score FROM s WHERE id NOT IN (SELECT id FROM seeds) ORDER BY s.score DESC, id LIMIT 20""")
def expand_one_hop(spark, sf_dir):
    g = graph(spark, sf_dir, "Nation")
    return expand.expand_decay(nation_seeds(g), g.edges, etypes={"in_nation": 1.0}, direction="in").select("id", r6("score").alias("score"))


@query(f"""WITH {EDGES}, {SEEDS}, walk AS (SELECT id, etype, src, dst FROM edges UNION ALL SELECT id, etype, dst, src FROM edges),
    ranked1 AS (SELECT w.*, s.score AS ps, row_number() OVER (PARTITION BY src ORDER BY etype, w.id) AS k FROM walk w JOIN seeds s ON s.id = w.src WHERE etype IN ('in_nation', 'placed')),
    hop1 AS (SELECT dst AS id, max(ps * 0.5 * CASE etype WHEN 'placed' THEN 2.0 ELSE 0.9 END) AS score FROM ranked1 WHERE k <= 30 GROUP BY dst), h1 AS (SELECT * FROM hop1 WHERE id NOT IN (SELECT id FROM seeds)),
    ranked2 AS (SELECT w.*, s.score AS ps, row_number() OVER (PARTITION BY src ORDER BY etype, w.id) AS k FROM walk w JOIN h1 s ON s.id = w.src WHERE etype IN ('in_nation', 'placed')),
    hop2 AS (SELECT dst AS id, max(ps * 0.5 * CASE etype WHEN 'placed' THEN 2.0 ELSE 0.9 END) AS score FROM ranked2 WHERE k <= 30 GROUP BY dst),
    h2 AS (SELECT * FROM hop2 WHERE id NOT IN (SELECT id FROM seeds) AND id NOT IN (SELECT id FROM h1)), found AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
    SELECT id, round(score, 6) AS score FROM found ORDER BY found.score DESC, id LIMIT 100""")
def expand_two_hops(spark, sf_dir):
    g = graph(spark, sf_dir, "Nation")
    t = expand.expand_decay(nation_seeds(g), g.edges, max_expand=100, decay=0.5, depth=2, etypes={"in_nation": 0.9, "placed": 2.0}, direction="both", max_per_seed=30)
    return t.select("id", r6("score").alias("score"))


@query(f"WITH {EDGES}, w AS (SELECT src, dst, sum(1.0::DOUBLE) AS w FROM edges WHERE etype IN ('in_nation', 'in_region') GROUP BY ALL) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM w")
def transition_matrix(spark, sf_dir):
    t = expand.transition(expand.authored(edges(spark, sf_dir, ("in_nation", "in_region"))))
    return t.select("src", "dst", r6("p").alias("p"))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"""WITH {EDGES}, m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, count(*)::DOUBLE AS w FROM edges WHERE etype IN ('in_nation', 'in_region') GROUP BY ALL)),
        n AS (SELECT src AS id FROM m UNION SELECT dst FROM m), z AS (SELECT count(*) AS k FROM n), r0 AS (SELECT id, 1.0::DOUBLE / k AS r FROM n, z)"""]
    for i in range(rounds):
        parts.append(f"""l{i} AS (SELECT coalesce(sum(r), 0) AS loose FROM r{i} WHERE id NOT IN (SELECT src FROM m)), c{i} AS (SELECT dst AS id, sum(r * p) AS came FROM m JOIN r{i} ON r{i}.id = m.src GROUP BY dst),
            r{i + 1} AS (SELECT n.id, (0.15 + 0.85 * loose) / k + 0.85 * coalesce(came, 0) AS r FROM n CROSS JOIN z CROSS JOIN l{i} LEFT JOIN c{i} ON c{i}.id = n.id)""")
    return ", ".join(parts) + f" SELECT id, round(r / (SELECT sum(r) FROM r{rounds}), 6) AS score FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank(spark, sf_dir):
    adj = expand.authored(edges(spark, sf_dir, ("in_nation", "in_region")))
    return expand.pagerank(adj, iterations=5, eps=None).select("id", r6("score").alias("score"))


def _seeded_sql(rounds: int) -> str:
    parts = [f"""WITH {EDGES}, {SEEDS}, m AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, count(*)::DOUBLE AS w FROM edges WHERE etype IN ('in_nation', 'in_region') GROUP BY ALL)),
        n AS (SELECT src AS id FROM m UNION SELECT dst FROM m), own AS (SELECT * FROM seeds WHERE id IN (SELECT id FROM n)),
        r0 AS MATERIALIZED (SELECT n.id, coalesce(score, 0) / (SELECT sum(score) FROM own) AS p, coalesce(score, 0) / (SELECT sum(score) FROM own) AS r FROM n LEFT JOIN own USING (id))"""]
    for i in range(rounds):
        parts.append(f"""l{i} AS (SELECT coalesce(sum(r), 0) AS loose FROM r{i} WHERE id NOT IN (SELECT src FROM m)), c{i} AS (SELECT dst AS id, sum(r * m.p) AS came FROM m JOIN r{i} ON r{i}.id = m.src GROUP BY dst),
            r{i + 1} AS MATERIALIZED (SELECT r{i}.id, p, (0.15 + 0.85 * loose) * p + 0.85 * coalesce(came, 0) AS r FROM r{i} CROSS JOIN l{i} LEFT JOIN c{i} ON c{i}.id = r{i}.id)""")
    last = f"r{rounds}"
    return ", ".join(parts) + f" SELECT id, round(r / (SELECT sum(r) FROM {last}), 6) AS score FROM {last} WHERE r > 0 AND id NOT IN (SELECT id FROM seeds) ORDER BY r DESC, id LIMIT 30"


@query(_seeded_sql(15))
def personalized_pagerank(spark, sf_dir):
    g = graph(spark, sf_dir, "Nation")
    adj = expand.authored(edges(spark, sf_dir, ("in_nation", "in_region")))
    return expand.expand_pagerank(nation_seeds(g), adj, 30).select("id", r6("score").alias("score"))


KNN = f"{VECTORS}, near AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS weight FROM vecs a JOIN vecs b ON a.id <> b.id), knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 12) DESC, dst) AS k FROM near QUALIFY k <= 5)"


@query(f"WITH {KNN} SELECT src, dst, round(weight, 6) AS weight FROM knn")
def knn_edges(spark, sf_dir):
    return expand.knn(graph(spark, sf_dir).embeddings, 5).select("src", "dst", r6("weight").alias("weight"))


@query("""WITH a AS (SELECT DISTINCT 'v' || vec_id AS src, 'v' || (vec_id + 1) AS dst FROM embeddings WHERE vec_id % 3 = 0), k AS (SELECT 'v' || vec_id AS src, 'v' || (vec_id + 1) AS dst FROM embeddings)
    SELECT src, dst, 'authored' AS provenance FROM a UNION ALL SELECT src, dst, 'knn' FROM k WHERE (src, dst) NOT IN (SELECT (src, dst) FROM a)""")
def hybrid_adjacency(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    k = v.select(F.concat(F.lit("v"), "vec_id").alias("src"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("dst"), F.lit(0.5).alias("weight"), F.lit("knn").alias("provenance"))
    own = expand.authored(v.where("vec_id % 3 = 0").select(F.concat(F.lit("v"), "vec_id").alias("src"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("dst")).distinct())
    return expand.hybrid(own, k).select("src", "dst", "provenance")


@query(f"""WITH {DENSE}, m AS (SELECT id, vec_label AS community FROM vecs), ranked AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM dense),
    best AS (SELECT community, max(score) AS best FROM ranked JOIN m USING (id) WHERE place <= 3 GROUP BY community),
    add_rows AS (SELECT m.id, best * 0.5 AS score, best, community, row_number() OVER (PARTITION BY community ORDER BY m.id) AS k FROM m JOIN best USING (community) WHERE m.id NOT IN (SELECT id FROM dense) QUALIFY k <= 4)
    SELECT id, round(score, 6) AS score, place FROM ranked UNION ALL SELECT id, round(score, 6), (50 + row_number() OVER (ORDER BY best DESC, community, k))::INT FROM add_rows""")
def community_expansion(spark, sf_dir):
    e = graph(spark, sf_dir).embeddings
    t = expand.expand_community(rank.dense(e, first_vector(spark, sf_dir), 50), e.select(F.col("node_id").alias("id"), F.col("vec_label").alias("community")), 3, 4, 0.5)
    return t.select("id", r6("score").alias("score"), "place")


@query(f"""WITH RECURSIVE {EDGES}, walk(id, hop) AS (SELECT 'region:0000000001', 0 UNION SELECT e.src, hop + 1 FROM walk JOIN edges e ON e.dst = walk.id WHERE hop < 2 AND e.etype IN ('in_region', 'in_nation'))
    SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id""")
def explain_paths(spark, sf_dir):
    t = expand.explain_paths(edges(spark, sf_dir, ("in_region", "in_nation")), "region:0000000001", depth=2, per_node=1_000_000)
    return t.select("id", "hop")


# --- analytics ------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM e GROUP BY id")
def degree(spark, sf_dir):
    return analytics.degree(edges(spark, sf_dir))


@query(f"WITH {KNN} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(weight), 6) AS weight FROM knn WHERE weight > 0 GROUP BY ALL")
def undirected_graph(spark, sf_dir):
    return analytics.undirected(expand.knn(graph(spark, sf_dir).embeddings, 5).where("weight > 0")).select("a", "b", r6("weight").alias("weight"))


@query(f"""WITH {KNN}, pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM knn WHERE weight > 0 GROUP BY ALL), m AS (SELECT id, vec_label AS c FROM vecs),
    t AS (SELECT 2 * sum(w) AS m2 FROM pairs), deg AS (SELECT c, sum(w) AS a FROM (SELECT a AS id, w FROM pairs UNION ALL SELECT b, w FROM pairs) JOIN m USING (id) GROUP BY c),
    ins AS (SELECT x.c, 2 * sum(w) AS e FROM pairs JOIN m x ON x.id = pairs.a JOIN m y ON y.id = pairs.b WHERE x.c = y.c GROUP BY x.c)
    SELECT round(sum(coalesce(e, 0) / m2 - (a / m2) ^ 2), 6) AS modularity FROM deg LEFT JOIN ins USING (c), t""")
def modularity(spark, sf_dir):
    e = graph(spark, sf_dir).embeddings
    pairs = analytics.undirected(expand.knn(e, 5).where("weight > 0"))
    return analytics.modularity(pairs, e.select(F.col("node_id").alias("id"), F.col("vec_label").alias("community"))).select(r6("modularity").alias("modularity"))


@query()
def communities(spark, sf_dir):
    """One node after another in one worker while the edges are few enough for it, else by joins."""
    pairs = cut(analytics.undirected(expand.knn(graph(spark, sf_dir).embeddings, 5).where("weight > 0")))
    few = pairs.count() <= analytics.COMMUNITY_EDGES
    return analytics.communities(pairs) if few else analytics.spread_communities(pairs)


def _labels_sql(rounds: int) -> str:
    parts = [f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE etype IN ('in_nation', 'in_region') AND src <> dst),
        walk AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), c0 AS MATERIALIZED (SELECT DISTINCT x AS id, x AS community FROM walk)"""]
    for i in range(rounds):
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT x AS id, community FROM walk JOIN c{i} ON c{i}.id = walk.y GROUP BY x, community
            QUALIFY row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, community) = 1)""")
    return ", ".join(parts) + f" SELECT id, community FROM c{rounds}"


@query(_labels_sql(3))
def label_propagation(spark, sf_dir):
    return analytics.label_propagation(analytics.undirected(expand.authored(edges(spark, sf_dir, ("in_nation", "in_region")))), 3)


def _summary_sql(picks: int) -> str:
    parts = [f"""WITH {VECTORS}, own AS (SELECT vec_label AS g, id, v, right(id, 2)::INT + 1 AS central FROM vecs WHERE vec_label IS NOT NULL),
        dims AS (SELECT g, i, avg(x) AS x FROM (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM own) GROUP BY g, i), centres AS (SELECT g, list(x ORDER BY i) AS centre FROM dims GROUP BY g),
        left0 AS MATERIALIZED (SELECT g, id, v, 0.8 * list_cosine_similarity(v, centre) + 0.2 * central / max(central) OVER (PARTITION BY g) AS base, 0.0::DOUBLE AS red FROM own JOIN centres USING (g))"""]
    for i in range(picks):
        parts.append(f"""pick{i} AS MATERIALIZED (SELECT *, 0.5 * base - 0.5 * red AS score FROM left{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(0.5 * base - 0.5 * red, 12) DESC, id) = 1),
            left{i + 1} AS MATERIALIZED (SELECT a.g, a.id, a.v, a.base, greatest(a.red, list_cosine_similarity(a.v, p.v)) AS red FROM left{i} a JOIN pick{i} p ON a.g = p.g AND a.id <> p.id)""")
    rows = " UNION ALL ".join(f'SELECT g AS "group", id, {i + 1} AS place, round(score, 6) AS score FROM pick{i}' for i in range(picks))
    return ", ".join(parts) + " " + rows


@query(_summary_sql(5))
def community_summary(spark, sf_dir):
    e = graph(spark, sf_dir).embeddings
    t = e.select(F.col("vec_label").alias("group"), F.col("node_id").alias("id"), "vector", (F.substring("node_id", -2, 2).cast("int") + 1).alias("centrality"))
    return analytics.mmr(analytics.summary_scores(t), 5).select("group", "id", "place", r6("score").alias("score"))


@query(f"""WITH {DENSE}, s AS (SELECT score, row_number() OVER (ORDER BY score) AS i, lead(score) OVER (ORDER BY score) - score AS gap FROM dense), l AS (SELECT list(score ORDER BY score) AS s FROM dense),
    x AS (SELECT s[1] AS low, s[50] AS high, s[26] AS median, s[13] AS q1, s[38] AS q3 FROM l), b AS (SELECT bool_or(i >= 2 AND 50 - i >= 2 AND gap > (high - low) / 2) AS wide FROM s, x)
    SELECT 50::BIGINT AS n, round(low, 6) AS low, round(high, 6) AS high, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
        CASE WHEN wide THEN 'bimodal' WHEN high - median > 2 * (q3 - q1) THEN 'long-tail' ELSE 'uniform' END AS shape FROM x, b""")
def score_shape(spark, sf_dir):
    t = analytics.shape(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50))
    return t.select("n", *[r6(c).alias(c) for c in ("low", "high", "median", "q1", "q3", "iqr")], "shape")


@query(f"WITH {DENSE} SELECT id, round((49 - (row_number() OVER (ORDER BY score DESC, id) - 1)) / 49.0::DOUBLE, 6) AS quantile FROM dense")
def score_quantiles(spark, sf_dir):
    return analytics.quantiles(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)).select("id", r6("quantile").alias("quantile"))


@query(f"WITH {DENSE}, x AS (SELECT score - min(score) OVER () AS x FROM dense), p AS (SELECT x / sum(x) OVER () AS p FROM x) SELECT round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(50), 6) AS entropy FROM p")
def score_entropy(spark, sf_dir):
    return analytics.entropy(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)).select(r6("entropy").alias("entropy"))


MARGINS = "g AS (SELECT row_number() OVER w AS place, greatest(0, (score - lead(score) OVER w) / greatest(abs(score), 1e-9)) AS gap, lead(score) OVER w AS nxt FROM dense WINDOW w AS (ORDER BY score DESC, id)), gaps AS (SELECT * FROM g WHERE nxt IS NOT NULL)"


@query(f"WITH {DENSE}, {MARGINS} SELECT round(median(gap), 6) AS margin FROM gaps WHERE place <= 10")
def median_margin(spark, sf_dir):
    return analytics.median_margin(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50), 10).select(r6("margin").alias("margin"))


@query(f"""WITH {DENSE}, {MARGINS}, x AS (SELECT score - min(score) OVER () AS x FROM dense), p AS (SELECT x / sum(x) OVER () AS p FROM x), h AS (SELECT -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(50) AS h FROM p),
    m AS (SELECT median(gap) AS mid, max(CASE WHEN place = 1 THEN gap END) AS f FROM gaps)
    SELECT CASE WHEN mid < 1e-9 THEN 'low' WHEN f >= 2 * mid AND h < least(0.999, greatest(0, 1 - 2 * mid)) THEN 'high' WHEN f > mid THEN 'medium' ELSE 'low' END AS agreement FROM m, h""")
def rank_agreement(spark, sf_dir):
    return analytics.rank_agreement(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50))


@query(f"WITH {DENSE} SELECT round(least(1, greatest(0, 1 - min(score) / max(score))), 6) AS confidence FROM dense")
def retrieve_confidence(spark, sf_dir):
    return analytics.confidence(rank.dense(graph(spark, sf_dir).embeddings, first_vector(spark, sf_dir), 50)).select(r6("confidence").alias("confidence"))


@query("""WITH o AS (SELECT DISTINCT o_orderkey % 50 AS doc, o_orderkey AS sentence, p_brand AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    n AS (SELECT doc, count(DISTINCT sentence) AS total FROM o GROUP BY doc), one AS (SELECT doc, entity, count(*) AS c FROM o GROUP BY ALL),
    two AS (SELECT x.doc, x.entity AS a, y.entity AS b, count(*) AS cab FROM o x JOIN o y ON x.doc = y.doc AND x.sentence = y.sentence AND x.entity < y.entity GROUP BY ALL)
    SELECT two.doc, a, b, round(ln(cab * total / (p.c * r.c)::DOUBLE), 6) AS pmi FROM two JOIN n USING (doc) JOIN one p ON p.doc = two.doc AND p.entity = a JOIN one r ON r.doc = two.doc AND r.entity = b WHERE ln(cab * total / (p.c * r.c)::DOUBLE) > 0.3""")
def cooccurrence_pmi(spark, sf_dir):
    t = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    t = t.select((F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("sentence"), F.col("p_brand").alias("entity")).distinct()
    t = t.join(t.groupBy("doc").agg(F.count_distinct("sentence").alias("sentences")), "doc")
    return analytics.pmi(t, 0.3).select("doc", "a", "b", r6("pmi").alias("pmi"))


# --- versions -------------------------------------------------------------------------------------------------

BASE = "base AS (SELECT p_partkey AS id, 'c' || p_size AS cid FROM part WHERE p_partkey % 10 <> 3)"
OURS = "ours AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'o' ELSE 'c' END || p_size AS cid FROM part WHERE p_partkey % 11 <> 5)"
THEIRS = "theirs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 't' WHEN p_partkey % 35 = 0 THEN 'o' ELSE 'c' END || p_size AS cid FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 13 <> 4)"


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    side = lambda keep, letter: p.where(keep).select(k.alias("id"), F.concat(letter, F.col("p_size").cast("string")).alias("cid"))
    return (
        side(k % 10 != 3, F.lit("c")), side(k % 11 != 5, F.when(k % 7 == 0, "o").otherwise("c")),
        side((k % 10 != 3) & (k % 13 != 4), F.when(k % 6 == 0, "t").when(k % 35 == 0, "o").otherwise("c")),
    )


@query(f"WITH {BASE}, {OURS} SELECT coalesce(base.id, ours.id) AS id, CASE WHEN base.cid IS NULL THEN 'added' WHEN ours.cid IS NULL THEN 'removed' ELSE 'changed' END AS change, base.cid AS old_cid, ours.cid AS new_cid FROM base FULL JOIN ours ON base.id = ours.id WHERE base.cid IS DISTINCT FROM ours.cid")
def snapshot_diff(spark, sf_dir):
    base, ours, _ = sides(spark, sf_dir)
    return versions.diff(base, ours)


@query(f"WITH {BASE}, {OURS}, {THEIRS}, u AS (SELECT * FROM base UNION ALL SELECT * FROM ours UNION ALL SELECT * FROM theirs) SELECT id, max(cid) AS cid, min(cid) <> max(cid) AS conflict FROM u GROUP BY id")
def union_of_versions(spark, sf_dir):
    return versions.union_versions(list(sides(spark, sf_dir)))


@query(f"WITH {OURS}, {THEIRS} SELECT coalesce(o.id, t.id) AS id, coalesce(t.cid, o.cid) AS cid FROM ours o FULL JOIN theirs t ON o.id = t.id")
def strategy_union(spark, sf_dir):
    _, ours, theirs = sides(spark, sf_dir)
    return versions.union_by_strategy(ours, theirs, "theirs")


MERGE = f"""{BASE}, {OURS}, {THEIRS}, ids AS (SELECT id FROM base UNION SELECT id FROM ours UNION SELECT id FROM theirs),
    m AS (SELECT ids.id, b.cid AS b, o.cid AS o, t.cid AS t, CASE WHEN o.cid IS NOT DISTINCT FROM t.cid THEN CASE WHEN o.cid IS NOT DISTINCT FROM b.cid THEN 'same' ELSE 'both' END WHEN t.cid IS NOT DISTINCT FROM b.cid THEN 'ours'
        WHEN o.cid IS NOT DISTINCT FROM b.cid THEN 'theirs' WHEN o.cid IS NULL OR t.cid IS NULL THEN 'delete-modify' ELSE 'divergent' END AS outcome FROM ids LEFT JOIN base b USING (id) LEFT JOIN ours o USING (id) LEFT JOIN theirs t USING (id))"""


@query(f"WITH {MERGE} SELECT id, outcome, CASE WHEN outcome IN ('same', 'both', 'ours') THEN o WHEN outcome = 'theirs' THEN t ELSE greatest(o, t) END AS cid FROM m")
def three_way_merge(spark, sf_dir):
    return versions.three_way(*sides(spark, sf_dir)).select("id", "outcome", "cid")


@query(f"WITH {MERGE} SELECT outcome, count(*) AS n FROM m GROUP BY outcome")
def conflict_counts(spark, sf_dir):
    return versions.conflict_counts(versions.three_way(*sides(spark, sf_dir)))


@query(f"WITH {MERGE}, s AS (SELECT id, CASE WHEN outcome IN ('same', 'both', 'ours') THEN o WHEN outcome = 'theirs' THEN t WHEN id % 2 = 0 THEN o ELSE t END AS cid FROM m) SELECT id, cid FROM s WHERE cid IS NOT NULL")
def merge_with_picks(spark, sf_dir):
    m = versions.three_way(*sides(spark, sf_dir))
    return versions.settled(m, picks=m.select("id", F.when(F.col("id") % 2 == 0, "ours").otherwise("theirs").alias("side")))


@query(f"WITH {BASE}, {OURS}, {THEIRS}, d AS (SELECT coalesce(base.id, ours.id) AS id, base.cid AS back, ours.cid AS was FROM base FULL JOIN ours ON base.id = ours.id WHERE base.cid IS DISTINCT FROM ours.cid), r AS (SELECT coalesce(t.id, d.id) AS id, CASE WHEN d.id IS NULL OR t.cid IS DISTINCT FROM d.was THEN t.cid ELSE d.back END AS cid FROM theirs t FULL JOIN d ON d.id = t.id) SELECT id, cid FROM r WHERE cid IS NOT NULL")
def revert(spark, sf_dir):
    base, ours, theirs = sides(spark, sf_dir)
    return versions.reverted(theirs, base, ours)


@query(f"WITH {BASE}, a AS (SELECT p_partkey AS id, 'new' AS cid FROM part WHERE p_partkey % 9 = 1) SELECT id, cid FROM base WHERE id % 4 <> 2 AND id NOT IN (SELECT id FROM a) UNION ALL SELECT id, cid FROM a")
def commit_snapshot(spark, sf_dir):
    base, _, _ = sides(spark, sf_dir)
    added = read(spark, sf_dir, "part").where("p_partkey % 9 = 1").select(F.col("p_partkey").alias("id"), F.lit("new").alias("cid"))
    return versions.committed(base, added, base.where("id % 4 = 2").select("id"))


def commit_name(k):
    return F.concat(F.lit("k"), F.lpad(k.cast("string"), 9, "0"))


def commit_table(spark, sf_dir) -> DataFrame:
    """A history over the parts: each commit's parent is the one before it; every fifth has a second parent ten back."""
    k = F.col("p_partkey") + 1
    parents = F.when(k <= 1, F.array().cast("array<string>")).when((k % 5 == 0) & (k > 10), F.array(commit_name(k - 1), commit_name(k - 10))).otherwise(F.array(commit_name(k - 1)))
    return read(spark, sf_dir, "part").select(commit_name(k).alias("cid"), parents.alias("parents"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("author"), (k * 1000).alias("time"), F.col("p_name").alias("message"))


def fork_table(spark, sf_dir) -> DataFrame:
    """A history of two branches that part at the third commit: odd numbers on one, even ones on the other."""
    k = F.col("p_partkey") + 1
    parents = F.when(k <= 1, F.array().cast("array<string>")).when(k <= 3, F.array(commit_name(k - 1))).when(k <= 5, F.array(commit_name(F.lit(3)))).otherwise(F.array(commit_name(k - 2)))
    return read(spark, sf_dir, "part").select(commit_name(k).alias("cid"), parents.alias("parents"))


def last_commit(commits: DataFrame) -> str:
    return commits.agg(F.max("cid")).first()[0]


CID = "'k' || lpad(({})::VARCHAR, 9, '0')"
TOP = "(SELECT max(p_partkey) + 1 FROM part)"


@query(f"SELECT {TOP} - p_partkey - 1 AS depth, {CID.format('p_partkey + 1')} AS cid, 'a' || ((p_partkey + 1) % 3) AS author, p_name AS message FROM part ORDER BY p_partkey DESC LIMIT 10")
def log_first_parents(spark, sf_dir):
    t = commit_table(spark, sf_dir)
    return versions.log(t, last_commit(t), 10).select(F.col("depth").cast("long").alias("depth"), "cid", "author", "message")


# each row of the recursion holds the depths of the ten commits after its own
DEPTHS = f"""up(k, last) AS (SELECT {TOP}, [0] UNION ALL
        SELECT k - 1, list_prepend(CASE WHEN len(last) >= 10 AND (k + 9) % 5 = 0 AND k + 9 > 10 THEN least(last[1], last[10]) ELSE last[1] END + 1, last)[1:10] FROM up WHERE k > 1)"""


@query(f"WITH RECURSIVE {DEPTHS} SELECT {CID.format('k')} AS cid, last[1]::INT AS depth FROM up")
def ancestor_closure(spark, sf_dir):
    t = commit_table(spark, sf_dir)
    head = t.agg(F.max("cid").alias("cid")).select(F.col("cid").alias("head"), "cid")
    return versions.ancestors(t, head).select("cid", "depth")


FORK = "CASE WHEN k <= 1 THEN NULL WHEN k <= 3 THEN k - 1 WHEN k <= 5 THEN 3 ELSE k - 2 END"


@query(f"""WITH RECURSIVE a(k) AS (SELECT {TOP} UNION ALL SELECT {FORK} FROM a WHERE k > 1), b(k) AS (SELECT {TOP} - 1 UNION ALL SELECT {FORK} FROM b WHERE k > 1)
    SELECT {CID.format('max(k)')} AS cid FROM a JOIN b USING (k)""")
def lowest_common_ancestor(spark, sf_dir):
    t = fork_table(spark, sf_dir)
    heads = [r[0] for r in t.orderBy(F.col("cid").desc()).select("cid").limit(2).collect()]
    return versions.lowest_common_ancestor(t, heads)


@query(f"""WITH RECURSIVE {DEPTHS}, v AS (SELECT p_partkey AS id, 1 + p_partkey * 7 % ({TOP} - 3) + j AS k FROM part, range(4) r(j))
    SELECT id, {CID.format('k')} AS cid FROM v JOIN up USING (k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY last[1] DESC, k) = 1""")
def blame(spark, sf_dir):
    t = commit_table(spark, sf_dir)
    reach = versions.ancestors(t, t.agg(F.max("cid").alias("cid")).select(F.col("cid").alias("head"), "cid"))
    # an edge is in the version that made it and in the three after that
    part = read(spark, sf_dir, "part")
    made = F.col("p_partkey") * 7 % (F.col("top") - 3) + 1
    held = part.crossJoin(part.agg((F.max("p_partkey") + 1).alias("top"))).select(F.col("p_partkey").alias("id"), F.explode(F.sequence(made, made + 3)).alias("k"))
    return versions.blame(reach, held.select("id", commit_name(F.col("k")).alias("commit")))


@query(f"SELECT {CID.format('p_partkey + 1')} AS cid FROM part WHERE p_partkey + 1 > {TOP} * 4 // 5")
def unreachable_blocks(spark, sf_dir):
    t = commit_table(spark, sf_dir)
    links = t.select("cid", F.explode("parents").alias("parent"))
    roots = read(spark, sf_dir, "part").agg(commit_name(F.floor((F.max("p_partkey") + 1) * 4 / 5)).alias("cid"))
    return versions.unreachable(t, links, roots)


@query("SELECT sha256(text) AS cid FROM documents WHERE doc_id % 50 = 7 AND text IS NOT NULL")
def corrupt_blocks(spark, sf_dir):
    """Blocks of all documents, some of them with one more character than their hash is of."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return versions.corrupt(d.select(F.sha2("text", 256).alias("cid"), F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content")))


@query("""WITH u AS (SELECT s_name AS name, 't' || (s_suppkey % 4) AS target, 1 - 2 AS sign FROM supplier UNION ALL SELECT s_name, 't' || (s_suppkey % 4 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END), 1 FROM supplier
        UNION ALL SELECT s_name, 't' || (s_suppkey % 4 + CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END), 1 FROM supplier), l AS (SELECT name, target FROM u GROUP BY ALL HAVING sum(sign) > 0)
    SELECT name, string_agg(target, ',' ORDER BY target) AS targets, CASE WHEN count(*) > 1 THEN 'conflicted' ELSE 'normal' END AS kind FROM l GROUP BY name""")
def ref_merge(spark, sf_dir):
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    at = lambda more: s.select(F.col("s_name").alias("name"), F.concat(F.lit("t"), (k % 4 + more).cast("string")).alias("target"))
    return versions.merged_refs(at(F.lit(0)), [at(F.when(k % 3 == 0, 1).otherwise(0)), at(F.when(k % 5 == 0, 2).otherwise(0))])


@query("SELECT n_name AS name, 'k' || n_nationkey AS target FROM nation WHERE n_regionkey = 1")
def branch_list(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    refs = n.select(F.concat(F.when(F.col("n_regionkey") == 1, "refs/heads/").otherwise("refs/tags/"), "n_name").alias("name"), F.concat(F.lit("k"), "n_nationkey").alias("target"))
    return versions.refs_named(refs, "refs/heads/")


@query(f"WITH {NODES} SELECT 'Part' AS ntype, 'p_brand' AS prop, b.v AS value, coalesce(m.id, 'new:' || substr(sha256('Part' || chr(10) || 'p_brand' || chr(10) || b.v), 1, 32)) AS id, m.id IS NULL AS created FROM (SELECT DISTINCT 's:' || p_brand AS v FROM part UNION SELECT 's:Brand#none') b LEFT JOIN (SELECT 's:' || p_brand AS v, max({nid('Part', 'p_partkey')}) AS id FROM part GROUP BY p_brand) m ON m.v = b.v")
def resolve_or_create(spark, sf_dir):
    g = graph(spark, sf_dir, "Part")
    wanted = read(spark, sf_dir, "part").select(F.concat(F.lit("s:"), "p_brand").alias("value")).distinct().unionByName(spark.createDataFrame([("s:Brand#none",)], "value string"))
    return versions.resolved_or_created(wanted.select(F.lit("Part").alias("ntype"), F.lit("p_brand").alias("prop"), "value"), g.nodes)


@query("SELECT c_custkey AS cid, c_nationkey AS key FROM customer WHERE c_custkey > 40 * (1 + c_nationkey)")
def revoked_signatures(spark, sf_dir):
    signed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("time"))
    revocations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), (40 * (1 + F.col("n_nationkey"))).alias("revoked_at"))
    return versions.revoked(signed, revocations).select("cid", "key")


# --- chunks and extraction ------------------------------------------------------------------------------------

MESSAGES = "msgs AS (SELECT conv_id::VARCHAR AS doc, turn::INT AS idx, '[' || role || ']' AS heading, text FROM conversations WHERE trim(text) <> '')"


@query("SELECT doc_id::VARCHAR AS doc, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS idx, trim(part, ' ' || chr(10)) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM documents) WHERE trim(part, ' ' || chr(10)) <> ''")
def chunk_paragraph(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("depth"), "text")
    return chunk.chunk_paragraph(d).select("doc", "idx", "text")


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, (greatest(0, ceil((len(w) - 256) / 224.0)) * 224 + 1)::BIGINT, 224)) AS a FROM t WHERE len(w) > 0)
    SELECT doc_id::VARCHAR AS doc, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS idx, array_to_string(w[a + 1:a + 256], ' ') AS text, len(w[a + 1:a + 256])::INT AS tokens FROM s""")
def chunk_recursive(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("depth"), "text")
    return chunk.chunk_recursive(d).select("doc", "idx", "text", "tokens")


@query(f"""WITH RECURSIVE {MESSAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k, heading = '[user]' AS u FROM msgs),
    fold(doc, k, g, n, other) AS (SELECT doc, k, 0, 1, NOT u FROM o WHERE k = 1 UNION ALL
        SELECT o.doc, o.k, CASE WHEN (u AND other) OR n >= 3 THEN g + 1 ELSE g END, CASE WHEN (u AND other) OR n >= 3 THEN 1 ELSE n + 1 END, CASE WHEN (u AND other) OR n >= 3 THEN NOT u ELSE other OR NOT u END FROM fold JOIN o ON o.doc = fold.doc AND o.k = fold.k + 1)
    SELECT fold.doc, g AS idx, string_agg(heading || chr(10) || text, chr(10) || chr(10) ORDER BY o.k) AS text, count(*) AS messages FROM fold JOIN o ON o.doc = fold.doc AND o.k = fold.k GROUP BY ALL""")
def chunk_session(spark, sf_dir):
    t = chunk.chunk_session(readers.message_table(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), 3)
    return t.select("doc", "idx", "text", "messages")


#: Sentences with their tokens added up, then one chunk after another: as many sentences as fit, the next from where at most 32 tokens repeat.
SENTENCES_SQL = """WITH RECURSIVE parts AS (SELECT doc_id AS doc, list_filter(list_transform(
        regexp_extract_all(text, '[^.!?…]*[.!?…]+["'')\\]]*\\s*|[^.!?…]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
    sized AS (SELECT doc, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[:i], lambda x: len(regexp_extract_all(x, '\\S+')))), 0)) AS c FROM parts WHERE len(s) > 0),
    walk AS (SELECT doc, 0 AS idx, 1 AS a, greatest(2, len(list_filter(c, lambda v: v <= 256))) AS b, s, c FROM sized
        UNION ALL SELECT doc, idx + 1, a2, greatest(a2 + 1, len(list_filter(c, lambda v: v <= c[a2] + 256))), s, c FROM (
            SELECT *, list_min(list_filter(range(a + 1, b + 1), lambda k: c[b] - c[k] <= 32)) AS a2 FROM walk WHERE b <= len(s)))
    SELECT doc::VARCHAR AS doc, idx, array_to_string(s[a:b - 1], ' ') AS text, len(regexp_extract_all(array_to_string(s[a:b - 1], ' '), '\\S+')) AS tokens FROM walk"""


@query(SENTENCES_SQL)
def chunk_sentences(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("depth"), "text")
    return chunk.chunk_sentences(d).select("doc", "idx", "text", "tokens")


def entities_sql(source: str) -> str:
    """Names in the relation `source` of (doc, text): runs of capitalised words, cut out with what stands between them."""
    run = "[A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*)*"
    not_first, suffixes = ("[" + ", ".join(f"'{w}'" for w in sorted(x)) + "]" for x in (extract.NOT_FIRST, extract.ORG_SUFFIXES))
    return f"""runs AS (SELECT doc, regexp_extract_all(text, '{run}') AS c, string_split_regex(text, '{run}') AS g FROM {source}),
    placed AS (SELECT *, string_split(c, ' ') AS w, sum(strlen(g) + strlen(c)) OVER r - strlen(c) AS byte0, sum(length(g) + length(c)) OVER r - length(c) AS char0
        FROM (SELECT doc, unnest(c) AS c, unnest(g[1:len(c)]) AS g, generate_subscripts(c, 1) AS i FROM runs) WINDOW r AS (PARTITION BY doc ORDER BY i)),
    begun AS (SELECT *, list_position(list_transform(w, lambda x: NOT list_contains({not_first}, x)), true) AS j FROM placed),
    cuts AS (SELECT doc, byte0, char0, list_slice(w, j, len(w)) AS w, coalesce(list_sum(list_transform(list_slice(w, 1, j - 1), lambda x: length(x) + 1)), 0) AS skip FROM begun WHERE j > 0 AND len(w) > j),
    entities AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY byte0) - 1 AS ordinal, CASE WHEN list_has_any(w, {suffixes}) THEN 'Entity:Organization' ELSE 'Entity:Person' END AS kind,
        array_to_string(w, ' ') AS text, (byte0 + skip)::BIGINT AS "start", (byte0 + skip + length(array_to_string(w, ' ')))::BIGINT AS "end", (char0 + skip)::BIGINT AS cstart, (char0 + skip + length(array_to_string(w, ' ')))::BIGINT AS cend FROM cuts)"""


def relations_sql(source: str) -> str:
    """After entities_sql(source): each two names of a text with at most six words between them."""
    return f"""between AS (SELECT a.doc, a.ordinal AS subject, b.ordinal AS object, substr(t.text, a.cend + 1, b.cstart - a.cend) AS x
        FROM entities a JOIN entities b ON a.doc = b.doc AND a.ordinal < b.ordinal JOIN {source} t ON t.doc = a.doc),
    relations AS (SELECT doc, subject, object, CASE WHEN verb THEN 'acts_on' ELSE 'co_occurs_with' END AS kind, CASE WHEN verb THEN 0.5 ELSE 0.4 END AS confidence
        FROM (SELECT *, regexp_matches(x, '(?i)\\b(?:{extract.VERBS})\\b') AS verb FROM between WHERE len(regexp_extract_all(x, '[^ \\t\\n\\x0B\\f\\r]+')) <= 6))"""


DOC_TEXTS = "texts AS (SELECT doc_id AS doc, text FROM documents)"


@query(f'WITH {DOC_TEXTS}, {entities_sql("texts")} SELECT doc, ordinal, kind, text, "start", "end", 0.6::DOUBLE AS confidence FROM entities')
def rule_entities(spark, sf_dir):
    return extract.entities(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f'WITH {DOC_TEXTS}, {entities_sql("texts")}, {relations_sql("texts")} SELECT doc, subject, object, kind, confidence::DOUBLE AS confidence FROM relations')
def rule_relations(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return extract.relations(extract.entities(texts), texts)


@query(f'WITH {DOC_TEXTS}, {entities_sql("texts")} SELECT doc, kind, lower(trim(text)) AS name, arg_min(text, ordinal) AS text, count(*) AS mentions FROM entities GROUP BY 1, 2, 3')
def canonical_entities(spark, sf_dir):
    return extract.canonical_entities(extract.entities(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS doc, list_filter(string_split(lower(trim(regexp_replace(text, '[^\\pL\\pN_'']+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM conversations),
    stop AS (SELECT [%s] AS stop),
    g AS (SELECT doc, unnest(list_transform(range(1, len(w) + 2 - n), lambda i: w[i:i + n - 1])) AS g FROM t, (SELECT unnest([1, 2, 3]) AS n))
    SELECT doc, array_to_string(g, ' ') AS gram, count(*) AS n FROM g, stop WHERE NOT list_contains(stop, g[1]) AND NOT list_contains(stop, g[-1]) GROUP BY ALL""" % ", ".join(f"'{w}'" for w in fn.STOPWORDS))
def keyword_ngrams(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return extract.ngrams(c)


@query()
def keywords(spark, sf_dir):
    c = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), "text")
    return extract.keywords(c, extract.hashed_embedding(), 5).select("doc", "gram", "place", r6("score").alias("score"))


def sections_sql(source: str) -> str:
    """Sections of the relation `source` of (doc, text): lines numbered, each heading begins one. For texts without fenced code."""
    head = " {0,3}(#{1,6})(?:[ \\t]+(.*?))??(?:[ \\t]+#+)?[ \\t]*"
    return f"""lines AS (SELECT doc, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc, string_split(text, chr(10)) AS l FROM {source})),
    marked AS (SELECT *, regexp_full_match(line, '{head}') AS h FROM lines), numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc ORDER BY i) AS part FROM marked),
    joined AS (SELECT doc, part, max(line) FILTER (h) AS head, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), ''), '^\\n+|\\s+$', '', 'g') AS text FROM numbered GROUP BY doc, part),
    sections AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS idx, trim(regexp_extract(head, '^{head}$', 2)) AS heading, coalesce(length(regexp_extract(head, '^{head}$', 1)), 0) AS depth, text
        FROM joined WHERE head IS NOT NULL OR trim(text) <> '')"""


@query(f"""WITH marked_up AS (SELECT doc_id AS doc, '# Doc' || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10)) AS text FROM documents), {sections_sql("marked_up")}
    SELECT doc::VARCHAR AS doc, idx, heading, depth, length(text) AS length FROM sections""")
def markdown_sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("# Doc\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n"))).alias("text"))
    return readers.markdown(d).select("doc", "idx", "heading", "depth", F.length("text").alias("length"))


#: Fixed value: the pattern of a heading line in plain text, for SQL; readers.is_heading says it in words.
HEADING_PATTERN = r"(?:(?:ARTICLE|CHAPTER|PART)\s+(?:[IVXLCDM]{1,8}|\d+)|(?:SECTION|Section)\s+\d+(?:\.\d+)*|[IVXLCDM]{1,5}\.\s+[A-Z]|[A-Z][A-Z &\-/]{2,}[A-Z])"


@query(f"""WITH {DOC_TEXTS}, lines AS (SELECT doc, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc, string_split(text, chr(10)) AS l FROM texts)),
    marked AS (SELECT *, regexp_full_match(line, '[ \\t]*{HEADING_PATTERN}[ \\t]*[:.]?[ \\t]*'.replace('\\s', '[ \\t]')) AS h FROM lines),
    headed AS (SELECT *, h AND sum(h::INT) OVER (PARTITION BY doc) >= 2 AS head FROM marked), numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY i) AS part FROM headed),
    sections AS (SELECT doc, part, list_filter(regexp_split_to_array(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '\\s+'), lambda x: x <> '') AS w FROM numbered GROUP BY doc, part),
    cut AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(w) - 256) / 224.0)) * 224 + 1)::BIGINT, 224)) AS a FROM sections WHERE len(w) > 0),
    chunks AS (SELECT doc AS of, doc::VARCHAR || ':' || part || ':' || a AS doc, array_to_string(w[a + 1:a + 256], ' ') AS text FROM cut),
    {entities_sql("chunks")}, {relations_sql("chunks")}, named AS (SELECT of, e.doc, ordinal, (of, kind, lower(e.text)) AS entity FROM entities e JOIN chunks USING (doc))
    SELECT 'chunk_of' AS etype, count(*) AS n FROM chunks HAVING count(*) > 0 UNION ALL SELECT 'chunk_mentions', count(DISTINCT (doc, entity)) FROM named HAVING count(*) > 0
    UNION ALL SELECT r.kind, count(DISTINCT (a.entity, b.entity)) FROM relations r JOIN named a ON a.doc = r.doc AND a.ordinal = r.subject JOIN named b ON b.doc = r.doc AND b.ordinal = r.object WHERE a.entity <> b.entity GROUP BY r.kind""")
def ingest_edges(spark, sf_dir):
    out = readers.ingest(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "text")
    return out["edges"].groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id::VARCHAR AS doc, '[' || role || ']' AS heading, text FROM conversations WHERE trim(text) <> ''")
def conversation_source(spark, sf_dir):
    """Chat exports as they would be uploaded, read back as sections."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    raw = c.select(F.col("conv_id").alias("doc"), F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("m").alias("conversation")))).otherwise(F.to_json("m")).alias("text"))
    return readers.conversations(raw).select("doc", "heading", "text")


# --- scalar functions -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, (ceil(len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4.0) + ceil(len(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / 1.5))::BIGINT AS tokens,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, CASE WHEN len(text) > 80 THEN substr(text, 1, 80) || ' <...+' || (len(text) - 80) || ' chars>' ELSE text END AS clipped,
    lower(trim(text)) AS canonical, sha256(text) AS hash, substr(sha256(source), 1, 16) AS fingerprint, regexp_matches(text, '[0-9]') AS digit FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", fn.token_estimate(t).alias("tokens"), fn.token_count(t).cast("long").alias("words"), fn.clip_text(t, 80).alias("clipped"), fn.canonical(t).alias("canonical"), fn.content_hash(t).alias("hash"),
        fn.author_fingerprint(F.col("source")).alias("fingerprint"), fn.has_digit(t).alias("digit"),
    )


@query(f"""WITH {VECTORS}, {FIRST} SELECT id, round(list_dot_product(v, q), 6) AS dot, round(list_cosine_similarity(v, q), 6) AS cosine, round(sqrt(list_dot_product(v, v)), 6) AS norm,
    round(1 / (1 + list_distance(v, q)), 6) AS l2, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS unit_sum FROM vecs, first""")
def vector_functions(spark, sf_dir):
    v = F.transform("vector", lambda x: x.cast("double"))
    one = F.array(*[F.lit(x) for x in first_vector(spark, sf_dir)])
    return graph(spark, sf_dir).embeddings.select(
        F.col("node_id").alias("id"), r6(fn.dot(v, one)).alias("dot"), r6(fn.cosine(v, one)).alias("cosine"), r6(fn.norm(v)).alias("norm"), r6(fn.similarity(v, one, "l2")).alias("l2"),
        r6(F.aggregate(fn.l2_normalise(v), F.lit(0.0), lambda s, x: s + x)).alias("unit_sum"),
    )


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda x: x <> '')) AS w FROM benchmark), f AS (SELECT w AS q FROM t WHERE item_id = (SELECT min(item_id) FROM t))
    SELECT item_id, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q)))::DOUBLE, 6) AS jaccard FROM t, f""")
def jaccard_scores(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", fn.word_set(F.lower("text")).alias("w"))
    one = b.orderBy("item_id").limit(1).select(F.col("w").alias("q"))
    return b.crossJoin(F.broadcast(one)).select("item_id", r6(fn.jaccard(F.col("w"), F.col("q"))).alias("jaccard"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def rfc3339(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", fn.micros_to_rfc3339(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"))


@query("""SELECT doc_id, round(0.25 + 0.3 * len(list_intersect(q, w)) / len(q) + CASE WHEN d THEN 0.10 ELSE 0 END, 6) AS score FROM (
    SELECT doc_id, list_distinct(regexp_extract_all(lower('When was the license of the software released'), '[\\pL\\pN_]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS w,
        (strpos(lower(text), '20') > 0 AND regexp_full_match(substr(lower(text), strpos(lower(text), '20') + 2, 2), '[0-9][0-9]')) OR regexp_matches(lower(text), '[0-9]/+[0-9]') OR regexp_matches(lower(text), 'jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') AS d FROM documents)""")
def lexical_boost(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", r6(evaluate.lexical_boost(F.lit(0.25), F.lit("When was the license of the software released"), F.col("text"))).alias("score"))


# --- evaluation -----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS qid, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
    h AS (SELECT c_mktsegment AS qtype, max(CASE WHEN item = '1-URGENT' AND k <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN item = '1-URGENT' AND k <= 5 THEN 1 ELSE 0 END) AS h5 FROM customer JOIN r ON qid = c_custkey GROUP BY c_custkey, c_mktsegment)
    SELECT coalesce(qtype, 'all') AS qtype, count(*) AS questions, round(avg(h1), 6) AS hit_at_1, round(avg(h5), 6) AS hit_at_5 FROM h GROUP BY ROLLUP (qtype)""")
def hit_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey", "o_orderpriority"))).alias("r"))
    t = read(spark, sf_dir, "customer").join(o, F.col("qid") == F.col("c_custkey")).select("qid", F.col("c_mktsegment").alias("qtype"), F.transform("r", lambda x: x["o_orderpriority"]).alias("ranked"), F.array(F.lit("1-URGENT")).alias("gold"))
    return evaluate.report(t, (1, 5)).select("qtype", "questions", r6("hit_at_1").alias("hit_at_1"), r6("hit_at_5").alias("hit_at_5"))


@query("SELECT qid, session, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session)::INT AS place FROM (SELECT l_returnflag AS qid, l_suppkey % 10 AS session, max(l_quantity) AS score FROM lineitem GROUP BY ALL)")
def session_scores(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    hits = li.select(F.col("l_returnflag").alias("qid"), F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("score"))
    sessions = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("session"))
    return evaluate.by_session(hits, sessions)


@query("SELECT o_custkey AS qid, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY k)::INT AS place FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL)")
def first_occurrences(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("item"), "o_orderkey")
    return evaluate.first_occurrences(o, "qid", "item", "o_orderkey").select("qid", "item", "place")


@query("""WITH e AS (SELECT conv_id AS qid, turn AS eid, lower(substr(text, 1, 40)) AS e FROM conversations WHERE turn % 2 = 0), t AS (SELECT conv_id AS qid, lower(text) AS t FROM conversations WHERE turn < 3),
    o AS (SELECT e.qid, e.eid, max(CASE WHEN contains(t, e) OR contains(e, t) THEN 1 ELSE 0 END) AS ok FROM e LEFT JOIN t ON e.qid = t.qid GROUP BY ALL)
    SELECT qid, sum(ok)::BIGINT AS found, count(*) AS of, round(avg(ok), 6) AS recall FROM o GROUP BY qid""")
def evidence_recall(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    e = c.where("turn % 2 = 0").select(F.col("conv_id").alias("qid"), F.col("turn").alias("eid"), F.substring("text", 1, 40).alias("evidence"))
    return evaluate.evidence_found(c.where("turn < 3").select(F.col("conv_id").alias("qid"), "text"), e).select("qid", "found", "of", r6("recall").alias("recall"))


# --- retrieval ------------------------------------------------------------------------------------------------


def vector_graph(spark, sf_dir) -> Graph:
    g = graph(spark, sf_dir, "Nation")
    nodes = g.embeddings.select(F.col("node_id").alias("id"), F.when(F.col("vec_label") % 2 == 0, "Even").otherwise("Odd").alias("ntype"), F.concat(F.lit("vector of "), "vec_label").alias("summary"), F.create_map(F.lit("label"), F.concat(F.lit("i:"), "vec_label")).alias("props"), F.lit(None).cast("bigint").alias("created_at"))
    chain = g.embeddings.select("node_id", F.substring("node_id", 5, 10).cast("long").alias("k"))
    links = chain.select(F.concat(F.lit("next:"), "k").alias("id"), F.lit("next").alias("etype"), F.col("node_id").alias("src"), node_id("Vec", F.col("k") + 1).alias("dst"))
    gone = nodes.where("substring(id, -4) % 17 = 0").select(F.col("id").alias("node_id"))
    return Graph(nodes, links, g.embeddings, None, gone)


@query(f"WITH {VECTORS}, {FIRST}, lane AS (SELECT id, vec_label, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 64) SELECT id, round(score, 6) AS score FROM lane WHERE vec_label % 2 = 0 AND NOT {GONE}")
def filter_after_top_k(spark, sf_dir):
    t = Retriever(vector_graph(spark, sf_dir), label="Even", vector_cap=64).vector(first_vector(spark, sf_dir)).candidates()
    return t.select("id", r6("score").alias("score"))


@query(f"WITH {VECTORS} SELECT id, 1.0::DOUBLE AS score FROM vecs WHERE vec_label = 3 AND NOT {GONE}")
def retrieve_without_ranker(spark, sf_dir):
    return Retriever(vector_graph(spark, sf_dir), prop=("label", 3)).candidates().select("id", "score")


RETRIEVE = f"""{VECTORS}, {FIRST}, lane AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 30), seeds AS (SELECT * FROM lane WHERE NOT {GONE}),
    hop AS (SELECT 'vec:' || lpad((substr(id, 5)::BIGINT + 1)::VARCHAR, 10, '0') AS id, score * 0.7 AS score FROM seeds), grown AS (SELECT * FROM hop WHERE id NOT IN (SELECT id FROM seeds) ORDER BY score DESC, id LIMIT 20),
    found AS (SELECT * FROM seeds UNION ALL SELECT * FROM grown WHERE NOT {GONE} AND id IN (SELECT id FROM vecs)),
    item AS (SELECT f.id, score, row_number() OVER (ORDER BY score DESC, f.id) AS k, ceil(len('ntype: ' || CASE WHEN vec_label % 2 = 0 THEN 'Even' ELSE 'Odd' END || '#id: ' || f.id || '#summary: vector of ' || vec_label || '#label: ' || vec_label || '#') / 4.0)::BIGINT AS tokens FROM found f JOIN vecs USING (id))"""


@query(f"""WITH RECURSIVE {RETRIEVE}, fold(k, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, []::VARCHAR[] UNION ALL
        SELECT item.k, CASE WHEN used + tokens <= 400 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 400 THEN list_append(kept, id) ELSE kept END FROM fold JOIN item ON item.k = fold.k + 1),
    done AS (SELECT * FROM fold WHERE k = (SELECT max(k) FROM item)) SELECT x.id, round(item.score, 6) AS score, used AS tokens_used FROM (SELECT unnest(kept) AS id, used FROM done) x JOIN item ON item.id = x.id""")
def hybrid_retrieve(spark, sf_dir):
    r = Retriever(vector_graph(spark, sf_dir), vector_cap=30, expansion=GraphExpand(), budget=400).vector(first_vector(spark, sf_dir))
    return r.items().select("id", r6("score").alias("score"), "tokens_used")


@query(f"""WITH {VECTORS}, {FIRST}, last AS (SELECT arg_max(v, id) AS q FROM vecs), a AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, first ORDER BY score DESC, id LIMIT 256), b AS (SELECT id, list_cosine_similarity(v, q) AS score FROM vecs, last ORDER BY score DESC, id LIMIT 256),
    a30 AS (SELECT * FROM a WHERE NOT {GONE} ORDER BY score DESC, id LIMIT 30), b30 AS (SELECT * FROM b WHERE NOT {GONE} ORDER BY score DESC, id LIMIT 30),
    u AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM a30 UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM b30), f AS (SELECT id, sum(s)::DOUBLE AS score FROM u GROUP BY id)
    SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10""")
def multi_query_fusion(spark, sf_dir):
    g = vector_graph(spark, sf_dir)
    last = [float(x) for x in read(spark, sf_dir, "embeddings").orderBy(F.col("vec_id").desc()).select("embedding").first()[0]]
    return multi_query([Retriever(g).vector(first_vector(spark, sf_dir)), Retriever(g).vector(last)], 10).select("id", r6("score").alias("score"))


@query(f"WITH {DENSE} SELECT id, 'vector' AS lane FROM dense ORDER BY score DESC, id LIMIT 20")
def lane_diagnostics(spark, sf_dir):
    t = Retriever(vector_graph(spark, sf_dir), vector_cap=20).vector(first_vector(spark, sf_dir)).lane_scores()
    return t.select("id", F.substring_index(F.element_at("lanes", 1), ":", 1).alias("lane"))


# --- windows over time ----------------------------------------------------------------------------------------


@query("SELECT user_id, time_bucket(INTERVAL 60 SECONDS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, least(count(*), 2) AS admitted FROM events GROUP BY ALL")
def author_rate_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    return state.rate_windows(e, "user_id", "ts", 60, 2)


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def arrival_storm(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.storm(e, "ts", 3600, "event_type").select("event_id", "recent")


@query("""WITH w AS (SELECT event_id, count(*) OVER f AS n, median(value) OVER f AS m FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW))
    SELECT event_id, CASE WHEN n >= 12 THEN round(m, 6) END AS median FROM w""")
def session_median(spark, sf_dir):
    return state.rolling_median(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", r6("median").alias("median"))


@query("""WITH w AS (SELECT event_id, list_sort(list(value) OVER f) AS v FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(v[ceil(len(v) * 0.75)::INT], 6) AS p75 FROM w""")
def rolling_p75(spark, sf_dir):
    return state.rolling_p75(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").select("event_id", r6("p75").alias("p75"))


# --- typed properties, admission, further merges --------------------------------------------------------------


@query("SELECT p_size % 5 AS bucket, count(*) AS n, sum(p_size)::BIGINT AS total, min(p_brand) AS brand, 0::BIGINT AS mistyped FROM part GROUP BY p_size % 5")
def node_accessors(spark, sf_dir):
    t = graph(spark, sf_dir, "Part").nodes
    size = fn.get_int(F.col("props"), "p_size")
    return t.groupBy((size % 5).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.min(fn.get_str(F.col("props"), "p_brand")).alias("brand"), F.count(fn.get_int(F.col("props"), "p_brand")).alias("mistyped"))


@query(f"SELECT {nid('Part', 'p_partkey')} AS id, sha256('Part' || chr(10) || 'p_brand=s:' || p_brand || chr(10) || 'p_size=i:' || p_size || chr(10) || 'p_type=s:' || p_type) AS cid FROM part")
def deterministic_ids(spark, sf_dir):
    return graph(spark, sf_dir, "Part").nodes.select("id", fn.deterministic_id(F.col("ntype"), F.col("props")).alias("cid"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal / 10000 >= 0.5")
def admitted_candidates(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2 == 0).alias("opt_in"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return extract.admitted(t, True, 0.5).select("id")


@query("SELECT DISTINCT p_brand AS src, p_type AS dst, 'is' AS etype FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size <> a.p_size)")
def edge_collisions(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("is").alias("etype"), F.col("p_size").cast("string").alias("cid")).distinct()
    return versions.edge_collisions(e, e)


@query(f"WITH {MERGE} SELECT id, outcome FROM m WHERE outcome <> 'same' AND id % 5 = 0")
def tombstone_conflicts(spark, sf_dir):
    gone = read(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("node_id"))
    return versions.tombstone_conflicts(versions.three_way(*sides(spark, sf_dir)), gone)


@query(f"WITH {DENSE}, p AS (SELECT d.id, score, vec_label FROM dense d JOIN vecs USING (id)) SELECT id, round(score, 6) AS score FROM p WHERE vec_label IN (1, 3, 5)")
def multi_label_filter(spark, sf_dir):
    e = graph(spark, sf_dir).embeddings
    t = rank.dense(e, first_vector(spark, sf_dir), 50).join(e.select(F.col("node_id").alias("id"), "vec_label"), "id")
    return t.where(F.col("vec_label").isin(1, 3, 5)).select("id", r6("score").alias("score"))


@query("SELECT n_nationkey AS id, 'name' AS key, 's:' || n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', 'i:' || n_regionkey FROM nation")
def key_value_parsing(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    t = n.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.concat(F.lit("name="), "n_name"), F.concat(F.lit("region="), F.col("n_regionkey").cast("string")))).alias("kv"))
    return t.select("id", fn.parse_kv(F.col("kv")).alias("p")).select("id", "p.key", "p.value")


@query("WITH e AS (SELECT n_nationkey AS id, 1 AS kind, n_name AS v FROM nation), s AS (SELECT n_nationkey AS id, n_name || '!' AS v FROM nation WHERE n_nationkey % 3 = 0) SELECT e.id, coalesce(s.v, e.v) AS vector FROM e LEFT JOIN s USING (id)")
def embedding_upsert(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("m").alias("model"), F.col("n_name").alias("vector"))
    s = n.where("id % 3 = 0").select("id", "model", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("old").alias("vector")), F.struct(F.lit(2).alias("seq"), F.concat("vector", F.lit("!")).alias("vector")))).alias("x")).select("id", "model", "x.vector", "x.seq")
    return versions.upserted(n, s, ["id", "model"], "seq").select("id", "vector")


@query(f"SELECT {nid('Event', 'event_id')} AS id, epoch_us(ts) AS created_at, 7::BIGINT AS updated_at FROM events")
def commit_memory(spark, sf_dir):
    t = label_nodes(spark, sf_dir, "Event").withColumn("updated_at", F.lit(None).cast("bigint"))
    return versions.remembered(t, 7).select("id", "created_at", "updated_at")


from . import indexed, more  # noqa: E402, F401  register further queries
