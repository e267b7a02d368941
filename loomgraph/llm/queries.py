"""The queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .jaccard import jaccard_join
from .language import identify, train, training_rows
from .line_dedup import line_dedup
from .lm import score_lm
from .mixing import mix_sources
from .packing import pack
from .pii import find_pii
from .repeats import repeated_passages
from .search import rank_items
from .vectors import embedding_dedup


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents")).drop("bucket", "chain_link")


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, train(training_rows(docs)))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join(read(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents"))


def op6_pack(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return find_pii(read(spark, sf_dir, "documents")).drop("base")


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op9_lm_score(spark, sf_dir):
    return score_lm(read(spark, sf_dir, "documents"))


def op10_repeated_passages(spark, sf_dir):
    return repeated_passages(read(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark, sf_dir):
    return fingerprints(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return rank_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_language_id, op3_line_dedup, op4_jaccard_join, op5_mix_sources, op6_pack, op7_pii, op8_embedding_dedup, op9_lm_score,
        op10_repeated_passages, op11_document_fingerprints, op12_ranked_search, op13_source_divergence,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    # The constants are line_dedup's defaults: 10 documents, 3 leading words, agreement 0.6, likeness 0.7.
    "op3_line_dedup": r"""
        WITH docs AS (SELECT doc_id, text, (doc_id, text) AS rid FROM documents),
        split AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
                  FROM (SELECT DISTINCT doc_id, rid, text FROM docs WHERE text IS NOT NULL)),
        masked AS (SELECT doc_id, rid, pos, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS own FROM split),
        lines AS (SELECT *, string_split(own, ' ') AS tokens FROM masked WHERE own <> ''),
        tree AS (SELECT *, (len(tokens), array_to_string(tokens[1:3], ' ')) AS leaf FROM lines),
        leaves AS (SELECT leaf FROM tree GROUP BY leaf HAVING count(DISTINCT rid) >= 10),
        hot AS (SELECT * FROM tree WHERE leaf IN (SELECT leaf FROM leaves)),
        words AS (SELECT leaf, place, token, count(*) AS n FROM (SELECT leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM hot) GROUP BY ALL),
        places AS (SELECT leaf, place, max({'n': n, 'token': token}) AS top, sum(n) AS total FROM words GROUP BY leaf, place),
        template AS (SELECT leaf, list(CASE WHEN top.n >= 0.6 * total AND top.token <> '<*>' THEN top.token END ORDER BY place) AS template FROM places GROUP BY leaf),
        compared AS (
            SELECT doc_id, rid, pos, own, hot.leaf, len(tokens) AS n, len(list_filter(tokens, lambda t: t = '<*>')) AS masks,
                   len(list_filter(template, lambda t: t IS NOT NULL)) AS constant,
                   len(list_filter(range(1, len(tokens) + 1), lambda i: coalesce(template[i] = tokens[i], false))) AS equal
            FROM hot JOIN template ON hot.leaf = template.leaf),
        keyed AS (SELECT doc_id, rid, pos, CASE WHEN constant + masks >= 0.7 * n AND constant > 0 AND equal >= 0.7 * constant THEN ('leaf', leaf::VARCHAR) ELSE ('own', own) END AS template FROM compared),
        often AS (SELECT template FROM keyed GROUP BY template HAVING count(DISTINCT rid) >= 10),
        gone AS (SELECT rid, list(DISTINCT pos) AS gone FROM keyed WHERE template IN (SELECT template FROM often) GROUP BY rid)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
               sha256(coalesce(CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(
                   list_transform(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE string_split(d.text, chr(10))[i] END),
                   lambda s: s IS NOT NULL), chr(10)) END, '')) AS text_sha256
        FROM docs d LEFT JOIN gone g ON d.rid = g.rid""",
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        size AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
        q AS (
            SELECT DISTINCT item_id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        occurs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM occurs GROUP BY term), size),
        lengths AS (SELECT rid, doc_id, 100 - 90 + (90 * len(terms) * n) // l AS m FROM d, size WHERE len(terms) > 0),
        scores AS (
            SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM occurs JOIN weights USING (term) JOIN lengths USING (rid) JOIN q USING (term) GROUP BY ALL),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        occurs AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM occurs GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS c FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (
            SELECT lang, source, coalesce(n, 0) AS n
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source)),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(counts.c, 0) AS c,
                   1 + (1000000000::HUGEINT * (coalesce(counts.c, 0) + 1)) // (g.n + l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v)::HUGEINT AS q
            FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
            LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
        found AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
        ranked AS (
            SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
