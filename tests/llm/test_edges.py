"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import types as T
from pyspark.sql.functions import lit as spark_lit

import corpus_pipeline
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.jaccard import jaccard_join
from loomgraph.llm.language import identify, train, training_rows
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.lm import score_lm
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.packing import pack
from loomgraph.llm.pii import find_pii
from loomgraph.llm.repeats import repeated_passages
from loomgraph.llm.vectors import embedding_dedup

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "the same text\nof two lines", "en", "a", 3), (2, "the  same\ttext of two lines", "en", None, 3), (2, "the  same\ttext of two lines", "en", None, 3),
    (3, None, "fr", "a", None), (4, "", None, "b", 0), (5, " \n\t ", "fr", "b", 3), (None, "no id here at all", "en", "c", 1), (6, LONG, "en", "c", 9), (7, LONG + " more", "de", None, 9),
    (8, "12 34 +++ ###", "de", "a", 1), (9, "é" * 5000, "fr", "a", 1), (10, "Be " * 200, "en", "a", 1), (11, "mail a.b@c.de or +49 (30) 1234-5678", "en", "b", 1),
]
# names that the operators use themselves
CLASH = ("key", "node", "n", "size", "tree", "leaf", "p", "block", "text_sha256", "keep_id", "a.b")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

OPERATORS = {
    "exact_dedup": exact_dedup, "jaccard_join": jaccard_join, "identify": lambda d: identify(d, train(training_rows(d))), "line_dedup": line_dedup, "score_lm": score_lm,
    "mix_sources": mix_sources, "pack": pack, "find_pii": find_pii,
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, df["doc_id"])
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    if name == "pack":
        assert {(r.doc_id, r.piece) for r in rows} >= {(i, 0) for i in [None, *range(1, 12)]}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeats_edges(spark, docs):
    got = repeated_passages(docs).collect()
    assert {(r.doc_id, r.match_doc_id) for r in got} == {(6, 7), (7, 6)}
    # the last words of 7 are in a stretch that is nearly one of 6
    assert all(r.start_word == 0 and r.end_word in (30_000, 30_000 + (r.doc_id == 7)) for r in got)
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)
    for name, f in OPERATORS.items():
        assert len(f(df).collect()) == 2, name
    assert repeated_passages(df).collect() == []


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stage(spark, docs, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, "")
    rows = out.collect()
    if stage != "packing":
        assert out.columns == docs.columns
        assert {r.doc_id for r in rows} - {None} <= set(range(1, 12))
    assert f(spark, docs.limit(0), "").collect() == []


def test_stage_decisions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["language"](spark, docs, "").collect()}
    assert not kept & {None, 3, 4, 5, 8} and {1, 2, 6} <= kept
    kept = sorted(r.doc_id for r in stages["exact_dedup"](spark, docs, "").collect() if r.doc_id)
    assert 2 not in kept and 1 in kept and 4 not in kept and 3 in kept
    kept = {r.doc_id for r in stages["jaccard_join"](spark, docs, "").collect()}
    assert 6 in kept and 7 not in kept
    mixed = [r.doc_id for r in stages["mixing"](spark, docs.where("doc_id in (1, 3, 9, 10, 11)"), "").collect()]
    assert all(mixed.count(i) <= 2 for i in mixed)


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (None, [1.0, 0.0]), (10, [1e-300, 0.0])]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))).collect()
    links = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got)
    near = {"0", "1", "9", "10"}
    assert [x for x in links if x[0] in near] == [("0", 3, 0, True), ("1", 3, 0, False), ("10", 3, 0, False), ("9", 3, 0, False), ("9", 3, 0, False)]
    assert all(x[1] == 0 for x in links if x[0] not in near)
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_exact_stage_keeps_one_of_equal_rows(spark):
    rows = [(1, "a b", "en", "x", 3), (1, "a  b", "en", "x", 3), (1, "other", "en", "x", 3), (2, "a b", "en", "x", 3), (3, "c", "en", "x", 1), (3, "c", "en", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", spark_lit(1))
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in out.collect()) == [(1, "a b"), (1, "other"), (3, "c")]


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Copies, near copies and rows without letters leave; what is packed is what was mixed, whole."""
    import random
    import zlib

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, own = [], [text(60) for _ in range(40)]
    for i, t in enumerate(own):
        rows.append((i, t, "en" if i % 2 else "fr", "ab"[i % 2], len(t)))
    rows += [(100 + i, "  ".join(own[i].split(" ")), "en", "a", 1) for i in range(5)]
    rows += [(200 + i, own[10 + i] + " more", "en", "b", 1) for i in range(5)]
    rows += [(300, "123 456", "en", "a", 1), (301, None, "en", "a", 1), (None, text(20), "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(40))
    words = sum(len(t.split()) for t in own)
    from tokenizers import Tokenizer

    from loomgraph.llm.packing import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    import numpy as np

    for r in out:
        ids = np.array([*tok.encode(own[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.piece, r.start, r.length) == (0, 0, len(ids)) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    taken = sum(len(own[r.doc_id].split()) for r in out)
    assert abs(taken - 1.5 * words) <= 0.1 * words  # both sources are below twice their size
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
