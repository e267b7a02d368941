"""Chunkers over sections (doc, idx, heading, depth, text): paragraphs, token windows, sentences, sessions, structure."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import token_count, whitespace_tokens

#: Section and chunk rows: (doc, idx, section_path, text, tokens)
OUT = "doc string, idx int, section_path array<string>, text string, tokens int"


def stacked(batches):
    """For mapInArrow over (doc, idx, heading, depth) sorted by doc and idx: (doc, idx, section_path). The open headings of a document
    are a stack, so each row is looked at once."""
    doc, stack = None, []
    for b in batches:
        paths = []
        for d, heading, depth in zip(b.column("doc").to_pylist(), b.column("heading").to_pylist(), b.column("depth").to_pylist()):
            if d != doc:
                doc, stack = d, []
            if heading is not None:
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, heading))
            paths.append([h for level, h in stack if level <= depth])
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("idx"), pa.array(paths, pa.list_(pa.string()))], names=["doc", "idx", "section_path"])


def section_paths(sections: DataFrame) -> DataFrame:
    """Sections with section_path: walking back, headings of ever smaller depth, outermost first.

    Paths are made of headings alone; texts meet them afterwards, and don't move where no section has a depth."""
    t = sections.select("doc", "idx", "heading", "depth", "text")
    inside = t.where("depth > 0").select("doc", "idx", "heading", "depth")
    none = F.array().cast("array<string>")
    if inside.isEmpty():
        return t.withColumn("section_path", none)
    kinds = f"doc {t.schema['doc'].dataType.simpleString()}, idx {t.schema['idx'].dataType.simpleString()}"
    paths = inside.repartition("doc").sortWithinPartitions("doc", "idx").mapInArrow(stacked, f"{kinds}, section_path array<string>")
    out = t.join(paths, ["doc", "idx"], "left")
    return out.select("doc", "idx", "heading", "depth", "text", F.coalesce("section_path", none).alias("section_path"))


def chunk_paragraph(sections: DataFrame) -> DataFrame:
    """Trimmed, non-empty parts between blank lines."""
    t = section_paths(sections).select("doc", "idx", "section_path", F.posexplode(F.split("text", "\n\n")).alias("n", "part"))
    t = t.withColumn("part", F.regexp_replace("part", r"^\s+|\s+$", "")).where("part <> ''")
    return t.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("idx", "n")) - 1).alias("idx"), "section_path", F.col("part").alias("text"), token_count(F.col("part")).alias("tokens"))


def chunk_structural(sections: DataFrame) -> DataFrame:
    return section_paths(sections).select("doc", "idx", "section_path", "text", token_count(F.col("text")).alias("tokens"))


def windows(text, most: int, overlap: int):
    """Array of arrays of whitespace tokens: windows of `most`, the last `overlap` of one beginning the next."""
    step = most - min(overlap, most - 1)
    tokens = whitespace_tokens(text)
    n = F.size(tokens)
    # a window begins as long as the one before it didn't reach the end
    last = F.greatest(F.lit(0), F.ceil((n - most) / step)).cast("int") * step
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(tokens, i + 1, most)))


def chunk_recursive(sections: DataFrame, most: int = 256, overlap: int = 32) -> DataFrame:
    """Windows of whitespace tokens, joined by single spaces."""
    t = section_paths(sections).select("doc", "idx", "section_path", F.posexplode(windows(F.col("text"), most, overlap)).alias("n", "part"))
    return t.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("idx", "n")) - 1).alias("idx"), "section_path", F.array_join("part", " ").alias("text"), F.size("part").alias("tokens"))


SENTENCE = re.compile(r"[^.!?…]*(?:[.!?…]+[\"')\]]*\s*|$)", re.S)


def sentences_of(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if s.strip()]


def packed_sentences(text: str, most: int, overlap: int) -> list[str]:
    """Whole sentences up to `most` tokens, stepping back whole sentences for the overlap; each chunk begins after the last one did."""
    parts = [(s.strip(), len(s.split())) for s in sentences_of(text)]
    out, at = [], 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + parts[end][1] <= most):
            total += parts[end][1]
            end += 1
        out.append(" ".join(s for s, _ in parts[at:end]))
        if end == len(parts):
            break
        back, kept = end, 0
        while back - 1 > at and kept + parts[back - 1][1] <= overlap:
            back -= 1
            kept += parts[back][1]
        at = back
    return out


def chunk_sentences(sections: DataFrame, most: int = 256, overlap: int = 32) -> DataFrame:
    """Chunks of whole sentences; a sentence ends at . ! ? or an ellipsis, an approximation of Unicode's rules."""

    def run(batches):
        for t in batches:
            rows = [(d, i, list(p), n, c) for d, i, p, x in zip(t["doc"], t["idx"], t["section_path"], t["text"]) for n, c in enumerate(packed_sentences(x or "", most, overlap))]
            yield pd.DataFrame(rows, columns=["doc", "idx", "section_path", "n", "text"])

    t = section_paths(sections).select("doc", "idx", "section_path", "text").mapInPandas(run, "doc string, idx int, section_path array<string>, n int, text string")
    return t.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("idx", "n")) - 1).alias("idx"), "section_path", "text", token_count(F.col("text")).alias("tokens"))


def chunk_session(sections: DataFrame, most: int = 10) -> DataFrame:
    """Messages in groups: a new one where the user speaks after somebody else, or after `most` messages. The reset at `most` makes
    it a fold over the messages of a document in their order; blank messages are left out."""
    own = sections.where(F.trim("text") != "")
    lists = own.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "heading", "text"))).alias("all"))

    def step(acc, s):
        user = F.coalesce(s["heading"] == "[user]", F.lit(False))
        new = (user & acc["other"]) | (acc["n"] >= most)
        other = F.when(new, ~user).otherwise(acc["other"] | ~user)
        group = F.when(new, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(group.alias("group"), F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), other.alias("other"), F.concat(acc["of"], F.array(group)).alias("of"))

    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("n"), F.lit(False).alias("other"), F.array().cast("array<int>").alias("of"))
    t = lists.select("doc", "all", F.aggregate("all", start, step)["of"].alias("of")).select("doc", F.explode(F.arrays_zip("all", "of")).alias("z")).select("doc", "z.all.*", F.col("z.of").alias("chunk"))
    line = F.concat(F.coalesce(F.concat("heading", F.lit("\n")), F.lit("")), "text")
    t = t.groupBy("doc", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda e: e["line"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("messages"), F.min("idx").alias("first"))
    return t.select("doc", F.col("chunk").alias("idx"), "first", "messages", "text", token_count(F.col("text")).alias("tokens"))


def sections_in_chunks(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, section, chunk): a section is in the chunks whose path ends with its heading; one without a heading is in all of its document."""
    last = F.try_element_at("section_path", F.lit(-1))
    a = sections.select("doc", F.col("idx").alias("section"), "heading")
    b = chunks.select(F.col("doc"), F.col("idx").alias("chunk"), last.alias("last"))
    named = a.where("heading is not null").join(b, [a["doc"] == b["doc"], a["heading"] == b["last"]]).select(a["doc"], "section", "chunk")
    return named.unionByName(a.where("heading is null").join(b, "doc").select("doc", "section", "chunk"))


#: What each kind of source is cut by, if nothing else is asked for.
AUTO = {"markdown": ("paragraph",), "text": ("recursive", 256, 32), "pdf": ("recursive", 512, 64), "conversation": ("session", 10), "code": ("structural",)}
CHUNKERS = {"paragraph": chunk_paragraph, "recursive": chunk_recursive, "sentence_recursive": chunk_sentences, "session": chunk_session, "structural": chunk_structural}


def chunk(sections: DataFrame, kind: str, chunker: str = "auto") -> DataFrame:
    if chunker == "auto":
        name, *args = AUTO[kind]
        return CHUNKERS[name](sections, *args)
    if chunker not in CHUNKERS:
        raise ValueError(f"unknown chunker {chunker}")
    return CHUNKERS[chunker](sections)
