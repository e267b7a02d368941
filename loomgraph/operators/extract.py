"""Entities, relations and keywords in texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import STOPWORDS, canonical, normalise

#: Suffixes of organisations, words that don't begin a name, verbs of a relation.
ORG_SUFFIXES = frozenset("Inc Inc. LLC Ltd Ltd. Corp Corp. Corporation Company Co Co. GmbH AG SA BV PLC".split())
NOT_FIRST = frozenset(
    "The This That These Those A An And Or But If In On At To From With By For Of As Is Was Are Were Be Been Being I We You He She It They My Our Your His Her Their Mr Mrs Ms Dr".split()
)
VERBS = "joined|founded|acquired|owns|hired|created|launched|bought|leads|runs"
RELATION_WINDOW = 6

_TOKEN = re.compile(r"[A-Z][A-Za-z.]*")


def named(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) in bytes: two or more capitalised words in a row, single spaces between them.

    A common word at the start ends the phrase before it begins; a suffix of organisations makes it one, else it is a person."""
    out, at = [], 0
    while m := _TOKEN.search(text, at):
        begin, words = m.start(), []
        while m:
            if not words and m[0] in NOT_FIRST:
                break
            words.append(m)
            m = _TOKEN.match(text, m.end() + 1) if text[m.end() : m.end() + 1] == " " else None
        if len(words) >= 2:
            end = words[-1].end()
            kind = "Entity:Organization" if any(w[0] in ORG_SUFFIXES for w in words) else "Entity:Person"
            a = len(text[:begin].encode())
            out.append((kind, text[begin:end], a, a + len(text[begin:end].encode())))
        at = words[-1].end() if words else m.end()
    return out


def entities(texts: DataFrame, ner=named, confidence: float = 0.6) -> DataFrame:
    """(doc, ordinal, kind, text, start, end, confidence) of (doc, text). ner: text -> spans; None finds nothing."""

    def run(batches):
        for t in batches:
            rows = []
            for d, x in zip(t["doc"], t["text"]):
                spans = sorted({(a, k, s, b) for k, s, a, b in (ner(x) if ner and x else [])})
                rows += [(d, i, k, s, a, b, confidence) for i, (a, k, s, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc", "ordinal", "kind", "text", "start", "end", "confidence"])

    return texts.select("doc", "text").mapInPandas(run, f"doc {texts.schema['doc'].dataType.simpleString()}, ordinal int, kind string, text string, start int, end int, confidence double")


def relations(found: DataFrame, texts: DataFrame, window: int = RELATION_WINDOW) -> DataFrame:
    """(doc, subject, object, kind, confidence): pairs of a document's entities with at most `window` words between them."""
    # no more than `window` entities fit between two that are near enough, so each is met with the next few alone
    a = found.select("doc", F.col("ordinal").alias("subject"), F.col("end").alias("from"), F.explode(F.sequence(F.col("ordinal") + 1, F.col("ordinal") + window + 1)).alias("object"))
    b = found.select("doc", F.col("ordinal").alias("object"), F.col("start").alias("to"))
    pairs = a.join(b, ["doc", "object"]).where("`from` <= `to`").join(texts.select("doc", "text"), "doc")
    between = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("from") + 1, F.col("to") - F.col("from")), "UTF-8")
    t = pairs.withColumn("between", between)
    words = F.size(F.filter(F.split("between", r"\s+"), lambda w: w != ""))
    verb = F.col("between").rlike(rf"(?i)\b(?:{VERBS})\b")
    return t.where(words <= window).select("doc", "subject", "object", F.when(verb, "acts_on").otherwise("co_occurs_with").alias("kind"), F.when(verb, 0.5).otherwise(0.4).alias("confidence"))


def canonical_entities(found: DataFrame) -> DataFrame:
    """(doc, kind, name, text, mentions): one row for each kind and canonical text of a document; the first mention's text."""
    return found.groupBy("doc", "kind", canonical(F.col("text")).alias("name")).agg(F.min_by("text", "ordinal").alias("text"), F.count(F.lit(1)).alias("mentions"))


def ngrams(texts: DataFrame, longest: int = 3) -> DataFrame:
    """(doc, gram, n): normalised 1- to longest-grams that neither begin nor end with a stopword, with their counts."""
    words = F.filter(F.split(normalise(F.regexp_replace("text", r"[^\p{L}\p{N}_']+", " ")), " "), lambda w: w != "")
    t = texts.select("doc", words.alias("w"))
    parts = []
    for n in range(1, longest + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))
        grams = F.transform(F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"))), lambda p: F.slice("w", p["i"], p["n"]))
        g = t.select("doc", F.explode(grams).alias("g"))
        parts.append(g.where(~F.element_at("g", 1).isin(STOPWORDS) & ~F.element_at("g", -1).isin(STOPWORDS)).select("doc", F.array_join("g", " ").alias("gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("n"))


def keywords(texts: DataFrame, embed, most: int = 10, penalty: float = 0.5, longest: int = 3) -> DataFrame:
    """(doc, gram, place, score): candidate n-grams by their likeness to the text, less `penalty` times that to what is picked.

    embed: a column function, text -> vector."""
    from .analytics import mmr

    from ..functions import cosine

    whole = texts.select("doc", embed(F.col("text")).alias("whole"))
    t = ngrams(texts, longest).join(whole, "doc").withColumn("vector", embed(F.col("gram")))
    scored = t.select(F.col("doc").alias("group"), F.col("gram").alias("id"), cosine(F.col("vector"), F.col("whole")).alias("score"), "vector")
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= 20 * most).drop("rank")
    return mmr(best, most, balance=None, penalty=penalty).select(F.col("group").alias("doc"), F.col("id").alias("gram"), "place", "score")


def hashed_embedding(dim: int = 32):
    """A stand-in embedder that is the same everywhere: signed counts of words by md5."""

    def embed(text):
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(slots, F.lit(0.0), lambda s, h: s + F.when(h % dim == i, F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))

    return embed


# --- admission ------------------------------------------------------------------------------------------------


def admitted(candidates: DataFrame, opted_in: bool, floor: float) -> DataFrame:
    """Candidates (opt_in, confidence, ...) that the consumer and they themselves allow, finite and at the floor or above."""
    c = F.col("confidence")
    return candidates.where(F.lit(opted_in) & F.col("opt_in") & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c >= floor))


def typed_relations(found: DataFrame, provenance: str) -> DataFrame:
    return found.select("src", "dst", "predicate", "confidence", F.lit(provenance).alias("provenance"))
