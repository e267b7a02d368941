"""Document fingerprints after I-Match; DataFrame operations only.

Of each text, the distinct terms inside a band of inverse document frequency are kept, sorted and hashed over many random
parts of the lexicon. A part hashes equal in two documents only if they keep the same of its terms, so the share of equal
parts says how alike two documents are. Parts that are too dense would never agree in long documents and empty ones say
nothing in short ones, so a document uses sub-lexicons that fit its length: level L holds each term with chance 1/2^L, a
document takes the level at which some 32 to 64 of its terms are left and the next one, and two documents are compared at the
levels both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, column, slots

#: Parts of each level, and the least number of terms that a level above 0 has in a document, before the band is applied.
PARTS = 32  # by the five leading bits of a term
TERMS = 32
#: Fewer kept parts than these in either document, and the terms outside of the band count as well.
LEAST = 4
#: Terms too frequent for the band are broadcast up to this number (8 bytes each), and left to the join beyond it.
BROADCAST_TERMS = 250_000
#: Ranges of documents for each shuffle partition, in which the next document is looked up.
RANGES = 8


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text, next_rid, next_text): the rows of docs, and of each the one after it by descending id.

    After the last comes the first. Null texts are empty, null ids come last, rows of one id follow a hash of their text.
    rid is unique. Rows are dealt to ranges of ids (a frequent id's rows to ranges of hashes), and the first row of each range
    also stands at the end of the range before, so no window spans the table."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("hash", F.xxhash64("text"))
    n = RANGES * slots(spark)
    cuts = rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"] or [0]
    # The number of cuts below a place, and of those up to it, by bisection; between both lie the cuts that a frequent id fills.
    table = F.lit(cuts)
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def bisect(test) -> Column:
        span = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
            goes = (s["low"] < s["high"]) & test(F.element_at(table, F.least(mid, F.lit(len(cuts) - 1)) + 1))
            return F.struct(F.when(goes, mid + 1).otherwise(s["low"]).alias("low"), F.when(goes | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

        return F.aggregate(steps, span, step)["low"]

    place = F.col("place")
    rows = rows.withColumn("below", bisect(lambda c: c < place)).withColumn("upto", bisect(lambda c: c <= place))
    share = F.shiftright("hash", 40) + (1 << 23)  # 24 bits, in the order of the hash
    rows = rows.withColumn("range", F.col("below") + F.shiftrightunsigned(share * (F.col("upto") - F.col("below") + 1), 24).cast("int"))
    rows = rows.drop("below", "upto")
    heads = rows.groupBy("range").agg(F.min(F.struct("place", "hash")).alias("head")).collect()  # a row for each range
    order = sorted(r["range"] for r in heads)
    at = {r["range"]: r["head"] for r in heads}
    ghosts = [(at[r]["place"], at[r]["hash"], order[i - 1], r) for i, r in enumerate(order)]
    ghosts = F.broadcast(spark.createDataFrame(ghosts, "place long, hash long, stands int, own int"))
    again = rows.drop("range").join(ghosts, ["place", "hash"]).withColumnRenamed("stands", "range")
    both = rows.withColumn("own", F.lit(None).cast("int")).unionByName(again.select("doc_id", "text", "place", "hash", "range", "own"))
    both = both.withColumn("ghost", F.col("own").isNotNull())
    w = W.partitionBy("range").orderBy("ghost", "place", "hash")
    number = F.row_number().over(w)
    rid = lambda r, k: F.shiftleft(r.cast("long"), 40) + k
    out = both.select(
        rid(F.col("range"), number).alias("rid"), "doc_id", "text", "ghost", F.lead("text").over(w).alias("next_text"),
        F.when(F.lead("ghost").over(w), rid(F.lead("own").over(w), F.lit(1))).otherwise(rid(F.col("range"), number + 1)).alias("next_rid"),
    )
    return out.where("not ghost").drop("ghost")


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down, in code points) replaced by as much of the start of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _with(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def distinct_terms(text: Column) -> Column:
    """Hashes of the distinct words, lower-cased; a text without any, unless it is empty, is one term itself."""
    spaced = F.lower(text)
    for code in range(9, 14):  # a split at one character needs no pattern
        spaced = F.replace(spaced, F.lit(chr(code)), F.lit(" "))
    words = F.transform(F.split(spaced, " "), lambda t: F.xxhash64(t))
    found = F.array_distinct(F.array_remove(words, F.xxhash64(F.lit(""))))
    return _with(found, lambda f: F.when((F.size(f) == 0) & (text != ""), F.array(F.xxhash64(text))).otherwise(f))


def _sampled(df: DataFrame, terms: str, level: str) -> DataFrame:
    """The level that fits the number of terms, and the terms that this level holds."""
    df = df.withColumn(level, F.length(F.bin(F.floor(F.greatest(F.size(terms), F.lit(TERMS)) / TERMS))) - 1)
    return df.withColumn(terms, F.filter(terms, lambda h: F.expr(f"shiftleft(1L, {level}) - 1").bitwiseAND(h) == 0))


def _parts(terms: Column, level: Column) -> Column:
    """A hash of the sorted terms of each part, at the level and the one above it; -1 where a part is empty."""
    above = lambda of: F.filter(of, lambda h: F.call_function("shiftrightunsigned", h, level).bitwiseAND(1) == 0)

    def hashed(of: Column) -> Column:
        """The part of a term is in its leading bits, so the sorted terms of a part stand side by side."""
        parts = F.transform(of, lambda h: F.shiftrightunsigned(h, 59).cast("int"))

        def one(part: Column, found: Column) -> Column:
            mine = F.slice(of, F.array_position(found, part).cast("int"), F.size(found) - F.size(F.array_remove(found, part)))
            return F.when(F.array_contains(found, part), F.xxhash64(mine).bitwiseAND(4095).cast("int")).otherwise(F.lit(-1))

        return _with(parts, lambda found: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda part: one(part, found)))

    return _with(F.sort_array(terms), lambda t: F.concat(hashed(t), _with(above(t), hashed)))


def _written(level: Column, band: Column, full: Column) -> Column:
    digits = lambda parts: F.array_join(F.transform(parts, lambda v: F.when(v < 0, F.lit("...")).otherwise(F.lpad(F.hex(v), 3, "0"))), "")
    return F.concat_ws(":", level.cast("string"), digits(band), digits(full))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of equal ones among the parts that either of two fingerprints fills, at the levels both have."""
    enough = lambda x: F.size(F.filter(x["band"], lambda v: v >= 0)) >= LEAST
    parts = F.when(enough(a) & enough(b), F.struct(a["band"].alias("a"), b["band"].alias("b"))).otherwise(F.struct(a["full"].alias("a"), b["full"].alias("b")))
    gap = a["level"] - b["level"]

    def shared(of: Column) -> Column:
        left = F.when(gap == 0, of["a"]).otherwise(F.slice(of["a"], F.when(gap == 1, 1).otherwise(PARTS + 1), F.lit(PARTS)))
        right = F.when(gap == 0, of["b"]).otherwise(F.slice(of["b"], F.when(gap == -1, 1).otherwise(PARTS + 1), F.lit(PARTS)))
        code = F.zip_with(left, right, lambda p, q: F.when((p < 0) & (q < 0), 0).when(p == q, 1_000_001).otherwise(1_000_000))
        return F.aggregate(code, F.lit(0), lambda s, v: s + v)

    share = lambda n: F.when(n > 0, (n % 1_000_000) / F.floor(n / 1_000_000)).otherwise(0.0)
    return F.when(a.eqNullSafe(b), 1.0).when(F.abs(gap) > 1, 0.0).otherwise(_with(_with(parts, shared), share))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): hashes of all terms of a corpus and the number of its documents that hold them."""
    terms = docs.select(F.explode(distinct_terms(F.coalesce(column(docs, text_col), F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.3, high: float = 0.95) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    low, high: the band, as ln(n / df) / ln(n) for n documents, so terms of n^(1-high) to n^(1-low) documents are kept. A
    document with fewer than 4 filled parts in the band (a copy among very many, a corpus of few documents) is compared by all of
    its terms. A fingerprint is the level, the parts of the band and the parts of all terms, in three hexadecimal digits each
    ("..." where empty). It depends on nothing but the terms, so equal texts have equal ones. A text of separators alone is one
    term; null and empty texts have none, and equal fingerprints are likeness 1. Terms are told apart by 64-bit hashes. Ties and
    repeated rows follow with_next. An empty table gives an empty result; other columns are not looked at."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    base = rows.select(
        "rid", "next_rid", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        distinct_terms(F.col("text")).alias("own"), distinct_terms(F.col("edited")).alias("changed"),
    )
    base = scratch.save(_sampled(_sampled(base, "own", "level"), "changed", "changed_level"), "base")
    counts = scratch.save(lexicon(docs, text_col), "lexicon")
    n = max(base.count(), 1)
    least, most = n ** (1 - high), n ** (1 - low)
    pairs = base.select("rid", F.explode(F.array_union("own", "changed")).alias("term"))
    frequent = counts.where(F.col("df") > most).select("term")
    if frequent.count() <= BROADCAST_TERMS:
        pairs = pairs.join(F.broadcast(frequent), "term", "left_anti")
    inside = pairs.join(counts.where(F.col("df").between(least, most)).select("term"), "term")
    inside = inside.groupBy("rid").agg(F.collect_list("term").alias("inside"))  # at most 128 terms
    both = base.join(inside, "rid", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<long>")))

    def made(terms: str, level: str) -> Column:
        band = _parts(F.array_intersect(terms, "inside"), F.col(level))
        return F.struct(F.col(level).alias("level"), band.alias("band"), _parts(F.col(terms), F.col(level)).alias("full"))

    both = both.select("rid", "next_rid", "doc_id", "n_chars", "sha", made("own", "level").alias("a"), made("changed", "changed_level").alias("b"))
    both = scratch.save(both, "fingerprints")
    other = both.select(F.col("rid").alias("next_rid"), F.col("a").alias("c"))
    return both.join(other, "next_rid").select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        _written(F.col("a.level"), F.col("a.band"), F.col("a.full")).alias("fingerprint"),
        _written(F.col("b.level"), F.col("b.band"), F.col("b.full")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
