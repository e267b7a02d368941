"""How far the sources of a language differ in their use of terms: exact sums over all pairs of sources, split by the frequency of terms.

A group is a (lang, source). Its share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), and a pair's value is the sum of
floor((p - q)^2 / q) over all V kept terms of the language, those that neither group has included. Terms that at least a fifth
of the groups have are heavy: they fill dense tiles of (sources x sources) over blocks of terms. The others are light: the sum as if
nobody had them is one product for each pair, what one group alone has comes from a histogram of its counts, and what both have
from the pairs within the term's short posting. The parts are added up; all of it is integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import batch
from .shared import Scratch, column
from .terms import counted, terms

#: A term is kept where so many documents of the language have it.
DOCUMENTS = 3
#: A term is heavy where groups that have it, times this, are as many as the groups of the language: one sparse pair costs about as much
#: as 25 cells of a tile, so each term goes the cheaper way.
HEAVY = 5
#: Terms and sources of a tile, and postings of a block of light terms.
TILE_TERMS = 2048
TILE_SOURCES = 64
LIGHT_ROWS = 50_000
RANKS = 200


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), by long division in three steps, so that it holds for counts up to 10^15."""
    by = total + kept
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, by)
        rest = (rest * 1000) % by
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of it that have the term."""

    def count(batches):
        for b in batches:
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
            first, of = np.unique(group, return_index=True, return_inverse=True)[1:]  # a row of each group, the group of each row
            for at, sizes, flat in terms(b.column("text"), digits=False):
                coded = flat.dictionary_encode()
                n = max(len(coded.dictionary), 1)
                row, code, times = counted(sizes, coded.indices.to_numpy().astype(np.int64), n)
                key, inverse = np.unique(of[at + row] * n + code, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, times)
                g = pa.array(first[key // n])
                yield batch(
                    lang=b.column("lang").take(g), source=b.column("source").take(g), term=coded.dictionary.take(pa.array(key % n)).cast(pa.string()),
                    n=pa.array(total), docs=pa.array(np.bincount(inverse, minlength=len(key)).astype(np.int64)),
                )

    text = lambda c: F.coalesce(column(docs, c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), column(docs, text_col).alias("text"))
    out = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _tiles(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums over heavy terms. rows: (lang, term, s, p); groups: (lang, s, zero, sources)."""
    wide = TILE_SOURCES
    blocks = rows.groupBy("lang").agg(F.ceil(F.count_distinct("term") / TILE_TERMS).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumn("across", F.ceil(F.col("sources") / wide).cast("int"))
    own = F.floor(F.col("s") / wide).cast("int")
    tiles = F.expr("concat(transform(sequence(0, across - 1), x -> struct(own as x, x as y)), filter(transform(sequence(0, across - 1), x -> struct(x as x, own as y)), t -> t.x <> own))")

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("own", own).withColumn("tile", F.explode(tiles)).select("lang", "block", "tile.x", "tile.y", "s", "term", "p", "terms")

    # a tile also counts the terms of its block that none of its sources has
    block = F.pmod("term", F.col("blocks")).cast("int").alias("block")
    terms = rows.select("lang", "term").distinct().join(blocks, "lang").groupBy("lang", block).agg(F.count(F.lit(1)).alias("terms"))
    heads = groups.join(terms, "lang").select("lang", "s", "across", "block", F.lit(None).cast("long").alias("term"), F.col("zero").alias("p"), "terms")
    cells = rows.join(groups.select("lang", "s", "across", "blocks"), ["lang", "s"])
    cells = cells.select("lang", "s", "across", block, "term", "p", F.lit(None).cast("long").alias("terms"))
    both = dealt(heads).unionByName(dealt(cells))

    def tile(key, table):
        x, y = key[2].as_py(), key[3].as_py()
        s, p = (table.column(c).to_numpy() for c in ("s", "p"))
        head = table.column("term").is_null().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        codes = table.column("term").filter(pa.array(~head)).combine_chunks()
        names, code = np.unique(codes.to_numpy(), return_inverse=True)
        known = np.unique(s[head])  # every group of both blocks
        zero = np.zeros(len(known), np.int64)
        zero[np.searchsorted(known, s[head])] = p[head]
        shares = np.repeat(zero[:, None], len(names), 1)
        shares[np.searchsorted(known, s[~head]), code] = p[~head]
        mine, other = known // wide == x, known // wide == y
        q, absent = shares[other], int(table.column("terms").filter(pa.array(head))[0].as_py()) - len(names)
        values = np.array([_far(a[None, :], q).sum(1) for a in shares[mine]], np.int64).reshape(int(mine.sum()), int(other.sum()))
        values += absent * _far(zero[mine][:, None], zero[other][None, :])
        a, b = np.meshgrid(known[mine], known[other], indexing="ij")
        n = values.size
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": pa.array(a.ravel(), pa.int32()), "b": pa.array(b.ravel(), pa.int32()), "value": values.ravel()})

    return both.groupBy("lang", "block", "x", "y").applyInArrow(tile, "lang string, a int, b int, value long")


def _postings(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): what pairs of groups that both have a light term add. rows: (lang, term, s, p, zero, sources)."""
    blocks = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / LIGHT_ROWS).cast("int").alias("blocks"))
    rows = rows.join(blocks, "lang").withColumn("block", F.pmod("term", F.col("blocks")).cast("int")).drop("blocks")

    def pairs(key, table):
        term, s, p, zero = (table.column(c).to_numpy() for c in ("term", "s", "p", "zero"))
        order = np.lexsort((s, term))
        term, s, p, zero = term[order], s[order].astype(np.int64), p[order], zero[order]
        n, keys, values = int(table.column("sources")[0].as_py()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(1, len(term)):  # a group and the one d places on in the same posting
            i = np.flatnonzero(term[d:] == term[:-d])
            if not len(i):
                break
            for a, b in ((i, i + d), (i + d, i)):
                more = _far(p[a], p[b]) - _far(p[a], zero[b]) - _far(zero[a], p[b]) + _far(zero[a], zero[b])
                keys, inverse = np.unique(np.concatenate((keys, s[a] * n + s[b])), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, inverse, np.concatenate((values, more)))
                values = total
        return pa.table({"lang": pa.array([key[0].as_py()] * len(keys), pa.string()), "a": pa.array(keys // n, pa.int32()), "b": pa.array(keys % n, pa.int32()), "value": values})

    return rows.groupBy("lang", "block").applyInArrow(pairs, "lang string, a int, b int, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source); null text, lang and source count as empty.

    part `pair`: each other source of the language, and the sum over its kept terms. part `term`: terms that the group uses more than its
    language does, the first `ranks` of them. Ranks go by value, then by item, in UTF-8 order. Groups without terms have pairs too;
    a language without kept terms has pairs of value 0. Repeated rows count each time. An empty table gives an empty result. Other
    columns are not looked at. Terms of a tile or block are told apart by 64-bit hashes together with their language."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(term_counts(docs, text_col, lang_col, source_col), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("c"), F.count(F.lit(1)).alias("having")).where(F.col("df") >= DOCUMENTS)
    rows = scratch.save(counts.join(kept.drop("df"), ["lang", "term"]).select("lang", "source", "term", "n", "c", "having"), "kept")

    text = lambda c: F.coalesce(column(docs, c).cast("string"), F.lit(""))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("all"))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v", "all"])
    lang = W.partitionBy("lang")
    groups = groups.withColumn("s", F.row_number().over(lang.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(lang))
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    groups = scratch.save(groups.withColumn("zero", zero), "groups")

    rows = rows.join(groups, ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("c"), F.col("all"), F.col("v")))
    rows = scratch.save(rows.select("lang", "source", F.col("term").alias("word"), F.xxhash64("term").alias("term"), "n", "p", "q", "s", "zero", "sources", "having"), "shares")
    heavy = F.col("having") * HEAVY >= F.col("sources")
    light = rows.where(~heavy)

    few = light.groupBy("lang", "s", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "s").agg(F.collect_list(F.struct("p", "n")).alias("alone"))
    lights = light.groupBy("lang").agg(F.count_distinct("term").alias("light"))
    sides = groups.join(few, ["lang", "s"], "left").join(lights, "lang", "left").select("lang", "source", "s", "zero", "alone", F.coalesce("light", F.lit(0)).alias("light"))
    sides = scratch.save(sides, "sides")
    a = sides.select("lang", "source", F.col("s").alias("a"), F.col("zero").alias("a_zero"), F.col("alone").alias("a_alone"), "light")
    b = sides.select("lang", F.col("source").alias("item"), F.col("s").alias("b"), F.col("zero").alias("b_zero"), F.col("alone").alias("b_alone"))
    pairs = a.join(b, "lang").where("a <> b")
    none = distance(F.col("a_zero"), F.col("b_zero"))
    total = lambda alone, far: F.coalesce(F.aggregate(alone, F.lit(0).cast("long"), lambda x, t: x + t["n"] * (far(t["p"]) - none)), F.lit(0))
    base = F.col("light") * none + total("a_alone", lambda p: distance(p, F.col("b_zero"))) + total("b_alone", lambda q: distance(F.col("a_zero"), q))
    pairs = pairs.select("lang", "source", "item", "a", "b", base.alias("base"))

    more = _tiles(rows.where(heavy).select("lang", "term", "s", "p"), groups).unionByName(_postings(light.select("lang", "term", "s", "p", "zero", "sources")))
    more = more.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    pairs = pairs.join(more, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    ordered = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ordered))
    found = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("word").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= ranks)
    return pairs.unionByName(found)
