"""Line dedup over a log-template tree; DataFrame operations only.

A line's words pass a tree of fixed depth: first their number, then the leading words, those with digits read as a
wildcard. In a leaf that many documents reach, a place where most lines agree is a constant of the leaf's template and
any other place a variable field; lines that agree with enough constants belong to that template. Each other line belongs
to the template of those of its words that are about as frequent at their places as enough of them are, so a leaf
holds any number of templates; where too few of its words recur, to that of its own words with wildcards for what holds digits.
A template of `min_docs` documents or more is boilerplate, and its lines are dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Scratch, column, cut

ANY = "<*>"


#: Leaves that many documents reach are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_LEAVES = 250_000


def masked(line):
    """The line's words with one space between them, those with digits as a wildcard; most lines need neither step."""
    line = F.when(line.rlike(r"[\x09-\x0D]|^ | $|  "), F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ ]*[0-9][^ ]*", ANY)).otherwise(line)


def leaf(line, lead: int):
    """The leaf of a masked line: the number of its words and the leading ones."""
    return F.xxhash64(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", lead))


def spread(lines: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Values of `key` that occur in min_docs documents or more; a document counts once, and sums meet before the shuffle."""
    return lines.groupBy(key, "rid").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("one").alias("docs")).where(F.col("docs") >= min_docs).select(key)


def patterns(rest: DataFrame, words: DataFrame, min_docs: int, agree: float, alike: float) -> DataFrame:
    """(own, pattern) of the lines (leaf, own, tokens) in which words of min_docs lines or more, or wildcards, are at a share `alike` of the
    places. words: (leaf, at, token, n). The constants of a line are its words that are at least `agree` times as frequent at
    their places as the rarest that is needed for that share."""
    masks = F.size(F.filter("tokens", lambda t: t == ANY))
    need = F.greatest(F.ceil(alike * F.size("tokens") - F.lit(1e-9)).cast("int") - masks, F.lit(1))
    each = rest.select("leaf", "own", need.alias("need"), F.posexplode("tokens").alias("at", "token")).where(F.col("token") != ANY)
    each = each.join(words.where(F.col("n") >= agree * min_docs), ["leaf", "at", "token"])
    lines = each.groupBy("leaf", "own").agg(F.max("need").alias("need"), F.collect_set(F.struct("n", "at", F.xxhash64("token").alias("token"))).alias("held")).where(F.size("held") >= F.col("need"))
    lines = lines.withColumn("least", F.element_at(F.sort_array("held", asc=False), F.col("need"))["n"]).where(F.col("least") >= min_docs)
    constants = F.array_sort(F.transform(F.filter("held", lambda w: w["n"] >= agree * F.col("least")), lambda w: F.struct(w["at"].alias("at"), w["token"].alias("token"))))
    return lines.select("own", F.xxhash64("leaf", constants, F.lit(3)).alias("pattern"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, lead: int = 3, agree: float = 0.6, alike: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, text (without the dropped lines), n_lines, n_dropped.

    Lines end at U+000A. A line of white space alone belongs to no template and stays. A null text stays null, with no lines; rows
    that repeat (same id and text) count as one document and lose the same lines. A place is constant where a share of `agree` of
    the leaf's lines have one word, or a share of `agree` of the lines that have the rest of a line's constants; a template needs
    constants at a share of `alike` of its places, and a line must agree with such a share of the leaf's. Whole texts are read; all leaves and templates are counted over all documents."""
    scratch = Scratch(docs.sparkSession)
    text = column(docs, text_col)
    # each document sends each of its leaves once
    own = F.array_distinct(F.transform(F.transform(F.split(text, "\n"), masked), lambda line: leaf(line, lead)))
    leaves = cut(docs.where(text.isNotNull()).select(F.explode(own).alias("leaf")).groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"))
    rows = docs.where(text.isNotNull()).select(F.xxhash64(column(docs, id_col), text).alias("rid"), F.posexplode(F.transform(F.split(text, "\n"), masked)).alias("pos", "line"))
    # masked before the explode, which keeps the filter below from doing it again
    rows = rows.where("line <> ''").withColumn("leaf", leaf(F.col("line"), lead))
    few = leaves.count() <= BROADCAST_LEAVES
    # a template is within a leaf, so only lines of leaves that many documents reach matter from here on
    met = rows.join(F.broadcast(leaves) if few else leaves, "leaf")
    hot = scratch.save(met.select("rid", "pos", "leaf", F.xxhash64("line", F.lit(1)).alias("own"), F.split("line", " ").alias("tokens")), "hot")
    hot = hot.join(spread(hot, "leaf", min_docs), "leaf")  # documents that repeat count once
    words = hot.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    places = words.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("of"))
    fixed = places.select("leaf", "at", F.when((F.col("top.n") >= agree * F.col("of")) & (F.col("top.token") != ANY), F.col("top.token")).alias("token"))
    template = fixed.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("places"))
    template = template.select("leaf", F.transform("places", lambda p: p["token"]).alias("template"))
    constant = F.size(F.filter("template", lambda t: t.isNotNull()))
    equal = F.size(F.filter(F.zip_with("template", "tokens", lambda a, b: a == b), lambda e: F.coalesce(e, F.lit(False))))
    masks = F.size(F.filter("tokens", lambda t: t == ANY))
    fits = (constant + masks >= alike * F.size("tokens")) & (constant > 0) & (equal >= alike * constant)
    judged = hot.join(template, "leaf").select("rid", "pos", "leaf", "own", "tokens", fits.alias("matches"))
    others = patterns(judged.where("not matches"), words, min_docs, agree, alike)
    matched = judged.select("rid", "pos", "leaf", "own", "matches").join(others, "own", "left")
    matched = cut(matched.select("rid", "pos", F.when(F.col("matches"), F.xxhash64("leaf", F.lit(2))).otherwise(F.coalesce("pattern", "own")).alias("template")))
    dropped = matched.join(spread(matched, "template", min_docs), "template").groupBy("rid").agg(F.collect_set("pos").alias("gone"))  # lines of one document
    rows = docs.select(column(docs, id_col).alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    out = rows.join(dropped.hint("shuffle_hash"), "rid", "left")  # texts are not sorted
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("gone", i)), "\n")
    return out.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
