"""Scalar functions: vectors, sparse vectors, text, identifiers, time, parsing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- vectors --------------------------------------------------------------------------------------------------


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v over its norm; unchanged where the norm is 0 or not finite."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n)).otherwise(_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine and dot are the plain inner product (normalise first), l2 is 1 / (1 + distance)."""
    if metric in ("cosine", "dot"):
        return dot(a, b)
    if metric == "l2":
        gap = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
        return F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)))
    raise ValueError(f"unknown metric {metric}")


def embedding_valid(vector: Column, dim: Column) -> Column:
    return F.size(vector) == dim


#: Bytes of one number of an encoded vector, by its kind.
WIDTHS = {"f16": 2, "f32": 4, "f64": 8, "i8": 1}


def encoded_valid(content: Column, kind: Column, dim: Column) -> Column:
    """Whether the bytes of a vector are as many as its kind and dimension ask for."""
    table = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])
    return F.coalesce(F.octet_length(content) == dim * F.try_element_at(table, kind), F.lit(False))


def decode_embedding(content: Column, kind: Column, dim: Column) -> Column:
    """The numbers of a vector from its little-endian bytes, as floats; null where they are not as many as they should be."""
    kinds = {"f16": "<f2", "f32": "<f4", "f64": "<f8", "i8": "<i1"}

    @F.pandas_udf("array<float>")
    def decoded(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or k not in kinds or len(c) % WIDTHS[k] else np.frombuffer(c, kinds[k]).astype(np.float32) for c, k in zip(content, kind)])

    return F.when(encoded_valid(content, kind, dim), decoded(content, kind))


# --- sparse vectors -------------------------------------------------------------------------------------------


def sparse_valid(indices: Column, values: Column) -> Column:
    """As many values as indices, and the indices strictly ascending."""
    return (F.size(indices) == F.size(values)) & (indices == F.array_sort(F.array_distinct(indices)))


def sparse_from_unsorted(pairs: Column) -> Column:
    """Of an array of (index, value): ascending indices, the greatest value of each, values above 0 only."""
    kept = F.filter(pairs, lambda p: p["value"] > 0)
    indices = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["index"])))
    return F.transform(indices, lambda i: F.struct(i.alias("index"), F.array_max(F.transform(F.filter(kept, lambda p: p["index"] == i), lambda p: p["value"])).alias("value")))


def sparse_dot(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    """Sum of products over the indices both have."""
    lookup = F.map_from_arrays(bi, bv)
    products = F.zip_with(ai, av, lambda i, v: v.cast("double") * F.coalesce(F.element_at(lookup, i).cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def token_slot(token: Column, slots: int = 1024) -> Column:
    """The slot of a token in the hashed vocabulary: the leading 32 bits of its md5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def token_weight(token: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.octet_length(token))


# --- text -----------------------------------------------------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters and two thirds of the others, each rounded up."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.ceil((F.length(text) - other) / 4.0) + F.ceil(other / 1.5)).cast("long")


def clip_text(text: Column, cap: int) -> Column:
    more = F.length(text) - cap
    return F.when(more > 0, F.concat(F.substring(text, 1, cap), F.lit(" <...+"), more.cast("string"), F.lit(" chars>"))).otherwise(text)


def short_summary(text: Column, most: int = 200) -> Column:
    """The trimmed text; above `most` bytes, as many whole characters as fit in them and an ellipsis."""
    t = F.trim(text)
    # the longest prefix of whole characters in `most` bytes: without the bytes of a character that the cut left incomplete
    head = F.hex(F.substring(F.encode(t, "UTF-8"), 1, most))
    cut = F.decode(F.unhex(F.regexp_replace(head, "^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", "$1")), "UTF-8")
    return F.when(F.octet_length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def canonical(text: Column) -> Column:
    return F.lower(F.trim(text))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


#: The stopwords of keyword extraction.
STOPWORDS = (
    "a an and are as at be but by for from has have he her hers him his i if in into is it its me my no not of on or our ours over she so that "
    "the their theirs them then there they this those to too us was we were what when where which while who whom why will with you your yours"
).split()


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(STOPWORDS)


def word_set(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def asks_for_date(question: Column) -> Column:
    q = F.lower(question)
    return q.contains("when ") | q.contains("what year") | q.contains("what month") | q.contains("date")


def asks_for_number(question: Column) -> Column:
    q = F.lower(question)
    return q.contains("how many") | q.contains("how much") | q.contains("number of") | q.contains("count")


#: Month prefixes.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def has_date(text: Column) -> Column:
    """The first "20" followed by two digits, a digit, slashes and a digit, or a month's first letters."""
    first = F.instr(text, "20")
    year = (first > 0) & F.substring(text, first + 2, F.lit(2)).rlike("^[0-9][0-9]$")
    return year | text.rlike("[0-9]/+[0-9]") | text.rlike(MONTHS)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


# --- identifiers and time -------------------------------------------------------------------------------------


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def author_fingerprint(author: Column) -> Column:
    return F.substring(F.sha2(author, 256), 1, 16)


def sorted_props(props: Column) -> Column:
    return F.array_sort(F.map_entries(props))


def node_content_id(ntype: Column, summary: Column, props: Column) -> Column:
    """Content id of a node's body: equal bodies have equal ids."""
    return F.sha2(F.to_json(F.struct(ntype.alias("ntype"), summary.alias("summary"), sorted_props(props).alias("props"))), 256)


def deterministic_id(label: Column, props: Column) -> Column:
    body = F.array_join(F.transform(sorted_props(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return F.sha2(F.concat(label, F.lit("\n"), body), 256)


def value_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def short_id(cid: Column, n: int = 12) -> Column:
    return F.substring(cid, 1, n)


def micros_to_rfc3339(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def time_ordered_id(micros: Column, *parts: Column) -> Column:
    """An id that sorts by time and is the same whenever it is made: the milliseconds, then a hash of the parts, as a version 7 UUID."""
    t = F.lpad(F.lower(F.hex(F.floor(micros / 1000).cast("long"))), 12, "0")
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def now_micros() -> Column:
    return F.unix_micros(F.current_timestamp())


# --- parsing --------------------------------------------------------------------------------------------------


def parse_kv(text: Column) -> Column:
    """KEY=VALUE as (key, tagged value): a JSON number, boolean or string by its type, anything else as text."""
    key = F.substring_index(text, "=", 1)
    value = F.substring(text, F.length(key) + 2, F.length(text))
    kind = (
        F.when(value.rlike(r"^-?(0|[1-9][0-9]{0,17})$"), F.concat(F.lit("i:"), value)).when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.concat(F.lit("f:"), value.try_cast("double").cast("string")))
        .when(value.isin("true", "false"), F.concat(F.lit("b:"), value)).when(value.rlike('^".*"$'), F.concat(F.lit("s:"), F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(F.concat(F.lit("s:"), value))
    )
    return F.struct(key.alias("key"), kind.alias("value"))


def json_value(text: Column) -> Column:
    """A JSON text as a typed value: integers and decimals stay apart, lists and objects are kept; null where it is no JSON."""
    return F.try_parse_json(text)


def props_json(props: Column) -> Column:
    """Typed properties as one JSON object, its keys in order."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    body = lambda v: F.substring(v, F.lit(3), F.length(v))
    value = lambda v: F.when(v.startswith("s:"), quoted(body(v))).otherwise(body(v))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_props(props), lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"]))), ","), F.lit("}"))


def text_to_index(ntype: Column, summary: Column, content: Column, props: Column) -> Column:
    """What a node is embedded by: its summary, else its content, else its label and properties in order."""
    pairs = F.array_join(F.transform(sorted_props(props), lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], F.lit(3), F.length(e["value"])))), " ")
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(some(summary), some(content), F.trim(F.concat_ws(" ", ntype, pairs)))


def fill_template(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def cooccurrence_budget_ms(budget: Column) -> Column:
    return F.greatest(F.lit(20), F.floor(budget / 2))


def knn_budget_ms(cooccurrence: Column, batch: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(cooccurrence / F.greatest(batch, F.lit(1))))


def sample_size(width: Column) -> Column:
    """Wilson bound: samples for a confidence interval of that half width."""
    return F.greatest(F.lit(1), F.ceil(F.pow(F.lit(1.96) / width, F.lit(2.0)) * 0.25)).cast("long")


# --- typed properties -----------------------------------------------------------------------------------------


def _typed(props: Column, name: str, kind: str) -> Column:
    v = F.try_element_at(props, F.lit(name))
    return F.when(v.startswith(f"{kind}:"), F.substring(v, F.lit(3), F.length(v)))


def get_str(props: Column, name: str) -> Column:
    """The property as text; null if it is missing or of another type. So are the getters below."""
    return _typed(props, name, "s")


def get_int(props: Column, name: str) -> Column:
    return _typed(props, name, "i").cast("bigint")


def get_float(props: Column, name: str) -> Column:
    return _typed(props, name, "f").cast("double")


def get_bool(props: Column, name: str) -> Column:
    return _typed(props, name, "b").cast("boolean")
