"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier over character n-grams learns each bit. A text is given the
language whose codeword has the least loss against the classifiers' margins, each bit weighted by how well it did
in training. A text whose two nearest codewords are close is flagged as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .shared import column, mix, steps

FEATURES = 1 << 12
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Bytes that are no part of a letter: what is below 0x80 and not A-Z or a-z is read as a space.
_LOW[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class: every distinct two-way split up to seven classes, else the best of random codes."""
    if classes <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=classes) if b[0] == 1 and -1 in b] or [(1,)]
        return np.array(bits).T
    length = 8 * int(np.ceil(np.log2(classes)))
    rng, best = np.random.default_rng(1), None
    for _ in range(200):
        code = rng.choice((-1, 1), (classes, length))
        far = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        if best is None or far > best[0]:
            best = far, code
    return best[1]


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Root-scaled shares of hashed byte 2- to 4-grams of each text, one row each; runs of non-letters count as one space."""
    rows = len(offsets) - 1
    low = _LOW[data]
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (owner[1:] != owner[:-1])
    low, owner = low[keep].astype(np.uint32), owner[keep]
    out = np.zeros((rows, FEATURES))
    gram = low
    for n in (2, 3, 4):
        if len(low) < n:
            break
        gram = gram[:-1] * np.uint32(257) + low[n - 1 :]
        inside = owner[: len(gram)] == owner[n - 1 :]
        h = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((owner[: len(gram)] * FEATURES + h)[inside], minlength=rows * FEATURES).reshape(rows, FEATURES)
    norm = np.sqrt(out.sum(1, keepdims=True))
    return np.sqrt(out) / np.maximum(norm, 1)


class CodedClassifier:
    def __init__(self, languages: list[str], ridge: float = 1.0):
        self.languages, self.ridge = languages, ridge
        self.code = codewords(len(languages))

    def fit(self, x: np.ndarray, y: np.ndarray) -> CodedClassifier:
        """Ridge regression on +-1 for each bit, rows weighted so that languages count alike."""
        return self.fit_inplace(np.hstack([x, np.ones((len(x), 1))]), y)

    def fit_inplace(self, a: np.ndarray, y: np.ndarray) -> CodedClassifier:
        """fit of features whose last column is 1; they are scaled where they stand, since the driver holds no copy of them."""
        weight = 1.0 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1)[y]
        weight *= len(y) / weight.sum()
        a *= np.sqrt(weight)[:, None]
        t = self.code[y] * np.sqrt(weight)[:, None]
        if len(a) < a.shape[1]:  # the dual form is the smaller system
            self.w = a.T @ np.linalg.solve(self.ridged(a @ a.T), t)
        else:
            self.w = np.linalg.solve(self.ridged(a.T @ a), a.T @ t)
        wrong = (np.sign(a @ self.w) != self.code[y]) * weight[:, None]
        error = np.clip(wrong.mean(0), 1e-3, 0.499)
        self.trust = np.log((1 - error) / error)
        self.trust /= self.trust.sum()
        return self

    def ridged(self, gram: np.ndarray) -> np.ndarray:
        gram[np.diag_indices(len(gram))] += self.ridge
        return gram

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, gap to the second) by loss-weighted distance to each codeword."""
        loss = np.log1p(np.exp(-4 * self.margins(x)[:, None, :] * self.code[None, :, :])) @ self.trust
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        first = loss.argmin(1)
        two = np.sort(p, axis=1)[:, ::-1]
        return first, p[np.arange(len(p)), first], two[:, 0] - (two[:, 1] if p.shape[1] > 1 else 0)


def train(labelled: DataFrame, per_language: int = 600, max_bytes: int = 20_000) -> CodedClassifier | None:
    """From (key, text, lang): a bounded sample, `per_language` whole texts of each language by a hash of the key,
    among those of at most max_bytes bytes where there are any. None if nothing is labelled."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.struct((F.octet_length("text") > max_bytes).alias("long"), F.xxhash64("key", F.lit(3)).alias("h"), "key")
    # min_by of the k least keeps k rows of each language in each task, and no more
    usable = usable.withColumn("o", order).withColumn("part", F.pmod(F.xxhash64("key", F.lit(4)), F.lit(per_language)).cast("int"))
    rows = usable.groupBy("lang", "part").agg(F.min_by("text", "o").alias("text")).orderBy("lang", "part").toPandas()
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    y = rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    texts = pa.array(rows["text"], pa.string())
    del rows
    x, at = np.ones((len(texts), FEATURES + 1)), 0
    for _, offsets, data in steps(texts):
        for i in range(0, len(offsets) - 1, 256):  # each call takes some arrays of its rows' size
            o = offsets[i : i + 257]
            x[at : at + len(o) - 1, :FEATURES] = features(o - o[0], data[o[0] : o[-1]])
            at += len(o) - 1
    return CodedClassifier(languages).fit_inplace(x, y)


def predicted(model: CodedClassifier | None, ambiguous: float):
    """For mapInArrow: (..., lang_pred, score, ambiguous) from rows whose last two columns are text and has_letter."""

    def run(batches):
        for b in batches:
            n = b.num_columns - 2
            letters = np.asarray(b.column(n + 1).fill_null(False))
            lang, score, flag = [], [], []
            if model is None:
                lang, score, flag = ["und"] * b.num_rows, [0.0] * b.num_rows, [True] * b.num_rows
            else:
                for at, offsets, data in steps(b.column(n)):
                    size = len(offsets) - 1
                    for i in range(0, size, 256):
                        o = offsets[i : i + 257]
                        first, p, gap = model.decode(features(o - o[0], data[o[0] : o[-1]]))
                        ok = letters[at + i : at + i + len(first)]
                        lang += [model.languages[k] if y else "und" for k, y in zip(first, ok)]
                        score += np.where(ok, p, 0.0).tolist()
                        flag += (~ok | (gap < ambiguous)).tolist()
            yield batch(**{b.schema.names[k]: b.column(k) for k in range(n)}, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), ambiguous=pa.array(flag, pa.bool_()))

    return run


def identify(docs: DataFrame, model: CodedClassifier | None, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = 0.1, keep: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, (columns of `keep`), lang_pred, score, ambiguous.

    lang_pred is a language of the model, or `und` if the text is null or has no letter, or nothing was labelled. score is between
    0 and 1. Whole texts are read, and the text alone; rows that repeat get the same prediction each. Empty input: empty result."""
    text = F.coalesce(column(docs, text_col), F.lit(""))
    part = docs.select(column(docs, id_col).alias("doc_id"), *[column(docs, k).alias(f"keep_{i}") for i, k in enumerate(keep)], text.alias("text"), text.rlike(r"\p{L}").alias("has_letter"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields[:-2])
    out = part.mapInArrow(predicted(model, ambiguous), f"{kinds}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "lang_pred", "score", "ambiguous")


def training_rows(docs: DataFrame) -> DataFrame:
    """(key, text, lang) of documents that predictions may learn from: crc32 of doc_id as text, mod 4, is not 2."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(key.alias("key"), "text", "lang").where(F.crc32(key) % 4 != 2)
