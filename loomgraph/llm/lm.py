"""Language-model scores by deleted interpolation.

P(w | v) mixes the maximum-likelihood bigram and unigram estimates with a uniform share. The mixture weights depend on how
often the context v was seen: one set of weights for each bucket of context frequency (powers of two), learned by
expectation-maximisation on the counts of a held-out part of the training texts against counts of the rest.

The corpus is read once into a table of blocks of about `block` tokens. A block sends the distinct n-grams it has, with its own
counts of them, to the tasks that own them by hash; these add up and send each block the totals of what it asked for, and
apart from those the counts without the deleted part, for what the block's deleted texts hold. So a
frequent n-gram costs one entry for each block, no task holds more than a share of the n-grams, and nothing but a bounded
histogram for the weights reaches the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .shared import Scratch, column, mix, slots, steps, tidy, word_hashes, words

END, START = np.uint64(0x51ED270B), np.uint64(0x2545F491)  # the end of a text, and the context of its first token
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...; log-ratios of the estimates are kept to 1/8 of a factor of two.
CONTEXTS, FINE, CLIP = 40, 8, 30
#: Bits of a bigram's hash; words have 64.
PAIR_BITS = 56
#: Places in a block's vocabulary by their bytes.
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def fold_of(crc, modulus: int = 7, held: int = 2, deleted: int = 3):
    """0: counts only, 1: the deleted part of training, 2: held out altogether."""
    return np.where(crc % modulus == held, 2, np.where(crc % modulus == deleted, 1, 0))


def tokenised(block: int):
    """For mapInArrow: blocks of (id, doc_ids, folds, sizes, vocab, stream) from (doc_id, crc, text).

    vocab: the block's distinct token hashes in order; stream: the place there of each token, the end of each text included."""

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        ids: list = []
        folds: list = []
        sizes: list = []
        parts: list = []
        total = 0

        def flush():
            nonlocal at, ids, folds, sizes, parts, total
            vocab, stream = np.unique(np.concatenate(parts), return_inverse=True)
            kind = np.uint8 if len(vocab) < 1 << 8 else np.uint16 if len(vocab) < 1 << 16 else np.uint32
            out = batch(
                id=pa.array([(task << 32) + at]), doc_ids=pa.array([ids], pa.list_(pa.int64())), folds=pa.array([np.concatenate(folds).astype(np.int8).tobytes()], pa.binary()),
                sizes=pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()), vocab=pa.array([gaps(vocab)], pa.binary()), wide=pa.array([np.dtype(kind).itemsize]), stream=pa.array([stream.astype(kind).tobytes()], pa.binary()),
            )
            at, ids, folds, sizes, parts, total = at + 1, [], [], [], [], 0
            return out

        for b in batches:
            crc = np.asarray(b.column(1))
            for row, offsets, data in steps(b.column(2)):
                starts, ends, first = words(offsets, data)
                hashes = word_hashes(starts, ends, _LOW[data])
                n = np.diff(first)
                ids += b.column(0).slice(row, len(n)).to_pylist()
                folds.append(fold_of(crc[row : row + len(n)]))
                sizes.append(n + 1)
                parts.append(np.insert(hashes, first[1:], END))
                total += len(hashes) + len(n)
                if total >= block:
                    yield flush()
        if ids:
            yield flush()

    return run


def only_deleted(batches):
    """For mapInArrow: of each block its deleted texts, as a block; those without any are left out."""
    for row in rows_of(batches):
        folds, sizes = np.frombuffer(row["folds"], np.int8), np.frombuffer(row["sizes"], np.int64)
        word = np.frombuffer(row["stream"], WIDTHS[row["wide"]])[np.repeat(folds == 1, sizes)]
        if len(word):
            own, word = np.unique(word, return_inverse=True)
            yield batch(
                id=pa.array([row["id"]]), folds=pa.array([folds[folds == 1].tobytes()], pa.binary()), sizes=pa.array([sizes[folds == 1].tobytes()], pa.binary()),
                vocab=pa.array([gaps(ungap(row["vocab"])[own])], pa.binary()), wide=pa.array([row["wide"]]), stream=pa.array([word.astype(WIDTHS[row["wide"]]).tobytes()], pa.binary()),
            )


class Block:
    """One row of the table of blocks, with its n-grams: unigrams first, then bigrams, each by ascending key."""

    def __init__(self, folds: bytes, sizes: bytes, vocab: bytes, wide: int, stream: bytes):
        self.folds, self.sizes = np.frombuffer(folds, np.int8), np.frombuffer(sizes, np.int64)
        self.vocab = ungap(vocab)
        self.word = np.frombuffer(stream, WIDTHS[wide]).astype(np.int64)
        self.fold = np.repeat(self.folds, self.sizes)
        before = np.empty(len(self.word), np.int64)
        before[1:] = self.word[:-1]
        first = np.cumsum(self.sizes) - self.sizes
        before[first] = len(self.vocab)
        self.before = before
        with np.errstate(over="ignore"):
            left = np.append(mix(self.vocab + np.uint64(1)), mix(START))
            pair = mix(left[before] * np.uint64(3) + self.vocab[self.word])
        self.pairs, self.pair = np.unique(pair >> np.uint64(64 - PAIR_BITS), return_inverse=True)
        #: contexts are unigrams, and the start, whose count is the number of texts
        with np.errstate(over="ignore"):
            self.singles = np.append(mix(self.vocab ^ np.uint64(0x5DEECE66D)), mix(START ^ np.uint64(0x5DEECE66D)))

    def counts(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Of this block's unigrams (the start last) and bigrams, in texts of that fold."""
        here = self.fold == fold
        one = np.bincount(self.word[here], minlength=len(self.singles))
        one[-1] = int((self.folds == fold).sum())
        return one, np.bincount(self.pair[here], minlength=len(self.pairs))


def narrow(x: np.ndarray) -> bytes:
    """Counts, most of them small, in few bytes."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy().tobytes(), 1)


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def rows_of(batches):
    """The rows one by one: a block is large, and a batch may hold many."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def gaps(keys: np.ndarray, plain: int = 6) -> bytes:
    """Ascending keys as their differences, whose bytes above the `plain` low ones are nearly all 0 in a well-filled range."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    high = zlib.compress(planes[plain:].tobytes(), 1)
    return bytes([plain]) + len(high).to_bytes(4, "little") + high + planes[:plain].tobytes()


def ungap(b: bytes) -> np.ndarray:
    plain, n = b[0], int.from_bytes(b[1:5], "little")
    low = np.frombuffer(b, np.uint8, offset=5 + n).reshape(plain, -1)
    high = np.frombuffer(zlib.decompress(b[5 : 5 + n]), np.uint8).reshape(8 - plain, -1)
    return np.cumsum(np.concatenate((low, high)).T.copy().view("<u8").ravel(), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, bits: int, wide: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(wide - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def asked(bits: int):
    """For mapInArrow over blocks: for each owner the keys a block has, and its counts in both training folds."""

    def run(batches):
        for row in rows_of(batches):
            block = Block(*(row[k] for k in ("folds", "sizes", "vocab", "wide", "stream")))
            (one0, two0), (one1, two1) = block.counts(0), block.counts(1)
            order = np.argsort(block.singles, kind="stable")
            for kind, keys, c0, c1 in ((1, block.singles[order], one0[order], one1[order]), (2, block.pairs, two0, two1)):
                cuts = bucket_cuts(keys, bits, 64 if kind == 1 else PAIR_BITS)
                full = np.flatnonzero(np.diff(cuts))
                parts = [slice(cuts[k], cuts[k + 1]) for k in full]
                n = len(full)
                yield batch(
                    owner=pa.array((2 * full + kind - 1).astype(np.int32)), id=pa.array([row["id"]] * n, pa.int64()), kind=pa.array([kind] * n, pa.int32()), part=pa.array(full.astype(np.int32)),
                    keys=pa.array([gaps(keys[p], 6 if kind == 1 else 5) for p in parts], pa.binary()), c0=pa.array([narrow(c0[p]) for p in parts], pa.binary()), c1=pa.array([narrow(c1[p]) for p in parts], pa.binary()),
                )

    return run


def answered(batches):
    """For mapInArrow over requests sorted by owner: to each request the totals of its keys, and, of those that its deleted texts
    hold, the counts without the deleted part; with one of them the owner's sums."""

    def reply_of(rows):
        keys = [ungap(r["keys"]) for r in rows]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        del keys
        kept, all_ = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        deleted = []
        for r, i in zip(rows, own):  # a request has a key once
            c0, c1 = widen(r["c0"]), widen(r["c1"])
            kept[i] += c0
            all_[i] += c0 + c1
            deleted.append(i[c1 > 0])
        real = every != mix(START ^ np.uint64(0x5DEECE66D)) if rows[0]["kind"] == 1 else np.zeros(len(every), bool)
        sums = [int(kept[real].sum()), int(all_[real].sum()), int((all_[real] > 0).sum()), int((kept[real] > 0).sum())]
        n = len(rows)
        for flag, source, wanted in ((False, all_, own), (True, kept, deleted)):
            yield batch(
                id=pa.array([r["id"] for r in rows]), kind=pa.array([r["kind"] for r in rows], pa.int32()), part=pa.array([r["part"] for r in rows], pa.int32()),
                deleted=pa.array([flag] * n), total=pa.array([narrow(source[i]) for i in wanted], pa.binary()),
                sums=pa.array([[0, 0, 0, 0] if flag else sums] + [[0, 0, 0, 0]] * (n - 1), pa.list_(pa.int64())),
            )

    owner, rows = None, []
    for r in rows_of(batches):
        if r["owner"] != owner and rows:
            yield from reply_of(rows)
            rows = []
        owner = r["owner"]
        rows.append(r)
    if rows:
        yield from reply_of(rows)


def gathered(block: Block, got: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's unigrams (the start last) and bigrams from the answers it got."""
    out = []
    for kind in (1, 2):
        parts = [widen(g["total"]) for g in sorted((g for g in got if g["kind"] == kind), key=lambda g: g["part"])]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    one = np.empty(len(block.singles), np.int64)
    one[np.argsort(block.singles, kind="stable")] = out[0]
    return one, out[1]


def estimates(block: Block, one: np.ndarray, two: np.ndarray, total: int):
    """(context bucket, bigram and unigram estimates) of each token."""
    context = one[block.before]
    bucket = np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), CONTEXTS - 1)
    return bucket, two[block.pair] / np.maximum(context, 1), one[block.word] / max(total, 1)


def ratio_bin(p: np.ndarray, floor: float) -> np.ndarray:
    """-1: nothing; else the log-ratio to the uniform share, in steps of 1/FINE of a factor of two."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(np.log2(np.maximum(p, 1e-300) / floor) * FINE), -CLIP * FINE, CLIP * FINE), -CLIP * FINE - 1).astype(np.int64)


def learn(histogram: list[tuple[int, int, int, int]], iterations: int = 50) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by EM over (bucket, bigram ratio, unigram ratio, tokens)."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    if not histogram:
        return weights
    h = np.array(histogram, np.float64)
    bucket = h[:, 0].astype(int)
    p = np.stack([np.where(h[:, k] < -CLIP * FINE, 0.0, 2.0 ** (h[:, k] / FINE)) for k in (1, 2)] + [np.ones(len(h))], 1)
    for _ in range(iterations):
        share = weights[bucket] * p
        share /= share.sum(1, keepdims=True)
        new = np.zeros((CONTEXTS, 3))
        np.add.at(new, bucket, share * h[:, 3:4])
        new += 1e-3 * weights  # a bucket without held-out tokens keeps its weights; none becomes 0
        weights = new / new.sum(1, keepdims=True)
    return np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum(1, keepdims=True)


def score_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 100_000, share: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, then one end. Texts whose crc32 of doc_id as text is 2 mod 7 are held out,
    the rest are learned from; an id that is null counts as an empty one there. base_score is the add-one unigram's log10 probability, score the interpolated bigram's. A null or
    empty text has its end alone; rows that repeat count and are scored each. With nothing to learn from, every token is as likely as
    unknown. Empty input: empty result. Words are told apart by 64-bit hashes, bigrams by 56-bit ones. block and share: tokens of a block, and bigrams that an owner holds, about."""
    spark = docs.sparkSession
    text = F.coalesce(column(docs, text_col), F.lit(""))
    ids = column(docs, id_col)
    base = docs.select(ids.cast("long").alias("doc_id"), F.crc32(F.coalesce(ids.cast("string"), F.lit(""))).alias("crc"), text.alias("text"))
    scratch = Scratch(spark)
    kinds = "id long, doc_ids array<long>, folds binary, sizes binary, vocab binary, wide long, stream binary"
    blocks = scratch.save(base.mapInArrow(tokenised(block), kinds), "blocks")
    tokens = blocks.agg(F.sum(F.octet_length("stream") / F.col("wide"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, tokens / share)))))
    sent = blocks.drop("doc_ids").mapInArrow(asked(bits), "owner int, id long, kind int, part int, keys binary, c0 binary, c1 binary")
    sorted_ = sent.repartition(slots(spark), "owner").sortWithinPartitions("owner")
    totals = scratch.save(sorted_.mapInArrow(answered, "id long, kind int, part int, deleted boolean, total binary, sums array<long>"), "totals")
    sums = totals.where("kind = 1 and not deleted").agg(*[F.sum(F.col("sums")[k]) for k in range(4)]).first()
    n0, n, v, v0 = (int(x or 0) for x in sums)

    def joined(blocks: DataFrame, deleted: bool) -> DataFrame:
        """Each block with its answers, one for each owner."""
        answers = totals.where(F.col("deleted") == deleted).groupBy("id").agg(F.collect_list(F.struct("kind", "part", "total")).alias("got"))
        return blocks.join(answers, "id")

    def opened(row):
        b = Block(*(row[k] for k in ("folds", "sizes", "vocab", "wide", "stream")))
        return b, *gathered(b, row["got"])

    def counted(batches):
        """(bucket, ratios, tokens) of the deleted part against counts of the rest."""
        for row in rows_of(batches):
            bucket, p2, p1 = estimates(*opened(row), n0)
            code = (bucket * 1024 + ratio_bin(p2, 1 / (v0 + 1)) + 512) * 1024 + ratio_bin(p1, 1 / (v0 + 1)) + 512
            code, many = np.unique(code, return_counts=True)
            yield batch(bucket=pa.array(code >> 20), r2=pa.array((code >> 10) % 1024 - 512), r1=pa.array(code % 1024 - 512), tokens=pa.array(many.astype(np.int64)))

    deleted = blocks.drop("doc_ids").mapInArrow(only_deleted, "id long, folds binary, sizes binary, vocab binary, wide long, stream binary")
    histogram = joined(deleted, True).mapInArrow(counted, "bucket long, r2 long, r1 long, tokens long").groupBy("bucket", "r2", "r1").agg(F.sum("tokens").alias("tokens"))
    with tidy(spark):
        weights = learn([tuple(r) for r in histogram.collect()])  # as many rows as there are bins, at most

    def scored(batches):
        for row in rows_of(batches):
            b, one, two = opened(row)
            bucket, p2, p1 = estimates(b, one, two, n)
            w = weights[bucket]
            full = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
            count = one[b.word]
            plain = np.log10((count + 1.0) / (n + v + 1.0))
            first = np.cumsum(b.sizes) - b.sizes
            yield batch(
                doc_id=pa.array(row["doc_ids"], pa.int64()), held_out=pa.array(b.folds == 2), n_tokens=pa.array(b.sizes), n_known=pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                train_tokens=pa.array(np.full(len(first), n)), base_score=pa.array(np.add.reduceat(plain, first)), score=pa.array(np.add.reduceat(full, first)),
            )

    return joined(blocks, False).mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
