"""Best-fit packing of token pieces by a configuration linear program.

Only the histogram of piece lengths reaches the driver: one number for each length up to the capacity. The covering
program over configurations (how many pieces of each length share a sequence) is solved by multiplicative weights, whose pricing
step is a knapsack by dynamic programming: each round covers the longest lengths by configurations at its prices, in whole
numbers. Each piece then finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, column, steps, word_hashes

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class SegmentEncoder:
    """Ids of whole texts, from the ids of their segments.

    The tokenizer drops white space and never joins letters with ASCII punctuation, so a text's ids are those of the
    segments between such places, in turn; ASCII letters may be lower-cased before, as the tokenizer does it itself.
    Segments are known by 64-bit hashes, `limit` of them at most. Those of letters alone end at the id that
    closes a word, which lets many be encoded in one call."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.closes = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.array([END_ID] + [0] * 4095, np.int32), 1  # the end's id stands first

    def learn(self, hashes: np.ndarray, segments: list[bytes], plain: np.ndarray) -> None:
        order, ids, sizes = [], [], []
        at = np.flatnonzero(plain)
        if len(at):
            got = np.array(self.tok.encode(b" ".join([segments[i] for i in at]).decode(), add_special_tokens=False).ids, np.int32)
            last = np.flatnonzero(self.closes[got])
            if len(last) == len(at):
                order, ids, sizes = [at], [got], [np.diff(np.concatenate(([-1], last)))]
            else:
                plain = np.zeros(len(plain), bool)
        at = np.flatnonzero(~plain)
        for part in (at[k : k + 4096] for k in range(0, len(at), 4096)):
            got = [e.ids for e in self.tok.encode_batch([segments[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)]
            order.append(part)
            sizes.append(np.array([len(x) for x in got], np.int64))
            ids.append(np.fromiter((i for x in got for i in x), np.int32, int(sizes[-1].sum())))
        order, ids, sizes = np.concatenate(order), np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(sizes) - sizes + self.used
        lengths = np.empty(len(order), np.int64)
        lengths[order] = sizes
        self.used += len(ids)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.starts, self.sizes = np.insert(self.starts, place, starts), np.insert(self.sizes, place, lengths)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by END_ID; where each text begins, one more at the end)."""
        low, kind = _LOW[data], _KIND[data]
        lead = np.flatnonzero(low == 0xC3)  # a two-byte letter: U+00C0 to U+00FF but the two signs among them
        lead = lead[lead + 1 < len(low)]
        lead = lead[(low[lead + 1] != 0x97) & (low[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        starts, ends, first = segments(offsets, kind)
        hashes = word_hashes(starts, ends, low)
        every, index, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, every), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != every if len(self.hashes) else np.ones(len(every), bool)
        if len(self.hashes) + int(new.sum()) > self.limit:
            self.clear()
            new = np.ones(len(every), bool)
        if new.any():
            letters = np.concatenate(([0], np.cumsum(kind == LETTER)))
            s, e = starts[index[new]], ends[index[new]]
            raw = low.tobytes()
            self.learn(every[new], [raw[a:b] for a, b in zip(s.tolist(), e.tolist())], letters[e] - letters[s] == e - s)
        place = np.searchsorted(self.hashes, every)
        # the end of each text, at 0 of the flat ids, comes after its last segment
        begin = np.insert(self.starts[place][at] if len(at) else np.zeros(0, np.int64), first[1:], 0)
        sizes = np.insert(self.sizes[place][at] if len(at) else np.zeros(0, np.int64), first[1:], 1)
        stop = np.cumsum(sizes)
        take = np.arange(int(stop[-1])) + np.repeat(begin - stop + sizes, sizes)
        return self.flat[take], np.concatenate(([0], stop[first[1:] + np.arange(len(first) - 1)]))


SPACE_, LETTER, SIGN, OTHER = 0, 1, 2, 3
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE_
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = SIGN  # an apostrophe may open a contraction


def segments(offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of all segments, and for each text the index of its first (one more at the end)."""
    word = kind != SPACE_
    edge = np.zeros(len(kind) + 1, bool)
    a, b = kind[:-1], kind[1:]
    edge[1:-1] = (a == SPACE_) | (b == SPACE_) | ((a == LETTER) & (b == SIGN)) | ((a == SIGN) & (b == LETTER))
    edge[offsets] = True
    starts, ends = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One for each Python worker: what it knows serves the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def pieces(path: str, capacity: int):
    """For mapInArrow: (doc_id, piece, start, length, ids_crc32, task, nth) of (doc_id, text); nth counts the task's pieces of a length."""

    def run(batches):
        coder, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0)
            for at, offsets, data in steps(batch.column(1)):
                flat, begin = coder.encode(offsets, data)
                flat = flat.astype("<u4")
                n = -(-np.diff(begin) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                first = begin[row] + start
                length = np.minimum(begin[row + 1] - first, capacity)
                crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(first.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                head = np.searchsorted(sorted_, sorted_)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - head + seen[sorted_]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest price of pieces of at most c in all, for each c up to the capacity."""
    best, back = np.zeros(capacity + 1), price[::-1]  # back[capacity - l] = price[l]
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (best[:c] + back[capacity - c : capacity]).max())
    return best


def priced(length: int, price: np.ndarray, best: np.ndarray, left: np.ndarray) -> tuple[dict[int, int], float]:
    """The configuration of that length and what the knapsack says goes best with it, out of the pieces left, and its price."""
    capacity = len(best) - 1
    back = best[::-1]  # back[capacity - c + l] = best[c - l]
    free = np.where(left > 0, price, -np.inf)
    config, worth, room = {length: 1}, float(price[length]), capacity - length
    if left[length] == 1:
        free[length] = -np.inf
    while room > 0:
        k = int((free[1 : room + 1] + back[capacity - room + 1 :]).argmax()) + 1
        if left[k] == 0 or not np.isfinite(free[k]):
            break  # nothing that is left fits
        config[k] = config.get(k, 0) + 1
        worth += float(price[k])
        room -= k
        if config[k] >= left[k]:
            free[k] = -np.inf
    return config, worth


#: Pricing rounds: each covers the longest lengths left, up to its share of their tokens.
ROUNDS = 96
#: What the price of a token depends on beside the constant 1: how much of its length is to be covered yet, and how long it is. Long
#: pieces are worth more, so that short ones stay for where only they fit.
NEED, LONG = 0.005, 0.05
#: Of a length that only fills up, a configuration takes no more than this part of what is left at once.
PART = 2


def program(count: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int, float]:
    """(runs, number of sequences, share of the pieces that stand in configurations at the knapsack's price).

    A run is (length, first rank, pieces in a sequence, first sequence, first offset). The program asks for the fewest configurations that
    cover the histogram. Its weights, one for each length, fall by the exponential of the share that a round has covered; each
    round prices them, and takes configurations in whole numbers. Late in a round, and at the end, lengths run out and a
    configuration makes do with others: the share tells how often that costs more than 0.4 % of its price."""
    left = count.astype(np.int64)
    runs: list[tuple] = []
    used = np.zeros(capacity + 1, np.int64)
    sequences = at_price = 0
    sizes = np.arange(capacity + 1)
    weight = np.minimum(left / max(1.0, left[left > 0].mean() if left.any() else 1.0), 3.0)

    def place(config: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, a in sorted(config.items(), reverse=True):
            runs.append((length, used[length], a, sequences, offset))
            used[length] += a * times
            left[length] -= a * times
            offset += a * length
        sequences += times

    if left[capacity]:
        at_price += int(left[capacity])
        place({capacity: 1}, int(left[capacity]))
    for k in range(ROUNDS, 0, -1):
        todo = np.flatnonzero(left)[::-1]
        if not len(todo):
            break
        tokens = np.cumsum((left * sizes)[todo])
        before = left.copy()
        mean = weight[todo].mean()
        price = sizes / capacity * (1 + NEED * np.minimum(weight / mean, 3.0) + LONG * sizes / capacity)
        best = knapsack(np.where(left > 0, price, 0.0), capacity)
        for length in todo[: max(1, int(np.searchsorted(tokens, tokens[-1] / k, "right" if k == 1 else "left")))].tolist():
            while left[length] > 0:
                config, worth = priced(length, price, best, left)
                most = [left[n] // a if n == length else max(1, left[n] // a // PART) for n, a in config.items()]
                times = int(min(*most, *(left[n] // a for n, a in config.items())))
                if worth >= (price[length] + best[capacity - length]) * 0.996:
                    at_price += times * sum(config.values())
                place(config, times)
        weight *= np.exp(-(before - left) / np.maximum(before, 1))
        weight[left == 0] = 0.0
    table = np.array(runs, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences, at_price / max(1, int(count.sum()))


def plan(count: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, number of sequences) of the program."""
    return program(count, capacity)[:2]


def placed(runs: np.ndarray):
    """For mapInArrow: sequence_id and offset of pieces from their length and rank."""
    length, first, each, sequence, offset = runs.T
    wide = int(first.max(initial=0)) + 1

    def run(batches):
        for batch in batches:
            size, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            # the last run of that length that begins at this rank or before
            low, high = np.searchsorted(length, size, "left"), np.searchsorted(length, size, "right")
            key = length.astype(float) * wide + first
            at = np.clip(np.searchsorted(key, size.astype(float) * wide + np.minimum(rank, wide - 1), "right") - 1, low, high - 1)
            turn = rank - first[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence[at] + turn // each[at]), pa.array(offset[at] + turn % each[at] * size)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null text: none) and END_ID; one of more than `capacity` ids is cut, others never. A sequence
    holds `capacity` ids at most, without gaps. Rows that repeat, or have no id, are packed like any other row. Empty input:
    empty result. The path is that of a tokenizer file which every executor can read."""
    spark = docs.sparkSession
    base = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    table = Scratch(spark).save(base.mapInArrow(pieces(path or tokenizer_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")
    counts = table.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        count[r["length"]] = r["n"]
    runs, _ = plan(count, capacity)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = table.join(counts.select("length", "task", before.alias("before")), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
