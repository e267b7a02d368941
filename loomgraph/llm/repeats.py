"""Substring dedup by compact windows.

A text is its sequence of word 5-grams. Under each of several hash functions, the Cartesian tree over their hashes has
for every position the interval in which its hash is least; the positions whose interval holds a whole passage
(`passage` words) are its compact windows, about two for each passage length. All passages within the interval that
contain the position share its min-hash, so two texts with a common passage have windows with the same key, and a
passage of similarity s is met under one of k functions with probability 1 - (1 - s)^k, however crowded a key is.

Windows are joined by key. The intervals of two texts that meet under keys of few texts are united, and the words of
both are compared once for the pair. A key of many texts is compared as one group: equal stretches by a hash of the
whole stretch, then what could still match, by the number of its shingles that other rows of the key hold, against the
group's most typical rows, and what is left against every row that shares one of its rarest shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .shared import Scratch, column, cut, mix, numbers, shingles, slots, steps, word_hashes, words

SIZE = 5
#: Keys of up to so many texts are met pair by pair; those of more as one group.
FEW = 8
#: Rows of a crowded key that one task compares at once; a larger key is compared in blocks and pairs of blocks.
BLOCK = 16_384
#: Rounds against typical rows before the rarest shingles are looked up; candidate rows enumerated at once.
ROUNDS, SHARE = 8, 300_000
#: Places of shingles that are tried at once.
EVENTS = 1 << 20
#: Of stretches that follow one another, one in so many is counted first; a power of two.
STRIDE = 8
#: Places for signs of the shingles of a crowded key's row.
SIGNS = 1024
_FAR = 1 << 40
_RADIX = 0x9E3779B97F4A7C15


# --- compact windows -----------------------------------------------------------------------------------------


def sliding(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for each i."""
    n = len(h)
    pad = np.full((-n) % width, np.iinfo(h.dtype).max, h.dtype)
    m = np.concatenate((h, pad)).reshape(-1, width)
    left = np.minimum.accumulate(m, 1).ravel()
    right = np.minimum.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def compact(sh: np.ndarray, begin: np.ndarray, width: int, functions: int):
    """For each hash function: positions whose interval holds `width` shingles of one document, and how far it
    reaches to the left and to the right (width - 1 at most: no passage around the position reaches further)."""
    if len(sh) < width:
        return
    bits = np.uint64(max(1, int(len(sh)).bit_length()) + 1)
    place = np.arange(len(sh), dtype=np.uint64)
    # among equal shingles one in every half width goes first, so that a run of one shingle has few windows
    within = place - np.repeat(begin[:-1], np.diff(begin)).astype(np.uint64)
    place |= (within % np.uint64(max(1, width // 2)) != 0).astype(np.uint64) << (bits - np.uint64(1))
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    whole = doc[: len(sh) - width + 1] == doc[width - 1 :]
    salts, factors = numbers(31, functions), numbers(32, functions) | np.uint64(1)
    for j in range(functions):
        with np.errstate(over="ignore"):
            h = (((sh ^ salts[j]) * factors[j]) >> bits << bits) | place
        at = (sliding(h, width)[whole] & ((np.uint64(1) << (bits - np.uint64(1))) - np.uint64(1))).astype(np.int64)
        if not len(at):
            continue
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]  # the least moves to the right only
        reach = []
        for way in (-1, 1):
            near = at[:, None] + way * np.arange(1, width)
            inside = (near >= 0) & (near < len(sh))
            near = np.where(inside, near, at[:, None])
            less = ~inside | (doc[near] != doc[at][:, None]) | (h[near] < h[at][:, None])
            reach.append(np.where(less.any(1), less.argmax(1), width - 1))
        yield j, at, doc[at], reach[0], reach[1]


def windows(width: int, functions: int):
    """For mapInArrow: (key, node, mark) of (node, text); mark holds position, left and right reach."""

    def run(batches):
        for b in batches:
            for row, offsets, data in steps(b.column(1)):
                starts, ends, first = words(offsets, data)
                sh, begin = shingles(word_hashes(starts, ends, data), first, SIZE)
                node = np.asarray(b.column(0).slice(row, len(offsets) - 1))
                for j, at, doc, left, right in compact(sh, begin, width, functions):
                    key = mix(sh[at] + np.uint64(101 + j)).view(np.int64)
                    mark = (at - begin[doc]) << 16 | left << 8 | right
                    yield batch(key=pa.array(key), node=pa.array(node[doc]), mark=pa.array(mark))

    return run


def distinct_texts(batches):
    """For mapInArrow: (node, low, high, text), each text of this task once, with its least and greatest document."""
    seen: dict[int, list[int]] = {}
    for b in batches:
        node, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        new = []
        for i, (t, d) in enumerate(zip(node, ids)):
            if t not in seen:
                new.append(i)
                seen[t] = [d, d]
            elif not seen[t][0] <= d <= seen[t][1]:
                seen[t] = [min(seen[t][0], d), max(seen[t][1], d)]
        if new:
            at = pa.array(new)
            own = b.column(1).take(at)
            yield batch(node=b.column(0).take(at), low=own, high=own, text=b.column(2).take(at))
    wide = [(t, *r) for t, r in seen.items() if r[0] < r[1]]
    if wide:
        t, low, high = zip(*wide)
        none = pa.nulls(len(t), pa.string())
        yield batch(node=pa.array(t, pa.int64()), low=pa.array(low, pa.int64()), high=pa.array(high, pa.int64()), text=none)


# --- windows of one key --------------------------------------------------------------------------------------


def joined_by_key(few: int):
    """For mapInArrow over (key, node, mark) sorted by all three: (node, mark, group, crowded) of windows that meet others.

    Under a key of up to `few` texts a window gets a row for each other text, whose group is the pair; under one of
    more a single row, whose group is the key. A crowded key is passed on as it is read, never held."""

    def settle(key, node, mark):
        new = np.flatnonzero((np.diff(key, prepend=key[0] ^ 1) != 0) | (np.diff(node, prepend=node[0]) != 0))
        text = np.cumsum(np.bincount(new, minlength=len(key))) - 1  # of each row, its (key, text)
        at = np.flatnonzero(np.diff(key[new], prepend=key[0] ^ 1) != 0)
        texts = np.diff(np.append(at, len(new)))  # of each key
        of = np.repeat(np.arange(len(at)), texts)[text]  # of each row, its key
        d = texts[of]
        rows = np.flatnonzero((d > 1) & (d <= few))
        own = np.repeat(rows, d[rows])
        other = np.arange(len(own)) - np.repeat(np.cumsum(d[rows]) - d[rows], d[rows]) + at[of[own]]
        own, other = own[other != text[own]], other[other != text[own]]
        x, y = node[own].view(np.uint64), node[new[other]].view(np.uint64)
        with np.errstate(over="ignore"):
            pair = mix(np.minimum(x, y) * np.uint64(3) + mix(np.maximum(x, y)))
        many = np.flatnonzero(d > few)
        rows = np.concatenate((own, many))
        if len(rows):
            yield out(rows, node, mark, np.concatenate((pair.view(np.int64), key[many])), np.arange(len(rows)) >= len(own))

    def out(rows, node, mark, group, crowded):
        return batch(node=pa.array(node[rows]), mark=pa.array(mark[rows]), group=pa.array(group), crowded=pa.array(crowded))

    def run(batches):
        held = np.zeros((3, 0), np.int64)
        crowded, last = None, None
        for b in batches:
            now = np.stack([np.asarray(b.column(k)) for k in range(3)])
            new = np.ones(now.shape[1], bool)
            new[1:] = (now[:, 1:] != now[:, :-1]).any(0)
            if now.shape[1] and last is not None:
                new[0] = (now[:, 0] != last).any()  # copies of a text have equal windows
            if now.shape[1]:
                last = now[:, -1]
            held = np.concatenate((held, now[:, new]), 1)
            if crowded is not None:
                more = int(np.searchsorted(held[0] != crowded, True))
                if more:
                    yield out(slice(0, more), held[1], held[2], np.full(more, crowded), np.ones(more, bool))
                held = held[:, more:]
                crowded = None if held.shape[1] else crowded
            if held.shape[1] < 400_000:
                continue
            cut_ = int(np.flatnonzero(held[0] != held[0, -1])[-1]) + 1 if held[0, 0] != held[0, -1] else 0
            if cut_:
                yield from settle(*held[:, :cut_])
                held = held[:, cut_:]
            if held.shape[1] >= 400_000 and len(np.unique(held[1])) > few:
                crowded = held[0, -1]
                yield out(slice(None), held[1], held[2], held[0], np.ones(held.shape[1], bool))
                held = held[:, :0]
        if held.shape[1]:
            yield from settle(*held)

    return run


# --- pieces of text ------------------------------------------------------------------------------------------

PIECES = "kind byte, group long, digest long, node long, low long, high long, start long, length long, piece binary"


def pieces(width: int):
    """For mapInArrow over (node, mark, low, high, text), the text first, sorted by node: the pieces of text to compare.

    kind 0: a pair's, overlapping windows united; 1: a crowded key's, where a piece that this batch has for the key
    already comes without its bytes; 2: a whole text that several documents have, length shingles long."""

    def settle(rows: pa.Table):
        node, mark, low, high = (np.asarray(rows.column(k)) for k in ("node", "mark", "low", "high"))
        first = np.flatnonzero(np.diff(node, prepend=node[0] ^ 1) != 0)
        last = np.append(first[1:], len(node))
        text = rows.column("text")
        least = np.minimum.reduceat(np.where(mark < 0, low, np.iinfo(np.int64).max), first)
        most = np.maximum.reduceat(np.where(mark < 0, high, np.iinfo(np.int64).min), first)
        found: dict[str, list] = {k: [] for k in ("kind", "group", "digest", "node", "low", "high", "start", "length", "piece")}
        seen: set = set()
        for k in np.flatnonzero((most > least) | (mark[last - 1] >= 0)):
            a, z = int(first[k]), int(last[k])
            has = a
            while has < z and text[has].as_py() is None:
                has += 1
            raw = text[has].as_py().encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = words(np.array([0, len(data)]), data)
            total = len(starts) - SIZE + 1
            begin = a + int((mark[a:z] < 0).sum())
            m = mark[begin:z]
            at = m >> 17
            lo, hi = at - (m >> 9 & 255), at + (m >> 1 & 255)
            crowded, group = m & 1 == 1, low[begin:z]
            put = [(2, 0, 0, 0, total, b"")] if most[k] > least[k] and total >= width else []
            own = np.flatnonzero(~crowded)
            if len(own):
                own = own[np.lexsort((lo[own], group[own]))]
                g, x, y = group[own], lo[own], hi[own]
                same = np.concatenate(([False], g[1:] == g[:-1]))
                # the furthest end so far, within the group: ends are less than total
                step = np.cumsum(~same) * (total + 1)
                reach = np.maximum.accumulate(y + step) - step
                open_ = ~same | (x > np.concatenate(([0], reach[:-1])) + 1)
                head = np.flatnonzero(open_)
                tail = np.append(head[1:], len(own)) - 1
                for i, j in zip(head.tolist(), tail.tolist()):
                    p, q = int(x[i]), int(reach[j])
                    put.append((0, int(g[i]), 0, p, q - p + 1, raw[starts[p] : ends[q + SIZE - 1]]))
            for i in np.flatnonzero(crowded).tolist():
                p, q = int(lo[i]), int(hi[i])
                piece = raw[starts[p] : ends[q + SIZE - 1]]
                digest = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                mine = (int(group[i]), digest, int(least[k]), int(most[k]))
                put.append((1, int(group[i]), digest, p, q - p + 1, None if mine in seen else piece))
                seen.add(mine)
            for kind, g, digest, start, length, piece in put:
                for name, v in zip(found, (kind, g, digest, int(node[a]), int(least[k]), int(most[k]), start, length, piece)):
                    found[name].append(v)
        if found["kind"]:
            kinds = {"kind": pa.int8(), "piece": pa.binary()}
            yield batch(**{name: pa.array(v, kinds.get(name, pa.int64())) for name, v in found.items()})

    return by_runs("node", settle, 20_000, 8 << 20)


def by_runs(name, settle, most_rows: int, most_bytes: int):
    """For mapInArrow over rows sorted by the columns `name`: settle(table) of so many rows or bytes, in whole runs."""
    names = (name,) if isinstance(name, str) else name

    def run(batches):
        held: list = []
        rows = size = 0
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                held.append(part)
                rows += part.num_rows
                size += part.get_total_buffer_size() if k == 0 else 0
                if rows < most_rows and size < most_bytes:
                    continue
                t = pa.Table.from_batches(held)
                keys = [np.asarray(t.column(c)) for c in names]
                other = np.logical_or.reduce([c != c[-1] for c in keys])
                cut_ = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if cut_:
                    yield from settle(t.slice(0, cut_).combine_chunks())
                    held = t.slice(cut_).combine_chunks().to_batches()
                    rows, size = t.num_rows - cut_, 0
        if rows:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return run


# --- comparison of words -------------------------------------------------------------------------------------


def spread(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """at[k], at[k] + 1, ..., `length[k]` numbers for each k."""
    return np.repeat(at - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def covered(stretches: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places lie in a stretch of `width` from one of these starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, stretches, 1)
    np.add.at(edge, stretches + width, -1)
    return np.cumsum(edge)[:n] > 0


def _stretches(mark, many, there, piece, width, need, places):
    """Starts of stretches within one piece of which `need` shingles stand within one stretch of the other side.

    there: where on the other side a marked shingle stands first; many: it stands several times on one of the sides, so that it counts
    as often as both stretches have it. places: see _anywhere; the last are the places on this side."""
    total = np.concatenate(([0], np.cumsum(mark)))
    near = np.flatnonzero((total[width:] - total[:-width] >= need) & (piece[: len(piece) - width + 1] == piece[width - 1 :]))
    if not len(near):
        return near
    several = np.concatenate(([0], np.cumsum(many & mark)))
    several = several[near + width] > several[near]
    rest, ok = near[~several], []
    spots = np.where(mark, there, _FAR)
    if len(rest):
        low = sliding(spots, width)[rest]
        high = _FAR - sliding(np.where(mark, _FAR - there, _FAR), width)[rest]
        ok.append(rest[high - low < width])
        rest = rest[high - low >= width]
    for k in range(0, len(rest), 8192):
        at = rest[k : k + 8192]
        p = np.sort(spots[at[:, None] + np.arange(width)], 1)
        hit = (p[:, need - 1 :] - p[:, : width - need + 1] < width) & (p[:, need - 1 :] < _FAR)
        ok.append(at[hit.any(1)])
    rest = near[several]
    if len(rest):
        # neither way has more than the shingles of a stretch that the other side has as often
        rest = rest[_at_most(mark, piece, width, *places[:3])[rest] >= need]
        straight = _straight(rest, mark, many, there, piece, width, need, *places)
        ok.append(rest[straight])
        rest = rest[~straight]
        ok.append(rest[_anywhere(rest, mark, piece, width, need, *places[:-1])])
    return np.concatenate(ok)


def _at_most(mark, piece, width, group, begin, count):
    """Of each stretch how many of its shingles the whole other side has, each counted as often as it stands there."""
    at = np.flatnonzero(mark)
    order = at[np.argsort(group[at], kind="stable")]  # of each shingle its places on this side, ascending
    n, g = len(mark), group[order]
    later = np.arange(len(order)) + count[g]
    # in a stretch that reaches the place so many occurrences later, this one is one too many
    same = later < len(order)
    same[same] = (g[later[same]] == g[same]) & (piece[order[later[same]]] == piece[order[same]])
    end = order + 1
    end[same] = np.minimum(end[same], order[later[same]] - width + 1)
    first = np.maximum(order - width + 1, 0)
    keep = end > first
    edge = np.bincount(first[keep], minlength=n + 1) - np.bincount(end[keep], minlength=n + 1)
    return np.cumsum(edge)[: max(0, n - width + 1)]


def _straight(starts, mark, many, there, piece, width, need, group, begin, count, place, own):
    """Which of the stretches from these starts have `need` shingles on the other side at one distance from their own places: found without
    trying all."""
    sure = np.flatnonzero(mark & ~many)
    if not len(sure) or not len(starts):
        return np.zeros(len(starts), bool)
    last = np.maximum(np.searchsorted(sure, np.arange(len(mark)), "right") - 1, 0)
    shift = (there - own)[sure[last]]  # as the last shingle that stands once on both sides
    steady = np.concatenate(([0], np.cumsum((np.diff(shift) != 0) | (np.diff(piece) != 0))))
    asked = np.flatnonzero(mark & covered(starts, len(mark), width))
    at, group = (own + shift)[asked], group[asked]
    low, high = begin[group], begin[group] + count[group]
    end = high.copy()
    while (low < high).any():  # bisection of each shingle's places
        mid = (low + high) // 2
        right = (low < high) & (place[np.minimum(mid, len(place) - 1)] < at)
        high = np.where((low < high) & ~right, mid, high)
        low = np.where(right, mid + 1, low)
    met = np.zeros(len(mark) + 1, np.int64)
    met[asked[(low < end) & (place[np.minimum(low, len(place) - 1)] == at)] + 1] = 1
    total = np.cumsum(met)
    return (total[starts + width] - total[starts] >= need) & (steady[starts] == steady[starts + width - 1])


def _anywhere(at, mark, piece, width, need, group, begin, count, place):
    """Which stretches have `need` shingles within one stretch of the other side, if each may stand at any of its places there.

    A stretch that starts a place later has one more or one fewer at most, so a stretch that has many more or fewer than `need` decides
    those around it as well: every STRIDE-th of a run is counted first, and what is still open at half the distance, to every one."""
    known = np.zeros(len(at), np.int8)  # 1 or -1 where it is known
    at_ = at + piece[at] * _FAR  # stretches of two pieces are far from each other
    order = np.argsort(at_)
    ranked = at_[order]
    step = STRIDE
    while step:
        ask = np.flatnonzero((known[order] == 0) & (at[order] % step == 0))
        if len(ask):
            most = _most(at[order[ask]], mark, width, group, begin, count, place)
            side = np.where(most >= need, 1, -1)
            span = np.where(most >= need, most - need, need - most - 1)
            low, high = np.searchsorted(ranked, ranked[ask] - span), np.searchsorted(ranked, ranked[ask] + span, "right")
            flat = order[spread(low, high - low)]
            known[flat] = np.repeat(side, high - low)
        step //= 2
    return known > 0


def _most(at, mark, width, group, begin, count, place):
    """How many shingles of each stretch stand within one stretch of the other side, if each may stand at any of its places there.

    group: the shingle of each place; begin, count: its places within `place`, which ascend. A shingle at x stands in the stretches
    that start from x - width + 1 to x. The starts that each shingle allows are counted, one that this stretch has n times up to n
    times, and the most allowed start decides."""
    out = np.zeros(len(at), np.int64)
    size = np.concatenate(([0], np.cumsum(np.where(mark, count[group], 0))))
    size = np.cumsum(size[at + width] - size[at])
    k = 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + EVENTS, "right")))
        flat = at[k:end, None] + np.arange(width)
        own, which = np.nonzero(mark[flat])
        key, times = np.unique(own * len(begin) + group[flat[own, which]], return_counts=True)
        own, shingle = key // len(begin), key % len(begin)
        n = count[shingle]
        x = place[spread(begin[shingle], n)]
        nth = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        own, times = np.repeat(own, n), np.repeat(times, n)
        before = np.where(nth >= times, x[np.maximum(np.arange(len(x)) - times, 0)], -_FAR)  # so many places on, this one is one too many
        start = np.maximum(x - width + 1, before + 1)
        when, change = np.concatenate((start, x + 1)), np.repeat((1, -1), len(x))
        who = np.concatenate((own, own))
        order = np.lexsort((change, when, who))  # what ends goes before what begins
        level = np.cumsum(change[order])  # 0 again after each stretch
        if len(level):
            who = who[order]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            out[k + who[first]] = np.maximum.reduceat(level, first)
        k = end
    return out


def compared(a: tuple, b: tuple, width: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of a and of b lie in a passage that both have. a, b: (shingle, pair, place, piece) arrays, places of a pair ascending."""
    n = len(a[0])
    pair = np.concatenate((a[1], b[1])).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = mix(np.concatenate((a[0], b[0])) + mix(pair + np.uint64(9)))
    order = np.argsort(code, kind="stable")  # of equal ones those of a come first
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, bool), np.zeros(0, bool)
    size = np.diff(np.append(first, len(code)))
    of_b = np.add.reduceat((order >= n).astype(np.int64), first)
    of_a = size - of_b
    both = (of_a > 0) & (of_b > 0)
    place = np.concatenate((a[2], b[2]))[order]
    there = np.zeros((2, len(first)), np.int64)
    there[0, both] = place[(first + of_a)[both]]
    there[1, both] = place[first[both]]
    group = np.empty(len(code), np.int64)
    group[order] = np.repeat(np.arange(len(first)), size)
    out = []
    several = (of_a > 1) | (of_b > 1)
    sides = ((0, group[:n], of_b, first + of_a, a[2], a[3]), (1, group[n:], of_a, first, b[2], b[3]))
    for side, g, count, begin, own, piece in sides:
        places = (g, begin, count, place, own)
        at = _stretches(both[g], several[g], there[side][g], piece, width, need, places) if len(g) >= width else np.zeros(0, np.int64)
        out.append(covered(at, len(g), width))
    return out[0], out[1]


def runs_of(cover: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each covered run within one piece."""
    on = np.flatnonzero(cover)
    cut_ = (np.diff(on) > 1) | (np.diff(piece[on]) != 0)
    return on[np.concatenate(([True], cut_))] if len(on) else on, on[np.concatenate((cut_, [True]))] if len(on) else on


def hashed_pieces(column_) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of binary pieces of text, and the first of each piece."""
    parts, sizes = [], []
    for _, offsets, data in steps(column_.cast(pa.string())):
        starts, ends, first = words(offsets, data)
        sh, begin = shingles(word_hashes(starts, ends, data), first, SIZE)
        parts.append(sh)
        sizes.append(np.diff(begin))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def other_document(low, high, i, j) -> np.ndarray:
    """Whether rows i and j have two documents between them."""
    return (low[i] != low[j]) | (high[i] != high[j]) | (low[i] != high[i])


def pairs_compared(width: int, need: int):
    """For mapInArrow over kind 0 sorted by (group, node, start): (node, start, end, match, last) of passages in common."""

    def settle(rows: pa.Table):
        group, node, low, high, start = (np.asarray(rows.column(k)) for k in ("group", "node", "low", "high", "start"))
        sh, begin = hashed_pieces(rows.column("piece"))
        pair = np.cumsum(np.diff(group, prepend=group[0]) != 0)
        head = np.flatnonzero(np.diff(group, prepend=group[0] ^ 1) != 0)
        tail = np.append(head[1:], len(group)) - 1
        side = node != node[head][pair]
        differ = other_document(low, high, head, tail)[pair]
        piece = np.repeat(np.arange(len(group)), np.diff(begin))
        place = np.arange(len(sh)) - begin[:-1][piece] + start[piece]
        sides = []
        for s in (False, True):
            at = np.flatnonzero(((side == s) & differ)[piece])
            sides.append((sh[at], pair[piece[at]], place[at], piece[at]))
        for me, cover in zip(sides, compared(*sides, width, need)):
            x, y = runs_of(cover, me[3])
            row = me[3][x]
            other = np.where(side[row], head[pair[row]], tail[pair[row]])
            yield batch(
                node=pa.array(node[row]), start=pa.array(me[2][x]), end=pa.array(me[2][y] + 1),
                match=pa.array(low[other]), last=pa.array(high[other]),
            )

    return by_runs("group", settle, 20_000, 2 << 20)


class Crowd:
    """Rows of crowded keys: which of their shingles lie in a passage that another document has under the same key.

    seg: the key (or block of one) of each row; home: rows of one home (0 or more) have met before; asks: rows that still look for others."""

    def __init__(self, seg, low, high, sh, begin, width, need, home=None, asks=None, cover=None):
        self.seg, self.low, self.high, self.sh, self.begin, self.width, self.need = seg, low, high, sh, begin, width, need
        n = len(seg)
        self.home = np.full(n, -1) if home is None else home
        self.asks = np.ones(n, bool) if asks is None else asks
        self.length = np.diff(begin)
        self.row = np.repeat(np.arange(n), self.length)
        self.cover = np.zeros(len(sh), bool) if cover is None else cover
        self.match, self.last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        self.code = mix(sh + mix(seg.astype(np.uint64) + np.uint64(5))[self.row])
        whole = self.row[: max(0, len(sh) - width + 1)] == self.row[width - 1 :]
        self.starts = np.flatnonzero(whole)  # of all stretches

    def note(self, rows, partner, top):
        np.minimum.at(self.match, rows, partner)
        np.maximum.at(self.last, rows, top)

    def equal(self):
        """Passages that are equal word by word, of all rows at once."""
        own = np.flatnonzero((self.low != self.high) & (self.length >= self.width))  # equal pieces in several documents
        self.cover[spread(self.begin[own], self.length[own])] = True
        self.note(own, self.low[own], self.high[own])
        if not len(self.starts):
            return
        n = len(self.sh)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(n, _RADIX, np.uint64))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.code) * power)))
            power = np.multiply.accumulate(np.full(n, pow(_RADIX, -1, 1 << 64), np.uint64))
            code = mix((total[self.starts + self.width] - total[self.starts]) * power[self.starts])
        order = np.argsort(code)
        row = self.row[self.starts[order]]
        code = code[order]
        at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        size = np.diff(np.append(at, len(code)))
        least, most = np.minimum.reduceat(self.low[row], at), np.maximum.reduceat(self.high[row], at)
        ok = np.repeat(least < most, size)
        self.cover |= covered(self.starts[order[ok]], n, self.width)
        self.note(row[ok], np.repeat(least, size)[ok], np.repeat(most, size)[ok])

    def support(self):
        """Of each shingle how many rows of its key hold it, and whether two documents do."""
        self.order = np.argsort(self.code)
        code = self.code[self.order]
        self.at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        self.often = np.diff(np.append(self.at, len(code)))
        row = self.row[self.order]
        shared = np.minimum.reduceat(self.low[row], self.at) < np.maximum.reduceat(self.high[row], self.at)
        self.group = np.empty(len(code), np.int64)
        self.group[self.order] = np.repeat(np.arange(len(self.at)), self.often)
        self.held = shared[self.group]
        self.sign = np.zeros((len(self.seg), SIGNS), bool)
        self.sign[self.row, self.group % SIGNS] = True
        total = np.concatenate(([0], np.cumsum(self.held)))
        # no passage has fewer shingles than `need` in another document
        self.starts = self.starts[total[self.starts + self.width] - total[self.starts] >= self.need]

    def open(self):
        """Starts of stretches that could match and are not covered yet."""
        total = np.concatenate(([0], np.cumsum(self.cover)))
        at = self.starts
        return at[(total[at + self.width] - total[at] < self.width) & self.asks[self.row[at]]]

    def likely(self, i, j):
        """Which pairs could match, by the signs of the shingles of j: no others have a stretch of i with `need` shingles of j, in any order,
        and without one no stretch of j has as many of i."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 6000):
            r, other = i[k : k + 6000], j[k : k + 6000]
            at, pair = spread(self.begin[r], self.length[r]), np.repeat(np.arange(len(r)), self.length[r])
            total = np.concatenate(([0], np.cumsum(self.sign[other[pair], self.group[at] % SIGNS] & self.held[at])))
            first = np.cumsum(self.length[r]) - self.length[r]
            out[k : k + 6000] = (self.length[r] < self.width) & (total[first + self.length[r]] - total[first] >= self.need)
            near = np.flatnonzero(total[self.width :] - total[: -self.width] >= self.need)
            out[k + pair[near[pair[near] == pair[near + self.width - 1]]]] = True
        return out

    def compare(self, i, j):
        ok = (i != j) & other_document(self.low, self.high, i, j) & ((self.home[i] != self.home[j]) | (self.home[i] < 0))
        i, j = i[ok], j[ok]
        for x, y in ((0, 1), (1, 0)):
            ok = self.likely((i, j)[x], (i, j)[y])
            i, j = i[ok], j[ok]
        for k in range(0, len(i), 6000):
            x, y = i[k : k + 6000], j[k : k + 6000]
            sides, flat = [], []
            for r in (x, y):
                at, pair = spread(self.begin[r], self.length[r]), np.repeat(np.arange(len(r)), self.length[r])
                sides.append((self.sh[at], pair, at - self.begin[r][pair], pair))
                flat.append(at)
            for me, at, cover, own, other in zip(sides, flat, compared(*sides, self.width, self.need), (x, y), (y, x)):
                self.cover[at[cover]] = True
                hit = np.unique(me[1][cover])
                self.note(own[hit], self.low[other[hit]], self.high[other[hit]])

    def typical(self):
        """What is open against the row of its key that has most in common with all; again for those still open."""
        score = np.bincount(self.row, self.often[self.group] * self.held, len(self.seg))
        used = np.zeros(len(self.seg), bool)
        for k in range(ROUNDS):
            rows = np.unique(self.row[self.open()])
            if not len(rows):
                return
            pool = rows[~used[rows]] if k else np.flatnonzero(np.isin(self.seg, self.seg[rows]))
            pool = pool[np.lexsort((score[pool], self.seg[pool]))]
            hub = pool[np.flatnonzero(np.diff(np.append(self.seg[pool], -1)) != 0)] if len(pool) else pool
            used[hub] = True
            of = np.full(int(self.seg.max()) + 1, -1)
            of[self.seg[hub]] = hub
            rows = rows[of[self.seg[rows]] >= 0]
            self.compare(rows, of[self.seg[rows]])

    def rarest(self):
        """What is still open against all rows that share one of its rarest shingles.

        A match shares `need` of a stretch's shingles, so at least one of any width - need + 1 of them; those that no
        other document holds are surely among the others."""
        at = self.open()
        if not len(at):
            return
        miss = self.width - self.need + 1
        wanted = []
        for k in range(0, len(at), 8192):
            flat = at[k : k + 8192, None] + np.arange(self.width)
            often = np.where(self.held[flat], self.often[self.group[flat]], 0)  # those alone go first, and ask nothing
            best = np.argsort(often, 1, kind="stable")[:, :miss]
            rare = np.take_along_axis(flat, best, 1)[np.take_along_axis(often, best, 1) > 0]
            wanted.append(np.unique(self.row[rare] << 32 | self.group[rare]))
        wanted = np.unique(np.concatenate(wanted))
        size = self.often[wanted & 0xFFFFFFFF]
        order = np.argsort(size, kind="stable")
        wanted, size = wanted[order], size[order]
        total = np.concatenate(([0], np.cumsum(size)))
        done = np.zeros(0, np.int64)
        k = 0
        while k < len(wanted):
            end = max(k + 1, int(np.searchsorted(total, total[k] + SHARE, "right")) - 1)
            row, group = wanted[k:end] >> 32, wanted[k:end] & 0xFFFFFFFF
            still = np.isin(row, self.row[self.open()])
            row, group = row[still], group[still]
            other = self.row[self.order[spread(self.at[group], self.often[group])]]
            pair = np.unique(np.repeat(row, self.often[group]) << 32 | other)
            pair = pair[~np.isin(pair, done, assume_unique=True)]
            done = np.union1d(done, pair)[-4 * SHARE :]  # only spares work
            self.compare(pair >> 32, pair & 0xFFFFFFFF)
            k = end

    def settle(self):
        if len(self.sh):
            self.equal()
            self.support()
            self.typical()
            self.rarest()
        return self


FOUND = "group long, digest long, start long, end long, match long, last long"


def crowds_compared(width: int, need: int):
    """For mapInArrow over kind 1 sorted by (group, block): (group, digest, start, end, match, last), places from the piece's first."""

    def settle(rows: pa.Table):
        group, block, digest, low, high = (np.asarray(rows.column(k)) for k in ("group", "block", "digest", "low", "high"))
        seg = np.cumsum((np.diff(group, prepend=group[0]) != 0) | (np.diff(block, prepend=block[0]) != 0))
        sh, begin = hashed_pieces(rows.column("piece"))
        more = {k: np.asarray(rows.column(k)) for k in ("home", "asks") if k in rows.column_names}
        c = Crowd(seg, low, high, sh, begin, width, need, **more).settle()
        x, y = runs_of(c.cover, c.row)
        row = c.row[x]
        yield batch(
            group=pa.array(group[row]), digest=pa.array(digest[row]), start=pa.array(x - begin[row]), end=pa.array(y + 1 - begin[row]),
            match=pa.array(c.match[row]), last=pa.array(c.last[row]),
        )

    return by_runs(("group", "block"), settle, 10_000, 6 << 20)


def coded(batches):
    """For mapInArrow: (group, digest, low, high, place, code) of each shingle of (group, digest, low, high, piece)."""
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            sh, begin = hashed_pieces(part.column(4))
            row = np.repeat(np.arange(part.num_rows), np.diff(begin))
            group = np.asarray(part.column(0)).view(np.uint64)
            code = mix(sh + mix(group)[row]).view(np.int64)
            own = pa.array(row)
            yield batch(
                group=part.column(0).take(own), digest=part.column(1).take(own), low=part.column(2).take(own), high=part.column(3).take(own),
                place=pa.array((np.arange(len(sh)) - begin[:-1][row]).astype(np.int32)), code=pa.array(code),
            )


def unsettled(width: int, need: int):
    """For mapInArrow: (group, digest, code) of rows (group, digest, places, spans) with a stretch that other documents could match and none
    covers: its rarest shingles. places: (place, code, often) of the shingles that two documents hold.

    A match has one of any width - need + 1 shingles of the stretch, and those that no other document holds are among the others."""
    miss = width - need + 1

    def wanted(places, spans):
        place, code, often = (np.array(c, np.int64) for c in zip(*((p["place"], p["code"], p["often"]) for p in places)))
        n = int(place.max()) + 1
        held, cover = np.zeros(n + width, np.int64), np.zeros(n + width, np.int64)
        held[place] = often
        for s in spans or ():
            cover[s["start"] : s["end"]] = 1
        total, done = (np.concatenate(([0], np.cumsum(v))) for v in (held > 0, cover))
        at = np.flatnonzero((total[width:] - total[:-width] >= need) & (done[width:] - done[:-width] < width))
        flat = at[:, None] + np.arange(width)
        rare = np.take_along_axis(flat, np.argsort(held[flat], 1, kind="stable")[:, :miss], 1)  # those alone go first, and ask nothing
        return np.unique(code[np.isin(place, rare[held[rare] > 0])])

    def run(batches):
        for b in batches:
            codes = [wanted(places, spans) for places, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            if codes:
                own = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
                yield batch(group=b.column(0).take(own), digest=b.column(1).take(own), code=pa.array(np.concatenate(codes)))

    return run


def across(placed: DataFrame, found: DataFrame, width: int, need: int) -> DataFrame:
    """What rows of keys of several blocks have in common with other blocks' rows.

    Only rows that could still match look for others: which of their shingles two documents of the key hold is counted over the
    whole key. Of the other rows those come that hold one of the rarest shingles looked for; all of these are dealt to blocks anew, and
    met in pairs of blocks."""
    many = placed.where("blocks > 1")
    codes = many.select("group", "digest", "low", "high", "piece").mapInArrow(coded, "group long, digest long, low long, high long, place int, code long")
    shared = codes.groupBy("code").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("often")).where("least < most").select("code", "often")
    held = cut(codes.select("group", "digest", "place", "code").join(shared, "code"))
    places = held.groupBy("group", "digest").agg(F.collect_list(F.struct("place", "code", "often")).alias("places"))  # a piece's own
    spans = found.groupBy("group", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    wanted = cut(places.join(spans, ["group", "digest"], "left").mapInArrow(unsettled(width, need), "group long, digest long, code long"))
    open_ = wanted.select("group", "digest", F.lit(True).alias("asks")).distinct()
    near = held.join(wanted.select("code").distinct(), "code").select("group", "digest").distinct()  # those that ask among them
    rows = many.join(near, ["group", "digest"]).join(open_, ["group", "digest"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    rows = cut(rows.select("group", "digest", "low", "high", "piece", "block", "asks"))
    parts = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(1)), "parts").cast("int"))
    asked = rows.where("asks").select("group", F.col("part").alias("other"), F.lit(True).alias("any")).distinct()
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.join(asked, ["group", "other"], "left").where("asks or any")
    # within a part those of one block have met, and in two parts those of one part meet elsewhere
    home = F.when(F.col("part") == F.col("other"), F.col("block")).otherwise(F.col("part"))
    block = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    met = met.select("group", block.alias("block"), "digest", "low", "high", "piece", home.alias("home"), "asks")
    sorted_ = met.repartition(slots(placed.sparkSession), "group", "block").sortWithinPartitions("group", "block")
    return sorted_.mapInArrow(crowds_compared(width, need), FOUND)


# --- the operator --------------------------------------------------------------------------------------------


def merged(batches):
    """For mapInArrow: passages (node, start_word, end_word, n_words, match, last) of (node, spans)."""
    for b in batches:
        rows: list[tuple] = []
        for node, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            now = None
            for s in sorted((x["start"], x["end"], x["match"], x["last"]) for x in spans):
                if now and s[0] <= now[1]:
                    now = [now[0], max(now[1], s[1]), min(now[2], s[2]), max(now[3], s[3])]
                else:
                    if now:
                        rows.append((node, *now))
                    now = list(s)
            if now:
                rows.append((node, *now))
        node, start, end, match, last = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        end = end + SIZE - 1
        yield batch(
            node=pa.array(node), start_word=pa.array(start), end_word=pa.array(end), n_words=pa.array(end - start),
            match=pa.array(match), last=pa.array(last),
        )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 50, threshold: float = 0.8, functions: int = 4) -> DataFrame:
    """One row per passage that another document repeats: doc_id, start_word, end_word (exclusive), n_words, match_doc_id.

    A passage is a stretch of at least `passage` words of which each stretch of that many has a Jaccard similarity of
    at least the threshold (of word 5-grams) to one in another document; match_doc_id is the smallest such document met.
    A 5-gram that repeats there counts once for each time the stretch has it, at the place that serves best. Passages that overlap are one row. Passages that
    only their own document repeats are not reported, so rows of one id and text are one document; rows without an id, null
    texts and texts shorter than a passage give nothing. Whole texts are read."""
    spark = docs.sparkSession
    width = passage - SIZE + 1
    need = int(np.ceil(2 * width * threshold / (1 + threshold) - 1e-9))
    scratch = Scratch(spark)
    base = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text")).where("doc_id is not null and text is not null")
    base = base.select(F.xxhash64("text").alias("node"), "doc_id", "text")
    seen = base.select("node", "text").mapInArrow(windows(width, functions), "key long, node long, mark long")
    seen = seen.repartition(slots(spark), "key").sortWithinPartitions("key", "node", "mark")
    met = seen.mapInArrow(joined_by_key(FEW), "node long, mark long, group long, crowded boolean")
    met = met.select("node", F.expr("mark * 2 + int(crowded)").alias("mark"), F.col("group").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(None).cast("string").alias("text"))
    met = scratch.save(met, "met")
    texts = base.mapInArrow(distinct_texts, "node long, low long, high long, text string")
    both = texts.select("node", F.lit(-1).cast("long").alias("mark"), "low", "high", "text").unionByName(met)
    both = both.repartition(slots(spark), "node").sortWithinPartitions("node", "mark")
    made = scratch.save(both.mapInArrow(pieces(width), PIECES), "pieces")
    scratch.drop("met")
    pairs = made.where("kind = 0").select("group", "node", "low", "high", "start", "piece")
    pairs = pairs.repartition(slots(spark), "group").sortWithinPartitions("group", "node", "start")
    spans = pairs.mapInArrow(pairs_compared(width, need), "node long, start long, end long, match long, last long")
    whole = made.where("kind = 2").select("node", "start", F.col("length").alias("end"), F.col("low").alias("match"), F.col("high").alias("last"))
    # pieces of crowded keys, each content once
    key = ["group", "digest"]
    least = made.where("kind = 1").groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    content = made.where("kind = 1 and piece is not null").groupBy(*key).agg(F.first("piece").alias("piece"))
    content = scratch.save(content.join(least, key), "contents")
    blocks = content.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = content.join(cut(blocks), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    rows = placed.select("group", "block", "digest", "low", "high", "piece").repartition(slots(spark), "group", "block")
    found = cut(rows.sortWithinPartitions("group", "block").mapInArrow(crowds_compared(width, need), FOUND))
    found = found.unionByName(across(placed, found, width, need))
    members = made.where("kind = 1").select("group", "digest", "node", F.col("start").alias("first"))
    crowd = members.join(found, key).select("node", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"), "match", "last")
    every = spans.unionByName(whole).unionByName(crowd).groupBy("node").agg(F.collect_list(F.struct("start", "end", "match", "last")).alias("spans"))
    passages = every.mapInArrow(merged, "node long, start_word long, end_word long, n_words long, match long, last long")
    out = base.select("node", "doc_id").distinct().join(passages, "node")
    partner = F.when(F.col("match") != F.col("doc_id"), F.col("match")).otherwise(F.col("last"))
    return out.select("doc_id", "start_word", "end_word", "n_words", partner.alias("match_doc_id"))
