"""Benchmark decontamination: pigeonhole seeds, hierarchical and exact edit verification.

Texts and items are compared in lower case with runs of anything but letters
and digits as one space.  A text is contaminated by an item if some part of it
has edit similarity ``SIMILARITY`` or more to the item: at most
(1 - SIMILARITY) * length edits.

1. Seeds.  An item of length L may have e = floor((1 - SIMILARITY) * L) edits.
   Cut into e + 1 pieces, at least one piece stands in the text unchanged:
   every place of a text where a piece of 3 to 5 bytes stands is a seed.
2. Hierarchy.  Adjacent pieces are joined by twos, fours and so on.  If j
   joined pieces have at most j - 1 edits, so has one half with its own count;
   so some seed leads up through joined pieces that all keep their bound, and
   seeds that break a bound on the way are dropped without any loss.
3. Verification.  Myers' bit-parallel algorithm finds the item's least edit
   distance to any part of the text around every seed that is left.

Nothing within the similarity is lost, wherever its edits are.  CGK walks with
bit sampling (``Walks``) lose matches and are no part of the search.

Items are broadcast in passes of at most ``ITEM_BYTES`` bytes.  Texts stay
where they are: nothing is shuffled.

Cases: null or blank texts and items match nothing; items under
``SHORT`` bytes must occur exactly, between word ends; long texts are read whole; repeated rows
and null ids get a result each; equal items are reported for each of their
ids; empty tables give no hits; other columns are kept or ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
SHORT = 12
#: Independent walks, samplings of each walk's embedding, places in a sampling.
WALKS, REPEATS, SAMPLED = 6, 32, 3
ITEM_BYTES = 8_000_000
#: Places of a text that are looked up at once, and zeros around the texts.
SLICE, PAD = 1 << 14, 192
#: Joined pieces that are tried before the whole item.
JOINED = (4, 8, 16, 32, 64)
_C0 = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, and the place of each in ``data``."""
    x = _FOLD[data]
    keep = np.ones(len(x), bool)
    space = x == 32
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return x[at], at


def distance(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Least edit distance (at most ``most``) of ``pattern`` to any part of ``text``, and where that part ends."""
    m = len(pattern)
    if (at := text.find(pattern)) >= 0:
        return 0, at + m
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # free start in the text
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Walks:
    """CGK embeddings: a random step or stay for each place of a walk and byte.

    A single walk may lose its way and never meet again, so there are several.
    """

    def __init__(self, longest: int):
        rng = np.random.default_rng(23)
        self.length = 2 * longest
        self.steps = rng.integers(0, 2, (WALKS, self.length, 256), dtype=np.uint8)

    def signatures(self, windows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(n, WALKS * REPEATS) sampled bytes of the embeddings.

        ``windows`` (n, w) hold ``lengths`` bytes each and zeros after;
        ``sizes`` are the lengths of the items, whose doubles are sampled.
        """
        n, w = windows.shape
        padded = np.zeros((w + 1, n), np.uint8)
        padded[:w] = windows.T
        flat, rows = padded.ravel(), np.arange(n)
        walked = np.empty((self.length, n), np.uint8)
        out = np.zeros((n, WALKS * REPEATS), np.uint32)
        last = 2 * int(sizes.max(initial=0))
        rng = np.random.default_rng(29)
        for k in range(WALKS):
            at = np.zeros(n, np.int64)
            for j in range(last):
                c = flat[at * n + rows]
                walked[j] = c
                at += self.steps[k, j][c]
                np.minimum(at, lengths, out=at)
            share = rng.random((REPEATS, SAMPLED))
            for r in range(REPEATS):
                for s in range(SAMPLED):
                    place = (share[r, s] * 2 * sizes).astype(np.int64)
                    out[:, k * REPEATS + r] = out[:, k * REPEATS + r] << np.uint32(8) | walked[place, rows]
        return out


class Items:
    """Benchmark items ready for look-up: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.ids, self.texts, self.short = [], [], []
        for item_id, text in items:
            x = normal(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip()
            if len(x) >= SHORT:
                self.ids.append(item_id)
                self.texts.append(x)
            elif x:
                self.short.append((item_id, x))
        self.lengths = np.array([len(x) for x in self.texts], np.int64)
        self.most = np.floor((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        count = self.most + 1
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.item = np.repeat(np.arange(len(count)), count)
        length, count = self.lengths[self.item], count[self.item]
        bound = lambda k: np.minimum(k, count) * length // np.maximum(count, 1)
        self.start, end = bound(piece), bound(piece + 1)
        base = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.concatenate([np.zeros(PAD, np.uint8), *(np.frombuffer(x, np.uint8) for x in self.texts), np.zeros(PAD, np.uint8)])
        self.base = base[self.item] + PAD
        self.size = np.minimum(end - self.start, 8)
        ahead, back = eights(self.bytes)
        # the other piece of each pair, read away from this one
        even = piece % 2 == 0
        low, high = np.where(even, end, bound(piece - 1)), np.where(even, bound(piece + 2), self.start)
        other = np.minimum(high - low, 7)  # one byte more of the text must fit a word
        self.other = np.where(even, ahead[self.base + low], back[self.base + self.start]) & MASK[other]
        self.mask = MASK[other]
        self.even, self.step = even, np.where(even, end - self.start, 0)
        self.joined = []
        for j in JOINED:
            # less than half a group at the end goes to the group before it
            last = np.maximum((count + j // 2) // j, 1) - 1
            group = np.minimum(piece // j, last)
            first, after = group * j, np.where(group == last, count, group * j + j)
            a, b = bound(first), bound(after)
            self.joined.append((a, b - a, after - first - 1))
        # pieces by size and hash
        code = ahead[self.base + self.start] & MASK[self.size]
        self.bits = max(16, int(len(code)).bit_length() + 4)
        self.tables = []
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            slot = slots(code[own], self.bits)
            order = np.argsort(slot, kind="stable")
            n = np.bincount(slot, minlength=1 << self.bits)
            self.tables.append((MASK[size], own[order], code[own[order]], n.astype(np.int32), np.cumsum(n) - n))

    @cached_property
    def walks(self) -> Walks:
        return Walks(int(self.lengths.max(initial=1)))

    @cached_property
    def signatures(self) -> np.ndarray:
        wide = np.zeros((len(self.texts), int(self.lengths.max(initial=1))), np.uint8)
        for k, x in enumerate(self.texts):
            wide[k, : len(x)] = np.frombuffer(x, np.uint8)
        return self.walks.signatures(wide, self.lengths, self.lengths)


#: The lowest n bytes of a word.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def slots(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * _C0) >> np.uint64(64 - bits)).view(np.int64)


def eights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each place on, and the eight before it, nearest first; both as long as ``x``."""
    y = np.concatenate([np.zeros(8, np.uint8), x, np.zeros(8, np.uint8)])
    word = np.ndarray((len(x) + 9,), "<u8", y, 0, (1,))
    return word[8 : 8 + len(x)].copy(), word[: len(x)].byteswap()


def one_edit(text: np.ndarray, piece: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether ``piece`` (its bytes under ``mask``) begins the text with at most one edit."""
    seven, eight = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(8)
    differ = (text ^ piece) & mask
    low = (((differ & seven) + seven) | differ) & ~seven
    low &= ~low + np.uint64(1)  # the top bit of the first byte that differs
    after = ~(low | (low - np.uint64(1)))
    out = (differ & after) == 0
    out |= ((text << eight) ^ piece) & mask & after == 0
    after = ~((low >> np.uint64(7)) - np.uint64(1))
    out |= ((text >> eight) ^ piece) & mask & after == 0
    return out


def near(items: Items, x: np.ndarray, piece: np.ndarray, zero: np.ndarray, join: int) -> np.ndarray:
    """Whether the joined pieces of each seed keep their bound around their own diagonal, on which the item starts at ``zero``."""
    start, length, most = (v[piece] for v in items.joined[join])
    width, band = int(length.max(initial=0)), int(most.max(initial=0))
    kind = np.uint8 if 2 * width + 2 * band < 256 else np.uint16
    out = np.empty(len(piece), bool)
    for lo in range(0, len(piece), 8192):
        own = slice(lo, lo + 8192)
        at, n = start[own], length[own]
        cols = np.arange(width)[:, None]
        pattern = np.where(cols < n, items.bytes[np.minimum((items.base[piece[own]] + at) + cols, len(items.bytes) - 1)], 0)
        wild = pattern == 0
        text = x[np.clip((zero[own] + at - band) + np.arange(width + 2 * band)[:, None], 0, len(x) - 1)]
        row = np.zeros((2 * band + 1, len(n)), kind)
        for i in range(width):
            new = row + ((text[i : i + 2 * band + 1] != pattern[i]) & ~wild[i])
            np.minimum(new[:-1], row[1:] + kind(1), out=new[:-1])
            d = 1
            while d <= 2 * band:  # bytes that only the text has, by doubling
                new[d:] = np.minimum(new[d:], new[:-d] + kind(d))
                d *= 2
            row = new
        out[own] = row.min(axis=0) <= most[own]
    return out


def seeds(items: Items, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, start) of where items may stand, starts as places in ``x``; no item within its edits is left out."""
    x = np.concatenate([np.zeros(PAD, np.uint8), x, np.zeros(PAD, np.uint8)])
    ahead, back = eights(x)
    kept_piece, kept_zero = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(PAD, len(x) - PAD, SLICE):
        own = ahead[lo : min(lo + SLICE, len(x) - PAD)]
        for mask, entries, codes, count, first in items.tables:
            code = own & mask
            slot = slots(code, items.bits)
            n = count[slot]
            at = np.flatnonzero(n)
            n = n[at]
            which = np.repeat(at, n)
            entry = np.arange(len(which)) + np.repeat(first[slot[at]] - (np.cumsum(n) - n), n)
            same = np.flatnonzero(codes[entry] == code[which])
            piece, at = entries[entry[same]], which[same] + lo
            beside = np.where(items.even[piece], ahead[at + items.step[piece]], back[at])
            good = np.flatnonzero(one_edit(beside, items.other[piece], items.mask[piece]))
            kept_piece.append(piece[good])
            kept_zero.append(at[good] - items.start[piece[good]])
    piece, zero = np.concatenate(kept_piece), np.concatenate(kept_zero)
    for join, j in enumerate(JOINED):
        # seeds of the same joined pieces and diagonal are one
        first = items.base[piece] + items.joined[join][0][piece]
        order = np.lexsort((zero, first))
        f, z = first[order], zero[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (z[1:] != z[:-1])
        piece, zero = piece[order[new]], zero[order[new]]
        good = near(items, x, piece, zero, join)
        piece, zero = piece[good], zero[good]
    return items.item[piece], zero - PAD


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, distance, start, end) of the nearest part of each text to each item within reach; bytes of ``data``."""
    x, place = normal(data)
    off = np.searchsorted(place, offsets)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    raw = x.tobytes()
    item, start = seeds(items, x)
    # the seed's document: a start may lie before it by the allowed edits, as may the end behind it
    docs = [np.searchsorted(off, np.clip(start + shift, 0, max(len(x) - 1, 0)), side="right") - 1 for shift in (-items.most[item], items.lengths[item] + items.most[item])]
    n = docs[1] - docs[0] + 1
    which = np.repeat(np.arange(len(item)), n)
    doc = docs[0][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    item, start = item[which], start[which]
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    # windows that overlap are searched as one
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > items.lengths[item[1:]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    for a, b in zip(heads[: len(doc)].tolist(), tails[: len(heads)].tolist(), strict=True):
        di, it = int(doc[a]), int(item[a])
        most, length, known = int(items.most[it]), int(items.lengths[it]), out.get((di, it))
        left = max(int(off[di]), int(start[a]) - most)
        right = min(int(off[di + 1]), int(start[b]) + length + most)
        if right - left < length - most or known and known[0] == 0:
            continue
        found = distance(items.texts[it], raw[left:right], most)
        if found and (known is None or found[0] < known[0]):
            end = left + found[1]
            out[di, it] = found[0], max(left, end - length), end
    for item_id, text in items.short:
        padded = b" " + text + b" "
        at = (b" " + raw + b" ").find(padded)
        while at >= 0:
            di = int(np.searchsorted(off, at, side="right")) - 1
            if at + len(text) <= off[di + 1] if di < len(off) - 1 else False:
                out.setdefault((di, ~item_id), (0, at, at + len(text)))
            at = (b" " + raw + b" ").find(padded, at + 1)
    result = []
    for (di, it), (far, a, b) in out.items():
        item_id = items.ids[it] if it >= 0 else ~it
        result.append((di, item_id, far, int(place[a]) - int(offsets[di]), int(place[b - 1]) + 1 - int(offsets[di])))
    return sorted(result)


def item_passes(benchmark: DataFrame, most: int = ITEM_BYTES) -> list[list[tuple[int, str]]]:
    """The items in groups of at most about ``most`` bytes."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // most)
    out = []
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        out.append([(r.i, r.t) for r in own.orderBy("i").collect()])
    return out


HITS_SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of contaminated documents; places count UTF-8 bytes."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(items))

        def run(batches, shared=shared):
            for b in batches:
                ids = b.column(0).to_pylist()
                data, off = common.text_buffers(b.column(1))
                for i, j in common.chunks(off):
                    found = matches(shared.value, data[off[i] : off[j]], off[i : j + 1] - off[i])
                    if found:
                        di, item, far, a, e = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i + k] for k in di], pa.int64()), pa.array(item, pa.int64()), pa.array(far, pa.int32()), pa.array(a, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

        part = d.mapInArrow(run, HITS_SCHEMA)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], HITS_SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    out = docs
    column = docs.columns.index("text")
    for items in item_passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(items))

        def run(batches, shared=shared):
            for b in batches:
                data, off = common.text_buffers(b.column(column))
                keep = np.ones(b.num_rows, bool)
                for i, j in common.chunks(off):
                    for found in matches(shared.value, data[off[i] : off[j]], off[i : j + 1] - off[i]):
                        keep[i + found[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark, sf_dir):
    return hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
