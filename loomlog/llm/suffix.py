"""Exact substring deduplication with enhanced suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
document with a smaller id, or earlier in the same one) is marked; overlapping
marks merge.  Texts are UTF-8 bytes and matches never cross documents.

A suffix array of a whole corpus cannot be sorted in one place, so suffixes are
first dealt out by content:

1. In each window of LENGTH bytes the least hash of a ``GRAM``-byte string is
   its *anchor*.  Equal windows have equal anchors at equal offsets.  Windows
   in a row with one anchor form a *stretch*; a stretch is described in some
   twenty packed bytes (anchor, digest of its bytes, place).
2. Stretches meet by anchor.  Of stretches with equal bytes all but the first
   are marked as wholes; tasks do so before the shuffle, too.  An anchor with
   only one distinct stretch is done with.
3. The texts of the few stretches that share an anchor but differ are sorted
   in both directions from the anchor, as suffixes and as reversed prefixes,
   with their common-prefix lengths.  These bound which windows can repeat at
   all; those are sorted as suffixes, and each interval of the sorted order with
   common prefixes of LENGTH or more is a set of equal windows, of which all
   but the first are marked.

Anchors in the middle of a very common passage have few distinct stretches.
At the passage's edges there is a stretch for each neighbour; where a task or a
bucket sees many, their windows are dealt out by their own hash instead, after
equal ones have been merged by the task, so no anchor's group is gathered.

``EnhancedSuffixArray`` is the same idea for one bounded buffer: it scans the
common prefixes with a stack, tests the intervals' left extensions and gives
all maximal repeats with all their occurrences; ``repeat_groups`` gives those
of a DataFrame's equal windows.

Cases: null, empty and short texts have no windows; rows that repeat a doc_id
with the same text are one document; texts that differ under one id are told
apart (and ordered) by a hash; null ids sort first; very long texts are
processed whole; an empty table gives no rows; other columns are kept or ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 100, 24
SPREAD = LENGTH - GRAM + 1  # places of an anchor in a window
FLUSH = 400_000  # stretches that a task gathers before it merges and sends them
HOT_TASK, HOT_BUCKET = 16, 512  # distinct stretches of an anchor from which its windows are dealt out by hash
_DIGEST, _WINDOW = common.SpanHash(101), common.SpanHash(102)

#: Packed columns. doc, th: the document; start: of the first window; run: windows; ao: anchor from start.
ENTRY = ("<u4", "<u8", "<i8", "<i4", "<u4", "u1", "u1")  # anchor, digest, doc, th, start, run (0: a hot anchor), ao
SPAN = ("<i8", "<i4", "<u4", "<u4")  # doc, th, start, bytes
PENDING = ("<i8", "<i4", "<u4", "u1", "u1", "<u4", "<u4", "u1")  # doc, th, start, run, ao, anchor, bucket, hot
CONTENT = ("<u4", "<i8", "<i4", "<u4", "u1", "u1")  # anchor, doc, th, start, run, ao; then the bytes
WINDOWS = ("<u8", "<u8", "<i8", "<i4", "<u4")  # two hashes, doc, th, start


def pack(columns, kinds, tail: bytes = b"") -> bytes:
    body = b"".join(np.ascontiguousarray(c, dtype=k).tobytes() for c, k in zip(columns, kinds, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + body + tail)


def unpack(blobs: list[bytes], kinds) -> tuple[list[np.ndarray], bytes]:
    """Columns of all blobs together, and their tails."""
    parts, tails = [[np.zeros(0, k)] for k in kinds], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for part, k in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
        tails.append(raw[at:])
    return [np.concatenate(p) for p in parts], b"".join(tails)


def stretches(data: np.ndarray, off: np.ndarray):
    """(start, run, anchor place, anchor hash, digest) of all stretches of the texts in ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    data = np.ascontiguousarray(data)
    g = n - GRAM + 1
    word = lambda at: np.ndarray((g,), "<u8", data, at, (1,))
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word(8) * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h += word(16) * np.uint64(0xA0761D6478BD642F)
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(29)
    bits = np.uint64(max(1, int(g - 1).bit_length()))
    v = (h >> bits) << bits
    v |= np.arange(g, dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    v = np.minimum(v[: n - LENGTH + 1], v[SPREAD - width :][: n - LENGTH + 1])
    place = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    last = np.zeros(n + 1, np.int32)
    np.add.at(last, np.maximum(off[1:] - (LENGTH - 1), off[:-1]), 1)
    np.add.at(last, off[1:], -1)
    valid = np.cumsum(last[: len(place)]) == 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    digest = _DIGEST.spans(_DIGEST.sums(data), start, end + LENGTH - 1)
    return start, end - start, place[start], h[place[start]], digest


def _later(keys: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """True for rows whose keys equal those of a row with a smaller place."""
    out = np.zeros(len(keys[0]), bool)
    if len(out) < 2:
        return out
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order][1:] == keys[0][order][:-1]
    among = np.zeros(len(out), bool)
    among[1:] |= same
    among[:-1] |= same
    few = order[among]
    few = few[np.lexsort([p[few] for p in (*place[::-1], *keys[::-1])])]
    equal = np.ones(max(0, len(few) - 1), bool)
    for k in keys:
        equal &= k[few][1:] == k[few][:-1]
    at_same_place = np.ones(len(equal), bool)
    for p in place:
        at_same_place &= p[few][1:] == p[few][:-1]
    # a repeated row is no later than itself: carry the first row's verdict along
    first = np.ones(len(few), bool)
    first[1:] = ~equal
    moved = np.zeros(len(few), bool)
    moved[1:] = equal & ~at_same_place
    group = np.cumsum(first) - 1
    steps = np.cumsum(moved)
    out[few] = steps > steps[np.flatnonzero(first)][group] if len(few) else False
    return out


def _deal(bucket: np.ndarray, columns, kinds, kind: str):
    """Rows (bucket, kind, blob), one for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, edges):
        if len(own):
            yield int(bucket[own[0]]), kind, pack([c[own] for c in columns], kinds)


def _of_doc(doc: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    return (common.mix(doc.view(np.uint64) ^ (th.astype(np.int64).view(np.uint64) << np.uint64(7))) % np.uint64(buckets)).astype(np.int64)


BLOBS = "bucket int, kind string, blob binary"


def _batches(rows):
    rows = list(rows)
    if rows:
        b, k, x = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.string()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def keyed(docs: DataFrame) -> DataFrame:
    """(_doc, _th, text): neither key is ever null, so that all joins can share one exchange of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("_doc"), F.hash(text).alias("_th"), text.alias("text"))


def _scan(texts: DataFrame, buckets: int, lanes: int) -> DataFrame:
    """Step 1: packed stretches by anchor, with what a task can decide by itself."""

    def send(parts):
        start, run, ao, anchor, digest, doc, th = (np.concatenate(x) for x in zip(*parts, strict=True))
        late = _later([digest, anchor], [doc, th, start])
        yield from _deal(_of_doc(doc[late], th[late], lanes), [doc[late], th[late], start[late], run[late] + LENGTH - 1], SPAN, "S")
        start, run, ao, anchor, digest, doc, th = (x[~late] for x in (start, run, ao, anchor, digest, doc, th))
        bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
        hot = count[inverse] >= HOT_TASK
        low = anchor & np.uint64(0xFFFFFFFF)
        if hot.any():
            cols = [x[hot] for x in (doc, th, start, run, ao, low, bucket)]
            yield from _deal(_of_doc(cols[0], cols[1], lanes), [*cols, np.ones(len(cols[0]))], PENDING, "P")
            _, mark = np.unique(anchor[hot], return_index=True)
            mark = np.flatnonzero(hot)[mark]
            zero = np.zeros(len(mark), np.int64)
            yield from _deal(bucket[mark], [low[mark], zero, zero, zero, zero, zero, zero], ENTRY, "E")
        cool = ~hot
        yield from _deal(bucket[cool], [x[cool] for x in (low, digest, doc, th, start, run, ao)], ENTRY, "E")

    def run(batches):
        parts, held = [], 0
        for b in batches:
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = common.text_buffers(b.column(2))
            for i, j in common.chunks(off, 1 << 20):
                own = off[i : j + 1] - off[i]
                start, n, place, anchor, digest = stretches(data[off[i] : off[j]], own)
                if not len(start):
                    continue
                d = np.searchsorted(own, start, side="right") - 1
                parts.append((start - own[d], n, place - start, anchor, digest, doc[i:j][d], th[i:j][d]))
                held += len(start)
                if held >= FLUSH:
                    yield from _batches(send(parts))
                    parts, held = [], 0
        if parts:
            yield from _batches(send(parts))

    return texts.mapInArrow(run, BLOBS)


def _by_bucket(batches) -> dict[int, dict[str, list[bytes]]]:
    """The packed blobs of a task's partition, by bucket and kind."""
    out: dict[int, dict[str, list[bytes]]] = {}
    for b in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out.setdefault(bucket, {}).setdefault(kind, []).append(blob)
    return out


def _sent(parts: list[list[np.ndarray]], kinds, kind: str, lanes: int):
    """What a task found in all its buckets (columns start with doc, th), one blob for each lane of documents."""
    if parts:
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        yield from _deal(_of_doc(cols[0], cols[1], lanes), cols, kinds, kind)


def _meet(blobs: DataFrame, lanes: int) -> DataFrame:
    """Step 2: marks of equal stretches, and the stretches whose windows must be compared."""

    def run(batches):
        held = _by_bucket(batches)
        marks, waits = [], []
        for bucket in sorted(held):
            mine = held.pop(bucket)
            marks += [unpack([x], SPAN)[0] for x in mine.get("S", [])]
            waits += [unpack([x], PENDING)[0] for x in mine.get("P", [])]
            if "E" not in mine:
                continue
            (anchor, digest, doc, th, start, run, ao), _ = unpack(mine["E"], ENTRY)
            marked = np.unique(anchor[run == 0])
            real = run > 0
            anchor, digest, doc, th, start, run, ao = (x[real] for x in (anchor, digest, doc, th, start, run, ao))
            late = _later([digest, anchor], [doc, th, start])
            marks.append([doc[late], th[late], start[late], (run[late].astype(np.int64) + LENGTH - 1).astype("<u4")])
            # rows at one place are one stretch: keep one of each digest
            keep = np.flatnonzero(~late)
            anchor, digest, doc, th, start, run, ao = (x[keep] for x in (anchor, digest, doc, th, start, run, ao))
            _, one = np.unique(digest, return_index=True)
            if len(one) < len(digest):
                anchor, doc, th, start, run, ao = (x[one] for x in (anchor, doc, th, start, run, ao))
            _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
            is_marked = np.isin(anchor, marked)
            wait = np.flatnonzero((count[inverse] > 1) | is_marked)
            hot = (is_marked | (count[inverse] > HOT_BUCKET))[wait]
            waits.append([*(x[wait] for x in (doc, th, start, run, ao, anchor)), np.full(len(wait), bucket, "<u4"), hot.astype("u1")])
        yield from _batches([*_sent(marks, SPAN, "S", lanes), *_sent(waits, PENDING, "P", lanes)])

    return blobs.repartition("bucket").mapInArrow(run, BLOBS)


def _pending(met: DataFrame) -> DataFrame:
    """(_doc, _th, wait): the stretches of each document that wait for a comparison."""

    def reduce(key, group):
        (doc, th, *rest), _ = unpack(group.column("blob").to_pylist(), PENDING)
        order = np.lexsort([th, doc])
        new = np.flatnonzero(np.r_[True, (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])])
        out = [pack([x[own] for x in rest], PENDING[2:]) for own in np.split(order, new[1:])]
        return pa.table({"_doc": pa.array(doc[order][new]), "_th": pa.array(th[order][new]), "wait": pa.array(out, pa.binary())})

    return met.where("kind = 'P'").groupBy("bucket").applyInArrow(reduce, "_doc long, _th int, wait binary")


def _expand(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all numbers first, first + 1, ... (n of them)."""
    n = n.astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.astype(np.int64), n)


def _contents(texts: DataFrame, pending: DataFrame, buckets: int, lanes: int) -> DataFrame:
    """Step 3, sending: bytes of the waiting stretches by anchor, windows of hot ones by their hash."""

    def run(batches):
        for b in batches:
            data, off = common.text_buffers(b.column(2))
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in common.chunks(off, 1 << 22):
                rows = []
                per = [unpack([w], PENDING[2:])[0] for w in b.column(3).slice(i, j - i).to_pylist()]
                n = np.array([len(p[0]) for p in per])
                start, count, ao, anchor, bucket, hot = (np.concatenate(x) for x in zip(*per, strict=True))
                own = np.repeat(np.arange(i, j), n)
                d, t, at = doc[own], th[own], start.astype(np.int64) + off[own]
                cool = np.flatnonzero(hot == 0)
                if len(cool):
                    order = cool[np.argsort(bucket[cool], kind="stable")]
                    for part in np.split(order, np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1):
                        _, byte = _expand(at[part], count[part].astype(np.int64) + LENGTH - 1)
                        rows.append((int(bucket[part[0]]), "C", pack([x[part] for x in (anchor, d, t, start, count, ao)], CONTENT, data[byte].tobytes())))
                warm = np.flatnonzero(hot)
                if len(warm):
                    owner, place = _expand(at[warm], count[warm])
                    base = data[off[i] : off[j]]
                    local = place - off[i]
                    h1 = _WINDOW.spans(_WINDOW.sums(base), local, local + LENGTH)
                    h2 = _DIGEST.spans(_DIGEST.sums(base), local, local + LENGTH)
                    wd, wt, ws = d[warm][owner], t[warm][owner], place - off[own[warm][owner]]
                    late = _later([h1, h2], [wd, wt, ws])
                    rows += _deal(_of_doc(wd[late], wt[late], lanes), [wd[late], wt[late], ws[late], np.full(int(late.sum()), LENGTH)], SPAN, "S")
                    keep = ~late
                    rows += _deal((h1[keep] % np.uint64(buckets)).astype(np.int64), [h1[keep], h2[keep], wd[keep], wt[keep], ws[keep]], WINDOWS, "W")
                yield from _batches(rows)

    return texts.join(pending, ["_doc", "_th"]).select("_doc", "_th", "text", "wait").mapInArrow(run, BLOBS)


def _adjacent(rows: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row, the longest prefix it shares with another row of its group.

    Rows are sorted as in a suffix array; the longest common prefix with any
    other row is that with one of its two neighbours.
    """
    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort([length, keys, group])
    out = np.zeros(len(rows), np.int64)
    for lo in range(0, len(order) - 1, 20_000):
        a, b = order[lo : lo + 20_000], order[lo + 1 : lo + 20_001]
        a = a[: len(b)]
        differ = rows[a] != rows[b]
        common_length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common_length = np.minimum(common_length, np.minimum(length[a], length[b]))
        common_length[group[a] != group[b]] = 0
        np.maximum.at(out, a, common_length)
        np.maximum.at(out, b, common_length)
    return out


def repeated_windows(anchor, doc, th, start, run, ao, raw: bytes):
    """(owner, offset) of the windows that equal an earlier one, for stretches whose bytes are ``raw`` in a row."""
    size = run.astype(np.int64) + LENGTH - 1
    first = np.cumsum(size) - size
    data = np.frombuffer(raw + b"\0" * 2 * LENGTH, np.uint8)
    ao = ao.astype(np.int64)
    right_size, wide, deep = size - ao, 2 * LENGTH - GRAM, SPREAD
    span = np.arange(wide)
    right = np.where(span[None, :] < right_size[:, None], data[np.minimum((first + ao)[:, None] + span[None, :], len(data) - 1)], 0).astype(np.uint8)
    span = np.arange(1, deep + 1)
    left = np.where(span[None, :] <= ao[:, None], data[np.maximum((first + ao)[:, None] - span[None, :], 0)], 0).astype(np.uint8)
    reach_right, reach_left = _adjacent(right, right_size, anchor), _adjacent(left, ao, anchor)
    lo = np.maximum(ao - reach_left, 0)
    hi = np.minimum(run.astype(np.int64) - 1, ao + reach_right - LENGTH)
    owner, offset = _expand(lo, np.maximum(hi - lo + 1, 0))
    if not len(owner):
        return owner, offset
    order = np.lexsort([start[owner].astype(np.int64) + offset, th[owner], doc[owner]])  # places first: the sort below is stable
    owner, offset = owner[order], offset[order]
    every = np.ndarray((len(data) - LENGTH + 1, LENGTH), np.uint8, data, 0, (1, 1))
    suffix = np.ascontiguousarray(every[first[owner] + offset])
    sorted_ = np.argsort(suffix.view(f"S{LENGTH}").ravel(), kind="stable")
    same = (suffix[sorted_][1:] == suffix[sorted_][:-1]).all(axis=1)  # common prefix of LENGTH: one interval
    o, f = owner[sorted_], offset[sorted_]
    place = [doc[o], th[o], start[o].astype(np.int64) + f]
    moved = np.zeros(len(o), bool)
    moved[1:] = same & np.any([p[1:] != p[:-1] for p in place], axis=0)
    head = np.r_[True, ~same]
    steps = np.cumsum(moved)
    late = steps > steps[np.flatnonzero(head)][np.cumsum(head) - 1]
    return o[late], f[late]


def _compare(blobs: DataFrame, lanes: int) -> DataFrame:
    """Step 3, receiving: marks of windows that repeat."""

    def run(batches):
        held = _by_bucket(batches)
        marks = []
        for bucket in sorted(held):
            mine = held.pop(bucket)
            marks += [unpack([x], SPAN)[0] for x in mine.get("S", [])]
            if "C" in mine:
                (anchor, doc, th, start, run, ao), raw = unpack(mine["C"], CONTENT)
                o, f = repeated_windows(anchor, doc, th, start, run, ao, raw)
                marks.append([doc[o], th[o], (start[o].astype(np.int64) + f).astype("<u4"), np.full(len(o), LENGTH, "<u4")])
            if "W" in mine:
                (h1, h2, doc, th, start), _ = unpack(mine["W"], WINDOWS)
                late = _later([h1, h2], [doc, th, start])
                marks.append([doc[late], th[late], start[late], np.full(int(late.sum()), LENGTH, "<u4")])
        yield from _batches(_sent(marks, SPAN, "S", lanes))

    return blobs.repartition("bucket").mapInArrow(run, BLOBS)


def _merged(start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals for each owner; owners are dense and sorted, starts sorted within them."""
    base = owner.astype(np.int64) << 34
    a, b = base + start, base + start.astype(np.int64) + size
    reach = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(b, at)
    return owner[at], a[at] - base[at], end - base[at]


def _spans(marks: DataFrame) -> DataFrame:
    """(_doc, _th, spans): merged marks of each document as pairs of longs."""

    def reduce(key, group):
        (doc, th, start, size), _ = unpack(group.column("blob").to_pylist(), SPAN)
        order = np.lexsort([start, th, doc])
        doc, th, start, size = (x[order] for x in (doc, th, start, size))
        new = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
        owner, a, b = _merged(start, size, np.cumsum(new) - 1)
        pairs = np.column_stack([a, b]).astype("<i8")
        edges = np.searchsorted(owner, np.arange(int(new.sum()) + 1))
        out = [pairs[edges[k] : edges[k + 1]].tobytes() for k in range(len(edges) - 1)]
        return pa.table({"_doc": pa.array(doc[new]), "_th": pa.array(th[new]), "spans": pa.array(out, pa.binary())})

    return marks.groupBy("bucket").applyInArrow(reduce, "_doc long, _th int, spans binary")


def spans(texts: DataFrame) -> DataFrame:
    """(_doc, _th, spans) of the ``keyed`` texts that have repeated bytes."""
    spark = texts.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * lanes  # a task takes one bucket after the other
    met = common.cut(_meet(_scan(texts, buckets, lanes), lanes))
    compared = _compare(_contents(texts, _pending(met), buckets, lanes), lanes)
    return _spans(met.where("kind = 'S'").union(compared.where("kind = 'S'")))


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    texts = keyed(docs)
    found = spans(texts)

    def run(batches):
        for b in batches:
            data, off = common.text_buffers(b.column(1))
            rows = []
            for k, own in enumerate(b.column(2).to_pylist()):
                raw = data[off[k] : off[k + 1]]
                pairs = np.frombuffer(own or b"", "<i8").reshape(-1, 2)
                h, at = hashlib.sha256(), 0
                for a, e in pairs.tolist():
                    h.update(raw[at:a])
                    at = e
                h.update(raw[at:])
                rows.append((len(raw), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), h.hexdigest()))
            n, gone, count, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(found, ["_doc", "_th"], "left")
    return joined.select(F.when(F.col("_doc") != common.NULL_ID, F.col("_doc")).alias("doc_id"), "text", "spans").mapInArrow(run, DIGESTS)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text`` (characters cut in part become U+FFFD); a null text stays null."""
    texts = keyed(docs)
    found = spans(texts)
    key = texts.schema.names[:2]
    own = docs.select(*docs.columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("_doc"), F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    joined = own.join(found, key, "left").select(*docs.columns, "spans")
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            for text, pairs in zip(b.column(column).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is not None and pairs:
                    raw, at, parts = text.encode(), 0, []
                    for a, e in np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist():
                        parts.append(raw[at:a])
                        at = e
                    text = (b"".join(parts) + raw[at:]).decode("utf-8", "replace")
                out.append(text)
            arrays = list(b.columns[:-1])
            arrays[column] = pa.array(out, b.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


# --- one bounded buffer ------------------------------------------------------


class EnhancedSuffixArray:
    """Suffixes of several texts in order, with common-prefix lengths that stop at the texts' ends."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        symbols = np.concatenate([np.zeros(0, np.int64)] + [np.r_[np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0] for t in texts])
        n = len(symbols)
        self.text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.cumsum([0] + [len(t) + 1 for t in texts])
        rank = symbols.copy()
        rank[symbols == 0] = -1 - self.text_of[symbols == 0]  # each end is a symbol of its own
        rank = np.unique(rank, return_inverse=True)[1]
        width = 1
        while n and rank.max() < n - 1:  # prefix doubling
            second = np.full(n, -1, np.int64)
            second[: n - width] = rank[width:]
            order = np.lexsort([second, rank])
            new = np.r_[0, (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.symbols = symbols
        self.lcp = self._common(rank)

    def _common(self, rank: np.ndarray) -> np.ndarray:
        """lcp[i]: common prefix of suffixes i - 1 and i (Kasai)."""
        s, n, h = self.symbols.tolist(), len(self.symbols), 0
        order, out = self.suffixes.tolist(), [0] * len(self.symbols)
        for i, r in enumerate(rank.tolist()):
            if r:
                j = order[r - 1]
                while i + h < n and j + h < n and s[i + h] == s[j + h] and s[i + h]:
                    h += 1
                out[r] = h
                h = max(0, h - 1)
            else:
                h = 0
        return np.array(out, np.int64)

    def intervals(self, least: int):
        """(length, lo, hi) of all common-prefix intervals of length ``least`` or more, children first."""
        stack: list[tuple[int, int]] = []
        lcp = [*self.lcp.tolist(), 0]
        for i in range(1, len(lcp)):
            lo = i - 1
            while stack and stack[-1][0] > lcp[i]:
                length, lo = stack.pop()
                yield length, lo, i
            if lcp[i] >= least and (not stack or stack[-1][0] < lcp[i]):
                stack.append((lcp[i], lo))

    def maximal_repeats(self, least: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """(length, [(text, start)]) of the repeats that no common byte extends on either side, with all occurrences."""
        out = []
        for length, lo, hi in self.intervals(least):
            at = self.suffixes[lo:hi]
            before = self.symbols[at - 1]
            before[at == self.first[self.text_of[at]]] = 0
            if (before == 0).any() or len(np.unique(before)) > 1:  # left-diverse
                text = self.text_of[at]
                out.append((length, sorted(zip(text.tolist(), (at - self.first[text]).tolist(), strict=True))))
        return sorted(out)


def repeat_groups(docs: DataFrame, least: int = LENGTH) -> DataFrame:
    """(length, doc_ids, starts) of the maximal repeats of a bounded table, with all occurrences (UTF-8 bytes).

    The table is gathered in one task: at most 8 MB of texts; ``dedup`` has no such bound.
    """

    def reduce(key, group):
        texts = [x.encode() for x in group.column("text").to_pylist()]
        if sum(map(len, texts)) > 8_000_000:
            raise ValueError("repeat_groups is for tables of up to 8 MB of text")
        doc = group.column("_doc").to_pylist()
        found = EnhancedSuffixArray(texts).maximal_repeats(least)
        return pa.table({
            "length": pa.array([n for n, _ in found], pa.int64()),
            "doc_ids": pa.array([[doc[t] for t, _ in own] for _, own in found], pa.list_(pa.int64())),
            "starts": pa.array([[s for _, s in own] for _, own in found], pa.list_(pa.int64())),
        })

    return keyed(docs).select(F.lit(0).alias("one"), "_doc", "text").groupBy("one").applyInArrow(reduce, "length long, doc_ids array<long>, starts array<long>")


def query(spark, sf_dir):
    return digests(common.read(spark, sf_dir, "documents"))
