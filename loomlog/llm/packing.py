"""Best-fit packing of tokenised documents into fixed-length sequences.

Each text is turned into token ids with an end id (0) after it.  A document
longer than a sequence is cut into full pieces; its first piece takes the
remainder.  Full pieces fill a sequence each.  The others are packed by their
lengths alone: there are fewer lengths than ``SIZE``, so the packing problem
of any corpus is one count for each length, and the driver never sees a
document.

Packing starts from best-fit decreasing over those counts and goes on with a
swap-based local search between underfull bins: one-for-one and two-for-one
exchanges and moves that increase the sum of squared fills, until bins run
empty and are dropped.  Bins with the same contents are one *pattern* with a
count, and a step applies to as many pairs of bins as both patterns have.

Pieces then take the places of their length in order of (scan task, place
within the task), found by binary search in the pattern table, whose size is
bounded by the number of patterns and not by the corpus.

Cases: a null text is empty and has the end id only; a null ``doc_id`` and
repeated rows are packed like any others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
_TOKENIZERS: dict = {}


def tokenizer_files() -> tuple[str, str]:
    """Paths of the tokenizer and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str]):
    """text -> ids.  Both files hold one vocabulary; the ranks are several times
    faster and give the same ids, except where the special token's own string
    stands in a text, which only the tokenizer file knows."""
    if files not in _TOKENIZERS:
        import public_tokenizers
        import tiktoken

        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENIZERS[files] = [tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), None]
    pair = _TOKENIZERS[files]

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            if pair[1] is None:
                from tokenizers import Tokenizer

                pair[1] = Tokenizer.from_file(files[0])
            return pair[1].encode(text, add_special_tokens=False).ids
        return pair[0].encode_ordinary(text)

    return encode


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces(docs: DataFrame, size: int = SIZE, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; (task, nth) numbers the pieces of a length within a scan task."""
    files = files or tokenizer_files()

    def run(batches):
        task, seen, encode = TaskContext.get().partitionId(), Counter(), encoder(files)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            ids_out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), size)):
                    own = ids[start : start + length]
                    for name, x in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), seen[length]), strict=True):
                        out[name].append(x)
                    seen[length] += 1
                    if with_ids:
                        ids_out.append(own.astype(np.int32))
            n = len(out["piece"])
            arrays = [pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(np.full(n, task)), pa.array(out["nth"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# --- packing of counts -------------------------------------------------------


def best_fit(counts: dict[int, int], size: int = SIZE) -> Counter:
    """Best-fit decreasing over length counts: {contents, longest first: number of bins}."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []  # sorted

    def put(contents, n):
        room = size - sum(contents)
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((contents, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[at]
            contents, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = min(room // length, left)
            bins = min(n, left // each)
            if bins < n:
                put(contents, n - bins)
            put(contents + (length,) * each, bins)
            left -= bins * each
    out: Counter = Counter()
    for found in open_bins.values():
        for contents, n in found:
            out[tuple(sorted(contents, reverse=True))] += n
    return out


def _improve(a: tuple[int, ...], b: tuple[int, ...], size: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The move or exchange that most fills the fuller of two bins, ``a``: its sum of squares grows with that."""
    room = size - sum(a)
    best, found = 0, None
    for i, x in enumerate(b):  # move x
        if best < x <= room:
            best, found = x, ((), (i,))
    if best == room:
        pass
    else:
        for j, y in enumerate(a):  # y goes to b for one or two documents
            for i, x in enumerate(b):
                if best < x - y <= room:
                    best, found = x - y, ((j,), (i,))
            want = room + y
            lo, hi = 0, len(b) - 1
            while lo < hi:  # b is sorted, longest first
                two = b[lo] + b[hi]
                if two > want:
                    lo += 1
                else:
                    if two - y > best:
                        best, found = two - y, ((j,), (lo, hi))
                    hi -= 1
            if best == room:
                break
    if not found:
        return None
    out, into = found
    na = [x for j, x in enumerate(a) if j not in out] + [b[i] for i in into]
    nb = [x for i, x in enumerate(b) if i not in into] + [a[j] for j in out]
    if sum(nb) > size:
        return None
    return tuple(sorted(na, reverse=True)), tuple(sorted(nb, reverse=True))


def local_search(bins: Counter, size: int = SIZE) -> Counter:
    """Exchange documents between underfull bins while that raises the sum of squared fills.

    Patterns wait in a heap, emptiest first; each gives to the fullest underfull
    pattern that it finds a step with.  One that finds none waits until a
    pattern appears that it has not been tried with, so the search ends when no
    pair of patterns has a step, or when there are as few bins as tokens allow.
    """
    bins = Counter(bins)
    total = sum(sum(c) * n for c, n in bins.items())
    least, count = -(-total // size), sum(bins.values())
    born = dict.fromkeys(bins, 0)  # when a pattern last became more frequent
    tried: dict[tuple[int, ...], int] = {}  # the time up to which a giver's partners were tried
    now = 0
    heap = [(sum(c), c) for c in bins if sum(c) < size]
    heapq.heapify(heap)
    waiting = {c for _, c in heap}
    while heap and count > least:
        fill, giver = heapq.heappop(heap)
        waiting.discard(giver)
        n = bins.get(giver, 0)
        if not n:
            continue
        since = tried.get(giver, -1)
        step = None
        for taker in sorted((c for c in bins if fill <= sum(c) < size and born[c] > since), key=lambda c: (-sum(c), c)):
            pairs = min(n, bins[taker]) if taker != giver else n // 2
            if pairs and (step := _improve(taker, giver, size)):
                break
        if not step:
            tried[giver] = now
            continue
        for old in (taker, giver):
            bins[old] -= pairs
            count -= pairs
            if not bins[old]:
                del bins[old]
        now += 1
        fresh = [new for new in step if new]
        for new in fresh:
            bins[new] += pairs
            count += pairs
            born[new] = now
        most = max((sum(c) for c in fresh if sum(c) < size), default=-1)
        for c in bins:  # givers that a new pattern may take from, the new ones among them
            if sum(c) <= most and c not in waiting or c in (giver, taker) and sum(c) < size and c not in waiting:
                waiting.add(c)
                heapq.heappush(heap, (sum(c), c))
    return bins


def pack_counts(counts: dict[int, int], size: int = SIZE) -> Counter:
    full = Counter({(size,): counts[size]}) if counts.get(size) else Counter()
    return local_search(best_fit({k: n for k, n in counts.items() if k < size}, size), size) + full


def placement(bins: Counter) -> dict[str, np.ndarray]:
    """For each length, runs of ranks with the sequences and offsets they take.

    A run covers ``per`` places of a length in each of ``n`` bins of a
    pattern: rank r of the length is place (r - first) % per of bin
    (r - first) // per, at offset + place * length.
    """
    rows, base = [], 0
    taken: Counter = Counter()
    for contents, n in sorted(bins.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length, per in sorted(Counter(contents).items(), reverse=True):
            rows.append((length, taken[length], base, per, offset))
            taken[length] += per * n
            offset += per * length
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "base": table[:, 2], "per": table[:, 3], "offset": table[:, 4]}


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to materialised ``pieces``."""
    spark = found.sparkSession
    # counts by (task, length): at most SIZE rows a task
    by_task = found.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = common.cut(by_task.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("task", "length", "n", "before"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # SIZE rows at most
    table = spark.sparkContext.broadcast(placement(pack_counts(counts, size)))

    def run(batches):
        t = table.value
        starts = {int(x): (int(a), int(b)) for x, a, b in zip(*_runs(t["length"]), strict=True)}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = starts[int(x)]
                at = np.flatnonzero(length == x)
                k = lo + np.searchsorted(t["first"][lo:hi], rank[at], side="right") - 1
                bin_no, slot = np.divmod(rank[at] - t["first"][k], t["per"][k])
                seq[at] = t["base"][k] + bin_no
                offset[at] = t["offset"][k] + slot * x
            kept = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = [c for c in found.columns if c not in ("task", "nth")]
    schema = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    joined = found.join(by_task.select("task", "length", "before"), ["task", "length"])
    return joined.select(*names, "nth", "before").mapInArrow(run, schema)


def _runs(values: np.ndarray):
    u, first, n = np.unique(values, return_index=True, return_counts=True)
    return u, first, first + n


def pack(docs: DataFrame, size: int = SIZE, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of ``docs``."""
    return place(common.cut(pieces(docs, size, files, with_ids)), size)


def query(spark, sf_dir):
    return pack(common.read(spark, sf_dir, "documents"))
