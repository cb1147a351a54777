"""SimHash near-duplicate detection with multi-index hashing.

A 64-bit fingerprint is the bitwise majority over the XXH64 hashes (seed 42)
of a text's word shingles.  Two fingerprints are linked at ``radius`` (4) or
fewer differing bits.  The fingerprint is cut into m segments; if all segments
differed by more than their shares of the radius, and the shares sum to
radius - m + 1, the whole would differ by more than the radius, so enumerating
the Hamming balls of these shares around the segments and looking them up finds
every link.  ``segments`` chooses the fewest rows for the number of
fingerprints: three segments with shares 1, 1 and 0 at first, two long ones with
shares 2 and 1 from some hundred million on.

``dedup`` removes near-duplicates by the shingles' Jaccard similarity with a
longer fingerprint of the same kind (``near``).

Only distinct fingerprints are compared.  Buckets of a segment value with up
to ``WIDE`` fingerprints are joined directly.  Wider buckets are dealt out in
blocks, and each pair of blocks yields a spanning forest of its links instead
of the links themselves: components need no more, and no task holds a whole
bucket.

Cases: null or blank texts have fingerprint zero and are linked like others;
texts with fewer words than a shingle use their whole word sequence; a
repeated ``doc_id`` gets one row for each input row; a null ``doc_id`` keeps
its row, and its component is the smallest non-null id, if there is one;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, near

WIDE = 32
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    tails = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), tails.tolist(), strict=True))
    for at in range(0, n, 65536):
        raw = b"".join([digest(joined[a:b], 42) for a, b in spans[at : at + 65536]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            data, off = common.text_buffers(b.column(1))
            raw = data.tobytes()
            fp = [fingerprint(raw[off[i] : off[i + 1]], shingle) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segments(n: int, radius: int = 4) -> tuple[tuple[int, int, int], ...]:
    """First bit, width and ball radius of each segment: the cut with the fewest probes and chance meetings for ``n`` fingerprints."""
    found = []
    for m in range(1, radius + 2):
        edges = [64 * k // m for k in range(m + 1)]
        shares = [(radius - m + 1) // m + (k < (radius - m + 1) % m) for k in range(m)]
        balls = [sum(math.comb(b - a, r) for r in range(share + 1)) for a, b, share in zip(edges, edges[1:], shares, strict=False)]
        cost = sum(ball * (1 + n / 2 ** (b - a)) for a, b, ball in zip(edges, edges[1:], balls, strict=False))
        found.append((cost, tuple((a, b - a, share) for a, b, share in zip(edges, edges[1:], shares, strict=False))))
    return min(found)[1]


def _ball(value: Column, width: int, radius: int) -> list[Column]:
    return [value.bitwiseXOR(F.lit(sum(1 << i for i in bits))) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def _keys(fps: DataFrame, cut: tuple[tuple[int, int, int], ...]) -> tuple[DataFrame, DataFrame]:
    """Table entries (key, fp) and probes (key, fp) of all segments; a key holds segment number and value."""
    tables, probes = [], []
    for number, (low, width, radius) in enumerate(cut):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(number << 40)
        tables.append(value)
        probes += _ball(value, width, radius)
    return fps.select(F.explode(F.array(*tables)).alias("key"), "fp"), fps.select(F.explode(F.array(*probes)).alias("key"), "fp")


def _forest(table: np.ndarray, probe: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect what the links between ``table`` and ``probe`` connect, at most one for each fingerprint."""
    nodes, inverse = np.unique(np.concatenate([table, probe]), return_inverse=True)
    t, p = inverse[: len(table)], inverse[len(table) :]
    parent = np.arange(len(nodes))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    step = max(1, 4_000_000 // max(1, len(p)))
    for at in range(0, len(t), step):
        block = t[at : at + step]
        near = np.bitwise_count(nodes[block][:, None] ^ nodes[p][None, :]) <= radius
        near &= block[:, None] != p[None, :]
        for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = root(block[a]), root(p[b])
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(int(nodes[a]))
                right.append(int(nodes[b]))
    return left, right


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps(fp)``: all of narrow buckets, a spanning forest of wide ones."""
    table, probe = _keys(fps, segments(fps.count(), radius))
    wide = common.cut(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WIDE))
    t = table.join(wide.select("key"), "key", "left_anti")
    p = probe.withColumnRenamed("fp", "pf")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pf"))) <= radius
    out = t.join(p, (t["key"] == p["key"]) & near & (F.col("fp") != F.col("pf"))).select(F.col("fp").alias("u"), F.col("pf").alias("v"))
    return out.union(_wide_links(table, probe, wide, radius))


def _wide_links(table: DataFrame, probe: DataFrame, wide: DataFrame, radius: int) -> DataFrame:
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.hash("fp"), blocks)
    members = table.join(wide, "key").select("key", "fp", own.alias("tb"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("pb"), F.lit(0).alias("side"))
    probes = probe.join(wide, "key").select("key", "fp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("tb"), own.alias("pb"), F.lit(1).alias("side"))

    def run(key, group):
        fp, side = group.column("fp").to_numpy().view(np.uint64), group.column("side").to_numpy()
        u, v = _forest(fp[side == 0], fp[side == 1], radius)
        return pa.table({"u": pa.array(np.array(u, np.uint64).view(np.int64)), "v": pa.array(np.array(v, np.uint64).view(np.int64))})

    return members.union(probes).groupBy("key", "tb", "pb").applyInArrow(run, "u long, v long")


def components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    fps = common.cut(fingerprints(docs, shingle))
    classes = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = common.connected_components(links(classes.select("fp"), radius))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = common.cut(joined)
    smallest = common.cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that the join can split a very large component
    of = joined.join(smallest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, words: int = near.WORDS, similarity: float = near.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: see ``near``."""
    return near.dedup(docs, words, similarity)


def query(spark, sf_dir):
    c = components(common.read(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
