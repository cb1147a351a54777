"""Shared helpers: lineage cuts, Arrow text views, byte hashing, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id inside joins and comparisons; nulls sort first.
NULL_ID = -(2**63)
#: Edges in a part of a graph: few edges in very many parts would be mostly files.
EDGES = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is configured and all run on it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomlog-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder, in at most ``parts`` files, and forget how it was made."""
    shared_dir(df.sparkSession)
    return (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - (off[0] if len(off) else 0)


def chunks(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges whose texts have about ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64, in place where it can be."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class SpanHash:
    """Hashes of any spans of a byte buffer from one running sum modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _grown(powers: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(powers) < n:
            step = np.uint64(pow(base, len(powers), 2**64))
            powers = np.concatenate([powers, powers * step])
        return powers

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.powers = self._grown(self.powers, self.base, n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.inverses = self._grown(self.inverses, self.inverse, len(sums))
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indices of the words of each text (ASCII white space parts words)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= space[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of these edges' components, for each node but the roots; a root is its component's smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def contracted(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with every ``EDGES`` of a part replaced by the stars of what they connect."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
            if n >= EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], ["u", "v"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(u, v)``, longs: root is the smallest node reachable.

    Alternating large-star and small-star contraction: rounds grow with the
    logarithm of a component's size, and each round also contracts what the
    edges of a part connect among themselves, which saves rounds.  Minima are pre-aggregated and written
    before they are joined, so both sides of each join are plain exchanges,
    which Spark splits where a node has very many neighbours.
    """
    e = cut(contracted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    parts = max(8, e.count() // EDGES)
    e = e.coalesce(parts)
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), parts)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), parts)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        star = small.select("u", "v").union(small.select(F.col("w").alias("u"), "v")).where("u <> v").distinct()
        e = cut(contracted(star.coalesce(parts)))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
