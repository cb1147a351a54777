"""Approximate nearest neighbours by inner product with additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each
codebook.  Codebooks are fitted level by level on the residuals of a bounded,
deterministic sample (``SAMPLE`` rows).  Every vector is then encoded by beam
search over the codebooks: inner products with all codewords and the codebooks'
Gram matrix are enough to follow ``BEAM`` partial sums exactly.  Beside its
codes a row stores the ratio of its own norm to that of its approximation,
which takes the shrinkage of quantisation out of the score, and the norm of
what the scaled approximation still misses.

A search scores blocks of rows against blocks of queries through lookup tables
(one inner product for each codeword).  A score is off by the inner product of
query and missing part, which has a standard deviation of about their norms'
product over the root of the dimension.  Every row that could be among the k
best within ``MARGIN`` deviations is scored exactly in double precision: no
fixed number of candidates is kept.  With ``exact`` the margin is the norms'
product itself, which the error never exceeds, and no neighbour is lost.
Equal vectors of a block are one candidate with its smallest ids, so a vector
that fills a third of the table cannot crowd out others.  Queries are broadcast
in passes of at most ``QUERY_BLOCK`` rows; each pass reads the index once and
shuffles k rows for each task and query.

Cases: vectors that are null, zero, or hold null or non-finite components,
rows without an id and vectors of another length than the most frequent one
take no part; rows that repeat a vec_id count once, by their best score, and
never answer a query of that id; ties go to the smaller vec_id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BOOKS, WORDS, BEAM = 16, 128, 4
SAMPLE, ROUNDS = 8192, 6
MARGIN = 2.0
PAIRS = 32768  # rows that are scored exactly at once
BLOCK_ROWS, BLOCK_QUERIES, QUERY_BLOCK = 4096, 64, 65536


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (sizes.d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (books, words, d): k-means on what the levels before leave."""
    rng = np.random.default_rng(7)
    rest = sample.astype(np.float32).copy()
    words = max(1, min(words, len(rest)))
    out = []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            full = n > 0
            c[full] = sums[full] / n[full, None]
        near = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
        rest -= c[near]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, books), the ratio of each norm to its approximation's, and the norm of what that misses."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram = flat @ flat.T
    half = np.diag(gram) / 2
    xc = x.astype(np.float32) @ flat.T  # n, m*k
    n = len(x)
    codes = np.zeros((n, 1, m), np.int64)
    cost = np.zeros((n, 1), np.float32)  # (|approximation|^2 - 2 <x, approximation>) / 2
    for level in range(m):
        own = slice(level * k, level * k + k)
        add = (half[own][None, :] - xc[:, own])[:, None, :] + cost[:, :, None]
        for before in range(level):
            add = add + gram[codes[:, :, before] + before * k, own]
        wide = add.reshape(n, -1)
        keep = min(beam, wide.shape[1])
        best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(wide, best, 1)
        codes = np.take_along_axis(codes, (best // k)[:, :, None], 1).copy()
        codes[:, :, level] = best % k
    codes = codes[np.arange(n), np.argmin(cost, axis=1)]
    approx = books[np.arange(m)[None, :], codes].sum(1)
    ratio = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(approx, axis=1), 1e-12)
    missing = np.linalg.norm(x - ratio[:, None] * approx, axis=1)
    return codes.astype(np.uint8), ratio.astype(np.float32), missing.astype(np.float32)


def index(vectors: DataFrame, books: int = BOOKS, words: int = WORDS, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """The materialised index (vec_id, v, codes, ratio, missing) of every valid row, and its codebooks."""
    if words > 256:
        raise ValueError("codes are bytes: 256 words at most")
    rows = valid(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    if not len(drawn):
        return rows.select("vec_id", "v", F.lit(b"").alias("codes"), F.lit(1.0).cast("float").alias("ratio"), F.lit(0.0).cast("float").alias("missing")), np.zeros((books, 1, 1), np.float32)
    codebooks = fit(_matrix(drawn), books, words)
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                codes, ratio, missing = encode(_matrix(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio), pa.array(missing)], ["vec_id", "v", "codes", "ratio", "missing"])

    kind = rows.schema["v"].dataType.simpleString()
    return common.cut(rows.mapInArrow(run, f"vec_id long, v {kind}, codes binary, ratio float, missing float")), codebooks


class _Best:
    """The k best (score, id) of each query so far; ids are distinct."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[at], score], 1), np.concatenate([self.id[at], ids], 1)
        order = np.lexsort((-score, ids), axis=1)  # by id, then best score: repeats stand together
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        score[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _score_block(best: _Best, ids, x, codes, ratio, missing, books, query_ids, queries, margin: float) -> None:
    order = np.argsort(ids, kind="stable")
    ids, x, codes, ratio, missing = ids[order], x[order], codes[order], ratio[order], missing[order]
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))[inverse]  # distinct vectors in order of their smallest id
    reps = np.sort(first)
    width = min(best.k + 1, int(np.bincount(rank).max()))
    table = np.full((len(reps), width), np.iinfo(np.int64).max)
    by = np.argsort(rank, kind="stable")
    starts = np.searchsorted(rank[by], np.arange(len(reps)))
    nth = np.arange(len(by)) - starts[rank[by]]
    few = nth < width
    table[rank[by][few], nth[few]] = ids[by][few]
    wide, codes, ratio = x[reps].astype(np.float64), codes[reps].T.astype(np.intp), ratio[reps]
    single = x[reps].astype(np.float32)
    slack = (margin * missing[reps] + 1e-5).astype(np.float32)
    top = min(best.k + 1, len(reps))
    for lo in range(0, len(queries), BLOCK_QUERIES):
        at = slice(lo, min(lo + BLOCK_QUERIES, len(queries)))
        q = queries[at]
        size = np.linalg.norm(q, axis=1)
        approx, part = np.zeros((len(reps), len(q)), np.float32), np.empty((len(reps), len(q)), np.float32)
        for level in range(len(books)):
            approx += np.take(books[level] @ q.T.astype(np.float32), codes[level], axis=0, out=part, mode="clip")
        approx *= ratio[:, None]
        least = best.score[at, -1]
        if top > best.k:  # the k + 1 best of those that look best bound what a row must reach; one of them may be the query itself
            n = min(len(reps), 4 * top)
            sure = np.argpartition(-approx, n - 1, axis=0)[:n].T if n < len(reps) else np.broadcast_to(np.arange(n), (len(q), n))
            close = np.matmul(single[sure], q.astype(np.float32)[:, :, None])[:, :, 0]
            least = np.maximum(least, np.partition(close, n - top, axis=1)[:, n - top])
        ri, qi = np.nonzero(approx + slack[:, None] * size[None, :].astype(np.float32) >= (least - 1e-5 * size).astype(np.float32)[None, :])
        exact = np.empty(len(qi))
        for a in range(0, len(qi), PAIRS):
            own = slice(a, a + PAIRS)
            exact[own] = np.einsum("nd,nd->n", q[qi[own]], wide[ri[own]])
        order = np.lexsort((ri, -exact, qi))
        qi, ri, exact = qi[order], ri[order], exact[order]
        nth = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi]
        few = nth < top
        score = np.full((len(q), top, width), -np.inf)
        own = np.full((len(q), top, width), np.iinfo(np.int64).max)
        score[qi[few], nth[few]] = exact[few][:, None]
        own[qi[few], nth[few]] = table[ri[few]]
        score, own = score.reshape(len(q), -1), own.reshape(len(q), -1)
        score = np.where((own == query_ids[at][:, None]) | (own == np.iinfo(np.int64).max), -np.inf, score)
        best.add(at, score, own)


def search(index_rows: DataFrame, books: np.ndarray, queries: DataFrame, k: int = 20, margin: float = MARGIN, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each of ``queries`` (vec_id, v)."""
    margin = 1.0 if exact else margin / np.sqrt(books.shape[2])
    spark = index_rows.sparkSession
    n = queries.count()
    passes = max(1, -(-n // (QUERY_BLOCK // 2)))
    parts = []
    for p in range(passes):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).select("vec_id", "v").toArrow()
        if not own.num_rows:
            continue
        ids, at = np.unique(own.column("vec_id").to_numpy(), return_index=True)
        vectors = _matrix(own.column("v").combine_chunks())[at].astype(np.float64)
        parts.append(_pass(index_rows, spark.sparkContext.broadcast((books, ids, vectors)), k, margin))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(index_rows: DataFrame, shared, k: int, margin: float) -> DataFrame:
    def run(batches):
        books, query_ids, queries = shared.value
        best = _Best(len(queries), k)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                _score_block(best, part.column(0).to_numpy(), _matrix(part.column(1)), codes, part.column(3).to_numpy(), part.column(4).to_numpy(), books, query_ids, queries, margin)
        q, r = np.nonzero(np.isfinite(best.score))
        for at in range(0, len(q), 1 << 18):
            a, c = q[at : at + (1 << 18)], r[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[a]), pa.array(best.id[a, c]), pa.array(best.score[a, c])], ["query_id", "vec_id", "score"])

    return index_rows.select("vec_id", "v", "codes", "ratio", "missing").mapInArrow(run, "query_id long, vec_id long, score double")


def query(spark, sf_dir):
    rows, books = index(common.read(spark, sf_dir, "embeddings"))
    return search(rows, books, rows.where("vec_id % 20 = 0"), k=20)
