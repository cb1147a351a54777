"""Quality classification with hierarchical empirical Bayes.

A logistic classifier over character and line statistics rates each text by
itself.  Sites correct it: hosts and the paths below them have rates of good
documents, estimated as posteriors of nested Beta priors whose strengths come
from the spread between sites (method of moments).  A sparse path leans on
its host and a sparse host on the global rate.  A document's posterior odds are
its own odds times the odds of its site against the global ones; its own
evidence is left out of its site's counts.

The classifier is fitted on at most ``SAMPLE`` labelled rows (a documented
bound); rates are grouped, pre-aggregated sums over all rows.  The table of
sites is broadcast only if it has ``SITES`` rows or fewer.

``documents`` have no address: by default ``source`` is the host and ``lang``
the path; other columns or parts of a url can be given instead.

Cases: a null or empty text is rated like any other by its statistics (all
zero); null hosts and paths are sites of their own; repeated rows count as
often as they stand; without labels of both kinds all documents have even
evidence and none is rejected; an empty table gives no rows; other columns
are kept or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import fit_curve

SAMPLE = 20_000
SITES = 50_000
REJECTED = 500_000
REJECT_BELOW = 0.5
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 white space, 5 sentence mark, 6 symbol
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_LINE = common.SpanHash(5)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 18) statistics of texts and of their most unusual lines."""
    n = len(off) - 1
    kinds = _CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(off))
    share = np.bincount(doc * 7 + kinds, minlength=n * 7).reshape(n, 7).astype(np.float64)
    size = np.maximum(share.sum(axis=1), 1)
    words_start, words_end, word_doc = common.word_bounds(data, off)
    words = np.bincount(word_doc, minlength=n)
    length = np.bincount(word_doc, weights=words_end - words_start, minlength=n) / np.maximum(words, 1)
    cut = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    cut = cut[cut <= off[-1]]
    a, b = cut[:-1], cut[1:]
    line_doc = np.searchsorted(off, a, side="right") - 1
    line_kinds = np.zeros((len(a), 7))
    if len(a):
        line = np.repeat(np.arange(len(a)), b - a)
        line_kinds = np.bincount(line * 7 + kinds[cut[0] : cut[-1]], minlength=len(a) * 7).reshape(-1, 7).astype(np.float64)
    rows = np.maximum(line_kinds.sum(axis=1), 1)
    lines = np.bincount(line_doc, minlength=n)
    h = _LINE.spans(_LINE.sums(data), a, b) if len(a) else np.zeros(0, np.uint64)
    own = h ^ common.mix(line_doc.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(own, return_index=True)
    distinct = np.bincount(line_doc[at], minlength=n)
    wh = _LINE.spans(_LINE.sums(data), words_start, words_end) ^ common.mix(word_doc.astype(np.uint64) + np.uint64(1)) if len(words_start) else np.zeros(0, np.uint64)
    _, at = np.unique(wh, return_index=True)
    kinds_of_words = np.bincount(word_doc[at], minlength=n)
    most = np.zeros((n, 3))
    bulk = np.zeros((n, 3))
    for k, c in enumerate((2, 3, 6)):
        ratio = line_kinds[:, c] / rows
        ratio[rows < 20] = 0
        np.maximum.at(most[:, k], line_doc, ratio)
        bulk[:, k] = np.bincount(line_doc, weights=rows * (ratio > 0.12), minlength=n) / size
    return np.column_stack([
        share[:, 1:] / size[:, None], np.log1p(share.sum(axis=1)), length, distinct / np.maximum(lines, 1), kinds_of_words / np.maximum(words, 1),
        np.log1p(lines), size / np.maximum(lines, 1) / 1000, most, bulk,
    ])


def _rows(batch: pa.RecordBatch, column: int):
    data, off = common.text_buffers(batch.column(column))
    for i, j in common.chunks(off):
        yield i, statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics with their square roots and squares: thresholds need not be linear."""
    return np.hstack([x, np.sqrt(np.abs(x)), x * x])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The curve (mean, scale, weights) of P(good); None without labels of both kinds."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    own = common.cut(own.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "_id").select("text", "quality")

    def run(batches):
        for b in batches:
            for i, x in _rows(b, 0):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, len(x)), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = d.mapInArrow(run, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    return fit_curve(expand(got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)), y)


def evidence(docs: DataFrame, curve, host: Column, path: Column, carry: list[str]) -> DataFrame:
    """``carry`` and (_host, _path, _evidence) of each row; _evidence is P(good) by the text alone."""
    d = docs.select(*[F.col(c) for c in carry], host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col("text").cast("string").alias("_text"))
    if curve is None:
        return d.drop("_text").withColumn("_evidence", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(curve)

    def run(batches):
        mean, scale, w = shared.value
        for b in batches:
            p = [1 / (1 + np.exp(-np.clip((expand(x) - mean) / scale @ w[:-1] + w[-1], -12, 12))) for _, x in _rows(b, b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(p) if p else np.zeros(0))], [*b.schema.names[:-1], "_evidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]) + ", _evidence double"
    return d.mapInArrow(run, schema)


def _strength(rates: DataFrame, n: str, s: str, prior: Column) -> Column:
    """Method-of-moments strength of a Beta prior: the smaller the spread beyond chance, the stronger."""
    r = F.col(s) / F.col(n)
    spread = F.sum(F.col(n) * (r - prior) * (r - prior)) / F.sum(n) - F.sum(prior * (1 - prior)) / F.sum(n)
    within = F.sum(F.col(n) * prior * (1 - prior)) / F.sum(n)
    return F.least(F.greatest(within / F.greatest(spread, F.lit(1e-6)) - 1, F.lit(2.0)), F.lit(1e4))


def sites(rated: DataFrame) -> DataFrame:
    """A row for each (_host, _path): counts and sums of both levels, the global rate and the priors' strengths."""
    paths = common.cut(rated.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_evidence").alias("_s")))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    total = hosts.agg(F.sum("_hs") / F.sum("_hn")).first()[0]
    g = F.lit(min(max(total if total is not None else 0.5, 1e-3), 1 - 1e-3))
    kh = hosts.agg(_strength(hosts, "_hn", "_hs", g)).first()[0] or 2.0
    both = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    of_host = (F.col("_hs") + kh * g) / (F.col("_hn") + kh)
    kp = both.agg(_strength(both, "_n", "_s", of_host)).first()[0] or 2.0
    return both.select("_host", "_path", "_n", "_s", "_hn", "_hs", g.alias("_g"), F.lit(kh).alias("_kh"), F.lit(kp).alias("_kp"))


def _posterior() -> tuple[Column, Column]:
    """Rate of the site without the row itself, and the row's posterior."""
    e, g = F.col("_evidence"), F.col("_g")
    host = (F.col("_hs") - e + F.col("_kh") * g) / (F.col("_hn") - 1 + F.col("_kh"))
    rate = F.least(F.greatest((F.col("_s") - e + F.col("_kp") * host) / (F.col("_n") - 1 + F.col("_kp")), F.lit(1e-3)), F.lit(1 - 1e-3))
    logit = lambda x: F.log(x / (1 - x))
    return rate, 1 / (1 + F.exp(-(logit(e) + logit(rate) - logit(g))))


def _identity() -> list[Column]:
    """A row's document: its id (null comes first) and a hash of its text, as texts may differ under one id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text_hash")]


def decided(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(_doc, _text_hash, _evidence, _site_rate, _posterior, _keep) for each row.

    Texts are scored once: a few bytes of each row are written, of which sites
    are summed and to which their rates are joined.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    curve = train(docs, labels)
    own = docs.select("*", *_identity())
    rated = common.cut(evidence(own, curve, host, path, ["_doc", "_text_hash"]))
    known = common.cut(sites(rated))
    if known.count() <= SITES:
        known = F.broadcast(known)
    known = known.withColumnRenamed("_host", "_h").withColumnRenamed("_path", "_p")
    joined = rated.join(known, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    rate, posterior = _posterior()
    keep = F.lit(True) if curve is None else F.col("_posterior") >= REJECT_BELOW
    return joined.select("_doc", "_text_hash", "_evidence", rate.alias("_site_rate"), posterior.alias("_posterior")).withColumn("_keep", keep)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Needs ``doc_id``, ``text`` and the columns of ``host`` and ``path`` (default: ``source`` and ``lang``).
    Rejected rows are named by id and text; up to REJECTED of them are broadcast, more are joined by a shuffle.
    """
    bad = common.cut(decided(docs, labels, host, path).where("not _keep").select(F.col("_doc").alias("_bad"), F.col("_text_hash").alias("_bad_hash")).distinct())
    if bad.count() <= REJECTED:
        bad = F.broadcast(bad)
    doc, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID)), F.xxhash64(docs["text"].cast("string"))
    return docs.join(bad, (doc == bad["_bad"]) & (text == bad["_bad_hash"]), "left_anti")


def query(spark, sf_dir):
    c = decided(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    doc = F.when(F.col("_doc") != common.NULL_ID, F.col("_doc")).alias("doc_id")
    return c.select(doc, *[F.col(f"_{n}").alias(n) for n in ("evidence", "site_rate", "posterior", "keep")])
