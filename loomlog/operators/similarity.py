"""Nearest neighbours, clusters, medoids and centroids over token sets and vectors.

Searches take a stated query set against all rows: queries are held in blocks
of a bounded size, each task keeps its own best k, and only those are shuffled.
Clusters at distance ``eps`` with two members or more are the connected
components of the graph of pairs within ``eps``; short sets that share a large
subset have an edge to the first of them, longer ones come from an exact join by
rare tokens, so no group of short sets is paired in full.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Catalog
from . import graphs

#: Bytes of queries that a pass over the rows holds.
BLOCK_BYTES = 64_000_000
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Large subsets of a set up to which near sets are found by them.
SUBSETS = 256


def _blocks(queries: DataFrame, size) -> list[list]:
    """Queries in blocks of at most BLOCK_BYTES; they stream through the driver one partition at a time."""
    out, held = [[]], 0
    for row in queries.toLocalIterator():
        n = size(row)
        if held + n > BLOCK_BYTES and out[-1]:
            out.append([])
            held = 0
        out[-1].append(row)
        held += n
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "target_id", "score")


def jaccard_topk(queries: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, target_id, score): the k targets with the highest Jaccard similarity, ties to the smaller id.

    Both have (id, tokens), tokens without repeats; pairs that share nothing score 0 and fill up in order of id.
    """
    found = None
    for block in _blocks(queries.select(F.col("id").cast("long"), "tokens"), lambda r: 64 + sum(len(t) + 60 for t in r[1] or ())):
        part = _jaccard_pass(targets, block, k)
        found = part if found is None else found.union(part)
    return _best(found, k)


def _jaccard_pass(targets: DataFrame, block: list, k: int) -> DataFrame:
    ids = [r[0] for r in block]
    sizes = np.array([len(r[1] or ()) for r in block])
    posting: dict[str, list[int]] = defaultdict(list)
    for q, r in enumerate(block):
        for t in r[1] or ():
            posting[t].append(q)
    postings = {t: np.array(q) for t, q in posting.items()}
    shared = targets.sparkSession.sparkContext.broadcast((ids, sizes, postings))

    def run(batches):
        ids, sizes, postings = shared.value
        best: list[list] = [[] for _ in ids]
        worst = np.full(len(ids), -1.0)  # score that a target must reach to be looked at
        for b in batches:
            for target, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = tokens or []
                hits = [postings[t] for t in tokens if t in postings]
                both = np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(len(ids), int)
                total = np.maximum(sizes + len(tokens) - both, 1)
                score = both / total
                for q in np.flatnonzero(score >= worst).tolist():
                    entry = (float(score[q]), -target)
                    if len(best[q]) < k:
                        heapq.heappush(best[q], entry)
                    elif entry > best[q][0]:
                        heapq.heapreplace(best[q], entry)
                    if len(best[q]) == k:
                        worst[q] = best[q][0][0]
        rows = [(ids[q], -t, s) for q, own in enumerate(best) for s, t in own]
        q, t, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.float64())], ["query_id", "target_id", "score"])

    return targets.select(F.col("id").cast("long"), "tokens").mapInArrow(run, "query_id long, target_id long, score double")


def cosine_topk(queries: DataFrame, targets: DataFrame, k: int = 5, other_than_self: bool = True) -> DataFrame:
    """(query_id, rank, target_id, score): the k targets with the highest cosine, ties to the smaller id.

    Both have (id, vector); zero vectors score 0.
    """
    found = None
    for block in _blocks(queries.select(F.col("id").cast("long"), "vector").where("vector is not null"), lambda r: 8 * len(r[1])):
        if not block:
            continue
        part = _cosine_pass(targets, block, k, other_than_self)
        found = part if found is None else found.union(part)
    if found is None:
        return targets.sparkSession.createDataFrame([], "query_id long, rank int, target_id long, score double")
    return _best(found, k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def _cosine_pass(targets: DataFrame, block: list, k: int, other: bool) -> DataFrame:
    shared = targets.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), _unit(np.array([r[1] for r in block], float))))

    def run(batches):
        ids, q = shared.value
        best_s, best_t = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        rows = max(1, CELLS // 4096)  # queries that are compared at once: the scores of all would be as large as queries times targets
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                own = part.column(0).to_numpy()
                m = _unit(np.stack([np.asarray(x, float) for x in part.column(1).to_numpy(zero_copy_only=False)]))
                for at in range(0, len(ids), rows):
                    some = slice(at, at + rows)
                    s = q[some] @ m.T
                    if other:
                        s[ids[some, None] == own[None, :]] = -np.inf
                    hit = np.flatnonzero((s >= best_s[some, -1:]).any(axis=1))  # a score as high as the k-th may have a smaller id
                    if not len(hit):
                        continue
                    hit_s = np.hstack([best_s[some][hit], s[hit]])
                    hit_t = np.hstack([best_t[some][hit], np.broadcast_to(own, (len(hit), len(own)))])
                    order = np.lexsort([hit_t, -hit_s], axis=1)[:, :k]
                    best_s[at + hit], best_t[at + hit] = np.take_along_axis(hit_s, order, 1), np.take_along_axis(hit_t, order, 1)
        for at in range(0, len(ids), rows):
            row, col = np.nonzero(best_s[at : at + rows] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + row]), pa.array(best_t[at + row, col]), pa.array(best_s[at + row, col])], ["query_id", "target_id", "score"])

    return targets.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, target_id long, score double")


# --- clusters --------------------------------------------------------------


def jaccard_links(sets: DataFrame, least: float, among: Column | None = None) -> DataFrame:
    """(u, v): pairs of ``sets(id, tokens)`` with Jaccard similarity ``least`` or more; tokens sets are distinct.

    Two such sets share one of their few rarest tokens; only those are joined on.
    With ``among`` one of a pair holds that condition on ``tokens``.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, at most 1")
    counts = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    ranked = sets.select("id", F.explode("tokens").alias("t")).join(counts, "t").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("tokens"))
    ranked = graphs.cut(ranked)
    n = F.size("tokens")
    head = F.slice("tokens", 1, (n - F.ceil(n * F.lit(least - 1e-9)) + 1).cast("int"))
    entry = ranked.select("id", n.alias("n"), (F.lit(True) if among is None else among).alias("k"), F.explode(head).alias("t"))
    a, b = entry.toDF("u", "nu", "ku", "t"), entry.toDF("v", "nv", "kv", "t")
    near = a.join(b, "t").where((F.col("u") < F.col("v")) & (F.col("ku") | F.col("kv")) & (F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(least - 1e-9))).select("u", "v").distinct()
    both = near.join(ranked.toDF("u", "tu"), "u").join(ranked.toDF("v", "tv"), "v")
    return both.where(scalars.jaccard(F.col("tu"), F.col("tv")) >= F.lit(least - 1e-12)).select("u", "v")


def _subsets(n: int, least: float) -> int:
    """How many subsets of a set of n a set with similarity ``least`` to it can share with it."""
    return sum(math.comb(n, k) for k in range(math.ceil(n * (least - 1e-9)), n + 1))


def jaccard_forest(sets: DataFrame, least: float) -> DataFrame:
    """(u, v): edges whose components are those of ``jaccard_links(sets, least)``, no more than the sets' subsets.

    Near sets share a subset that is large in both.  Of all sets with one
    subset, in order of size, those that are near by it are near to the first
    as well, so each has one edge.  Sets with more than SUBSETS large subsets
    are joined by their rare tokens.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, at most 1")
    longest = next((n for n in range(4096) if _subsets(n + 1, least) > SUBSETS), 4096)

    def run(batches):
        for b in batches:
            keys, ids, sizes, shared = [], [], [], []
            for i, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in range(math.ceil(len(tokens) * (least - 1e-9)), len(tokens) + 1):
                    for own in itertools.combinations(tokens, k):
                        keys.append(hashlib.blake2b(repr(own).encode(), digest_size=16).digest())
                        ids.append(i)
                        sizes.append(len(tokens))
                        shared.append(k)
                if len(keys) > 50_000:
                    yield table(keys, ids, sizes, shared)
                    keys, ids, sizes, shared = [], [], [], []
            yield table(keys, ids, sizes, shared)

    def table(keys, ids, sizes, shared):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(shared, pa.int32())], ["s", "id", "n", "k"])

    short = sets.where(F.size("tokens") <= longest).select(F.col("id").cast("long"), F.array_sort("tokens").alias("tokens"))
    entries = short.mapInArrow(run, "s binary, id long, n int, k int")
    w = Window.partitionBy("s").orderBy("n", "id")
    stars = entries.withColumn("u", F.first("id").over(w)).withColumn("nu", F.first("n").over(w)).where("id <> u")
    out = stars.where(F.col("k") / (F.col("n") + F.col("nu") - F.col("k")) >= F.lit(least - 1e-12)).select("u", F.col("id").alias("v"))
    if sets.where(F.size("tokens") > longest).isEmpty():
        return out
    reach = sets.where(F.size("tokens") >= F.lit((longest + 1) * (least - 1e-9)))
    return out.union(jaccard_links(reach, least, F.size("tokens") > longest))


def jaccard_clusters(lines: DataFrame, eps: float = 0.5, strict: bool = False) -> DataFrame:
    """(id, cluster) of lines(id, text): cluster is its smallest id; lines near no other one have null.

    Lines with equal token sets are one node; lines without tokens are near nothing.
    """
    tokens = lines.select("id", F.array_sort(scalars.line_tokens(F.coalesce("text", F.lit("")), strict)).alias("tokens"))
    tokens = tokens.withColumn("key", F.array_join("tokens", " "))
    classes = graphs.cut(tokens.where(F.size("tokens") > 0).groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("tokens").alias("tokens")))
    roots = graphs.components(jaccard_forest(classes.select(F.col("least").alias("id"), "tokens"), 1 - eps))
    labelled = classes.join(roots.withColumnRenamed("node", "least"), "least", "left")
    own = labelled.select("key", F.when(F.col("root").isNotNull(), F.col("root")).when(F.col("n") > 1, F.col("least")).alias("cluster"))
    return tokens.select("id", "key").join(own, "key", "left").select("id", "cluster")


def medoids(lines: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, id): the member with the least sum of Jaccard distances to its cluster, ties to the smaller id.

    A token that one set of a cluster alone has is shared with no other, so sets
    of one size with the same other tokens are one kind: the sum over members is
    a sum over kinds with their counts, which are compared in blocks.
    """
    sets = lines.join(clusters.where("cluster is not null"), "id").select("cluster", "id", F.array_sort(scalars.line_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    sets = graphs.cut(sets.groupBy("cluster", "tokens").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    kinds = _kinds(sets)
    sets = graphs.cut(kinds.groupBy("cluster", "tokens", "size").agg(F.min("id").alias("id"), F.sum("n").alias("n")))
    width = 1024
    sizes = sets.groupBy("cluster").agg(F.ceil(F.count("*") / width).cast("int").alias("blocks"))
    dealt = sets.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = dealt.select("cluster", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "id", "tokens", "size", "n", F.lit(0).alias("side"))
    right = dealt.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.col("own").alias("b"), "id", "tokens", "size", "n", F.lit(1).alias("side"))

    def run(key, group):
        rows = group.to_pylist()
        mine, others = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
        posting = defaultdict(list)
        for k, r in enumerate(others):
            for t in r["tokens"]:
                posting[t].append(k)
        postings = {t: np.array(p) for t, p in posting.items()}
        size, weight = np.array([r["size"] for r in others]), np.array([r["n"] for r in others])
        total = []
        for r in mine:
            hits = [postings[t] for t in r["tokens"] if t in postings]
            both = np.bincount(np.concatenate(hits), minlength=len(others)) if hits else np.zeros(len(others), int)
            total.append(float(((1 - both / np.maximum(size + r["size"] - both, 1)) * weight).sum()))
        return pa.table({"cluster": pa.array([r["cluster"] for r in mine], pa.int64()), "id": pa.array([r["id"] for r in mine], pa.int64()), "total": pa.array(total, pa.float64())})

    sums = left.union(right).groupBy("cluster", "a", "b").applyInArrow(run, "cluster long, id long, total double")
    sums = sums.groupBy("cluster", "id").agg(F.sum("total").alias("total")).withColumnsRenamed({"id": "kind", "cluster": "c"})
    own = kinds.join(sets.select("cluster", "tokens", "size", F.col("id").alias("kind")), ["cluster", "tokens", "size"])
    self = F.when(F.col("size") > 0, 1 - F.size("tokens") / F.greatest(2 * F.col("size") - F.size("tokens"), F.lit(1))).otherwise(0.0)  # what the sum has for a set's distance to itself, which is 0
    each = own.join(sums, (F.col("cluster") == F.col("c")) & (own["kind"] == sums["kind"])).select("cluster", "id", F.round(F.col("total") - F.col("n") * self, 9).alias("total"))
    return each.groupBy("cluster").agg(F.min(F.struct("total", "id")).alias("m")).select("cluster", F.col("m.id").alias("id"))


def _kinds(sets: DataFrame) -> DataFrame:
    """(cluster, id, n, size, tokens): ``tokens`` without those that one set of the cluster alone has."""
    each = sets.select("cluster", "id", F.explode("tokens").alias("t"))
    alone = each.groupBy("cluster", "t").agg(F.min("id").alias("id"), F.count("*").alias("c")).where("c = 1").groupBy("cluster", "id").agg(F.collect_list("t").alias("alone"))
    both = sets.join(alone, ["cluster", "id"], "left")
    rest = F.array_except("tokens", F.coalesce("alone", F.array().cast("array<string>")))
    return graphs.cut(both.select("cluster", "id", "n", F.size("tokens").alias("size"), rest.alias("tokens")))


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """(by, n, centroid): mean vector of each group; sums are made before the shuffle, a group may be of any size."""
    parts = vectors.where(F.col("vector").isNotNull()).select(by, F.posexplode("vector").alias("pos", "x"))
    mean = parts.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def merge_clusters(centroid: DataFrame, by: str = "label", least: float = 0.95) -> DataFrame:
    """(by, merged): labels whose centroids are within cosine ``least``, closed transitively; merged is the smallest.

    There is one centroid for each label: the driver holds them (at most BLOCK_BYTES).
    """
    rows, held = [], 0
    for r in centroid.select(by, "centroid").toLocalIterator():
        held += 8 * len(r[1])
        if held > BLOCK_BYTES:
            raise ValueError("too many labels for the driver")
        rows.append((r[0], r[1]))
    rows.sort()
    m = _unit(np.array([v for _, v in rows], float)) if rows else np.zeros((0, 1))
    a, b = np.nonzero(np.triu(m @ m.T > least, 1))
    root = graphs.union_find((rows[i][0], rows[j][0]) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    kind = dict(centroid.dtypes)[by]
    return centroid.sparkSession.createDataFrame([(k, root.get(k, k)) for k, _ in rows], f"{by} {kind}, merged {kind}")


def centroid_rank(centroid: DataFrame, vectors: DataFrame, by: str = "label", k: int = 3) -> DataFrame:
    """(id, rank, label, score): the k nearest centroids of each vector; labels are few and travel with the task."""
    shared = vectors.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in centroid.select(by, "centroid").collect()))

    def run(batches):
        rows = shared.value
        m = _unit(np.array([v for _, v in rows], float))
        labels = np.array([r for r, _ in rows])
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            s = np.round(_unit(np.stack([np.asarray(x, float) for x in b.column(1).to_numpy(zero_copy_only=False)])) @ m.T, 9)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            n = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows)), pa.array(labels[order].ravel().astype(np.int64)), pa.array(np.take_along_axis(s, order, 1).ravel())],
                ["id", "rank", "label", "score"],
            )

    return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "id long, rank int, label long, score double")


def nearest_description(vectors: DataFrame, by: str = "label") -> DataFrame:
    """(by, id): the member nearest to its group's centroid."""
    c = centroids(vectors, by)
    scored = vectors.join(F.broadcast(c.select(by, "centroid")), by).select(by, "id", F.round(scalars.cosine(F.col("vector"), F.col("centroid")), 9).alias("s"))
    return scored.groupBy(by).agg(F.max(F.struct("s", (-F.col("id")).alias("i"))).alias("m")).select(by, (-F.col("m.i")).alias("id"))


# --- bounded buffers and metadata, on the driver ----------------------------


def cluster_buffer(lines: list[str], n: int, depth: int = 10, strict: bool = False) -> list[tuple[str, int]]:
    """At most n clusters of a bounded buffer of lines as (medoid, size), largest first.

    The distance at which lines join is searched by halving; n <= 0 takes 0.5 and keeps all clusters.
    """
    import re

    lines = list(lines)
    if 0 < n and len(lines) <= n:
        return [(x, 1) for x in lines]
    fold = lambda s: re.sub("[^a-z]", "", s.lower()) if strict else s.lower()
    sets = [frozenset(t for t in re.split(r"[.\-/_:\\\s]+", fold(s)) if t) for s in lines]
    kinds = sorted(set(sets), key=sets.index)
    index = {s: k for k, s in enumerate(kinds)}
    dist = np.ones((len(kinds), len(kinds)))
    for i, a in enumerate(kinds):
        for j, b in enumerate(kinds):
            if a and b:
                dist[i, j] = 1 - len(a & b) / len(a | b)

    def run(eps):
        a, b = np.nonzero(np.triu(dist <= eps, 1))
        root = graphs.union_find(zip(a.tolist(), b.tolist(), strict=True))
        groups = defaultdict(list)
        for k, s in enumerate(sets):
            groups[root.get(index[s], index[s])].append(k)
        return list(groups.values())

    if n <= 0:
        groups = run(0.5)
    else:
        low, high = 0.0, 1.0
        groups = run(1.0)
        for _ in range(depth):
            eps = (low + high) / 2
            got = run(eps)
            if len(got) <= n:
                groups, high = got, eps
            else:
                low = eps
    out = []
    for g in groups:
        own = [index[sets[k]] for k in g]
        out.append((lines[g[int(np.argmin(dist[np.ix_(own, own)].sum(axis=1)))]], len(g)))
    out.sort(key=lambda x: -x[1])
    return out if n <= 0 else out[:n]


def coverage(line: str, weights: dict[str, float]) -> float:
    """Mean weight of the characters that weighted tokens cover (the greatest where they overlap), times the found tokens' share of all weight."""
    if not line or not weights:
        return 0.0
    mask, found = np.zeros(len(line)), 0.0
    for token, w in weights.items():
        at = line.find(token) if token else -1
        if at < 0:
            continue
        found += w
        while at >= 0:
            np.maximum(mask[at : at + len(token)], w, out=mask[at : at + len(token)])
            at = line.find(token, at + 1)
    total = sum(weights.values())
    return float(mask.mean()) * (found / total if total else 1.0)


def rank_templates(line: str, full: dict[int, dict[str, float]], parts: dict[int, dict[str, float]], k: int = -1) -> list[tuple[int, float]]:
    """Templates by half the coverage with whole tokens and half that with parts."""
    scores = [(t, 0.5 * (coverage(line, full[t]) + coverage(line, parts.get(t, {})))) for t in full]
    scores.sort(key=lambda x: -x[1])
    return scores[:k] if k > 0 else scores


def template_distance(weights: dict[int, dict[str, float]], template: int, k: int = -1) -> list[tuple[int, float]]:
    """Other templates by the weight of the tokens they share with ``template`` over all its weight."""
    own = weights[template]
    total = sum(own.values()) or 1.0
    scores = [(t, sum(w for x, w in own.items() if x in other) / total) for t, other in weights.items() if t != template]
    scores.sort(key=lambda x: -x[1])
    return scores[:k] if k > 0 else scores


def ordered_templates(catalog: Catalog, node: int) -> list[tuple[int, float]]:
    """Templates by how far from ``node``'s path they part, as a share of that path."""
    path = catalog.lineage(node)
    out = []
    for t, own in catalog.templates.items():
        same = 0
        while same < min(len(path), len(own)) and path[same] == own[same]:
            same += 1
        out.append((t, 1 - same / len(path)))
    return sorted(out, key=lambda x: x[1])


def prefix_clusters(catalog: Catalog) -> dict[int, int]:
    """Variables that stand behind equal text: node -> least such node, carried on until nothing changes."""
    variables = [n for n in catalog.breadth_first() if catalog.nodes[n].token.is_variable]
    label = {n: n for n in variables}
    while True:
        by: dict[tuple, list[int]] = defaultdict(list)
        for n in variables:
            key = tuple(label[m] if m in label else catalog.nodes[m].token.value.replace(" ", "") for m in catalog.lineage(n)[:-1])
            by[(*_joined(key), catalog.nodes[n].token.type)].append(n)
        new = {n: min(label[m] for m in own) for own in by.values() for n in own}
        if new == label:
            return label
        label = new


def _joined(key: tuple) -> list:
    out: list = []
    for x in key:
        if isinstance(x, str) and out and isinstance(out[-1], str):
            out[-1] += x
        else:
            out.append(x)
    return out


def interleave(*rankings: list, k: int = -1) -> list:
    """One ranking from several, taking turns, without repeats."""
    out: dict = {}
    for i in range(max(map(len, rankings), default=0)):
        for r in rankings:
            if i < len(r):
                out.setdefault(r[i])
    got = list(out)
    return got[:k] if k > 0 else got
