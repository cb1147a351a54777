"""Helpers of parser generation: prefixes of lines, representatives, density clusters, closest variables, merged labels."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import align
from ..plans.catalog import Catalog, wildcard
from . import graphs, match, similarity, stats

#: Bytes of vectors in a block, blocks at least, and rows by columns of one product.
BLOCK_BYTES, BLOCKS, ROWS, COLUMNS = 32_000_000, 5, 1024, 4096


def prefixes(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """(line_id, node_id, prefix, suffix) of unmatched lines: the deepest node reached, ties to the smaller one; node 0 for none."""
    depth = F.create_map(*[x for n in catalog.nodes for x in (F.lit(n), F.lit(len(catalog.lineage(n))))]) if catalog.nodes else F.create_map().cast("map<int,int>")
    best = F.array_min(F.transform("partial", lambda p: F.struct((-F.element_at(depth, p["node_id"])).alias("d"), p["node_id"].alias("node_id"), p["suffix"].alias("suffix"))))
    line = scalars.strip(F.coalesce("content", F.lit("")))
    own = match.unmatched(parsed).select("line_id", line.alias("_line"), best.alias("_b"))
    suffix = F.coalesce("_b.suffix", "_line")
    return own.select("line_id", F.coalesce("_b.node_id", F.lit(0)).alias("node_id"), F.expr("substring(_line, 1, length(_line) - length(coalesce(_b.suffix, _line)))").alias("prefix"), suffix.alias("suffix"))


def filled(parsed: DataFrame) -> DataFrame:
    """(line_id, template_id) of the full matches whose variables are all non-empty."""
    whole = F.filter("matches", lambda m: F.forall(m["fields"], lambda f: f["value"] != ""))
    return parsed.select("line_id", F.explode(F.transform(whole, lambda m: m["template_id"])).alias("template_id"))


def same_prefix(lines: list[str], catalog: Catalog, node: int) -> list[str]:
    """Lines (a bounded sample) with what they match up to ``node`` replaced by the first one's text."""
    pattern = re.compile(match.prefix_pattern(catalog, tuple(catalog.lineage(node)), capture=False))
    found = [pattern.match(x) for x in lines]
    first = next((m[0] for m in found if m), "")
    return [first + x[m.end() :] if m else x for x, m in zip(lines, found, strict=True)]


def all_match(lines: DataFrame, pattern: str, content: str = "content") -> DataFrame:
    """One row: whether the pattern is found in all lines, in how many, and how often in all."""
    p = F.lit(pattern)
    hit = F.col(content).rlike(pattern)
    return lines.agg(F.coalesce(F.bool_and(hit), F.lit(True)).alias("all"), F.count_if(hit).alias("lines"), F.coalesce(F.sum(F.regexp_count(F.col(content), p)), F.lit(0)).alias("times"))


def previous_matches(parsed: DataFrame, pattern: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(template_id, n): sampled lines of each template that a candidate pattern takes too."""
    return stats.sample(parsed, k, seed).where(F.col("content").rlike(pattern)).groupBy("template_id").agg(F.count("*").alias("n"))


# --- clusters ----------------------------------------------------------------


def vector_forest(vectors: DataFrame, eps: float) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of vectors(id, vector) within Euclidean distance ``eps``; vectors are distinct.

    All pairs are looked at, as no cut of space helps in many dimensions: rows
    are dealt into blocks of bounded bytes, each pair of blocks is one group and
    gives a tree for each component that it finds, so what leaves a group grows
    with its rows, not with its pairs.
    """
    sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))  # others are near nothing
    sized = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(sound)
    held = sized.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    blocks = max(BLOCKS, -(-held // BLOCK_BYTES))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.select(F.size("vector").alias("d"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "vector")

    def run(key, group):
        d, a, b = (k.as_py() for k in key)
        ids = group.column("id").to_numpy()
        x = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
        first = group.column("own").to_numpy() == a
        order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
        ids, x, n = ids[order], x[order], int(first.sum())
        root = _trees(x, slice(0, n), slice(0, n) if a == b else slice(n, len(ids)), eps)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": pa.array(ids[root[far]]), "v": pa.array(ids[far])})

    return pairs.repartition(2 * blocks * (blocks + 1), "d", "a", "b").groupBy("d", "a", "b").applyInArrow(run, "u long, v long")


def _trees(x: np.ndarray, left: slice, right: slice, eps: float) -> np.ndarray:
    """For each row the root that pairs within ``eps`` between two stretches of rows give it.

    Products tell pairs that are near or far by more than their rounding; the others are measured.
    """
    root = np.arange(len(x))
    norm = (x * x).sum(axis=1)
    top = max(float(norm.max(initial=0)), eps * eps)
    kind = np.float32 if top < 1e3 * eps * eps and top > 1e-30 else np.float64
    slack = 4 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * top
    y, half = x.astype(kind), (norm / 2).astype(kind)
    least = kind((eps * eps + slack) / 2)
    for i in range(left.start, left.stop, ROWS):
        mine = slice(i, min(i + ROWS, left.stop))
        for j in range(right.start, right.stop, COLUMNS):
            theirs = slice(j, min(j + COLUMNS, right.stop))
            if left == right and theirs.stop <= mine.start:
                continue
            s = y[mine] @ y[theirs].T
            s -= half[mine, None]
            s -= half[None, theirs]
            u, v = np.nonzero(~(s < -least))
            u, v = u + i, v + j
            open_ = (u != v) & (root[u] != root[v])
            u, v = u[open_], v[open_]
            for k in range(0, len(u), COLUMNS):
                p, q = u[k : k + COLUMNS], v[k : k + COLUMNS]
                at = root[p] != root[q]
                p, q = p[at], q[at]
                near = np.sqrt(((x[p] - x[q]) ** 2).sum(axis=1)) <= eps
                _join(root, p[near], q[near])
    return root


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u[i] and v[i]; every row's root is the least row of its class, before and after."""
    while len(u):
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up
        differ = root[u] != root[v]
        u, v = u[differ], v[differ]


def density_clusters(vectors: DataFrame, eps: float = 0.05) -> DataFrame:
    """(id, cluster) of vectors(id, vector): components of pairs within ``eps``; a vector near no other has null.

    Equal vectors are one node, so a vector with very many copies is one row in the search.
    """
    keyed = vectors.where(F.col("vector").isNotNull()).withColumn("_k", F.transform("vector", lambda x: x.cast("double")))
    classes = graphs.cut(keyed.groupBy("_k").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = graphs.components(vector_forest(classes.select(F.col("least").alias("id"), F.col("_k").alias("vector")), eps)).withColumnRenamed("node", "least")
    own = classes.join(roots, "least", "left").select("_k", F.when(F.col("root").isNotNull(), F.col("root")).when(F.col("n") > 1, F.col("least")).alias("cluster"))
    return keyed.select("id", "_k").join(own, "_k").select("id", "cluster")


def direction_clusters(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """The same at cosine ``least``: on unit vectors that is a Euclidean distance."""
    norm = F.sqrt(scalars.dot(F.col("vector"), F.col("vector")))
    unit = match.once(vectors.where(F.col("vector").isNotNull()), _n=norm).where(F.col("_n") > 0).select("id", F.transform("vector", lambda x: F.round(x.cast("double") / F.col("_n"), 12)).alias("vector"))
    return density_clusters(unit, float(np.sqrt(2 * (1 - least))))


def by_prefix(clusters: DataFrame, prefix: DataFrame) -> DataFrame:
    """(cluster, node_id, n, ids): clusters (id, cluster) parted by the prefix their lines matched, largest first; the unclustered come last.

    ``ids`` are the first five.
    """
    both = clusters.join(prefix.select(F.col("line_id").alias("id"), "node_id"), "id")
    first = Window.partitionBy("cluster", "node_id").orderBy("id")
    counts = both.groupBy("cluster", "node_id").agg(F.count("*").alias("n"))
    ids = both.withColumn("_r", F.row_number().over(first)).where("_r <= 5").groupBy("cluster", "node_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    key = [counts["cluster"].eqNullSafe(ids["cluster"]), counts["node_id"] == ids["node_id"]]
    out = counts.join(ids, key).select(counts["cluster"], counts["node_id"], "n", "ids")
    return out.orderBy(F.col("cluster").isNull(), F.desc("n"), "cluster", "node_id")


def representatives(lines: list[str], n: int = 5, seed: int = 0) -> list[str]:
    """Up to n different lines of a bounded buffer: medoids of its clusters, then others in an order that the seed fixes."""
    import hashlib

    kinds = list(dict.fromkeys(lines))
    out = [x for x, _ in similarity.cluster_buffer(kinds, n)] if kinds else []
    rest = sorted((x for x in kinds if x not in out), key=lambda x: hashlib.md5(f"{seed}{x}".encode()).digest())
    return (out + rest)[:n]


def few_shots(query: list[float], centroids: dict[int, list[float]], seeds: list[int] = (), k: int = 5) -> list[int]:
    """Templates to show beside a new one: seeds first, then by the cosine of their centroids."""
    q = similarity._unit(np.array([query], float))[0]
    scores = {t: float(similarity._unit(np.array([v], float))[0] @ q) for t, v in centroids.items()}
    return list(dict.fromkeys([*seeds, *sorted(scores, key=lambda t: (-scores[t], t))]))[:k]


def closest_variables(catalog: Catalog, node: int, overlap: dict[int, float], embedding: dict[int, float], k: int = 6) -> list[int]:
    """Variables most like ``node``: by shared values, by place in the tree, by their template's likeness, a third of k each, in turns."""
    others = [n for n, x in catalog.nodes.items() if x.token.is_variable and n != node]
    path = catalog.lineage(node)

    def depth(n):
        other = catalog.lineage(n)
        return sum(1 for a, b in zip(path, other, strict=False) if a == b)

    quota = max(1, k // 3)
    ranks = [
        sorted((n for n in others if overlap.get(n, 0) > 0), key=lambda n: (-overlap[n], n)),
        sorted(others, key=lambda n: (-depth(n), n)),
        sorted(others, key=lambda n: (-max((embedding.get(t, 0.0) for t in catalog.templates_of(n)), default=0.0), n)),
    ]
    return similarity.interleave(*[r[: 2 * quota] for r in ranks], k=k)


def merge_labels(*clusterings: dict[int, int], kind: dict[int, str] | None = None) -> dict[int, int]:
    """The finest clustering that all given ones refine, parted by kind: member -> smallest member."""
    root = graphs.union_find((n, c) for own in clusterings for n, c in own.items())
    groups = defaultdict(list)
    for n in {n for own in clusterings for n in own}:
        groups[root[n], (kind or {}).get(n)].append(n)
    return {n: min(own) for own in groups.values() for n in own}


def attribute_medoids(catalog: Catalog) -> dict[str, str | None]:
    """attribute -> the description nearest to the others of its nodes."""
    by = defaultdict(list)
    for n, s in sorted(catalog.semantics.items()):
        if s.name and s.embedding:
            by[s.name].append((n, s))
    out = {}
    for name, own in by.items():
        m = similarity._unit(np.array([s.embedding for _, s in own], float))
        out[name] = own[int(np.argmin((1 - m @ m.T).sum(axis=1).round(12)))][1].description
    return out


# --- tables of other tools --------------------------------------------------------


def parse_structured(structured: DataFrame, templates: dict[str, str], whole: bool = True) -> DataFrame:
    """(LineId, Content, ids, texts, groups): every wildcard template tried on each line's content, in order of the templates."""
    tests = []
    for k, text in templates.items():
        p = align.wildcard_pattern(text, whole)
        n = re.compile(p).groups
        groups = F.array(*[F.regexp_extract("Content", p, i + 1) for i in range(n)]).cast("array<string>")
        tests.append(F.when(F.col("Content").rlike(p), F.struct(F.lit(k).alias("id"), F.lit(text).alias("text"), groups.alias("groups"))))
    kind = "array<struct<id:string,text:string,groups:array<string>>>"
    found = F.filter(F.array(*tests), lambda m: m.isNotNull()).cast(kind) if tests else F.array().cast(kind)
    out = match.once(structured.select("LineId", "Content"), _m=found)
    return out.select("LineId", "Content", F.col("_m.id").alias("ids"), F.col("_m.text").alias("texts"), F.col("_m.groups").alias("groups"))


def suffix_matches(lines: DataFrame, catalog: Catalog) -> DataFrame:
    """(line_id, template_id, text, values): full matches of ``content`` seen from its part ``suffix``, a variable cut where that begins.

    Lines that do not end with their suffix, white space aside, give no row.
    """

    def run(batches):
        blank, gaps = re.compile(r"\s"), re.compile(r"\s*")
        plans = []
        for t in catalog.order():
            p = match.compile_template(catalog, t)
            tokens = [catalog.nodes[n].token for n in catalog.templates[t]]
            spans = [(x.is_variable, x.ws, None if x.is_variable else re.compile(x.pattern(last=True))) for x in tokens]
            plans.append((t, p.needle, re.compile(p.pattern), [re.compile(g) for g in p.guards], spans))
        for b in batches:
            rows = []
            for i, content, suffix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content, suffix = (content or "").strip(scalars.BLANKS), (suffix or "").strip(scalars.BLANKS)
                if suffix and not suffix[0].isspace() and content.endswith(suffix):
                    start = len(content) - len(suffix)  # a stripped suffix begins with no blank
                else:
                    bare = blank.sub("", suffix)
                    if not blank.sub("", content).endswith(bare):
                        continue
                    start, left = len(content), len(bare)
                    while left:
                        start -= 1
                        left -= not content[start].isspace()
                for t, needle, full, guards, spans in plans:
                    if needle not in content or not (hit := full.match(content)) or not all(g.match(content) for g in guards):
                        continue
                    text, values, at, k = "", [], 0, 0
                    for is_variable, ws, pattern in spans:
                        if is_variable:
                            k += 1
                            a, e = hit.span(k)
                            if e > start or a == e >= start:
                                values.append(content[max(a, start) : e])
                                text += "<*>"
                        else:
                            a = pattern.search(content, at)
                            a, e = a.span() if a else (at, at)
                            if e > start:
                                text += content[max(a, start) : e]
                        at = e
                        gap = gaps.match(content, at).end() if ws else at
                        if gap > start:
                            text += " " * (gap - max(at, start))
                        at = gap
                    rows.append((i, t, " ".join(text.split()), values))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], ["line_id", "template_id", "text", "values"])

    return match.spread(lines.select(F.col("line_id").cast("long"), "content", "suffix")).mapInArrow(run, "line_id long, template_id int, text string, values array<string>")


def write_benchmark(parsed: DataFrame, catalog: Catalog, path: str) -> None:
    """Structured and template CSVs in the layout that log-parsing benchmarks read; a line's first template counts."""
    text = {t: wildcard(catalog, t).strip() for t in catalog.templates}
    texts = F.create_map(*[x for t, s in text.items() for x in (F.lit(t), F.lit(s))])
    first = F.get(F.col("matches.template_id"), F.lit(0))
    own = match.once(parsed.select((F.col("line_id") + 1).alias("LineId"), F.col("content").alias("Content"), "matches"), _t=first)
    own.select("LineId", "Content", F.concat(F.lit("E"), F.col("_t").cast("string")).alias("EventId"), F.element_at(texts, F.col("_t")).alias("EventTemplate")).write.mode("error").option("header", True).option("escape", '"').csv(f"{path}/structured")
    counts = stats.template_counts(parsed)
    counts.select(F.concat(F.lit("E"), F.col("template_id").cast("string")).alias("EventId"), F.element_at(texts, F.col("template_id")).alias("EventTemplate"), F.col("n").alias("Occurrences")).coalesce(1).write.mode("error").option("header", True).option("escape", '"').csv(f"{path}/templates")
