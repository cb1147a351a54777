"""Near-duplicates by word shingles: SimHash candidates from multi-index hashing, exact Jaccard verification.

Two texts are linked when the sets of their ``WORDS``-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more; groups are connected components.

1. Texts with equal words are one class; only classes are compared.
2. A class has a long SimHash fingerprint over its shingle set: one word of 64
   bits to compare, and ``segments`` segments of ``width`` bits to look up.
   Bits of two texts differ with probability p = angle / pi, which the
   similarity bounds (``bit_error``).  ``plan`` takes segments of log2(classes)
   bits, so that a bucket holds a class or two by chance at any corpus size,
   and as many segments as the stated recall needs with Hamming balls of the
   cheapest radius around each segment.
3. Flipping one bit changes the parity of a segment.  So for radius 1 only
   classes whose segment has odd parity enumerate their ball, and every pair
   still meets, at half the rows.  Radius 2 probes the ball of radius 1 from
   both sides.
4. Everything in a bucket is compared with its smallest and its largest class
   by id, in one word of 64 bits; where a bucket has two classes, that is all
   pairs.  A few of each class's partners are verified on the whole shingle
   sets first; they join the members of a large group of copies, so that later
   steps skip its pairs.
5. Classes that meet an outer class in a bucket of more than ``FULL`` entries form
   families.  A family that is not one component yet is verified whole, in
   pairs of blocks that carry the sets: each sends on a spanning forest of true
   links between components, so none of a large group's pairs are written out.
6. What is left of the pairs, and the pairs of other buckets that step 4 did not
   compare, are verified between classes of different components and families.

No possible link is left out.  A large family in which many texts are just below
the similarity costs its blocks' comparisons; memory stays bounded.

Recall is ``RECALL`` or more for a pair just at the similarity, and rises fast
above it (tests measure both).  Words are separated by ASCII white space, A-Z in
lower case; fewer words than a shingle make one shingle.

Cases: null and blank texts form one class and link to nothing else; very long
texts are read whole; repeated rows and equal texts are one class; of equally
good rows the smallest doc_id stays, a null one only where its group has no
other; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.97
#: Stands in for a null id: it comes after all others.
NO_ID = 2**63 - 1
SLICE = 16_384  # shingles whose bits are counted at once
FIRST = 4  # partners of a class that are verified first
FULL = 8  # entries of a bucket from which its close classes are a family
CLASSES = 20_000  # classes in a part of the tables below
BLOCK, BLOCK_BYTES = 512, 32_000_000  # classes and bytes of sets in a block of a family
SENT = 400_000  # classes whose sets are asked for by a broadcast; more are joined by a shuffle
_HASH = common.SpanHash(31)
_ODD = np.random.default_rng(37).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bit_error(similarity: float) -> float:
    """Probability that a fingerprint bit of two equally large sets of this Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(classes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int, int]:
    """(segments, width, radius, most_bits): the cheapest that reach the recall for pairs just at the similarity."""
    p = bit_error(similarity)
    width = min(36, max(8, math.ceil(math.log2(max(2, classes))) + 1))
    most = math.floor(64 * p + 3 * math.sqrt(64 * p * (1 - p)))
    found, inside = [], 0.0
    for radius, rows in ((0, 1), (1, 1 + width / 2), (2, 2 + 2 * width)):
        inside += math.comb(width, radius) * p**radius * (1 - p) ** (width - radius)
        if radius:
            n = math.ceil(math.log(1 - recall) / math.log(1 - inside)) if inside < 1 else 1
            found.append((n * rows, n, radius))
    _, n, radius = min(found)
    return n, width, radius, most


def shingled(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each document's set of shingles in order, and a hash of each document's whole word sequence."""
    n = len(off) - 1
    low = common.lowered(data)
    start, end, doc = common.word_bounds(low, off)
    h = _HASH.spans(_HASH.sums(low), start, end)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    nth = np.arange(len(h)) - first[doc]
    whole = np.zeros(n, np.uint64)
    some = np.flatnonzero(count)
    power = common.SpanHash._grown(np.ones(1, np.uint64), _HASH.base, int(count.max(initial=0)) + 1)
    if len(some):
        whole[some] = common.mix(np.add.reduceat(h * power[nth], first[some]) + count[some].astype(np.uint64) * _ODD[63])
    acc = np.zeros(len(h), np.uint64)
    for j in range(words):
        at = np.minimum(np.arange(len(h)) + j, max(0, len(h) - 1))
        inside = nth + j < count[doc]
        acc += np.where(inside, h[at] * _ODD[j], np.uint64(0))
    head = (nth + words <= count[doc]) | (nth == 0)
    doc, acc = doc[head], common.mix(acc[head])
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])
    return doc[new], acc[new], whole


def fingerprints(doc: np.ndarray, shingle: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, bits) majority bits of each document's shingles; ``bits`` is a multiple of 64."""
    total = np.zeros((n, bits), np.int32)
    for a in range(0, len(doc), SLICE):
        own, d = shingle[a : a + SLICE], doc[a : a + SLICE]
        heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        for w in range(bits // 64):
            x = np.unpackbits(common.mix(own * _ODD[8 + w % 48] + np.uint64(w)).view(np.uint8).reshape(-1, 8), axis=1)
            total[d[heads], w * 64 : w * 64 + 64] += np.add.reduceat(x, heads, axis=0, dtype=np.int32)
    size = np.bincount(doc, minlength=n)
    return total * 2 > size[:, None]


def keys_of(bits: np.ndarray, segments: int, width: int) -> np.ndarray:
    """(n, segments): segment number and value."""
    weight = np.int64(1) << np.arange(width, dtype=np.int64)
    out = np.empty((len(bits), segments), np.int64)
    for s in range(segments):
        out[:, s] = (np.int64(s) << 40) + bits[:, 64 + s * width : 64 + s * width + width] @ weight
    return out


def described(docs: DataFrame, segments: int, width: int, words: int = WORDS) -> DataFrame:
    """(_doc, _text, _whole, _size, _word, _keys) for each row; _text is a hash of the text as it stands."""
    need = -(-(64 + segments * width) // 64) * 64

    def run(batches):
        for b in batches:
            data, off = common.text_buffers(b.column(1))
            for i, j in common.chunks(off, 1 << 20):
                doc, shingle, whole = shingled(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                bits = fingerprints(doc, shingle, j - i, need)
                word = np.packbits(bits[:, :64], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
                keys = keys_of(bits, segments, width)
                keys = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * segments, pa.array(keys.ravel()))
                size = np.bincount(doc, minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(whole.view(np.int64)), pa.array(size), pa.array(word), keys], ["_doc", "_text", "_whole", "_size", "_word", "_keys"])

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")))
    return d.mapInArrow(run, "_doc long, _text long, _whole long, _size long, _word long, _keys array<long>")


def _rows(classes: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Table entries (key, id, word), and entries with probes."""
    own = classes.select(F.explode("_keys").alias("key"), "id", F.col("_word").alias("word"))
    flips = F.array(*[F.col("key").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(width)])
    if radius == 1:  # the odd ones enumerate; values are below 2**40, segment numbers above
        odd = F.bit_count(F.col("key").bitwiseAND(F.lit((1 << 40) - 1))) % 2 == 1
        return own, own.withColumn("entry", F.lit(True)).union(own.where(odd).select(F.explode(flips).alias("key"), "id", "word", F.lit(False)))
    every = own.union(own.select(F.explode(flips).alias("key"), "id", "word"))
    return every, every.withColumn("entry", F.lit(True))


def sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(id, set): the packed, sorted shingle hashes of the classes ``needed`` (id, _least, _whole)."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_least"), F.col("text").cast("string").alias("_text"))
    joined = d.join(F.broadcast(needed) if needed.count() <= SENT else needed, "_least").select("id", "_whole", "_text")

    def run(batches):
        for b in batches:
            data, off = common.text_buffers(b.column(2))
            ids, want = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in common.chunks(off, 1 << 20):
                doc, shingle, whole = shingled(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                good = np.flatnonzero(whole.view(np.int64) == want[i:j])  # an id may stand for several texts
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][good]), pa.array([shingle[at[k] : at[k + 1]].tobytes() for k in good], pa.binary())], ["id", "set"])

    return joined.mapInArrow(run, "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity."""
    left, right = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))

    def run(batches):
        for b in batches:
            views = [[np.frombuffer(memoryview(x.as_buffer()), "<u8") for x in b.column(k)] for k in (2, 3)]
            good = pa.array([jaccard(x, y) >= similarity for x, y in zip(*views, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _close(most: int):
    return lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= most


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _meetings(classes: DataFrame, width: int, radius: int, most: int) -> DataFrame:
    """(key, id, word, entry, n, low, high): rows of buckets with their partners among the two outer classes, if close, and all rows of buckets of three or more."""
    table, rows = _rows(classes, width, radius)
    outer = table.groupBy("key").agg(F.min(F.struct("id", "word")).alias("lo"), F.max(F.struct("id", "word")).alias("hi"), F.count("*").alias("n"))
    close = _close(most)
    low = F.when((F.col("id") != F.col("lo.id")) & close(F.col("word"), F.col("lo.word")), F.col("lo.id"))
    high = F.when((F.col("id") != F.col("hi.id")) & (F.col("hi.id") != F.col("lo.id")) & close(F.col("word"), F.col("hi.word")), F.col("hi.id"))
    return rows.join(outer, "key").where((F.col("n") > 2) | low.isNotNull() | high.isNotNull()).select("key", "id", "word", "entry", "n", low.alias("low"), high.alias("high"))


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between places ``left`` and ``right`` that join different ``root``s; all are places in ``sets``."""
    size = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        both += part[left] @ part[right].T
    near = (both > 0) & (both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-6)
    parent: dict[int, int] = {}

    def top(i):
        while (up := parent.get(i, i)) != i:
            i = up
        return i

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(near & (root[left][:, None] != root[right][None, :]))), strict=True):
        ra, rb = top(int(root[left[a]])), top(int(root[right[b]]))
        if ra != rb:
            parent[rb] = ra
            out.append((int(left[a]), int(right[b])))
    return out


def _families(met: DataFrame, parts: int) -> DataFrame:
    """(id, family): classes that are close to an outer class of a full bucket."""
    edges = met.where(F.col("n") > FULL).select("id", F.explode(F.array("low", "high")).alias("other")).where("other is not null")
    return common.cut(common.connected_components(edges.select(F.col("id").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("family")), parts)


def _within(families: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """Links (u, v) between different components of each family."""
    of = families.join(roots, "id", "left").select("id", "family", F.coalesce("root", "id").alias("root")).join(sets, "id")
    sizes = of.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("s"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    sizes = common.cut(sizes.select("family", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_BYTES)).cast("int").alias("blocks")), parts)
    own = F.pmod(F.hash("id"), F.col("blocks"))
    dealt = of.join(sizes, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), "id", "root", "set", "own")

    def run(key, group):
        group = group.sort_by("id")
        ids, root, own = (group.column(c).to_numpy() for c in ("id", "root", "own"))
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        edges = block_links([np.frombuffer(x.as_py(), "<u8") for x in group.column("set")], left, right, root, similarity) if len(left) and len(right) else []
        u, v = (np.array([ids[e[k]] for e in edges], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    # by all three, as a family's blocks would else stay where the join by family left them
    return dealt.repartition("family", "ba", "bb").groupBy("family", "ba", "bb").applyInArrow(run, "u long, v long")


def _apart(met: DataFrame, roots: DataFrame, families: DataFrame, most: int, parts: int) -> DataFrame:
    """Close pairs (u, v) of buckets of three or more whose classes are in different components and families."""
    of = met.where("n > 2").join(roots, "id", "left").join(families, "id", "left")
    of = of.select("key", "id", "word", "entry", F.coalesce("root", "id").alias("root"), F.coalesce("family", "id").alias("family"))
    of = common.cut(of, parts)
    counts = of.groupBy("key", "family").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "family"))["family"].alias("main"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("main_key"), "main")
    few = of.join(main, (F.col("key") == F.col("main_key")) & (F.col("family") != F.col("main"))).select(*of.columns)
    other = of.select(F.col("key").alias("pk"), F.col("id").alias("pid"), F.col("word").alias("pw"), F.col("entry").alias("pe"), F.col("root").alias("pr"), F.col("family").alias("pf"))
    near = (F.col("root") != F.col("pr")) & (F.col("family") != F.col("pf")) & (F.col("entry") | F.col("pe")) & _close(most)(F.col("word"), F.col("pw"))
    return few.join(other, (F.col("key") == F.col("pk")) & near).select(*_ordered("id", "pid"))


def components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Materialised rows (_doc, _text, _whole, _size, _word) of all texts, and their classes with a ``_least`` document of the whole component."""
    segments, width, radius, most = plan(docs.count(), similarity, recall)
    rows = common.cut(described(docs, segments, width, words))
    identity = ["_whole", "_size", "_word"]
    classes = rows.groupBy(*identity).agg(F.min("_doc").alias("_least"), F.first("_keys").alias("_keys"))
    classes = common.cut(classes.withColumn("id", F.monotonically_increasing_id()))
    parts = max(16, classes.count() // CLASSES)
    cut = lambda d: common.cut(d, parts)
    classes = classes.coalesce(parts)
    known = classes.select("id", "_least", "_whole")
    met = cut(_meetings(classes.where("_size > 0"), width, radius, most))

    pairs = met.select("id", F.explode(F.array("low", "high")).alias("other")).where("other is not null")
    pairs = cut(pairs.select(*_ordered("id", "other")).distinct())
    nth = F.row_number().over(Window.partitionBy("v").orderBy("u"))
    first = cut(pairs.withColumn("nth", nth).where(F.col("nth") <= FIRST).select("u", "v"))
    ends = lambda d: d.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = cut(sets_of(docs, known.join(ends(first), "id"), words))
    links = cut(_verified(first, sets, similarity))
    roots = cut(common.connected_components(links).withColumnRenamed("node", "id"))

    families = _families(met, parts)
    more = families.select("id").join(sets.select("id"), "id", "left_anti")
    sets = sets.union(cut(sets_of(docs, known.join(more, "id"), words)))
    links = cut(_within(families, roots, sets, similarity, parts))
    of = lambda c: roots.join(families, "id", "full").select(F.col("id").alias(c), F.coalesce("root", "id").alias(f"r{c}"), F.coalesce("family", "id").alias(f"f{c}"))
    left = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    left = left.where((F.coalesce("ru", "u") != F.coalesce("rv", "v")) & (F.coalesce("fu", "u") != F.coalesce("fv", "v"))).select("u", "v")
    left = cut(left.union(_apart(met, roots, families, most, parts)).distinct().join(first, ["u", "v"], "left_anti"))
    more = ends(left).join(sets.select("id"), "id", "left_anti")
    sets = sets.union(cut(sets_of(docs, known.join(more, "id"), words)))
    links = links.union(_verified(left, sets, similarity)).union(roots.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))

    roots = common.connected_components(links).withColumnRenamed("node", "id")
    joined = cut(classes.join(roots, "id", "left").select(*identity, F.col("_least").alias("_first"), F.coalesce("root", "id").alias("_root")))
    smallest = cut(joined.groupBy("_root").agg(F.min("_first").alias("_least")))
    return rows, joined.join(smallest, "_root").select(*identity, "_root", "_least")


def dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; all columns are kept.

    Rows that repeat a kept id with a text of the same group are kept with it;
    texts that differ under one id are judged each by its own group.
    """
    rows, classes = components(docs, words, similarity, recall)
    gone = rows.join(classes, ["_whole", "_size", "_word"]).where("_doc <> _least").select(F.col("_doc").alias("_gone"), F.col("_text").alias("_gone_text")).distinct()
    own = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["_gone"], F.xxhash64(docs["text"].cast("string")) == gone["_gone_text"]]
    return docs.join(gone, own, "left_anti")
