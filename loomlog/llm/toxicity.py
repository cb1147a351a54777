"""Toxicity scores from class-conditional Kneser-Ney models.

Two word models, of toxic and of ordinary texts, are counted over every
labelled text outside the held-out fold.  Words are runs of letters, digits and
non-ASCII bytes, in lower case, hashed into ``CELLS`` cells.  Probabilities are
interpolated Kneser-Ney: bigrams of any two adjacent words back off to words,
and words back off to continuation counts (how many different words stand
before a word) that both classes share, so a rare expression differs between
the classes only by what was seen of it.  Every pair is counted; a continuation
count is the number of distinct pairs.

Beside words, the models count stems (a word's first ``STEM`` characters) in the
same way, so that a form never seen before is judged by its family.

A text's score compares its two log-likelihoods, each normalised by length, as
a whole and in its most toxic passages of ``WINDOWS`` words.  It does so for
words after words, for words alone and for stems.  A logistic curve
turns these into a probability.  It is fitted on at most ``SAMPLE`` texts of
one fold, scored by models that were counted on the other two; the models used
for all other scores are counted on all three.

The table of pairs grows with the labelled texts and stays on the executors, in
parts of some ``PART`` words' pairs; words are numbered by falling frequency
there, so that ordered pairs lie close together and take few bytes.  A block of ``WORDS`` words of the texts
to score asks each part for the counts of its own distinct pairs; the answers
lie in the shared folder, one file for a block, under the hash of the pairs
that it asked for, until the same texts are read again and scored.  A partition
must therefore hold the same rows both times, as those of stored tables do; a
missing answer is an error.  Tables by cell have fixed sizes and leave a task
as packed ranges.  Labels are broadcast if there are ``LABELS`` or fewer and
joined by a shuffle otherwise.

Cases: a null or empty text has no words and gets the curve's value for none; a null doc_id is
never labelled and not held out; repeated rows are counted and scored as often
as they stand; several labels of one document count as toxic if any is; with
no labels at all every score is 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 21
CELLS = 1 << BITS
RANGES = 64
SALTS = 16  # first step of merging the tasks' counts
PART = 1 << 19  # words of the labelled texts whose pairs make one part of the pair table, about
WORDS = 1 << 21  # words of a block, about
CHUNK = (1 << 20) - 1  # bytes hashed at once; the hashes keep tables of the next power of two
WINDOWS = (1, 2, 8)
FEATURES = 1 + 3 * (2 + len(WINDOWS))
SAMPLE = 20_000
LABELS = 2_000_000
HELD_OUT, CURVE = 2, 3
THRESHOLD = 0.3
STEM = 4
_HASH, _STEM = common.SpanHash(11), common.SpanHash(12)
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0)).cast("int")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and document index of each word."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _HASH.sums(common.lowered(data))
    h = _HASH.spans(sums, start, end)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(offsets, start, side="right") - 1


def stems(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cell of the first STEM characters of each word: inflected or invented forms of one stem share it."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    fourth = np.searchsorted(heads, start) + STEM
    stop = np.where(fourth < len(heads), heads[np.minimum(fourth, len(heads) - 1)] if len(heads) else end, end)
    h = _STEM.spans(_STEM.sums(common.lowered(data)), start, np.minimum(end, stop))
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch, column: int, stemmed: bool = True):
    """(rows, cells, stems or None, documents) for parts of a batch; documents count from the first row of a part."""
    data, off = common.text_buffers(batch.column(column))
    for i, j in common.chunks(off, CHUNK):
        part = off[i : j + 1] - off[i]
        cells, doc = tokens(data[off[i] : off[j]], part)
        yield slice(i, j), cells, stems(data[off[i] : off[j]], part) if stemmed else None, doc


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) of the labelled rows that may be learnt from."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = common.cut(own.where(fold(F.col("_id")) != HELD_OUT))
    if own.count() <= LABELS:
        own = F.broadcast(own)
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return d.join(own, "_id").select("_id", "text", "toxic", fold(F.col("_id")).alias("fold"))


#: Groups of counts: toxic and ordinary texts of the folds before the curve's, then of the curve's fold.
def _group(toxic: np.ndarray, fold_no: np.ndarray) -> np.ndarray:
    return (toxic == 0).astype(np.int64) + 2 * (fold_no == CURVE)


def _sum_packed(rows: DataFrame, height: int):
    """(part, table) of packed tables (part, salt, blob) of ``height`` rows, summed by their first row on the executors."""

    def merge(key, group):
        whole = None
        for blob in group.column("blob").to_pylist():
            whole = _combine(whole, _unpack(blob, height))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "blob": [_pack(whole)]})

    schema = "part int, blob binary"
    merged = rows.groupBy("part", "salt").applyInArrow(merge, schema).groupBy("part").applyInArrow(merge, schema)
    for r in merged.collect():
        yield r.part, _unpack(r.blob, height)


def _combine(a, b):
    """Sum the counts of the same cells; row 0 holds the cells, in order."""
    if a is None:
        return b
    return _summed(np.concatenate([a, b], axis=1))


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)  # np.unique alone hashes them, which takes many times as long
    return keys[_firsts(keys)]


def _summed(table: np.ndarray) -> np.ndarray:
    """One column for each key of row 0, in order, with the sums of the other rows."""
    order = np.argsort(table[0], kind="stable")
    keys = table[0][order]
    first = _firsts(keys)
    out = np.zeros((len(table), len(first)), np.int64)
    out[0] = keys[first]
    if len(first):
        for k in range(1, len(table)):  # row by row: a whole copy in order would be as large again
            out[k] = np.add.reduceat(table[k][order], first)
    return out


def _dense(ranges, salt: int):
    """(part, salt, blob) of dense tables of the RANGES ranges of cells without the cells that are zero throughout."""
    for part, n in enumerate(ranges):
        seen = np.flatnonzero(n.any(axis=0))
        if len(seen):
            yield part, salt, _pack(np.concatenate([seen[None, :] + part * (CELLS // RANGES), n[:, seen]]).astype(np.int64))


def _rows(found, names: list[str], kinds: list[pa.DataType]):
    for row in found:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def counts_of(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(4, CELLS) of words and of stems: counts of the four groups."""

    def run(batches):
        counts = np.zeros((8, CELLS), np.int32)
        for b in batches:
            group = _group(b.column(1).to_numpy(), b.column(2).to_numpy())
            for rows, cells, own_stems, doc in _texts(b, 0):
                g = group[rows][doc]
                for table, c in enumerate((cells, own_stems)):
                    for k in range(4):
                        np.add.at(counts[4 * table + k], c[g == k], 1)
        yield from _rows(_dense(np.split(counts, RANGES, axis=1), TaskContext.get().partitionId() % SALTS), ["part", "salt", "blob"], [pa.int32(), pa.int32(), pa.binary()])

    rows = labelled.select("text", "toxic", "fold").mapInArrow(run, "part int, salt int, blob binary")
    out = np.zeros((8, CELLS), np.int64)
    for _, table in _sum_packed(rows, 9):
        out[:, table[0]] = table[1:]
    out = out.astype(np.int32 if out.sum() < 2**31 else np.int64)
    return out[:4], out[4:]


def word_counts(labelled: DataFrame) -> np.ndarray:
    return counts_of(labelled)[0]


class Places:
    """Numbers of words and of stems by falling frequency (-1: never seen), and where the parts of the pair tables begin."""

    def __init__(self, words: np.ndarray, by_stem: np.ndarray, parts: int):
        """words and by_stem: counts by cell."""
        self.words, self.stems = self._numbers(words), self._numbers(by_stem)
        self.edges = self._edges(words, words, parts), self._edges(words, by_stem, parts)

    @staticmethod
    def _numbers(counts: np.ndarray) -> np.ndarray:
        out = np.empty(CELLS, np.int32)
        out[np.argsort(-counts, kind="stable")] = np.arange(CELLS)
        out[counts == 0] = -1
        return out

    @staticmethod
    def _edges(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
        """Equal shares of the pairs if neighbours were independent; a frequent word's pairs are split by the second."""
        share = [np.sort(c)[::-1] / max(1, c.sum()) for c in (left, right)]
        up_to = [np.cumsum(x) for x in share]
        at = np.arange(1, parts) / parts
        a = np.minimum(np.searchsorted(up_to[0], at, side="right"), CELLS - 1)
        rest = (at - up_to[0][a] + share[0][a]) / np.maximum(share[0][a], 1e-300)
        b = np.minimum(np.searchsorted(up_to[1], rest, side="right"), CELLS - 1)
        return np.r_[0, np.maximum.accumulate(a << BITS | b), 1 << 2 * BITS]


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers; -1 if either was never seen."""
    return np.where((a < 0) | (b < 0), -1, a.astype(np.int64) << BITS | b)


def _pack(table: np.ndarray) -> bytes:
    """An int64 table by planes of bytes; row 0 as steps, which are small in ordered keys."""
    steps = np.concatenate([np.diff(table[:1], prepend=0), table[1:]]).astype(np.int64)
    return zlib.compress(np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(blob: bytes, height: int) -> np.ndarray:
    table = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(height, -1)
    table[0] = np.cumsum(table[0])
    return table


def _by_part(table: np.ndarray, edges: np.ndarray):
    """(part, packed columns) of a table whose row 0 has ordered keys."""
    at = np.searchsorted(table[0], edges)
    for part in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield part, _pack(table[:, at[part] : at[part + 1]])


def _follows(doc: np.ndarray) -> np.ndarray:
    """Places of the words that stand after another word of their text."""
    return np.flatnonzero(doc[1:] == doc[:-1]) + 1


def pair_counts(labelled: DataFrame, places) -> DataFrame:
    """(kind, part, blob), written: kind 0 has the pairs of adjacent words with the counts of the four groups, kind 1 stems with the number of different words before them, to be summed over the parts.  Words and stems by their numbers in ``places``, which is broadcast."""

    def counted(held):
        keys = np.sort(np.concatenate([k for k, _ in held]))
        own = _firsts(keys)  # a pair and a group
        pair = _firsts(keys[own] >> 2)
        table = np.zeros((5, len(pair)), np.int64)
        table[0] = keys[own[pair]] >> 2
        table[1 + (keys[own] & 3), np.repeat(np.arange(len(pair)), np.diff(pair, append=len(own)))] = np.diff(own, append=len(keys))
        yield from ((0, *x) for x in _by_part(table, places.value.edges[0]))
        yield from ((1, *x) for x in _by_part(_distinct(np.concatenate([k for _, k in held]))[None, :], places.value.edges[1]))

    def run(batches):
        held, n = [], 0
        for b in batches:
            group = _group(b.column(1).to_numpy(), b.column(2).to_numpy())
            for rows, cells, own_stems, doc in _texts(b, 0):
                at, numbers = _follows(doc), places.value.words[cells]
                held.append((_keys(numbers[at - 1], numbers[at]) << 2 | group[rows][doc[at]], _keys(numbers[at - 1], places.value.stems[own_stems[at]])))
                n += len(at)
                if n >= WORDS:
                    yield from _rows(counted(held), ["kind", "part", "blob"], [pa.int32(), pa.int32(), pa.binary()])
                    held, n = [], 0
        if n:
            yield from _rows(counted(held), ["kind", "part", "blob"], [pa.int32(), pa.int32(), pa.binary()])

    def merge(key, group):
        kind, part = key[0].as_py(), key[1].as_py()
        table = np.concatenate([_unpack(x, 1 if kind else 5) for x in group.column("blob").to_pylist()], axis=1)
        if kind:
            table = np.stack(np.unique(_distinct(table[0]) & (CELLS - 1), return_counts=True))
        else:
            table = _summed(table)
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "blob": [_pack(table)]})

    schema = "kind int, part int, blob binary"
    return common.cut(labelled.select("text", "toxic", "fold").mapInArrow(run, schema).groupBy("kind", "part").applyInArrow(merge, schema))


#: Sums over groups: toxic and ordinary texts of the folds before the curve's, then of all folds.
_SUMS = ((0,), (1,), (0, 2), (1, 3))


def pair_totals(pairs: DataFrame, places: Places, dtype: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(10, CELLS): for each of _SUMS a word's count before others and the different words after it, then the different words before each word and before each stem; (4, 2): how many pairs were seen once and twice.  Of a type that holds them all."""

    def run(batches):
        lefts, rights = [np.zeros((9, 0), np.int64)], np.zeros((2, CELLS), np.int64)
        few, salt = np.zeros(8, np.int64), TaskContext.get().partitionId() % SALTS
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if kind:
                    own, n = _unpack(blob, 2)
                    rights[1, own] += n
                    continue
                table = _unpack(blob, 5)
                np.add.at(rights[0], table[0] & (CELLS - 1), 1)
                first = _firsts(table[0] >> BITS)
                left = np.zeros((9, len(first)), np.int64)
                left[0] = table[0, first] >> BITS
                for k, groups in enumerate(_SUMS):
                    n = sum(table[1 + g] for g in groups)
                    left[1 + k] = np.add.reduceat(n, first)
                    left[5 + k] = np.add.reduceat((n > 0).astype(np.int64), first)
                    few[2 * k : 2 * k + 2] += (n == 1).sum(), (n == 2).sum()
                lefts.append(left)
        left, size = _summed(np.concatenate(lefts, axis=1)), CELLS // RANGES

        def ranges():
            for part in range(RANGES):
                i, j = np.searchsorted(left[0], [part * size, part * size + size])
                n = np.zeros((10, size), np.int64)
                n[:8, left[0, i:j] - part * size] = left[1:, i:j]
                n[8:] = rights[:, part * size : part * size + size]
                yield n

        table = np.zeros((11, 8), np.int64)
        table[0], table[1] = np.arange(8), few
        yield from _rows([(-1, salt, _pack(table))], ["part", "salt", "blob"], [pa.int32(), pa.int32(), pa.binary()])
        yield from _rows(_dense(ranges(), salt), ["part", "salt", "blob"], [pa.int32(), pa.int32(), pa.binary()])

    cells = [np.argsort(np.where(x < 0, CELLS, x), kind="stable") for x in (places.words, places.stems)]
    out, few = np.zeros((10, CELLS), dtype), np.zeros(8, np.int64)
    for part, table in _sum_packed(pairs.select("kind", "blob").mapInArrow(run, "part int, salt int, blob binary"), 11):
        if part < 0:
            few += table[1]
        else:
            out[:9, cells[0][table[0]]] = table[1:10]
            out[9, cells[1][table[0]]] = table[10]
    return out, few.reshape(4, 2)


def _blocks(batches, column: int, places, stemmed: bool = True):
    """Blocks of some WORDS words: lists of (the rows' other columns, cells, stems, documents) and the pairs of each."""
    block, n = [], 0
    for b in batches:
        others = [k for k in range(b.num_columns) if k != column]
        for rows, cells, own_stems, doc in _texts(b, column, stemmed):
            own = b.select(others).take(pa.array(range(rows.start, rows.stop)))  # a slice would hold the texts
            at, numbers = _follows(doc), places.value.words[cells]
            block.append((own, cells.astype(np.int32), own_stems.astype(np.int32) if stemmed else None, doc.astype(np.int32), _keys(numbers[at - 1], numbers[at])))
            n += len(cells)
            if n >= WORDS:
                yield block
                block, n = [], 0
    if block:
        yield block


def _name(keys: np.ndarray) -> str:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).hexdigest()


def answered(texts: DataFrame, column: int, pairs: DataFrame, places, sums) -> str:
    """The folder of the counts, summed over the groups in ``sums``, of the pairs in each block of ``texts``; pairs with a word that was never seen need no answer."""
    folder = f"{common.shared_dir(texts.sparkSession)}/pairs-{uuid.uuid4().hex}"

    def ask(batches):
        for block in _blocks(batches, column, places, stemmed=False):
            keys = _distinct(np.concatenate([x[-1] for x in block]))
            keys = keys[keys >= 0]
            name = _name(keys)
            yield from _rows(((part, name, blob) for part, blob in _by_part(keys[None, :], places.value.edges[0])), ["part", "block", "blob"], [pa.int32(), pa.string(), pa.binary()])

    def answer(key, asked, known):
        table = np.concatenate([np.zeros((5, 0), np.int64), *(_unpack(x, 5) for x in known.column("blob").to_pylist())], axis=1)  # one row or none
        counts = np.stack([sum(table[1 + g] for g in groups) for groups in sums])
        blobs = []
        for blob in asked.column("blob").to_pylist():
            keys = _unpack(blob, 1)[0]
            found = np.zeros((1 + len(sums), len(keys)), np.int64)
            if table.shape[1]:
                at = np.minimum(np.searchsorted(table[0], keys), table.shape[1] - 1)
                found[1:] = np.where(table[0, at] == keys, counts[:, at], 0)
            blobs.append(_pack(found))
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "blob": pa.array(blobs, pa.binary())})

    def keep(key, group):
        block = key[0].as_py()
        found = dict(zip(group.column("part").to_pylist(), group.column("blob").to_pylist(), strict=True))  # equal blocks have equal answers
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        own = f"{path}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(own) as f:
            f.write(_pack(np.concatenate([_unpack(found[p], 1 + len(sums)) for p in sorted(found)], axis=1)))
        store.move(own, f"{path}/{block}")
        return pa.table({"block": [block]})

    asked = texts.mapInArrow(ask, "part int, block string, blob binary")
    known = pairs.where("kind = 0").select("part", "blob")
    found = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "block string, part int, blob binary")
    found.groupBy("block").applyInArrow(keep, "block string").count()
    return folder


def _with_counts(batches, column: int, places, folder: str, height: int):
    """(other columns, cells, stems, documents, counts of each pair) from what ``answered`` left in ``folder``."""
    for block in _blocks(batches, column, places):
        keys, at = np.unique(np.concatenate([x[-1] for x in block]), return_inverse=True)
        unseen = int(len(keys) > 0 and keys[0] < 0)
        counts = np.zeros((height, len(keys)), np.int64)
        if len(keys) > unseen:
            store, path = fs.FileSystem.from_uri(folder)
            try:
                with store.open_input_stream(f"{path}/{_name(keys[unseen:])}") as f:
                    counts[:, unseen:] = _unpack(f.read(), 1 + height)[1:]
            except FileNotFoundError as e:
                raise ValueError("a partition had other rows when it was read again: store the table first") from e
        done = 0
        for own, cells, own_stems, doc, asked in block:
            yield own, cells, own_stems, doc, counts[:, at[done : done + len(asked)]]
            done += len(asked)


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one else 0.5


def _smoothed(counts: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Probabilities in toxic and ordinary texts; both back off to one table of continuation counts."""
    shared = before + 0.5
    shared /= shared.sum()
    out = []
    for c in counts:
        total, d = max(1, c.sum()), _discount(int((c == 1).sum()), int((c == 2).sum()))
        out.append((np.maximum(c - d, 0) + (d * (c > 0).sum() if c.any() else 1.0) * shared) / total)
    return out


class Model:
    """Interpolated Kneser-Ney log-ratios (toxic to ordinary) of words after words, of words alone, and of words' stems."""

    def __init__(self, words: np.ndarray, before: np.ndarray, totals: np.ndarray, types: np.ndarray, few: np.ndarray, stem_counts: np.ndarray, stem_before: np.ndarray):
        """words, stem_counts, totals and types (2, CELLS) and few (2, 2): of the toxic and of the ordinary texts."""
        self.word = np.stack(_smoothed(words, before)).astype(np.float32)
        self.alone = np.log(self.word[0] / self.word[1])
        stem = _smoothed(stem_counts, stem_before)
        self.stem = np.log(stem[0] / stem[1]).astype(np.float32)
        self.discount = [_discount(*map(int, x)) for x in few]
        self.total = np.maximum(totals, 1).astype(np.float32)
        self.rest = np.stack([np.where(n > 0, d * t / np.maximum(n, 1), 1.0) for n, t, d in zip(totals, types, self.discount, strict=True)]).astype(np.float32)

    def ratios(self, cells: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts: (2, pairs), of each word that stands after another with that other."""
        at = _follows(doc)
        left, logs = cells[at - 1], []
        for k in (0, 1):
            p = self.word[k][cells].astype(np.float64)
            p[at] = np.maximum(counts[k] - self.discount[k], 0) / self.total[k][left] + self.rest[k][left] * p[at]
            logs.append(np.log(p))
        return logs[0] - logs[1]


def features(model: Model, cells: np.ndarray, own_stems: np.ndarray, doc: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, FEATURES): log length, then for words after words, for words alone and for stems the normalised log-ratio of the text, its sum by root of length, and the best passages'."""
    out = np.zeros((n_docs, FEATURES))
    if not len(cells):
        return out
    n = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    begin, at = first[doc], np.arange(len(cells))
    out[:, 0] = np.log1p(n)
    k = 1
    for r in (model.ratios(cells, doc, counts), model.alone[cells].astype(np.float64), model.stem[own_stems].astype(np.float64)):
        total = np.bincount(doc, weights=r, minlength=n_docs)
        out[some, k] = total[some] / n[some]
        out[some, k + 1] = total[some] / np.sqrt(n[some])
        run = np.concatenate([[0.0], np.cumsum(r)])
        for w, width in enumerate(WINDOWS, 2):
            passage = run[at + 1] - run[np.maximum(begin, at - width + 1)]
            out[some, k + w] = np.maximum.reduceat(passage, first[some]) / width
        k += 2 + len(WINDOWS)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias last) of a logistic curve: Newton steps, each halved until the penalised loss falls."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)  # a column that never varies says nothing
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(w):
        t = z @ w
        return np.logaddexp(0, t).sum() - (t * y).sum() + 0.5 * (penalty * w * w).sum()

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if new > now:
            break
        w, before, now = w + size * step, now, new
        if before - now < 1e-9 * max(1.0, before):
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame):
    """The model over all labelled rows outside the held-out fold, its curve and its table of pairs; None without labels of both kinds."""
    labelled = _labelled(docs, labels)
    words, by_stem = counts_of(labelled)
    if not words[[0, 2]].any() or not words[[1, 3]].any():
        return None
    places = docs.sparkSession.sparkContext.broadcast(Places(words.sum(axis=0), by_stem.sum(axis=0), 1 + int(words.sum()) // PART))
    pairs = pair_counts(labelled, places)
    totals, few = pair_totals(pairs, places.value, words.dtype)
    drawn = labelled.where(F.col("fold") == CURVE).select("_id", "text", "toxic")
    n = common.cut(drawn.select("_id")).count()
    if n > SAMPLE:
        drawn = drawn.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    if labels.limit(LABELS + 1).count() > LABELS:  # joined by a shuffle: read the same rows twice
        drawn = common.cut(drawn)
    folder = answered(drawn, 1, pairs, places, _SUMS[:2])
    shared = docs.sparkSession.sparkContext.broadcast(Model(words[:2], totals[8], totals[:2], totals[4:6], few[:2], by_stem[:2], totals[9]))

    def run(batches):
        for own, cells, own_stems, doc, counts in _with_counts(batches, 1, places, folder, 2):
            x = features(shared.value, cells, own_stems, doc, counts, len(own))
            yield pa.RecordBatch.from_arrays([own.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = drawn.mapInArrow(run, "y int, x array<double>").toArrow()
    shared.destroy()
    del shared, run  # before the other model: the driver holds one at a time
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
    y = got.column("y").to_numpy()
    if len(np.unique(y)) < 2:  # too few labels for a curve: compare the likelihoods alone
        curve = np.zeros(FEATURES), np.ones(FEATURES), np.r_[1.0, np.zeros(FEATURES)]
    else:
        curve = fit_curve(got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y)
    whole = Model(words[:2] + words[2:], totals[8], totals[2:4], totals[6:8], few[2:], by_stem[:2] + by_stem[2:], totals[9])
    return whole, curve, pairs, places


def score(docs: DataFrame, trained) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    d = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id").cast("long")) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    if trained is None:
        return d.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model, curve, pairs, places = trained
    folder = answered(d, 2, pairs, places, _SUMS[2:])
    shared = docs.sparkSession.sparkContext.broadcast((model, curve))

    def run(batches):
        model, (mean, scale, w) = shared.value
        for own, cells, own_stems, doc, counts in _with_counts(batches, 2, places, folder, 2):
            x = (features(model, cells, own_stems, doc, counts, len(own)) - mean) / scale
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
