import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from loomlog.llm import common, toxicity


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)]
    bad = ["vile", "awful", "nasty", "crud", "muck"]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 150))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randrange(1, 5)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(bad).upper())
        docs.append((i, " ".join(w) + "."))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_tokens_match_a_plain_split():
    texts = ["Ab c-d, é9", "", "x", " end.", "Ab"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    cells, doc = toxicity.tokens(np.frombuffer(b"".join(raw), np.uint8), off)
    assert doc.tolist() == [0, 0, 0, 0, 2, 3, 4]
    assert cells[0] == cells[6] and len(set(cells.tolist())) == 6


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "vile " * 40_000), (None, "w1 w2"), (3, docs[3][1])]
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs + extra], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(4, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(d, toxicity.train(d, lab)).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    right = total = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in truth:
            right += r.predicted == truth[r.doc_id]
            total += 1
    assert total > 80 and right / total >= 0.97
    assert next(r.predicted for r in rows if r.doc_id == 9002) == 1
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.score(d, toxicity.train(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))).collect()
    scores = lambda found: sorted((r.doc_id or -1, r.score) for r in found)
    for (i, a), (j, b) in zip(scores(rows), scores(again), strict=True):
        assert i == j and abs(a - b) < 1e-6


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, none) is None
    assert [r.score for r in toxicity.score(d, None).collect()] == [0.0]
    assert toxicity.score(d.limit(0), None).count() == 0


def test_counts_match_brute_force(spark):
    docs, labels = corpus(60, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled = toxicity._labelled(d, lab)
    words = toxicity.word_counts(labelled)
    want = np.zeros((4, toxicity.CELLS), np.int64)
    truth = {i: t for i, _, t in labels}
    for i, t in docs:
        f = zlib.crc32(str(i).encode()) % 4
        if i in truth and f != 2:
            raw, off = common.text_buffers(pa.array([t]))
            cells, _ = toxicity.tokens(raw, off)
            np.add.at(want[(truth[i] == 0) + 2 * (f == 3)], cells, 1)
    assert (words[:4] == want).all()


def test_pairs_of_uncommon_words_tell_the_classes_apart(spark):
    """1,500 words fill every text; two less common ones stand side by side in it, in toxic texts the other way round."""
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(1200):
        w = ["w%d" % rnd.randrange(1500) for _ in range(40)]
        a, b = "odd%d" % (i % 61), "rare%d" % (i % 61)
        toxic = i % 3 == 0
        w[10:10] = [a, b] if toxic else [b, a]
        docs.append((i, " ".join(w)))
        if zlib.crc32(str(i).encode()) % 4 != 2:
            labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = toxicity.score(d, toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    held = [r.predicted == (r.doc_id % 3 == 0) for r in rows if r.held_out]
    assert len(held) > 200 and sum(held) / len(held) >= 0.97


def test_ratios_match_brute_force_kneser_ney(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join("w%d" % int(rnd.paretovariate(0.4)) for _ in range(rnd.randrange(90)))) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in docs if i % 5]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model, _, pairs, places = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    words, couples = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in docs:
        if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2:
            words[i % 4 > 0].update(t.split())
            couples[i % 4 > 0].update(zip(t.split(), t.split()[1:]))
    assert len(words[0] + words[1]) > 1024
    before = Counter(b for _, b in couples[0] + couples[1])
    shared = {w: (before[w] + 0.5) / (sum(before.values()) + 0.5 * toxicity.CELLS) for _, t in docs for w in t.split()}

    def discount(c):
        one, two = (sum(n == k for n in c.values()) for k in (1, 2))
        return one / (one + 2 * two)

    def single(k, w):
        c, e = words[k], discount(words[k])
        return (max(c[w] - e, 0) + e * len(c) * shared[w]) / sum(c.values())

    def pair(k, a, b):
        c, e = couples[k], discount(couples[k])
        after = [n for (x, _), n in c.items() if x == a]
        return max(c[a, b] - e, 0) / sum(after) + e * len(after) / sum(after) * single(k, b) if after else single(k, b)

    texts = d.select("text", "doc_id").coalesce(1)
    folder = toxicity.answered(texts, 0, pairs, places, ((0, 2), (1, 3)))
    truth, seen = dict(docs), 0
    order = texts.toArrow().column("doc_id").to_pylist()
    batches = pa.table({"text": [truth[i] for i in order], "doc_id": order}).combine_chunks().to_batches()
    for own, cells, _, doc, counts in toxicity._with_counts(batches, 0, places, folder, 2):
        got = model.ratios(cells, doc, counts)
        for i, x in enumerate(own.column(0).to_pylist()):
            t = truth[x].split()
            want = [np.log(pair(0, a, b) / pair(1, a, b)) if a else np.log(single(0, b) / single(1, b)) for a, b in zip([None, *t], t)]
            assert np.allclose(got[doc == i], want, atol=1e-4)
            seen += len(t)
    assert seen == sum(len(t.split()) for t in truth.values())


def test_parts_and_batches_may_be_small(spark, monkeypatch):
    """The same scores whether pairs are dealt to one part or to many, and texts to one batch or to many."""
    docs, labels = corpus(120, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = lambda: np.array([s for _, s in sorted((r.doc_id, r.score) for r in toxicity.score(d, toxicity.train(d, lab)).collect())])
    one = found()
    monkeypatch.setattr(toxicity, "PART", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert np.allclose(one, found(), atol=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
