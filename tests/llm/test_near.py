import random
import re

import pytest
from loomlog.llm import near

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def brute(texts):
    """{doc_id: smallest doc_id of its group} by the Jaccard similarity of all pairs."""
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(rnd, vocab, n, words, edits):
    base = [rnd.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
    return out


def texts_of(rnd):
    vocab = ["w%d" % i for i in range(3000)]
    out = [None, "", " \t\n", "one two", "ONE\ttwo", "one two three", "x" * 50_000, " ".join(vocab * 8)]
    for _ in range(50):
        out += family(rnd, vocab, rnd.randrange(1, 5), rnd.randrange(20, 300), rnd.randrange(0, 4))
    out += family(rnd, vocab, 70, 120, 2)  # a large group of copies, each of its own
    out += [out[-1]] * 30
    return list(enumerate(out))


@pytest.mark.parametrize("radius", [1, 2])
def test_groups_against_all_pairs(spark, monkeypatch, radius):
    if radius == 2:  # as for very large tables; few segments and narrow ones, so that buckets are full
        monkeypatch.setattr(near, "plan", lambda n, s, r: (40, 8, 2, 18))
        monkeypatch.setattr(near, "FIRST", 1)
        monkeypatch.setattr(near, "SENT", 10)
        monkeypatch.setattr(near, "FULL", 3)
        monkeypatch.setattr(near, "BLOCK", 20)
    texts = texts_of(random.Random(4))
    want = set(brute(texts).values())
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, id string").repartition(3)
    got = {r.doc_id for r in near.dedup(df, recall=0.9999).collect()}
    assert got >= want  # nothing is removed that is not linked
    assert len(got - want) <= 1


def test_recall_just_at_the_similarity(spark):
    rnd = random.Random(11)
    vocab = ["v%d" % i for i in range(5000)]
    texts, pairs = [], 0
    while pairs < 400:
        a, b = family(rnd, vocab, 2, rnd.randrange(80, 250), rnd.randrange(1, 6))
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            texts += [a, b]
            pairs += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(texts) - near.dedup(df).count() >= 0.95 * pairs


def test_plan_follows_the_corpus():
    for n in (1, 100, 10**6, 10**9):
        segments, width, radius, _ = near.plan(n)
        assert 2**width >= n and radius in (1, 2) and segments * width < 4000


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, "other words here now"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in near.dedup(df).collect()) == [-1, 7, 7, 9]
    assert near.dedup(df.limit(0)).count() == 0
