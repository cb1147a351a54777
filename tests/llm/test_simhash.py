import random

import numpy as np
import xxhash
from loomlog.llm import simhash


def brute(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fp(t) for i, t in texts}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    c = simhash.components(df).collect()
    return {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in c}


def test_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(500)]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "x" * 50_000)]
    for k in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(3, 300))]
        for _ in range(rnd.randrange(1, 6)):
            w = list(base)
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append((100 + len(texts), " ".join(w)))
    want = brute(texts)
    assert run(spark, [(i, t, "clash") for i, t in texts]) == want
    with monkeypatch.context() as m:  # the cut for a very large table
        two = simhash.segments(10**10)
        m.setattr(simhash, "segments", lambda n, radius=4: two)
        assert run(spark, [(i, t, "clash") for i, t in texts]) == want
    monkeypatch.setattr(simhash, "WIDE", 1)
    monkeypatch.setattr(simhash, "BLOCK", 2)
    assert run(spark, [(i, t, "clash") for i, t in texts]) == want


def test_segments_cover_the_radius():
    for n in (10, 10**6, 10**10):
        for radius in (0, 2, 4):
            cut = simhash.segments(n, radius)
            assert sum(w for _, w, _ in cut) == 64 and sum(r + 1 for _, _, r in cut) == radius + 1
    assert [r for _, _, r in simhash.segments(10**6)] == [1, 1, 0] and [r for _, _, r in simhash.segments(10**10)] == [2, 1]


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 4))) for _ in range(60)]))
    u, v = simhash._forest(fps, fps, 4)
    assert len(u) < len(fps)


def test_empty_repeated_and_null_ids(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, "other words here now")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.components(df).collect())
    assert got == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    assert sorted(r.doc_id for r in simhash.dedup(df).collect()) == [7, 7, 9]
