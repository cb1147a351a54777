import hashlib
import random

from loomlog.llm import suffix


def brute(rows, n=suffix.LENGTH):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen and seen[w] != (i, s):
                gone[s : s + n] = b"\1" * n
            seen.setdefault(w, (i, s))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, alphabet="abcdefghij klmnop", n=60):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [text(rnd.randrange(60, 400)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 700), (3, "x" * 99), (4, "ab" * 200), (5, "é" * 120), (6, "\0" * 150 + "a"), (7, "\0" * 140)]
    for k in range(n):
        t = "".join(rnd.choice(shared)[rnd.randrange(40) :] if rnd.random() < 0.5 else text(rnd.randrange(150)) for _ in range(rnd.randrange(1, 6)))
        rows.append((10 + k, t))
    rows += [(500 + k, text(50) + shared[0] + text(50)) for k in range(40)]
    rows += [(600 + k, rows[20][1]) for k in range(5)]
    rnd.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(df).collect())


def test_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_brute_force_with_everything_hot(spark, monkeypatch):
    rows = corpus(2, "ab", 25)
    monkeypatch.setattr(suffix, "HOT_TASK", 2)
    monkeypatch.setattr(suffix, "HOT_BUCKET", 1)
    assert run(spark, rows) == brute(rows)


def test_brute_force_with_small_flushes(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(suffix, "FLUSH", 20)
    monkeypatch.setattr(suffix, "HOT_TASK", 3)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "q" + t)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_removed) for r in suffix.digests(df).collect())
    assert got == [(-1, 0), (1, 300), (1, 300), (2, 300)]
    assert sorted((r.doc_id or -1, r.text) for r in suffix.dedup(df).collect()) == [(-1, t), (1, ""), (1, ""), (2, "q")]
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [r.n_removed for r in suffix.digests(df).collect()] == [0, 0]
    assert suffix.digests(df.limit(0)).count() == 0


def test_maximal_repeats_against_brute_force(spark):
    rnd = random.Random(4)
    for _ in range(60):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 14))).encode() for _ in range(3)]
        places = {}
        for k, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 2, len(t) + 1):
                    places.setdefault(t[a:b], []).append((k, a))
        want = []
        for s, own in places.items():
            if len(own) > 1:
                before = {texts[k][a - 1] if a else (k, "start") for k, a in own}
                after = {texts[k][a + len(s)] if a + len(s) < len(texts[k]) else (k, "end") for k, a in own}
                if (len(before) > 1 or any(isinstance(x, tuple) for x in before)) and (len(after) > 1 or any(isinstance(x, tuple) for x in after)):
                    want.append((len(s), sorted(own)))
        assert suffix.EnhancedSuffixArray(texts).maximal_repeats(2) == sorted(want)
    df = spark.createDataFrame([(1, "xhello worldy"), (2, "zhello worldw"), (3, "hello world")], "doc_id long, text string")
    assert [tuple(r) for r in suffix.repeat_groups(df, 11).collect()] == [(11, [1, 2, 3], [1, 1, 0])]
