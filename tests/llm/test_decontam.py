import random

import numpy as np
from loomlog.llm import decontam


def edit(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def fold(t):
    import re

    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (t or "").encode().lower())


def noisy(rnd, text, share):
    out = []
    for c in text:
        r = rnd.random()
        if r < share / 3:
            continue
        out.append(rnd.choice("abcdefgh") if r < 2 * share / 3 else c)
        if r > 1 - share / 3:
            out.append(rnd.choice("abcdefgh"))
    return "".join(out)


def cases():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rnd.randrange(12, 60))) for k in range(12)] + [(50, None), (51, " "), (52, "short one")]
    docs = [(0, None), (1, ""), (2, prose(20_000))]
    for k in range(80):
        t = prose(rnd.randrange(0, 80))
        if k % 2:
            t += " " + noisy(rnd, rnd.choice(items[:12])[1], rnd.choice([0, 0, 0.03, 0.08, 0.15, 0.4])).upper() + ".\n\n" + prose(rnd.randrange(0, 40))
        docs.append((10 + k, t))
    docs += [(200, "a SHORT   one."), (201, "short ones"), (10, docs[5][1]), (None, items[0][1])]
    return items, docs


def test_distance_matches_dynamic_programming():
    rnd = random.Random(0)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))).encode() for _ in range(2))
        got = decontam.distance(a, b, len(a))
        assert got[0] == edit(a, b) if got else edit(a, b) >= len(a)


def test_hits_against_brute_force(spark):
    items, docs = cases()
    want = set()
    for n, (i, t) in enumerate(docs):
        for k, x in items[:12]:
            p = fold(x).strip()
            if n != 2 and edit(p, fold(t)) <= int(0.2 * len(p) + 1e-9):
                want.add((i or -1, k))
    want.add((200, 52))
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.hits(d, b).collect()
    got = {(r.doc_id or -1, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want), (want - got, got - want)
    exact = {(r.doc_id, r.item_id) for r in rows if r.distance == 0}
    for i, t in docs:
        for k, x in items[:12]:
            if x and i is not None and fold(x).strip() in fold(t):
                assert (i, k) in exact
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    bad = {r.doc_id for r in rows}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_lsh_alone_reaches_its_recall():
    rnd = random.Random(9)
    items = decontam.Items([(k, "".join(rnd.choice("abcdefghijklmnopqrst ") for _ in range(200))) for k in range(20)])
    met = total = 0
    for k, t in enumerate(items.texts):
        for share in (0.05, 0.1, 0.15):
            x = np.frombuffer(noisy(rnd, t.decode(), share).encode(), np.uint8)[None, : len(t)]
            sig = items.walks.signatures(x, np.array([x.shape[1]]), items.lengths[[k]])
            met += bool((sig == items.signatures[[k]]).any())
            total += 1
    assert met >= 0.97 * total


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text that is long enough")], "item_id long, text string")
    assert decontam.hits(d, b.limit(0)).count() == 0 and decontam.hits(d.limit(0), b).count() == 0 and decontam.hits(d, b).count() == 1
    assert decontam.clean(d, b.limit(0)).count() == 1


def spread(rnd, text, gap, kind):
    """``text`` with an edit at each ``gap``-th byte, the fewest unchanged runs that so many edits can leave."""
    out = []
    for k, c in enumerate(text):
        if k % gap != gap - 1:
            out.append(c)
        elif kind == "change":
            out.append(rnd.choice([x for x in "abcdefgh" if x != c]))
        elif kind == "insert":
            out += [c, rnd.choice("abcdefgh")]
    return "".join(out)


def test_evenly_spread_edits_are_found_at_every_length():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: fold(" ".join(word() for _ in range(n))).decode()[:n]
    texts = [prose(n).strip() for n in (12, 15, 19, 20, 33, 64, 100, 200, 323, 400, 1500, 4000)]
    items = decontam.Items(list(enumerate(texts)))
    docs, want = [], set()
    for k, t in enumerate(texts):
        for gap in (5, 6, 10, 12):
            for kind in ("change", "insert", "remove"):
                body = prose(40) + " " + spread(rnd, t, gap, kind) + " " + prose(40)
                p, b = fold(t).strip(), fold(body)
                if len(t) > 400 or edit(p, b) <= len(p) // 5:
                    want.add((len(docs), k))
                docs.append(body)
    data = "".join(docs).encode()
    off = np.cumsum([0] + [len(d) for d in docs])
    got = {(d, i): far for d, i, far, _, _ in decontam.matches(items, np.frombuffer(data, np.uint8), off)}
    assert want <= set(got) and len(want) >= 130
    for (d, i), far in got.items():
        if len(texts[i]) <= 100:
            assert far == edit(fold(texts[i]).strip(), fold(docs[d])) <= len(texts[i]) // 5


def test_search_loses_nothing_against_brute_force():
    rnd = random.Random(21)
    prose = lambda n: "".join(rnd.choice("abcde  ") for _ in range(n))
    texts = [" ".join(prose(rnd.randrange(14, 60)).split()) for _ in range(12)]
    texts = [t for t in texts if len(t) >= decontam.SHORT]
    items = decontam.Items(list(enumerate(texts)))
    docs = [prose(rnd.randrange(0, 60)) + noisy(rnd, rnd.choice(texts), rnd.choice([0, 0.1, 0.2, 0.25])) + prose(rnd.randrange(0, 60)) for _ in range(150)]
    off = np.cumsum([0] + [len(d) for d in docs])
    got = {(d, i): far for d, i, far, _, _ in decontam.matches(items, np.frombuffer("".join(docs).encode(), np.uint8), off)}
    want = {(d, i): far for d, b in enumerate(docs) for i, p in enumerate(texts) if (far := edit(p.encode(), fold(b))) <= int(0.2 * len(p) + 1e-9)}
    assert got == want


def test_random_edits_are_all_found_at_every_length():
    rnd = random.Random(31)
    letters = "aeinorst "
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(n)).split()) for n in (100, 200, 400, 1500, 4000)]
    items = decontam.Items(list(enumerate(texts)))
    docs, known = [], []
    for k, t in enumerate(texts):
        for share in (0.1, 0.18):
            for _ in range(12):
                edited = list(t)
                for at in rnd.sample(range(len(t)), int(share * len(t))):
                    edited[at] = rnd.choice(["", rnd.choice("bcd"), edited[at] + rnd.choice("bcd")])
                docs.append("".join(edited))
                known.append((len(docs) - 1, k))
    off = np.cumsum([0] + [len(d) for d in docs])
    got = {(d, i) for d, i, _, _, _ in decontam.matches(items, np.frombuffer("".join(docs).encode(), np.uint8), off)}
    assert set(known) <= got
