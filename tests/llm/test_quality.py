import random

import pytest
from loomlog.llm import quality


def corpus(n=500):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.8
        w = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(20, 200))]
        if not good:
            k = rnd.randrange(3)
            w = [x.upper() + "!!" for x in w] if k == 0 else [x + "%%%" for x in w] if k == 1 else [x + " |" for x in w]
        docs.append((i, " ".join(w), rnd.choice(["en", None]), rnd.choice(["h0"] * 5 + ["h%d" % i, None])))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    extra = [(900, None, "en", "h0"), (901, "", None, None), (902, "word " * 60_000, "en", "h0"), (3, *docs[3][1:]), (None, "plain words here", "en", "h1")]
    d = spark.createDataFrame([(*r, 1.0) for r in docs + extra], "doc_id long, text string, lang string, source string, evidence double").repartition(3)
    lab = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    c = quality.decided(d, lab).collect()
    assert len(c) == len(docs) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in c if r._doc in truth and r._doc % 2 == 0]
    assert sum(r._keep == bool(truth[r._doc]) for r in held) / len(held) > 0.97
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r._keep for r in c)


def strength(groups, priors):
    """Method of moments: what a Beta prior's strength must be for the spread of the groups' rates beyond chance."""
    n = sum(len(e) for e in groups)
    within = sum(len(e) * p * (1 - p) for e, p in zip(groups, priors, strict=True)) / n
    spread = sum(len(e) * (sum(e) / len(e) - p) ** 2 for e, p in zip(groups, priors, strict=True)) / n - sum(p * (1 - p) for p in priors) / n
    return min(max(within / max(spread, 1e-6) - 1, 2.0), 1e4)


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_posteriors_match_brute_force(spark, spread):
    rnd = random.Random(3)
    shift = {f"h{k}": spread * rnd.uniform(-1, 1) for k in range(6)}
    rows = []
    for _ in range(300):
        host, path = "h0" if rnd.random() < 0.5 else f"h{rnd.randrange(6)}", rnd.choice(["a", "b", None])
        rows.append((host, path, min(max(rnd.gauss(0.6 + shift[host], 0.1), 0.01), 0.99)))
    rated = spark.createDataFrame(rows, "_host string, _path string, _evidence double")
    s = quality.sites(rated)
    one = s.first()
    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    g = sum(e for *_, e in rows) / len(rows)
    kh = strength(list(hosts.values()), [g] * len(hosts))
    kp = strength(list(paths.values()), [(sum(hosts[h]) + kh * g) / (len(hosts[h]) + kh) for h, _ in paths])
    assert (one._g, one._kh, one._kp) == (pytest.approx(g), pytest.approx(kh), pytest.approx(kp))
    rate, post = quality._posterior()
    s2 = s.withColumnRenamed("_host", "_h").withColumnRenamed("_path", "_p")
    got = rated.join(s2, rated["_host"].eqNullSafe(s2["_h"]) & rated["_path"].eqNullSafe(s2["_p"])).select("_host", "_path", "_evidence", rate.alias("r"), post.alias("post")).collect()
    odds = lambda x: x / (1 - x)
    for r in got:
        host, path, e = hosts[r._host], paths[r._host, r._path], r._evidence
        top = (sum(host) - e + kh * g) / (len(host) - 1 + kh)
        site = min(max((sum(path) - e + kp * top) / (len(path) - 1 + kp), 1e-3), 1 - 1e-3)
        assert r.r == pytest.approx(site)
        assert odds(r.post) == pytest.approx(odds(e) * odds(site) / odds(g))


def test_without_labels_or_rows(spark):
    docs, _ = corpus(5)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(d, none).count() == 5
    assert quality.keep_good(d.limit(0), none).count() == 0
