import functools
import hashlib
import math
import random
import re

from loomlog.llm import queries, secrets


def brute(text):
    """The base spans, straight from their definition, without any test before the patterns."""
    out = []
    for kind, p, n in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)):
        for m in re.finditer(p, text):
            if len(m[2] if kind == "assign" else m[0]) >= n:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_base_spans_match_brute_force():
    rnd = random.Random(2)
    parts = ["password", "PassWD", " = ", ":", '"', "token", "API_KEY", "apikey", "secret=", "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "0" * 31, "é", "ſ", "K", " ", "\n", "x1y2z3w4", "short", "=", "."]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))
        assert secrets.joined(secrets.base_spans(t)) == brute(t)


def test_guess_costs():
    low = ["password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "2019-04-12", "abcabcabcabc", "abcdefghij", "changeme", "p4ssw0rd", "", "monkeydragon"]
    high = ["9fK2xq7LmZ0c", "b7db7aa4a5fcc78305", "Tr0ub4dor&3xQz", "jX8#kd02!mv1"]
    assert max(map(secrets.guess_bits, low)) < secrets.GUESS_BITS <= min(map(secrets.guess_bits, high))


def test_added_spans():
    base, every = secrets.spans("see pwd: 9fK2$xq7LmZ0c! and password = \"b7db7aa4a5fcc78305\" pwd=changeme")
    assert [k for _, _, k in base] == ["assign"] and [k for _, _, k in every] == ["guess", "assign"]


def test_query_and_redaction(spark, tmp_path):
    long = "word " * 60_000 + "token=abcdefgh12"
    rows = [(1, None), (2, ""), (3, long), (4, "ü AKIA" + "Q" * 12), (4, "ü AKIA" + "Q" * 12), (None, "f" * 40)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_secrets"](spark, str(tmp_path)).collect()
    want = sorted((i or -1, hashlib.sha256(brute(t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or -1, r.base_sha256) for r in got) == want
    assert {(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got} == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (4, 0, 1, 0), (None, 0, 0, 1)}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[4] == "ü [SECRET]" and clean[1] is None and clean[None] == "[SECRET]"


def test_random_values_of_six_to_nine_characters():
    rnd = random.Random(5)
    every = "".join(map(chr, range(35, 127))).translate({ord(c): None for c in "<>;,&|(){}'\""})
    kinds = {6: [every], 7: [every], 8: [every, "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789"], 9: [every]}
    for n, alphabets in kinds.items():
        for alphabet in alphabets:
            found = 0
            for _ in range(200):
                value = "".join(rnd.choice(alphabet) for _ in range(n))
                found += secrets.guess_bits(value) >= secrets.GUESS_BITS
            assert found >= 0.9 * 200, (n, alphabet, found)
    for value in ("monkey", "dragon1", "Welcome1", "passw0rd", "changeme!", "Summer19", "qwerty12", "12345678", "aaaaaaa", "20190412"):
        assert secrets.guess_bits(value) < secrets.GUESS_BITS, value
    text = 'password: "xK9#mQ2v!"'
    assert secrets.spans(text)[1] == [(11, 20, "guess")]


def test_long_values_take_time_in_proportion():
    rnd = random.Random(6)
    assert secrets.guess_bits("".join(rnd.choice("abcXYZ019+/") for _ in range(30_000))) > 1000


def segment_cost(value, a, b):
    """The cheapest rating of value[a:b] as one segment other than brute force, by definition."""
    own, low = value[a:b], value[a:b].lower()
    n, costs = b - a, []
    for form, extra in ((low, 0.0), (low.translate(secrets.LEET), 2.0)):
        if form in secrets.RANK and n >= 3:
            case = 0.0 if own == low else 1.0 if own[0].isupper() and own[1:] == low[1:] else 3.0
            costs.append(1 + math.log2(secrets.RANK[form] + 1) + case + (extra if form != low else 0.0))
    if any(f.fullmatch(low) for f in secrets.DATES):
        costs.append(7.0 if n == 4 else 16.0)
    if n >= 3:
        pairs = list(zip(low, low[1:], strict=False))
        if len(set(low)) == 1:
            costs.append(secrets.BRUTE[secrets.alphabet(own[-1])] + math.log2(n) + 1)
        if {ord(y) - ord(x) for x, y in pairs} in ({1}, {-1}):
            costs.append(4 + 2 * math.log2(n) + 1)
        if all(x + y in secrets.NEAR for x, y in pairs):
            costs.append(5 + 2 * math.log2(n) + 1)
    return min(costs, default=math.inf)


def exhaustive(value):
    """The least cost over all segmentations, each segment brute force or not."""

    @functools.cache
    def rest(a, after_brute):
        if a == len(value):
            return 0.0
        found = []
        for b in range(a + 1, len(value) + 1):
            found.append(segment_cost(value, a, b) + rest(b, False))
            if not after_brute:
                used = functools.reduce(lambda x, c: x | secrets.alphabet(c), value[a:b], 0)
                found.append((b - a) * secrets.BRUTE[used] + rest(b, True))
        return min(found)

    n, costs = len(value), [rest(0, False)]
    for size in range(1, n // 2 + 1):
        if n % size == 0 and value == value[:size] * (n // size):
            costs.append(exhaustive_once(value[:size]) + math.log2(n // size) + 1)
    return min(costs)


def exhaustive_once(block):
    """The least cost of one block, which is not itself seen as repeated."""
    return secrets.guess_bits(block) if len(block) < 2 or (block + block).find(block, 1) == len(block) else min_segments(block)


def min_segments(value):
    best = [(0.0, math.inf)] + [(math.inf, math.inf)] * len(value)  # ends in another segment, in brute force
    for b in range(1, len(value) + 1):
        other = min(min(best[a]) + segment_cost(value, a, b) for a in range(b))
        force = min(best[a][0] + (b - a) * secrets.BRUTE[functools.reduce(lambda x, c: x | secrets.alphabet(c), value[a:b], 0)] for a in range(b))
        best[b] = other, force
    return min(best[-1])


def test_dynamic_programming_against_all_segmentations():
    rnd = random.Random(8)
    parts = ["password", "pass", "p4ss", "the", "year", "qwe", "asdf", "aaa", "ddd", "abc", "321", "2019", "1.2.1999", "19990102", "x", "K", "7", "#", "é", "12", "monkey"]
    for _ in range(250):
        value = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
        value *= rnd.choice((1, 1, 1, 2, 3))
        assert math.isclose(secrets.guess_bits(value), exhaustive(value), abs_tol=1e-9), value


def test_repeats_of_any_block_and_every_date():
    rnd = random.Random(9)
    block = "".join(rnd.choice("abcdefgh") for _ in range(60))
    assert math.isclose(secrets.guess_bits(block * 4), secrets.guess_bits(block) + 3)
    assert secrets.guess_bits("1999112the") < secrets.guess_bits("1999112") + 8  # 1999-11-2, and not only 1999-1-12
    assert secrets.guess_bits("passwordddd") < 20
