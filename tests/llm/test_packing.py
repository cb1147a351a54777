import random
import zlib
from collections import Counter

import numpy as np
from loomlog.llm import packing
from tokenizers import Tokenizer


def check_bins(counts, bins, size):
    got = Counter()
    for contents, n in bins.items():
        assert n > 0 and sum(contents) <= size
        for x in contents:
            got[x] += n
    assert got == Counter(counts)


def test_local_search_improves_and_keeps_documents():
    rnd = random.Random(1)
    for _ in range(60):
        size = rnd.choice([10, 30, 100])
        counts = {k: rnd.randrange(1, 9) for k in rnd.sample(range(1, size + 1), rnd.randrange(1, min(size, 12)))}
        first = packing.best_fit({k: n for k, n in counts.items() if k < size}, size)
        after = packing.pack_counts(counts, size)
        check_bins(counts, after, size)
        assert sum(after.values()) <= sum(first.values()) + counts.get(size, 0)


def test_search_empties_a_bin():
    # best fit decreasing needs three bins of 10 here, two are enough
    start = Counter({(6, 2): 1, (5, 3): 1, (4,): 1})
    after = packing.local_search(start, 10)
    check_bins({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, after, 10)
    assert sum(after.values()) == 2


def test_cut_points():
    assert packing.cut_points(1, 4) == [(0, 1)]
    assert packing.cut_points(4, 4) == [(0, 4)]
    assert packing.cut_points(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack(spark):
    texts = [(0, None), (1, ""), (2, "a b c"), (None, "null id"), (4, "z <|endoftext|> z"), (5, "word \n  é ñ " * 3000), (6, "q" * 60_000)]
    texts += [(10 + i, "same text here " * (i % 7)) for i in range(60)] + [(2, "a b c")]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pack(df, with_ids=True).collect()
    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut_points(len(ids))):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert len(by) <= -(-sum(r.length for r in rows) // packing.SIZE) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_the_search_ends_where_no_pair_of_bins_has_a_step():
    rnd = random.Random(3)
    saved = 0
    for _ in range(150):
        size = rnd.choice((20, 50, 97))
        counts = {n: rnd.randrange(1, 6) for n in rnd.sample(range(size // 4, size), rnd.randrange(2, 12))}
        start = packing.best_fit(counts, size)
        for bins in (start, Counter({(n,): k for n, k in counts.items()})):  # the second is far from packed
            out = packing.local_search(bins, size)
            assert Counter(x for c, n in out.items() for x in c * n) == Counter(counts) and all(sum(c) <= size for c in out)
            saved += sum(bins.values()) - sum(out.values())
            if sum(out.values()) > -(-sum(n * k for n, k in counts.items()) // size):
                low = [c for c in out if sum(c) < size]
                assert not [1 for a in low for b in low if sum(b) <= sum(a) and (a != b or out[a] > 1) and packing._improve(a, b, size)]
    assert saved > 0


def test_the_fast_encoder_gives_the_tokenizer_s_ids():
    tok, encode = Tokenizer.from_file(packing.tokenizer_files()[0]), packing.encoder(packing.tokenizer_files())
    rnd = random.Random(7)
    parts = ["word", " the", "\n\n", "  ", "\t", "é", "名前", "🙂", "e\u0301", "'s", "'LL", "123", "12 345", "\u00a0", "\u200b", "<|endoftext|>", "<|endoftext", "\x00", "\r\n", "ß", "...", "=="]
    for _ in range(2000):
        t = "".join(rnd.choice(parts) if rnd.random() < 0.7 else chr(rnd.choice((rnd.randrange(32, 0x250), rnd.randrange(0x250, 0xD7FF), rnd.randrange(0xE000, 0x1F700)))) for _ in range(rnd.randrange(0, 30)))
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids, t
