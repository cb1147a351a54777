"""The pipeline's stages, each on its own input, against brute force."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from loomlog.llm import packing
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from test_decontam import edit, fold
    from test_linededup import brute as line_brute
    from test_near import brute as near_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    found = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        found[name] = before.collect(), docs.collect()
        assert k == 4 or docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]

    before, after = found[names[0]]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum((i in kept) == bool(q) for i, q in good.items()) / len(good) > 0.9

    before, after = found[names[1]]
    assert sorted((r.doc_id, r.text) for r in after) == line_brute([(r.doc_id, r.text) for r in before])
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = found[names[2]]
    roots = near_brute([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} >= set(roots.values())
    assert len({r.doc_id for r in after} - set(roots.values())) <= 0.05 * (len(before) - len(set(roots.values())))

    before, after = found[names[3]]
    items = [fold(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before if any(x in fold(r.text) for x in items)}
    kept = {r.doc_id for r in after}
    assert not dirty & kept
    for r in before:
        if r.doc_id not in kept and r.doc_id not in dirty:
            assert any(edit(x, fold(r.text)) <= 0.2 * len(x) for x in items)

    before, after = found[names[4]]
    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = Counter()
    for r in before:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut_points(len(ids))):
            want[r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"sequence_id", "offset"} <= set(out.columns)
