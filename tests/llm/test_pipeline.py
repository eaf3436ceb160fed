"""The whole pipeline against plain Python, stage by stage."""

import zlib
from collections import defaultdict

import numpy as np
from test_resemblance import naive_kept

import corpus_pipeline
from parley.llm import decontaminate, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if not model.score(r.text)[2]]
    assert 150 < len(rows) < 200
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = [(i, t) for i, t in rows if last[t] == i]
    stay = naive_kept(rows)
    rows = [(i, t) for i, t in rows if i in stay]
    items = [decontaminate.normalize(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [t for t in items if len(t) >= 40]
    holds = lambda t: any(q in t or decontaminate.myers(q, t, int(len(q) * 0.08)) for q in items)
    rows = [(i, t) for i, t in rows if not holds(decontaminate.normalize(t))]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.add((i, k, a, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
