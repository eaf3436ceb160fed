"""The near-copy stage of the pipeline against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F
from test_operators_llm import docs_of

import corpus_pipeline
from parley.llm import resemblance
from parley.storage import materialize


def naive_kept(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if label[i] > label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                    label[i] = label[j]
                    changed = True
    return {i for i in sets if label[i] == i}


def test_the_near_copy_stage_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    for i in range(200):  # near copies around the bound, some of copies
        t = texts[rng.randrange(40 if i % 2 else len(texts))].split()
        for _ in range(rng.randint(1, 1 + len(t) // 40)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [texts[3].upper(), "", None, " \t ", "one two three four", "One two  three four", "one two three"]
    want = naive_kept(list(enumerate(texts)))
    got = corpus_pipeline.simhash_stage(spark, docs_of(spark, texts), "").collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) and 60 < len(want) < 200


def test_the_near_copy_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.exact_stage(spark, docs, "").cache()
    want = naive_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()} == want


def dense_group(n=300, size=150):
    """Texts around one, of which many pairs reach 0.8 and many do not."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    base, texts = [rng.choice(words) for _ in range(size)], []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(size)] = rng.choice(words)
        texts.append(" ".join(t))
    return texts


def test_links_of_a_large_dense_group_are_fewer_than_its_rows(spark, monkeypatch):
    read, made, link = [], [], resemblance.link_shards

    def counted(rows, *args):
        out = materialize(link(rows, *args), "counted")
        read.append(rows.count())
        made.append(out.count())
        return out

    monkeypatch.setattr(resemblance, "link_shards", counted)
    texts = [*dense_group(), *(f"quite another text of number {i} " * 3 for i in range(20))]
    found = resemblance.near_copies(docs_of(spark, texts), shard=32)
    assert {r.doc_id for r in found.where("doc_id = component_id").collect()} == naive_kept(list(enumerate(texts)))
    assert len(made) == 2 and all(m < n for m, n in zip(made, read))


def test_the_simhash_step_brings_near_fingerprints_together(spark):
    texts = [*dense_group(80, 400), *dense_group(40, 30)]
    prints = {}
    for t in texts:
        s = resemblance.shingles(t.encode())
        prints[resemblance.xxhash.xxh64_intdigest(s.tobytes(), 42) >> 1] = resemblance.majority(s)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(n, signed(fp)) for n, fp in [*prints.items(), (7, 5), (8, 5)]], "node long, fp long")
    label = {n: n for n in [*prints, 7, 8]}
    buckets = resemblance.print_buckets(nodes).groupBy("key").agg(F.collect_set("node").alias("nodes")).collect()
    for r in buckets:
        old = {label[n] for n in r.nodes}
        label |= {n: min(old) for n in label if label[n] in old}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(pairs) > 20 and all(label[a] == label[b] for a, b in pairs) and label[8] == 7
    assert len(set(label.values())) > 10
