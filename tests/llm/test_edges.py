"""Null ids and texts, repeated rows, very long texts and clashing columns in every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontaminate, exact, licenses, packing, queries, secrets, sharding, simhash, suffix, toxicity, warc

LONG = "word and more " * 20_000
ROWS = [(None, None), (None, LONG), (1, ""), (1, ""), (2, LONG), (2, "other text"), (3, "token = abcdefghijklmnop\x0b\x0cx"), (4, "ÅÄ 漢 😀")]
CLASH = "tie mask node key lost_id Word_in kind size shard piece first n rank word fp row_id slot windows block base score toxic length stage".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (None, ""), (2, "other"), (3, "a passage of the benchmark that no document here holds at all")], "item_id long, text string")


def operators(labels, bench):
    return {
        "simhash": simhash.simhash_components,
        "exact": lambda d: exact.exact_dedup(d, digest_all=True),
        "secrets": secrets.find_secrets,
        "suffix": suffix.remove_repeats,
        "licenses": licenses.scan_licenses,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
    }


def test_one_row_for_each_row(docs, labels, bench):
    for name, run in operators(labels, bench).items():
        got = run(docs)
        assert got.count() == len(ROWS), name
        assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(i or 0 for i, _ in ROWS), name
        assert run(docs.limit(0)).count() == 0, name


def test_packing_and_sharding(spark, docs):
    pieces = packing.pack_documents(docs, queries.tokenizer_path())
    assert pieces.where("piece = 0").count() == len(ROWS)
    written = spark.read.parquet(sharding.external_shuffle(docs))
    assert written.count() == len(ROWS) and {"size_in", "shard_in", "slot_in", "size", "shard", "slot"} <= set(written.columns)


def test_suffix_of_long_copies(docs):
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.remove_repeats(docs).collect()}
    n = len(LONG)
    assert got[None, n] == 0 and got[2, n] == n and got[1, 0] == 0


def test_exact_of_ties(docs):
    got = sorted(((r.doc_id or 0, r.n_bytes), r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs).collect())
    assert got[0][1:] == (1, 3, False) and got[1][0] == (0, len(LONG)) and got[1][1:] == (2, 2, False)


def test_decontamination(docs, bench):
    assert [(r.doc_id, r.item_id, r.first_char, r.end_char) for r in decontaminate.benchmark_hits(docs, bench).collect()] == [(2, 2, 0, 5)]
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_stages(spark, docs, tmp_path, labels, bench):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    kept = corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, len(r.text or "")) for r in kept) == sorted([(1, 0), (2, len(LONG)), (2, 10), (3, len(ROWS[6][1])), (4, len(ROWS[7][1]))])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pages(spark):
    rows = [(None, None, None), (None, "u\r\nX: y", "a"), (1, "", "a"), (1, "", "a"), (2, "u", "a"), (3, None, ""), (4, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x"))
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (0, 0, "revisit", 3), (0, 1, "revisit", 2), (1, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", 0), (3, 0, "response", 0), (4, len(LONG), "response", 0),
    ]


def test_a_page_beyond_the_sample(spark):
    """A page of 18 MB neither hides the dictionary nor breaks its archive."""
    rows = [(i, f"http://h/{i}", f"<p>page {i % 9} of some words</p>") for i in range(40)] + [(99, "http://h/99", "\u00e9" * 9_000_000)]
    archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r.page_id: r.payload_bytes for r in warc.read_warc(archives).select("page_id", "payload_bytes").collect()}
    assert got[99] == 18_000_000 and len(got) == 41
    with open(archives.first().path.removeprefix("file://"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
