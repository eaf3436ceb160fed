"""Orphans are found among all rows of the tables."""

from parley.plans import QUERIES


def test_orphans_of_any_id_are_found(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", [(i,) for i in range(0, 90)], "doc_id long")
    write("labels", [(i,) for i in range(50, 93)], "doc_id long")
    write("conversations", [(c, k) for c in range(40) for k in range(3) if k or c % 13 != 12], "conv_id long, turn long")
    assert sorted(r.doc_id for r in QUERIES["label_orphans"](spark, str(tmp_path)).collect()) == [90, 91, 92]
    got = sorted((r.conv_id, r.turn) for r in QUERIES["turn_orphans"](spark, str(tmp_path)).collect())
    assert got == [(c, k) for c in (12, 25, 38) for k in (1, 2)]
