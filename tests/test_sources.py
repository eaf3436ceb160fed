"""Readers and writers on small files."""

import json
import zipfile

import pytest

from parley.operators import ingest
from parley.sources import readers, writers


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿text,label\n\"a, \"\"b\"\"\nc\",1\nd,0\n".encode())
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [(r.text, r.label, r.row) for r in rows] == [('a, "b"\nc', "1", 0), ("d", "0", 1)]
    (tmp_path / "l.csv").write_bytes("text\ncaf\xe9\n".encode("latin-1"))
    assert readers.read_csv_any_encoding(spark, str(tmp_path / "l.csv")).first().text == "café"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|FAILED_READ"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    assert [r._corrupt_record for r in readers.read_jsonl_errors(spark, str(tmp_path / "b.jsonl"), "a int").collect()] == ["not json"]


def test_split_map_and_registry(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"conversation_to_split": {"c1": "train", "c2": "test"}}))
    assert {(r.conversation_id, r.split) for r in readers.read_split_map(spark, str(tmp_path / "m.json")).collect()} == {("c1", "train"), ("c2", "test")}
    (tmp_path / "bad.json").write_text(json.dumps({"conversation_to_split": {"c1": "dev"}}))
    with pytest.raises(Exception, match="unknown split dev"):
        readers.read_split_map(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "r.json").write_text(json.dumps({"datasets": [{"id": "a", "status": "automatic"}, {"id": "b", "status": "manual"}]}))
    assert readers.read_registry(spark, str(tmp_path / "r.json")).where("status = 'automatic'").count() == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x/dialogues_text.txt", "hi __eou__ yo __eou__\n\nbye __eou__\n")
        z.writestr("x/other.txt", "no")
    lines = readers.read_zip_lines(readers.archives_at(spark, str(tmp_path / "d.zip")), r"dialogues_text\.txt$")
    assert ingest.from_utterances(lines).count() == 2
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("r/train/dialogues_001.json", json.dumps([{"dialogue_id": "1", "services": ["a"], "turns": [{"speaker": "USER", "utterance": "hi"}]}]))
        z.writestr("r/sgd_x/dialogues_001.json", "[]")
    rows = readers.read_zip_dialogues(readers.archives_at(spark, str(tmp_path / "s.zip")))
    assert rows.first().original_split == "train" and ingest.from_dialogue_arrays(rows).first().turns[0].speaker_role == "user"
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("t.csv", "ID,Content\n1,hello\n")
    assert readers.read_zip_csv(readers.archives_at(spark, str(tmp_path / "c.zip"))).first().fields == {"ID": "1", "Content": "hello"}
    assert len(readers.file_digests(spark, str(tmp_path / "c.zip")).first().sha256) == 64


def test_writers(spark, tmp_path):
    calls = spark.createDataFrame([(0, "caller: a", "0", "x"), (1, "caller: a", "0", "x")], "row int, text string, label string, scam_category string")
    df = ingest.with_quality(ingest.fingerprinted(ingest.from_labelled_calls(calls)))
    writers.fan_out(df, str(tmp_path / "o"))
    assert [spark.read.parquet(str(tmp_path / "o" / n)).count() for n in ("all", "kept", "turns")] == [2, 1, 1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.fan_out(df, str(tmp_path / "o"))
    old, new = (spark.createDataFrame([(k, v)], "k string, v int") for k, v in (("a", 1), ("a", 2)))
    assert writers.latest(old, new, ["k"]).first().v == 2
    assert writers.append_new(old, new, "k").count() == 0
    splits = spark.createDataFrame([("c2", "train"), ("c1", "train")], "conversation_id string, split string")
    writers.split_lists(splits, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s" / "split=train")).count() == 2
    writers.write_json(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert readers.read_json(str(tmp_path / "r.json")) == {"a": 2, "b": 1}


def test_encodings_of_files_side_by_side(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text\ncaf\u00e9\n".encode())
    (tmp_path / "b.csv").write_bytes("text\ncr\u00e8me\n\u00fc\n".encode("latin-1"))
    got = readers.read_csv_any_encoding(spark, str(tmp_path)).collect()
    assert sorted((r.text, r.row) for r in got) == [("caf\u00e9", 0), ("cr\u00e8me", 0), ("\u00fc", 1)]


def test_download_is_whole_or_not_there(tmp_path):
    from parley.sources import paged

    failures, waits = [2], []

    def fetch():
        yield b"ab"
        if failures[0]:
            failures[0] -= 1
            raise OSError("gone")
        yield b"cd"

    assert paged.download(fetch, str(tmp_path / "x" / "f"), wait=waits.append) == 4 and waits == [1, 2]
    assert (tmp_path / "x" / "f").read_bytes() == b"abcd" and len(list((tmp_path / "x").iterdir())) == 1
    with pytest.raises(ValueError):
        paged.download(fetch, str(tmp_path / "g"), most_bytes=3)
    failures[0] = 9
    with pytest.raises(OSError):
        paged.download(fetch, str(tmp_path / "g"), wait=waits.append)
    assert not (tmp_path / "g").exists() and not (tmp_path / "g.part").exists()
