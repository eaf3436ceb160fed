"""Queries over formats, signed events and streams: what is written is read back by the
library's readers and compared with the rows that went in."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import head_tail
from ..operators import ingest, loaders, reports, sampling
from ..sources import paged, readers, writers
from ..storage import new_path
from ..streaming import handoff
from .conversations import LINE_SQL, split_of, unit_sql
from .corpus import PARTS, QUALITY, canonical, gathered, spoken
from .events import _DELAY_SQL, received
from .registry import Tables, query


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS row, item_id::VARCHAR AS item_id, text FROM benchmark")
def csv_scan(t: Tables) -> DataFrame:
    """A header CSV with line breaks and quotes in its fields, rows numbered as they stand."""
    path = new_path(t.spark, "csv")
    t.benchmark.coalesce(1).sortWithinPartitions("item_id").write.csv(path, header=True, escape='"')
    return readers.read_csv(t.spark, path).select("row", "item_id", "text")


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_scan(t: Tables) -> DataFrame:
    path = new_path(t.spark, "jsonl")
    t.labels.write.json(path)
    return readers.read_jsonl(t.spark, path, "doc_id long, quality int, toxic int")


@query("SELECT item_id::VARCHAR AS id, 'automatic' AS status, length(text) AS size FROM benchmark")
def registry_scan(t: Tables) -> DataFrame:
    """A catalogue in one JSON document."""
    path = new_path(t.spark, "registry")
    entry = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("automatic").alias("status"), F.length("text").alias("size"))
    t.benchmark.agg(F.to_json(F.struct(F.collect_list(entry).alias("datasets"))).alias("value")).write.text(path)
    return readers.read_registry(t.spark, path).select("id", "status", F.col("size").cast("long").alias("size"))


def _split_sql(key: str) -> str:
    u = unit_sql(key, "split")
    return f"CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.85 THEN 'validation' ELSE 'test' END"


@query(f"SELECT item_id::VARCHAR AS conversation_id, {_split_sql('item_id')} AS split FROM benchmark")
def split_map_scan(t: Tables) -> DataFrame:
    """A split manifest in one JSON document."""
    path = new_path(t.spark, "manifest")
    entry = F.struct(F.col("item_id").cast("string").alias("k"), split_of(F.col("item_id")).alias("v"))
    t.benchmark.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("conversation_to_split"))).alias("value")).write.text(path)
    return readers.read_split_map(t.spark, path)


@query(f"""SELECT split, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) || chr(10)) AS sha256 FROM (SELECT doc_id, {_split_sql('doc_id')} AS split FROM documents) GROUP BY split""")
def split_list_digests(t: Tables) -> DataFrame:
    """Sorted id lists, one file per split, and the files' digests."""
    path = new_path(t.spark, "splits")
    writers.split_lists(t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"), split_of(F.col("doc_id")).alias("split")), path)
    files = readers.file_digests(t.spark, f"{path}/split=*")
    return files.select(F.regexp_extract("path", "split=([a-z]+)", 1).alias("split"), "sha256")


@query(f"""WITH {PARTS}, {QUALITY} SELECT 'all' AS part, count(*) AS n FROM q UNION ALL SELECT 'kept', count(*) FILTER (first_id = id) FROM q
UNION ALL SELECT 'turns', (sum(n_turns) FILTER (first_id = id))::BIGINT FROM q""")
def fan_out(t: Tables) -> DataFrame:
    """All conversations, the kept ones and their turns, written in one pass and counted."""
    path = new_path(t.spark, "build")
    writers.fan_out(ingest.with_quality(canonical(t)), path)
    parts = [t.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("all", "kept", "turns")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def archives(rows: DataFrame, key: Column, form) -> DataFrame:
    """path, content: a ZIP for each value of the key, made where its rows are. `form` gives the
    members of a frame of rows as pairs of path and text."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, body in form(frame):
                z.writestr(name, body)
        return pd.DataFrame({"path": [f"{frame['_archive'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    return rows.withColumn("_archive", key).groupBy("_archive").applyInPandas(pack, "path string, content binary")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text, CASE conv_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS original_split FROM conversations")
def zip_dialogues(t: Tables) -> DataFrame:
    """JSON arrays of dialogues in archives, the split named by their folder."""

    def form(f: pd.DataFrame):
        import json

        for split, part in f.groupby(f["conv_id"] % 3):
            made = [
                {"dialogue_id": str(c), "services": ["chat"], "turns": [{"speaker": r, "utterance": x} for r, x in zip(g["role"], g["text"])]}
                for c, g in part.sort_values("turn").groupby("conv_id")
            ]
            yield f"data/{['dev', 'test', 'train'][split]}/dialogues_001.json", json.dumps(made)
        yield "data/readme.md", "not a dialogue"

    packed = archives(t.conversations, F.col("conv_id") % 7, form)
    turns = readers.read_zip_dialogues(packed).select("dialogue_id", "original_split", F.posexplode("turns").alias("place", "x"))
    return turns.select(F.col("dialogue_id").cast("long").alias("conv_id"), F.col("place").cast("long").alias("place"), F.col("x.speaker").alias("role"), F.col("x.utterance").alias("text"), "original_split")


@query(r"SELECT conv_id % 7 AS archive, regexp_replace(text, '\s+', ' ', 'g') AS value FROM conversations WHERE trim(text) <> ''")
def zip_lines(t: Tables) -> DataFrame:
    """Lines of the one text member of each archive."""
    flat = t.conversations.select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("text")).where("trim(text) <> ''")
    packed = archives(flat, F.col("conv_id") % 7, lambda f: [("set/dialogues_text.txt", "\r\n".join(f.sort_values(["conv_id", "turn"])["text"]) + "\n\n"), ("set/acts.txt", "1 2")])
    return readers.read_zip_lines(packed).select(F.regexp_extract("archive", "([0-9]+)", 1).cast("long").alias("archive"), "value")


@query("SELECT conv_id, turn, role, text FROM conversations")
def zip_csv(t: Tables) -> DataFrame:
    """CSV members of archives, with line breaks and quotes in their fields."""
    packed = archives(t.conversations, F.col("conv_id") % 7, lambda f: [("a/rows.csv", f.drop(columns="_archive").to_csv(index=False))])
    fields = readers.read_zip_csv(packed).select("fields")
    return fields.select(F.col("fields")["conv_id"].cast("long").alias("conv_id"), F.col("fields")["turn"].cast("long").alias("turn"), F.col("fields")["role"].alias("role"), F.col("fields")["text"].alias("text"))


@query("SELECT i AS id, i * i AS square FROM range(997) r(i)")
def paged_rows(t: Tables) -> DataFrame:
    """All pages of a rows service, which here is a function, tried again where it fails."""
    failed: set[int] = set()

    def fetch(offset: int, length: int) -> list[dict]:
        if offset % 200 == 0 and offset not in failed:
            failed.add(offset)
            raise OSError("try again")
        return [{"id": i, "square": i * i} for i in range(offset, min(997, offset + length))]

    return paged.read_pages(t.spark, paged.with_retries(fetch), 1200, 100, "id long, square long")


@query("""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id * 1.5 END AS latency, turn FROM conversations)
SELECT turn, count(*) AS n, max(coalesce(latency, 'inf'::DOUBLE)) = 'inf'::DOUBLE AS unbounded, median(coalesce(latency, 'inf'::DOUBLE)) AS median_latency FROM c GROUP BY turn""")
def ladder_latency(t: Tables) -> DataFrame:
    """Latencies where a missing one counts as infinite."""
    rows = t.conversations.select("turn", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") * 1.5).alias("latency"))
    return reports.latency_summary(rows, ["turn"])


SECRET = "a secret of the tests"
KEY = SECRET.encode().ljust(64, b"\0")
INNER, OUTER = bytes(b ^ 0x36 for b in KEY).hex(), bytes(b ^ 0x5C for b in KEY).hex()
PAYLOAD = """'{"conversation_id":"' || user_id || '","decision_source":"base","detector_status":"eligible","event_id":"' || event_id || '","is_scam":"' || (event_id % 3 <> 0)
|| '","issued_at":"' || epoch_us(ts) || '","production_eligible":"' || (event_id % 2 = 0) || '","scam_score":"' || printf('%.6f', value / 1000) || '","threshold":"0.500000"}'"""
HMAC = f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode({PAYLOAD}))))"


def handoffs(t: Tables) -> DataFrame:
    """Hand-off events out of the event table, with the time they are received."""
    return received(t).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("conversation_id"), F.col("ts").cast("timestamp").alias("issued_at"), (F.col("value") / 1000).alias("scam_score"),
        F.lit(0.5).alias("threshold"), F.lit("eligible").alias("detector_status"), (F.col("event_id") % 2 == 0).alias("production_eligible"), F.lit("base").alias("decision_source"),
        (F.col("event_id") % 3 != 0).alias("is_scam"), "now",
    )


@query(f"SELECT event_id::VARCHAR AS event_id, {HMAC} AS signature FROM events")
def signed_events(t: Tables) -> DataFrame:
    return handoff.sign(handoffs(t), SECRET).select("event_id", "signature")


REJECTED = f"CASE WHEN event_id % 7 = 0 THEN 'unsigned' WHEN event_id % 5 = 0 THEN 'forged' WHEN {_DELAY_SQL} > 300 THEN 'stale' WHEN {_DELAY_SQL} < -60 THEN 'future' END"


def tampered(t: Tables) -> DataFrame:
    """Signed events, of which some lost their signature and some were altered after signing."""
    n = F.col("event_id").cast("long")
    signed = handoff.sign(handoffs(t), SECRET)
    cut = signed.withColumn("signature", F.when(n % 7 == 0, "").otherwise(F.col("signature")))
    return cut.withColumn("threshold", F.when((n % 5 == 0) & (n % 7 != 0), F.lit(0.25)).otherwise(F.col("threshold")))


@query(f"SELECT event_id::VARCHAR AS event_id, {REJECTED} AS rejected FROM events")
def verified_events(t: Tables) -> DataFrame:
    return handoff.verify(tampered(t), SECRET, F.col("now")).select("event_id", "rejected")


@query(f"SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS conversation_id FROM events WHERE {REJECTED} IS NULL AND event_id % 3 <> 0 AND value / 1000 >= 0.01 AND event_id % 2 = 0")
def admitted_events(t: Tables) -> DataFrame:
    """Events that may open a session: verified, once per id, through the gate."""
    twice = tampered(t).unionByName(tampered(t))
    made = handoff.admitted(twice, SECRET, handoff.Policy(enabled=True, minimum_scam_score=0.01), F.col("now"))
    return made.select("event_id", "conversation_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'detector_did_not_cross_threshold' WHEN event_id % 2 = 1 THEN 'detector_is_research_only' END AS blocked_reason,
event_id % 3 <> 0 AND event_id % 2 = 0 AS handoff FROM events""")
def recommendations(t: Tables) -> DataFrame:
    made = handoff.recommendation(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0, True)
    return t.events.select("event_id", made.alias("r")).select("event_id", "r.blocked_reason", "r.handoff")


MULTIPLY, PERMUTE = handoff.dihedral_tables()
FLAT_M, FLAT_P = [x for r in MULTIPLY for x in r], [x for r in PERMUTE for x in r]


def checksum_sql(digits: str) -> str:
    places = f"list_transform(string_split(reverse({digits}), ''), lambda c, i: ({FLAT_P})[(i - 1) % 8 * 10 + c::INT + 1])"
    return f"list_reduce([0] || {places}, lambda a, x: ({FLAT_M})[a * 10 + x + 1])"


@query(f"SELECT doc_id, {checksum_sql('lpad(doc_id::VARCHAR, 12, ' + chr(39) + '7' + chr(39) + ')')}::INT AS checksum FROM documents")
def checksums(t: Tables) -> DataFrame:
    digits = F.lpad(F.col("doc_id").cast("string"), 12, "7")
    return t.documents.select("doc_id", handoff.identity_check(digits, MULTIPLY, PERMUTE).cast("int").alias("checksum"))


@query(f"""WITH d AS (SELECT doc_id, rpad(regexp_replace(sha256('seed' || doc_id), '[^0-9]', '', 'g'), 24, '7') AS d FROM documents),
w AS (SELECT *, ({checksum_sql("substr(d, 1, 11) || '0'")} + 5) % 10 AS wrong FROM d)
SELECT doc_id, '+91 0' || substr(d, 1, 4) || ' ' || substr(d, 5, 5) AS phone, substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9, 3) || wrong AS identity,
'0000' || substr(d, 12, 6) AS account, 'asha.' || substr(d, 18, 4) || '@invalid' AS upi FROM w""")
def synthetic_identities(t: Tables) -> DataFrame:
    made = handoff.synthetic_identity(F.lit("Asha Example"), F.concat(F.lit("seed"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", made.alias("i")).select("doc_id", "i.phone", "i.identity", "i.account", "i.upi")


UNIT64 = "(('0x' || substr(sha256('split|' || conv_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@query(f"SELECT DISTINCT conv_id, CASE WHEN {UNIT64} < 0.7 THEN 'train' WHEN {UNIT64} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM conversations")
def hash_split64(t: Tables) -> DataFrame:
    """The split by the top 64 bits of the digest."""
    return t.conversations.select("conv_id").distinct().withColumn("split", hashing.assign_split(F.col("conv_id").cast("string"), "split"))


def drained(stream: DataFrame, schema: str) -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote."""
    out, spark = new_path(stream.sparkSession, "stream"), stream.sparkSession
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def streamed(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern lets the path be a file or a folder."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


@query("""WITH s AS (SELECT user_id, event_id, ts, epoch(ts)::BIGINT AS x, floor(epoch(ts)) - first_value(floor(epoch(ts))) OVER w AS age,
coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, count(*) FILTER (age <= 500000 AND closed = 0) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
r AS (SELECT *, CASE WHEN closed = 1 THEN 'disengaged' WHEN before >= 5 THEN 'maximum_turns_reached' WHEN age > 500000 THEN 'maximum_session_time_reached' END AS reason FROM b)
SELECT user_id::VARCHAR AS conversation_id, sum((reason IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY ts)::INT AS turn, reason IS NULL AS answered, reason FROM r""")
def session_budgets(t: Tables) -> DataFrame:
    """A stream of turns, answered within the budgets of turns and time and until disengaged."""
    turns = streamed(t, "events").select(F.col("user_id").cast("string").alias("conversation_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("disengage"))
    return drained(handoff.sessions(turns, handoff.Policy(enabled=True, maximum_turns=5, maximum_session_seconds=500_000)), handoff.ANSWER)


SCORE = unit_sql("conv_id || '/' || turn", "live")


@query(f"""SELECT conv_id::VARCHAR AS conversation_id, turn::INT AS turn, row_number() OVER w::INT AS size, max(({SCORE} >= 0.8)::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS latched
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def latched_turns(t: Tables) -> DataFrame:
    """A stream of scored turns whose decision stays once it has fired."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    turns = streamed(t, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("turn"), hashing.unit32(key, "live").alias("score"))
    return drained(handoff.latched(turns, 0.8), handoff.LATCH)


@query(f"""WITH r AS (SELECT doc_id, n_chars, sha256('batch|' || doc_id) AS h FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) - 1 AS place FROM r),
m AS (SELECT *, place // 64 AS mega FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY mega ORDER BY n_chars DESC, h, doc_id) - 1 AS i FROM m),
g AS (SELECT *, mega * 8 + i // 8 AS batch FROM b) SELECT doc_id, batch, i % 8 AS slot, sha256('order|' || batch) AS batch_rank FROM g""")
def sortish_batches(t: Tables) -> DataFrame:
    """Batches of like length: a seeded shuffle, lengths sorted within mega-batches, batches
    shuffled."""
    return sampling.sortish_batches(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 8).select("doc_id", "batch", "slot", "batch_rank")


@query("""WITH d AS (SELECT doc_id, list_transform(range(1 + doc_id % 20), lambda x: (x + 10)::INT) AS ids FROM documents)
SELECT doc_id, CASE WHEN len(ids) <= 8 THEN [1] || ids || [2] ELSE [1] || ids[1:3] || [3] || ids[len(ids) - 3:len(ids)] || [2] END AS ids FROM d""")
def head_tail_ids(t: Tables) -> DataFrame:
    """Token ids cut to a budget: the head, a separator, the tail."""
    ids = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 20).cast("int")), lambda x: x + 10)
    return t.documents.select("doc_id", head_tail(ids, 10, 0.5, 1, 3, 2).alias("ids"))


@query("SELECT doc_id::VARCHAR AS record_id, toxic AS label, 'clips/' || lang || '/./' || doc_id || '.wav' AS audio_path FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def audio_manifest(t: Tables) -> DataFrame:
    """Rows of an audio validation set, checked: relative paths inside their root, both labels."""
    rows = t.documents.join(t.labels, "doc_id").where("toxic is not null").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").cast("string").alias("conversation_id"), F.col("toxic").alias("label"), F.lit("audio_validation").alias("split"),
        F.concat(F.lit("clips/"), "lang", F.lit("/./"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"), F.lit(True).alias("pii_redacted"), F.lit("said").alias("reference_text"),
        F.col("lang").alias("language"), F.col("source").alias("source_group"), F.lit("granted").alias("rights_basis"),
    )
    return loaders.audio_records(rows).select("record_id", "label", "audio_path")


@query("""SELECT doc_id::VARCHAR || '.' || CASE doc_id % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'MP3' ELSE 'txt' END AS path, CASE WHEN doc_id % 3 = 2 THEN 'bad_extension' WHEN n_chars = 0 THEN 'empty_file' WHEN n_chars > 2000 THEN 'too_large' END AS fault FROM documents""")
def audio_files(t: Tables) -> DataFrame:
    kinds = F.array(F.lit("wav"), F.lit("MP3"), F.lit("txt"))
    path = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")))
    return loaders.audio_file_faults(t.documents.select(path.alias("path"), F.col("n_chars").alias("length")), ["wav", "mp3"], 2000).select("path", "fault")


@query(f"""WITH {PARTS} SELECT id AS conversation_id, 'train' AS split, CASE WHEN is_scam = 0 AND dataset IN ('intents', 'daily', 'schema_guided') THEN 0.5 ELSE 1.0 END::DOUBLE AS sample_weight FROM whole""")
def train_only_rows(t: Tables) -> DataFrame:
    """Rows that may only train, weighed by their provenance."""
    rows = canonical(t).withColumn("allowed_splits", F.array(F.lit("train")))
    return loaders.train_only(rows, ["source_label", "source_negative"], {"source_negative": 0.5}).select("conversation_id", "split", "sample_weight")


@query("""SELECT '{"doc_id": ' || doc_id || ', "toxic": ' AS bad FROM labels WHERE toxic = 1""")
def jsonl_faults(t: Tables) -> DataFrame:
    """The malformed lines of a file, here the toxic ones, cut short."""
    path = new_path(t.spark, "jsonl")
    start = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "toxic": '))
    t.labels.select(F.when(F.col("toxic") == 1, start).otherwise(F.concat(start, F.lit("0}"))).alias("value")).write.text(path)
    return readers.read_jsonl_errors(t.spark, path, "doc_id long, toxic int").select(F.col("_corrupt_record").alias("bad"))


@query("SELECT item_id::VARCHAR AS id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations")
def csv_encodings(t: Tables) -> DataFrame:
    """CSV files of two encodings side by side, each read in its own."""
    path = new_path(t.spark, "csv")
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    t.benchmark.select(F.col("item_id").cast("string").alias("id"), "text").write.csv(f"{path}/part=utf8", header=True, escape='"')
    t.conversations.select(key.alias("id"), "text").write.csv(f"{path}/part=latin", header=True, escape='"', encoding="ISO-8859-1")
    return readers.read_csv_any_encoding(t.spark, f"{path}/part=*").select("id", "text")


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, max((trim(text) = '')::INT) AS blank, length(string_agg({LINE_SQL}, chr(10) ORDER BY turn)) AS chars, {unit_sql('conv_id', 'detect')} AS score FROM conversations GROUP BY conv_id),
r AS (SELECT *, CASE WHEN n > 5 THEN 'too_many_turns' WHEN blank = 1 THEN 'empty_turn' WHEN chars > 1500 THEN 'too_long' END AS refused FROM c)
SELECT conv_id AS conversation_id, refused, CASE WHEN refused IS NULL THEN score >= 0.6 END AS is_scam, CASE WHEN refused IS NULL THEN score END AS scam_score,
CASE WHEN refused IS NULL THEN CASE WHEN score < 0.6 THEN 'detector_did_not_cross_threshold' END END AS blocked_reason, 'base_detector' AS decision_source FROM r""")
def detections(t: Tables) -> DataFrame:
    """Responses of the detector with a stand-in score: refusals, decisions, hand-off advice."""
    from ..operators import detect

    score = lambda df: df.withColumn("score", hashing.unit32(F.col("conversation_id").cast("string"), "detect"))
    rows = gathered(t, spoken()).withColumnRenamed("conv_id", "conversation_id")
    policy = detect.Policy(detector_status="eligible", enable_handoff=True, maximum_turns=5, maximum_characters=1500)
    made = detect.detect(rows, score, 0.6, policy)
    return made.select("conversation_id", "refused", "is_scam", "scam_score", F.col("handoff.blocked_reason").alias("blocked_reason"), "decision_source")
