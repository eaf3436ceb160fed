"""Queries over the corpus build: adapters, canonical rows, validation, text operators, loaders.

Conversations stand in for the raw sources: their turns are joined into the dialogue formats
that the adapters read, and what comes out is compared with the rows that went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities, signals, text
from ..operators import gates, ingest, loaders, multitask, reports, sampling, views
from ..schema import STAGES, TACTICS
from ..sources import writers
from .conversations import _TYPE_CASES, LINE_SQL, STAGE_SQL, unit_sql
from .registry import Tables, query

FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def flat_sql(column: str) -> str:
    return FLAT.format(column)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT doc_id, sha256({flat_sql('nfc_normalize(text)')}) AS normalized_sha256 FROM documents")
def normalized_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized_sha256"))


# the only letter of these texts whose case folding is not its lower case
FOLD = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({flat_sql(FOLD.format('text'))}, '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS asr_sha256 FROM documents""")
def asr_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.asr_normalize(F.col("text")), 256).alias("asr_sha256"))


def gathered(t: Tables, turn: Column, name: str = "turns") -> DataFrame:
    """A row per conversation with its turns in order, as the column given makes them."""
    rows = F.array_sort(F.collect_list(F.struct("turn", turn.alias("x"))), lambda a, b: F.signum(a["turn"] - b["turn"]).cast("int"))
    return t.conversations.groupBy("conv_id").agg(F.transform(rows, lambda r: r["x"]).alias(name))


def spoken() -> Column:
    return F.struct(F.col("role").alias("speaker_role"), F.col("text").alias("text"))


@query(f"""SELECT conv_id, sha256(string_agg(replace(lower(trim(role)), ' ', '_') || ': ' || lower({flat_sql('text')}), chr(10) ORDER BY turn)) AS transcript_sha256
FROM conversations GROUP BY conv_id""")
def transcripts(t: Tables) -> DataFrame:
    return gathered(t, spoken()).select("conv_id", F.sha2(loaders.transcript(F.col("turns")), 256).alias("transcript_sha256"))


def marked_dialogues(t: Tables) -> DataFrame:
    """conv_id and a dialogue with role markers: the turns, callers and receivers in turn."""
    marker = F.when(F.col("turn") % 2 == 0, "Caller: ").otherwise("Receiver : ")
    return gathered(t, F.concat(marker, F.col("text")), "parts").select("conv_id", F.array_join("parts", " ").alias("dialogue"))


PLACED = f"""placed AS (SELECT conv_id, turn, text, row_number() OVER w - 1 AS place, CASE turn % 2 WHEN 0 THEN 'caller' ELSE 'recipient' END AS role, {flat_sql('text')} AS plain
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"WITH {PLACED} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS place, role, plain AS text FROM placed WHERE plain <> ''")
def dialogue_turns(t: Tables) -> DataFrame:
    """Dialogues with role markers, split into turns."""
    made = marked_dialogues(t).select("conv_id", F.posexplode(text.split_roles(F.col("dialogue"))).alias("place", "x"))
    return made.select("conv_id", F.col("place").cast("long").alias("place"), "x.role", "x.text")


@query(f"""WITH {PLACED}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS place, plain FROM placed WHERE plain <> '')
SELECT conv_id, place, CASE place % 2 WHEN 0 THEN 'speaker_a' ELSE 'speaker_b' END AS role, plain AS text FROM n""")
def utterance_turns(t: Tables) -> DataFrame:
    """Utterances between marks, speakers taking turns."""
    lines = gathered(t, F.col("text"), "parts").select("conv_id", F.array_join("parts", " __eou__ ").alias("value"))
    made = lines.select("conv_id", F.posexplode(text.split_utterances(F.col("value"))).alias("place", "x"))
    return made.select("conv_id", F.col("place").cast("long").alias("place"), "x.role", "x.text")


@query(r"""SELECT page_id, CASE WHEN d = '' THEN '[REDACTED]' ELSE '***' || right(d, 4) END AS masked FROM (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS d FROM pages)""")
def masked_tails(t: Tables) -> DataFrame:
    return t.pages.select("page_id", entities.masked_tail(F.col("url")).alias("masked"))


@query(f"SELECT doc_id, CASE WHEN p LIKE '[ROLE=%' THEN p ELSE '[ROLE=caller] ' || p END AS tagged FROM (SELECT doc_id, {flat_sql('text')} AS p FROM documents WHERE trim(text) <> '')")
def tagged_text(t: Tables) -> DataFrame:
    return t.documents.where(F.trim("text") != "").select("doc_id", text.ensure_caller_tag(F.col("text")).alias("tagged"))


def reply_turn() -> Column:
    stage = F.when(F.col("turn") == 0, "contact").otherwise("chatter").alias("stage")
    return F.struct(F.col("role").alias("speaker_role"), F.col("text").alias("text"), stage, F.array(F.lit("urgency"), F.lit("small_talk")).alias("tactics"))


def replies(t: Tables) -> DataFrame:
    """Replies of a model: prose and fences around a JSON object of turns."""
    body = F.to_json(F.struct(F.col("turns").alias("turns")))
    return gathered(t, reply_turn()).select("conv_id", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")).alias("reply"))


@query("SELECT conv_id, turn AS place, role AS speaker_role, text, CASE turn WHEN 0 THEN 'contact' ELSE 'chatter' END AS stage, 'urgency,small_talk' AS tactics FROM conversations")
def reply_turns(t: Tables) -> DataFrame:
    made = replies(t).select("conv_id", F.posexplode(text.reply_turns(F.col("reply"))).alias("place", "x"))
    return made.select("conv_id", F.col("place").cast("long").alias("place"), "x.speaker_role", "x.text", "x.stage", F.array_join("x.tactics", ",").alias("tactics"))


@query(f"""WITH {PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS turn_id FROM placed WHERE plain <> '')
SELECT conv_id, turn_id, CASE place % 2 WHEN 0 THEN 'caller' ELSE 'callee' END AS speaker_role, plain AS text,
CASE WHEN conv_id % 2 = 0 THEN 'none_unknown' ELSE 'contact' END AS stage, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'urgency' END AS tactics FROM n""")
def generated_turns(t: Tables) -> DataFrame:
    """Turns of a reply as canonical turns: unknown roles by parity, closed lists only."""
    is_scam = (F.col("conv_id") % 2).cast("int")
    made = multitask.generated_turns(text.reply_turns(F.col("reply")), is_scam, F.lit("other_scam"), STAGES, TACTICS, "generated")
    rows = replies(t).select("conv_id", F.explode(made).alias("x"))
    return rows.select("conv_id", F.col("x.turn_id").cast("long").alias("turn_id"), "x.speaker_role", F.col("x.normalized_text").alias("text"), "x.labels.stage",
                       F.array_join(F.map_keys("x.labels.tactics"), ",").alias("tactics"))


TACTIC_CASES = {k: "CASE WHEN " + " OR ".join(f"contains(low, {quoted(w)})" for w in ws) + " THEN 1 END" for k, ws in signals.WEAK_TACTICS.items()}
TYPE_OF = f"CASE {' '.join(_TYPE_CASES)} ELSE 'other_scam' END"
CATEGORIES = ["bank_kyc", "amazon", "unheard of"]
PARTS = f"""
{PLACED},
raw AS (
  SELECT 'labelled_calls' AS dataset, 0 AS rank, conv_id::VARCHAR AS record, place, role, plain, conv_id % 2 AS is_scam, 'hi-Latn' AS language,
    (['bank_kyc', 'amazon', 'unheard of'])[conv_id % 3 + 1] AS category FROM placed
  UNION ALL SELECT 'messages', 1, doc_id::VARCHAR, 0, 'sender', {flat_sql('text')}, CASE WHEN coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END, 'mul', '' FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'synthetic_dialogue', 2, conv_id::VARCHAR, place, role, plain, (conv_id + 1) % 2, 'en', '' FROM placed
  UNION ALL SELECT 'intents', 4, item_id::VARCHAR, 0, 'customer', {flat_sql('text')}, 0, 'en', '' FROM benchmark
  UNION ALL SELECT 'daily', 5, conv_id::VARCHAR, place, NULL, plain, 0, 'en', '' FROM placed
  UNION ALL SELECT 'schema_guided', 6, conv_id::VARCHAR, place, 'user', plain, 0, 'en', '' FROM placed),
texts AS (
  SELECT 'labelled_calls' AS dataset, conv_id::VARCHAR AS record, lower(string_agg(CASE turn % 2 WHEN 0 THEN 'Caller: ' ELSE 'Receiver : ' END || text, ' ' ORDER BY turn)) AS low FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'messages', doc_id::VARCHAR, lower(text) FROM documents
  UNION ALL SELECT 'synthetic_dialogue', conv_id::VARCHAR, lower('loan ' || string_agg(CASE turn % 2 WHEN 0 THEN 'Caller: ' ELSE 'Receiver : ' END || text, ' ' ORDER BY turn)) FROM conversations GROUP BY conv_id),
typed AS (SELECT r.*, CASE WHEN is_scam = 0 THEN 'non_scam' ELSE (SELECT {TYPE_OF} FROM (SELECT x.low)) END AS kind,
  dataset || ':' || substr(sha256(dataset || '|' || record), 1, 20) AS id FROM raw r LEFT JOIN texts x USING (dataset, record)),
kinds AS (SELECT *, CASE WHEN kind = 'other_scam' AND dataset = 'labelled_calls' THEN CASE category WHEN 'bank_kyc' THEN 'fake_kyc_bank' WHEN 'amazon' THEN 'courier_customs' ELSE kind END ELSE kind END AS scam_type FROM typed),
said AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS turn_id FROM kinds WHERE plain <> ''),
turns AS (SELECT * REPLACE (CASE WHEN dataset = 'daily' THEN CASE turn_id % 2 WHEN 0 THEN 'speaker_a' ELSE 'speaker_b' END ELSE role END AS role) FROM said),
labelled AS (SELECT *, CASE WHEN dataset = 'daily' THEN turn_id ELSE place END AS turn, lower(plain) AS low FROM turns),
tactics AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in TACTIC_CASES.items())} FROM labelled),
staged AS (SELECT *, is_scam = 1 AND role IN ('caller', 'sender', 'unknown') AS weak, {STAGE_SQL} AS weak_stage FROM tactics),
whole AS (SELECT id, any_value(dataset) AS dataset, any_value(rank) AS rank, any_value(record) AS record, any_value(is_scam) AS is_scam, any_value(scam_type) AS scam_type,
  any_value(language) AS language, count(*) AS n_turns, sha256(string_agg(role || ':' || lower(plain), chr(10) ORDER BY turn_id)) AS exact_sha256 FROM staged GROUP BY id)
"""


def canonical(t: Tables) -> DataFrame:
    """Six sources in their fixed order, as canonical conversations with fingerprints."""
    calls = marked_dialogues(t)
    kinds = F.array(*(F.lit(c) for c in CATEGORIES))
    record = F.col("conv_id").cast("string").alias("row")
    labelled = calls.select(record, F.col("dialogue").alias("text"), (F.col("conv_id") % 2).alias("label"), F.element_at(kinds, (F.col("conv_id") % 3 + 1).cast("int")).alias("scam_category"))
    said = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("row"), F.col("text").alias("message"), F.when(F.col("toxic") == 1, "Scam ").otherwise("legit").alias("label"))
    synthetic = calls.select(record, "dialogue", F.lit("loan").alias("type"), ((F.col("conv_id") + 1) % 2).alias("label"))
    intents = t.benchmark.select(F.col("item_id").cast("string").alias("row"), "text", F.lit("faq").alias("category"))
    daily = gathered(t, F.col("text"), "parts").select(record, F.array_join("parts", " __eou__ ").alias("value"))
    guided = gathered(t, F.struct(F.lit("USER").alias("speaker"), F.col("text").alias("utterance"))).select(F.col("conv_id").cast("string").alias("dialogue_id"), F.array(F.lit("chat")).alias("services"), "turns")
    sources = [
        ingest.from_labelled_calls(labelled), ingest.from_messages(said), ingest.from_dialogues(synthetic), ingest.from_intents(intents),
        ingest.from_utterances(daily), ingest.from_dialogue_arrays(guided),
    ]
    return ingest.fingerprinted(ingest.union_sources(sources)).where(F.size("turns") > 0)


@query(f"WITH {PARTS} SELECT id AS conversation_id, dataset AS dataset_id, is_scam, scam_type, language, n_turns, exact_sha256 FROM whole")
def canonical_conversations(t: Tables) -> DataFrame:
    return canonical(t).select(
        "conversation_id", "source.dataset_id", "conversation_label.is_scam", "conversation_label.scam_type", F.col("language_profile")[0].alias("language"),
        F.size("turns").cast("long").alias("n_turns"), "exact_sha256",
    )


@query(f"""WITH {PARTS} SELECT id AS conversation_id, dataset AS dataset_id, turn_id, role AS speaker_role, sha256(plain) AS text_sha256,
CASE WHEN is_scam = 0 THEN 0 WHEN weak THEN 1 END AS is_scam, CASE WHEN is_scam = 0 THEN 'non_scam' WHEN weak THEN scam_type END AS scam_type,
CASE WHEN is_scam = 0 THEN 'none_unknown' WHEN weak THEN weak_stage END AS stage, CASE WHEN is_scam = 0 THEN 'source_negative' WHEN weak THEN 'weak_rule' ELSE 'unlabeled' END AS provenance,
CASE WHEN is_scam = 0 THEN 0 WHEN weak THEN urgency END AS urgency, CASE WHEN is_scam = 0 THEN 0 WHEN weak THEN financial_demand END AS financial_demand FROM staged""")
def canonical_turns(t: Tables) -> DataFrame:
    """Turns with their labels: blank ones gone, numbered densely, labelled by label and role."""
    flat = ingest.flat_turns(canonical(t))
    return flat.select(
        "conversation_id", "dataset_id", F.col("turn_id").cast("long").alias("turn_id"), "speaker_role", F.sha2("normalized_text", 256).alias("text_sha256"),
        "labels.is_scam", "labels.scam_type", "labels.stage", "labels.provenance", F.col("labels.tactics")["urgency"].alias("urgency"), F.col("labels.tactics")["financial_demand"].alias("financial_demand"),
    )


QUALITY = """q AS (SELECT *, first_value(id) OVER (PARTITION BY exact_sha256 ORDER BY rank, record, id) AS first_id FROM whole)"""


@query(f"""WITH {PARTS}, {QUALITY} SELECT id AS conversation_id, CASE WHEN first_id <> id THEN first_id END AS duplicate_of,
CASE WHEN first_id <> id THEN 'exact_duplicate' ELSE '' END AS reasons, first_id = id AS training_eligible FROM q""")
def exclusion_reasons(t: Tables) -> DataFrame:
    return ingest.with_quality(canonical(t)).select("conversation_id", "duplicate_of", F.array_join("exclusion_reasons", ",").alias("reasons"), "training_eligible")


@query(f"""WITH {PARTS}, {QUALITY} SELECT dataset AS dataset_id, is_scam AS label, count(*) AS n, count(*) FILTER (first_id = id) AS kept,
coalesce(sum(n_turns) FILTER (first_id = id), 0)::BIGINT AS turns FROM q GROUP BY dataset, is_scam""")
def build_counters(t: Tables) -> DataFrame:
    return reports.build_counters(ingest.with_quality(canonical(t)))


@query(f"""WITH {PARTS}, broken AS (SELECT id, record, dataset, scam_type, n_turns, abs(hash(id)) AS h, ('0x' || substr(sha256(id), 1, 4))::INT % 4 AS fault FROM whole)
SELECT id AS conversation_id, CASE fault WHEN 0 THEN '' WHEN 1 THEN 'bad_schema_version,bad_label' WHEN 2 THEN 'noncontiguous_turns,empty_turn,bad_scam_type' ELSE 'bad_stage' END AS errors FROM broken""")
def row_validation(t: Tables) -> DataFrame:
    """Codes of what is wrong with rows that were broken by their id's hash."""
    fault = F.conv(F.substring(F.sha2("conversation_id", 256), 1, 4), 16, 10).cast("int") % 4
    blank = lambda x: x.withField("normalized_text", F.lit(" ")).withField("turn_id", x["turn_id"] + 7)
    rows = canonical(t).withColumn("fault", fault)
    rows = rows.withColumn("schema_version", F.when(F.col("fault") == 1, "0").otherwise(F.col("schema_version")))
    label = F.col("conversation_label")
    rows = rows.withColumn("conversation_label", F.when(F.col("fault") == 1, label.withField("is_scam", F.lit(5))).when(F.col("fault") == 2, label.withField("scam_type", F.lit("odd"))).otherwise(label))
    odd = lambda x: x.withField("labels", x["labels"].withField("stage", F.lit("odd")))
    rows = rows.withColumn("turns", F.when(F.col("fault") == 2, F.transform("turns", blank)).when(F.col("fault") == 3, F.transform("turns", odd)).otherwise(F.col("turns")))
    return rows.select("conversation_id", F.array_join(ingest.validation_errors(), ",").alias("errors"))


# a document's case, by its id's hash: what a form says of it
def case(t: Tables, n: int, salt: str) -> tuple[DataFrame, Column]:
    return t.documents, F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), F.col("doc_id").cast("string")), 256), 1, 4), 16, 10).cast("int") % n


def case_sql(n: int, salt: str) -> str:
    return f"('0x' || substr(sha256('{salt}|' || doc_id), 1, 4))::INT % {n}"


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'consent_missing,too_few_turns' WHEN 2 THEN 'not_redacted,machine_generated' WHEN 3 THEN 'unknown_channel' ELSE 'no_language' END AS errors
FROM (SELECT doc_id, {case_sql(5, 'intake')} AS k FROM documents)""")
def intake_gate(t: Tables) -> DataFrame:
    rows, k = case(t, 5, "intake")
    one = F.struct(F.col("text").alias("text"))
    made = rows.where("trim(text) <> ''").unionByName(rows.where("trim(text) = '' or text is null").withColumn("text", F.lit("x"))).withColumn("k", k)
    made = made.select(
        "doc_id", (F.col("k") != 1).alias("consent_confirmed"), F.when(F.col("k") != 2, True).alias("pii_redacted"), (F.col("k") == 2).alias("llm_generated"),
        F.when(F.col("k") == 3, "fax").otherwise("call").alias("collection_channel"), F.when(F.col("k") == 4, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("language_profile"),
        F.when(F.col("k") == 1, F.array(one)).otherwise(F.array(one, one)).alias("turns"),
    )
    return made.select("doc_id", F.array_join(gates.intake_errors(["call", "chat"], 2), ",").alias("errors"))


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'no_annotator,bad_label' WHEN 2 THEN 'machine_label' WHEN 3 THEN 'unknown_tactic' ELSE 'tactic_without_evidence' END AS errors
FROM (SELECT doc_id, {case_sql(5, 'notes')} AS k FROM documents)""")
def annotation_gate(t: Tables) -> DataFrame:
    rows, k = case(t, 5, "notes")
    tactics = F.when(F.col("k") == 3, F.array(F.lit("urgency"), F.lit("odd"))).otherwise(F.array(F.lit("urgency")))
    shown = F.when(F.col("k") == 3, F.array(F.lit("urgency"), F.lit("odd"))).when(F.col("k") == 4, F.array(F.lit("secrecy"))).otherwise(F.array(F.lit("urgency")))
    made = rows.withColumn("k", k).select(
        "doc_id", F.when(F.col("k") == 1, " ").otherwise("ann").alias("annotator_id"), F.when(F.col("k") == 1, 2).otherwise(1).alias("is_scam"), (F.col("k") == 2).alias("llm_used"),
        tactics.alias("tactics"), F.transform(shown, lambda x: F.struct(x.alias("tactic"))).alias("evidence_spans"),
    )
    return made.select("doc_id", F.array_join(gates.annotation_errors(TACTICS), ",").alias("errors"))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, max((trim(text) = '')::INT) AS blank, length(string_agg({LINE_SQL}, chr(10) ORDER BY turn)) AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 5 THEN 'too_many_turns' WHEN blank = 1 THEN 'empty_turn' WHEN chars > 1500 THEN 'too_long' END AS refused FROM c""")
def request_limits(t: Tables) -> DataFrame:
    return gathered(t, spoken()).select("conv_id", loaders.request_faults(F.col("turns"), 5, 1500).alias("refused"))


@query(f"""SELECT n, fault FROM (SELECT count(*) AS n, CASE k WHEN 1 THEN 'text_missing' WHEN 2 THEN 'bad_label' WHEN 3 THEN 'bad_split' END AS fault FROM (SELECT {case_sql(4, 'form')} AS k FROM documents) GROUP BY k)""")
def load_faults(t: Tables) -> DataFrame:
    """The first fault of each row of a manifest, counted."""
    rows, k = case(t, 4, "form")
    made = rows.withColumn("k", k).select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("k") == 1, "  ").otherwise("x").alias("text"), F.when(F.col("k") == 2, 3).otherwise(1).alias("label"),
        F.when(F.col("k") == 3, "dev").otherwise("train").alias("split"),
    )
    rules = [(loaders.blank("text"), "text_missing"), (~F.col("label").isin(0, 1), "bad_label"), (~F.col("split").isin("train", "validation", "test"), "bad_split")]
    return loaders.with_faults(made, "id", rules).groupBy("fault").agg(F.count("*").alias("n")).select("n", "fault")


@query(f"""SELECT 'project::' || doc_id AS conversation_id, sha256('[ROLE=caller] ' || {flat_sql('text')}) AS text_sha256, coalesce(toxic, 0) AS label,
CASE WHEN toxic = 1 THEN 'project_authored' ELSE 'non_scam' END AS scam_type, lang AS language, CASE WHEN quality = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS sample_weight
FROM documents LEFT JOIN labels USING (doc_id) WHERE trim(text) <> ''""")
def project_examples(t: Tables) -> DataFrame:
    rows = t.documents.where("trim(text) <> ''").join(t.labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("toxic", F.lit(0)).alias("label"), F.lit("train").alias("split"), F.col("lang").alias("language"),
        F.when(F.col("quality") == 1, 2.0).alias("weight"),
    )
    made = loaders.project_examples(rows)
    return made.select("conversation_id", F.sha2("text", 256).alias("text_sha256"), "label", "scam_type", F.col("languages")[0].alias("language"), "sample_weight")


EXTERNAL_SPLIT = "CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END".replace("{u}", "u")


@query(f"""WITH u AS (SELECT *, ('0x' || substr(sha256('content-v1|' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND trim(text) <> '')
SELECT 'external::' || doc_id AS conversation_id, sha256('[ROLE=caller] ' || {flat_sql('text')}) AS text_sha256, toxic AS label, CASE toxic WHEN 1 THEN 'external' ELSE 'non_scam' END AS scam_type,
{EXTERNAL_SPLIT} AS split, source, lang AS language FROM u""")
def external_examples(t: Tables) -> DataFrame:
    """An external set, checked, split by whole sources, as training rows."""
    rows = t.documents.join(t.labels, "doc_id").where("toxic is not null and trim(text) <> ''").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").cast("string").alias("conversation_id"), F.lit(None).cast("string").alias("source_url"), "text",
        F.col("toxic").alias("label"), F.lit("external_evaluation").alias("split"), F.lit(True).alias("pii_redacted"), F.col("lang").alias("language"), F.col("source").alias("source_group"),
        F.lit("granted").alias("rights_basis"),
    )
    made = loaders.external_as_examples(loaders.partition_external(loaders.external_records(rows)), F.col("split"))
    return made.select("conversation_id", F.sha2("text", 256).alias("text_sha256"), "label", "scam_type", "split", "source", F.col("languages")[0].alias("language"))


@query(f"""WITH p AS (SELECT source, lang, {case_sql(3, 'split')} AS k FROM documents) SELECT CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, lang AS language, count(*) AS n FROM p GROUP BY k, lang""")
def partition_counts(t: Tables) -> DataFrame:
    """Rows of each split and language of a partitioned set."""
    rows, k = case(t, 3, "split")
    names = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    return rows.select(F.element_at(names, k + 1).alias("split"), F.col("lang").alias("language")).groupBy("split", "language").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT doc_id, {case_sql(4, 'status')} AS k FROM documents) SELECT doc_id::VARCHAR AS id, CASE k WHEN 0 THEN 'automatic' ELSE 'optional_large' END AS status FROM r
WHERE k = 0 OR k = 1 AND doc_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)""")
def downloads(t: Tables) -> DataFrame:
    """What may be fetched: automatic data sets, and optional ones that were asked for."""
    rows, k = case(t, 4, "status")
    names = F.array(F.lit("automatic"), F.lit("optional_large"), F.lit("manual"), F.lit("gated"))
    made = rows.select(F.col("doc_id").cast("string").alias("id"), F.element_at(names, k + 1).alias("status"))
    return loaders.downloadable(made, [str(i) for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)])


@query(f"SELECT min(doc_id) AS doc_id, sha256({FOLD.format(flat_sql('text'))}) AS transcript_sha256 FROM documents GROUP BY 2")
def distinct_transcripts(t: Tables) -> DataFrame:
    """The first row of equal texts, whatever their case and white space."""
    rows = loaders.distinct_transcripts(t.documents.select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", F.sha2(text.casefold(text.collapse(F.col("text"))), 256).alias("transcript_sha256"))


_PLAIN = "lower(text)"
for _pattern, _mark in text.PLAIN_MASKS:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, sha256({_PLAIN}) AS template FROM documents GROUP BY 2")
def distinct_templates(t: Tables) -> DataFrame:
    """The first row of each masked template."""
    key = F.sha2(text.mask(F.lower("text"), text.PLAIN_MASKS), 256)
    rows = t.documents.select("doc_id", key.alias("template"))
    return loaders.distinct_first(rows, F.col("template"), ["doc_id"])


@query(f"""SELECT doc_id, CASE WHEN k = 0 THEN 'new' ELSE 'old' END AS state, 'documents' AS dataset_id FROM (SELECT doc_id, {case_sql(3, 'receipt')} AS k FROM documents)""")
def receipts(t: Tables) -> DataFrame:
    """Receipts merged by their composite key, the new ones winning."""
    rows, k = case(t, 3, "receipt")
    old = rows.select("doc_id", F.lit("old").alias("state"), F.lit("documents").alias("dataset_id"))
    new = rows.where(k == 0).select("doc_id", F.lit("new").alias("state"), F.lit("documents").alias("dataset_id"))
    return writers.latest(old, new, ["dataset_id", "doc_id"])


@query(f"SELECT doc_id FROM (SELECT doc_id, {case_sql(3, 'known')} AS k FROM documents) WHERE k <> 0")
def unseen_rows(t: Tables) -> DataFrame:
    """Generated rows whose key the table lacks, once per key."""
    rows, k = case(t, 3, "known")
    return writers.append_new(rows.where(k == 0).select("doc_id"), rows.select("doc_id").unionAll(rows.select("doc_id")), "doc_id")


@query("""SELECT original_split, count(DISTINCT conv_id) AS dialogues, count(*) AS turns, count(DISTINCT role) AS services
FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS original_split FROM conversations) GROUP BY original_split""")
def archive_profile(t: Tables) -> DataFrame:
    names = F.array(F.lit("dev"), F.lit("test"), F.lit("train"))
    made = gathered(t, F.col("role")).select(
        F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int")).alias("original_split"), F.array_distinct("turns").alias("services"), "turns", F.col("conv_id").alias("dialogue_id")
    )
    return reports.archive_profile(made)


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, sha256(string_agg({LINE_SQL}, chr(10) ORDER BY turn)) AS h, min(role) AS first FROM conversations GROUP BY conv_id)
SELECT first AS scam_type, count(*) AS n, count(DISTINCT h) AS templates, round(avg(n), 2) AS mean_turns FROM c GROUP BY first""")
def generated_summary(t: Tables) -> DataFrame:
    turn = F.struct("role", text.format_turn(F.col("role"), F.col("text")).alias("line"))
    rows = gathered(t, turn).select(
        F.array_min(F.transform("turns", lambda x: x["role"])).alias("scam_type"), F.sha2(F.array_join(F.transform("turns", lambda x: x["line"]), "\n"), 256).alias("template_sha256"),
        F.size("turns").alias("n_turns"),
    )
    return reports.generated_summary(rows)


@query("SELECT label AS class, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT c, 0 FROM (VALUES (98), (99)) v(c)")
def class_histogram(t: Tables) -> DataFrame:
    """Rows of each class, classes of the manifest without rows as 0."""
    seen = t.embeddings.select(F.col("label").cast("int").alias("class"))
    manifest = t.spark.createDataFrame([(98,), (99,)], "class int").unionByName(seen.distinct())
    return manifest.join(seen.groupBy("class").agg(F.count("*").alias("n")), "class", "left").fillna(0, ["n"])


@query(f"SELECT count(*) FILTER (k = 0) AS passed, count(*) FILTER (k = 1) AS failed, count(*) FILTER (k = 2) AS skipped FROM (SELECT {case_sql(3, 'proof')} AS k FROM documents)")
def verification(t: Tables) -> DataFrame:
    """Digests of texts against those expected: right, wrong, or without a file."""
    rows, k = case(t, 3, "proof")
    path = F.col("doc_id").cast("string").alias("path")
    files = rows.where(k != 2).select(path, F.sha2("text", 256).alias("sha256"))
    expected = rows.select(path, F.when(k == 1, "0").otherwise(F.sha2("text", 256)).alias("expected"))
    return gates.roll_up(gates.digest_checks(files, expected))


@query("SELECT source, negatives::DOUBLE / positives AS weight, least(10, negatives::DOUBLE / positives) AS capped FROM (SELECT source, count(*) FILTER (toxic = 0) AS negatives, count(*) FILTER (toxic = 1) AS positives FROM documents JOIN labels USING (doc_id) GROUP BY source) WHERE positives > 0")
def positive_weights(t: Tables) -> DataFrame:
    """Negatives per positive, and the same held to ten."""
    return sampling.positive_weight(t.documents.join(t.labels, "doc_id").withColumn("label", F.col("toxic")), ["source"], 10.0)


@query(f"""WITH s AS (SELECT i AS id FROM range(300) r(i)) SELECT id, (['bank', 'courier', 'loan'])[id % 3 + 1] AS scenario, sha256('grid' || id) AS rank FROM s""")
def request_grid(t: Tables) -> DataFrame:
    """Scenarios in turn, shuffled by hash."""
    return sampling.request_grid(t.spark, ["bank", "courier", "loan"], ["hi", "en"], 300).select("id", "scenario", "rank")


@query("""SELECT tactic, CASE tactic WHEN 'fear_threat' THEN 'fear_intimidation' WHEN 'urgency' THEN 'urgency_scarcity' WHEN 'secrecy' THEN 'secrecy_instruction'
WHEN 'isolation' THEN 'isolation_instruction' WHEN 'credential_otp_request' THEN 'credential_request' ELSE tactic END AS renamed, count(*) AS n
FROM (SELECT unnest(['fear_threat', 'urgency', 'secrecy', 'isolation', 'credential_otp_request', 'accusation']) AS tactic FROM labels) GROUP BY tactic""")
def renamed_tactics(t: Tables) -> DataFrame:
    names = ["fear_threat", "urgency", "secrecy", "isolation", "credential_otp_request", "accusation"]
    rows = t.labels.select(F.explode(F.array(*(F.lit(x) for x in names))).alias("tactic"))
    return rows.groupBy("tactic").agg(F.count("*").alias("n")).select("tactic", multitask.canonical_tactic(F.col("tactic")).alias("renamed"), "n")


@query(f"""WITH c AS (SELECT conv_id, list({LINE_SQL} ORDER BY turn) FILTER (trim(text) <> '') AS lines, count(*) FILTER (trim(text) <> '') AS n, max(contains(lower(text), 'the')::INT) AS the, max(contains(lower(text), 'die')::INT) AS die FROM conversations GROUP BY conv_id)
SELECT conv_id, conv_id % 2 AS is_scam, [the, die] = [1, 1] AS both_on,
CASE WHEN conv_id % 2 = 0 THEN 1.0 WHEN the = 1 THEN 1.0 WHEN the + die > 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS mask_the,
CASE WHEN conv_id % 2 = 0 THEN 1.0 WHEN die = 1 THEN 1.0 WHEN the + die > 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS mask_die, n AS n_turns FROM c""")
def supervision_masks(t: Tables) -> DataFrame:
    """Tactic labels and masks of a conversation from its turns: negatives are sure, positives
    know what is marked."""
    on = lambda w: F.contains(F.lower("text"), F.lit(w)).cast("int")
    labels = F.struct(F.create_map(F.lit("the"), on("the"), F.lit("die"), on("die")).alias("tactics"), F.lit("none_unknown").alias("stage"))
    turn = F.struct(F.col("role").alias("speaker_role"), F.col("text").alias("raw_text"), F.col("text").alias("normalized_text"), labels.alias("labels"))
    rows = gathered(t, turn).withColumn("records", multitask.turn_records(F.col("turns"), ["the", "die"], STAGES)).withColumn("is_scam", F.col("conv_id") % 2)
    made = rows.withColumn("x", multitask.conversation_labels(F.col("records"), F.col("is_scam"), STAGES, 0.25))
    return made.select(
        "conv_id", "is_scam", (F.col("x.tactic_labels") == F.array(F.lit(1.0), F.lit(1.0))).alias("both_on"), F.col("x.tactic_mask")[0].alias("mask_the"), F.col("x.tactic_mask")[1].alias("mask_die"),
        F.size("records").cast("long").alias("n_turns"),
    )


@query(f"""WITH e AS (SELECT d.doc_id, CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 0 THEN 'non_scam' WHEN lang IN ('en', 'de') THEN 'loan_job' ELSE 'other_scam' END AS scam_type
FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, scam_type FROM e WHERE scam_type IS NOT NULL""")
def multitask_rows(t: Tables) -> DataFrame:
    """Eligible rows for several heads; unknown types of positives become other_scam."""
    rows = t.documents.join(t.labels, "doc_id", "left").where("toxic is not null")
    named = F.when(F.col("lang").isin("en", "de"), "loan_job").otherwise("unheard of")
    return rows.select("doc_id", multitask.known_type(F.col("toxic"), named).alias("scam_type"))


@query("SELECT count(DISTINCT toxic) = 2 AS both FROM labels WHERE toxic IS NOT NULL")
def both_labels(t: Tables) -> DataFrame:
    return t.labels.where("toxic is not null").agg((F.count_distinct("toxic") == 2).alias("both"))


@query(f"""WITH d AS (SELECT doc_id, source, lang, toxic, {unit_sql('doc_id', '17')} AS u FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
k AS (SELECT source, avg(u) AS fpr, avg(toxic) AS recall FROM d GROUP BY source)
SELECT source, fpr <= 0.5 AS fpr_within_cap, recall >= 0.1 AS recall_not_worse, true AS gold_available, CASE WHEN fpr <= 0.5 AND recall >= 0.1 THEN 'eligible' ELSE 'research_only' END AS status FROM k""")
def promotion(t: Tables) -> DataFrame:
    from ..functions.hashing import unit32
    from ..operators.detect import promoted

    rows = t.documents.join(t.labels, "doc_id").where("toxic is not null").withColumn("u", unit32(F.col("doc_id").cast("string"), "17"))
    per = rows.groupBy("source").agg(F.avg("u").alias("fpr"), F.avg("toxic").alias("recall"))
    return per.select("source", promoted(F.col("fpr"), F.col("recall"), F.lit(0.1), F.lit(True), 0.5).alias("p")).select("source", "p.*")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS pattern FROM documents),
c AS (SELECT doc_id, pattern, count(*)::DOUBLE AS c FROM w WHERE pattern NOT IN ('role', 'caller', 'role caller', 'aur', 'hai', 'ko', 'mat', 'se', 'the', 'a', 'an', 'to', 'is', 'are', 'will') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, pattern) AS r FROM c)
SELECT doc_id, array_to_string(list(pattern ORDER BY r), ',') AS patterns FROM r WHERE r <= 8 GROUP BY doc_id""")
def top_patterns(t: Tables) -> DataFrame:
    """The patterns that speak most for a row, by a stand-in contribution: their counts."""
    from ..operators.detect import top_patterns as best

    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0))).alias("pattern"))
    counted = words.groupBy("doc_id", "pattern").agg(F.count("*").cast("double").alias("contribution"))
    return best(counted, "doc_id").select("doc_id", F.array_join("patterns", ",").alias("patterns"))


@query("""SELECT source AS name, sum(n_chars)::DOUBLE AS importance FROM documents GROUP BY source ORDER BY importance DESC, name LIMIT 30""")
def feature_importance(t: Tables) -> DataFrame:
    return reports.by_importance(t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("double").alias("importance")), 30)


@query(f"""WITH {PLACED}, n AS (SELECT conv_id, place, plain FROM placed), m AS (SELECT lang AS backend, {unit_sql('doc_id', 'run')} AS r, {unit_sql('doc_id', 'a')} AS a, {unit_sql('doc_id', 'b')} AS b FROM documents)
SELECT backend, round(avg(a), 6) AS wer, round(avg(b), 6) AS cer, round(median(r), 6) AS runtime_median, round(sum(r), 6) AS runtime_total, round(avg(abs(a - b)), 6) AS shift_abs, round(avg(a - b), 6) AS shift,
round(avg(((a >= 0.5) <> (b >= 0.5))::INT), 6) AS flip_rate FROM m GROUP BY backend""")
def transcript_summary(t: Tables) -> DataFrame:
    from ..functions.hashing import unit32
    from ..operators.metrics import transcript_summary as summary

    key = F.col("doc_id").cast("string")
    a, b = unit32(key, "a"), unit32(key, "b")
    rows = t.documents.select(F.col("lang").alias("backend"), a.alias("wer"), b.alias("cer"), unit32(key, "run").alias("runtime"), a.alias("score"), b.alias("reference_score"), F.lit(0.5).alias("threshold"))
    out = summary(rows)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "backend"})


@query("""SELECT vec_id, round((CASE label WHEN 2 THEN 1.0 ELSE 0.5 END) / (CASE label WHEN 2 THEN 1.0 ELSE 0.5 END + 0.25), 6) AS p2, round(0.25 / (CASE label WHEN 2 THEN 1.0 ELSE 0.5 END + 0.25), 6) AS p5, 0.0::DOUBLE AS p0 FROM embeddings""")
def class_probabilities(t: Tables) -> DataFrame:
    """Probabilities of the classes a fold knew, at their global ids, others 0."""
    from ..operators.ml import class_probabilities as placed

    p = F.array(F.when(F.col("label") == 2, 1.0).otherwise(0.5), F.lit(0.25))
    made = t.embeddings.select("vec_id", p.alias("p")).select("vec_id", placed(F.col("p"), [2, 5], 6).alias("g"))
    return made.select("vec_id", F.round(F.col("g")[2], 6).alias("p2"), F.round(F.col("g")[5], 6).alias("p5"), F.col("g")[0].alias("p0"))


@query(f"""WITH s AS (SELECT doc_id, {unit_sql('doc_id', 'x')} AS a, {unit_sql('doc_id', 'y')} AS b FROM documents)
SELECT doc_id, CASE WHEN b > a THEN 'second' ELSE 'first' END AS label, greatest(a, b) AS probability,
array_to_string(list_filter([CASE WHEN a >= 0.6 THEN 'first' END, CASE WHEN b >= 0.6 THEN 'second' END], lambda x: x IS NOT NULL), ',') AS marked FROM s""")
def head_outputs(t: Tables) -> DataFrame:
    """A single-label head, a head of several labels with a threshold, an absent one."""
    from ..functions.hashing import unit32
    from ..operators.ml import head_outputs as heads

    key = F.col("doc_id").cast("string")
    p = F.array(unit32(key, "x"), unit32(key, "y"))
    none = F.lit(None).cast("array<double>")
    made = heads({"kind": (F.col("p"), ["first", "second"], None), "marks": (F.col("p"), ["first", "second"], 0.6), "gone": (none, ["x"], None)})
    rows = t.documents.select("doc_id", p.alias("p")).select("doc_id", made.alias("h")).where("h.gone is null")
    return rows.select("doc_id", "h.kind.label", "h.kind.probability", F.array_join(F.transform("h.marks", lambda m: m["label"]), ",").alias("marked"))


@query(f"""WITH c AS (SELECT doc_id, source, sha256('cap|' || doc_id) AS h, n_chars FROM documents),
s AS (SELECT *, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM c)
SELECT doc_id, source, upto FROM s WHERE upto <= 20000""")
def capped_chunks(t: Tables) -> DataFrame:
    """Chunks of an upload that fit a running size cap."""
    return loaders.within_cap(t.documents.select("doc_id", "source", (F.col("n_chars") + 1).alias("bytes")), ["source"], "doc_id", "bytes", 20_000).select("doc_id", "source", "upto")


_LEAKS = [(r"\+?91[\s-]?[6-9][0-9]{4}[\s-]?[0-9]{5}", "[REDACTED_PHONE]"), (r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "[REDACTED_ID]"), (r"\b[\w.\-]+@[\w\-]{2,}\b", "[REDACTED_HANDLE]"), (r"\b[0-9]{9,18}\b", "[REDACTED_ACCOUNT]")]
_LEAK_SQL = "text"
for _pattern, _mark in _LEAKS:
    _LEAK_SQL = f"regexp_replace({_LEAK_SQL}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT doc_id, sha256({_LEAK_SQL}) AS redacted_sha256 FROM documents WHERE NOT contains(text, '@invalid')")
def redacted_output(t: Tables) -> DataFrame:
    from ..streaming.handoff import redact_output

    return t.documents.where(~F.contains("text", F.lit("@invalid"))).select("doc_id", F.sha2(redact_output(F.col("text"), []), 256).alias("redacted_sha256"))


@query("SELECT conv_id, turn, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT conv_id, turn, greatest(1e-6, least(1 - 1e-6, " + unit_sql("conv_id || '/' || turn", "p") + ")) AS p FROM conversations)")
def logits(t: Tables) -> DataFrame:
    from ..functions.hashing import unit32
    from ..functions.numeric import logit

    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return t.conversations.select("conv_id", "turn", F.round(logit(unit32(key, "p")), 6).alias("logit"))


_WORD = r"[\p{L}\p{N}_]"


def _hits_sql(pattern: str) -> str:
    """Matches of a pattern, counted. Word boundaries are consumed; as neighbours share one, every
    other character is written twice."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    if inner == pattern:
        return f"len(regexp_extract_all(low, {quoted(pattern)}))"
    return "len(regexp_extract_all(wide, " + quoted(f"(?:^|[^{_WORD[1:-1]}])(?:{inner.replace(' ', ' +')})(?:[^{_WORD[1:-1]}]|$)") + "))"


_HITS = {k: " + ".join(map(_hits_sql, ps)) for k, ps in signals.LEXICAL_TACTICS.items()}
_STEPS = [["authority_impersonation"], ["accusation"], ["fear_threat", "urgency"], ["isolation", "secrecy", "surveillance_control"], ["financial_demand", "credential_otp_request"]]
_PROGRESS = "greatest(0.0, " + ", ".join(f"CASE WHEN {' OR '.join(f'{n} > 0' for n in names)} THEN {i + 1}::DOUBLE / 6 ELSE 0.0 END" for i, names in enumerate(_STEPS)) + ")"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '([^{_WORD[1:-1]}])', '\\1\\1', 'g') AS wide FROM documents),
h AS (SELECT doc_id, {', '.join(f'({v})::BIGINT AS {k}' for k, v in _HITS.items())} FROM d) SELECT *, {_PROGRESS}::DOUBLE AS stage_progress FROM h""")
def lexical_tactics(t: Tables) -> DataFrame:
    """Word-bounded hits and the stage they tell."""
    counted = t.documents.select("doc_id", *(v.cast("long").alias(k) for k, v in signals.lexical_hits(F.col("text")).items()))
    return counted.withColumn("stage_progress", signals.stage_progress({k: F.col(k) for k in signals.LEXICAL_TACTICS}))


@query(f"""SELECT doc_id, {flat_sql('text')} <> '' AND regexp_matches(lower(text), '(^|[^a-z0-9_])(?:the|die)([^a-z0-9_]|$)') AS kept, CASE WHEN toxic IS NULL THEN 'missing_binary_label'
WHEN trim(text) = '' THEN 'empty_text' END AS reason, CASE WHEN lang = 'en' THEN 0.5 ELSE 1.0 END::DOUBLE AS sample_weight FROM documents LEFT JOIN labels USING (doc_id)""")
def training_weights(t: Tables) -> DataFrame:
    """Provenance weights with their default, beside the reason that keeps a row out."""
    rows = t.documents.join(t.labels, "doc_id", "left")
    reason = views.first_reason([(F.col("toxic").isNull(), "missing_binary_label"), (F.trim("text") == "", "empty_text")])
    kept = (text.collapse(F.col("text")) != "") & F.lower("text").rlike("(^|[^a-z0-9_])(?:the|die)([^a-z0-9_]|$)")
    return rows.select("doc_id", kept.alias("kept"), reason.alias("reason"), views.provenance_weight(F.col("lang"), {"en": 0.5}).alias("sample_weight"))
