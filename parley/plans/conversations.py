"""Queries over conversations and raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities, hashing, signals, text
from ..operators import dedup, gates, metrics, sequence, views
from ..storage import materialize
from .registry import Tables, query

LINE_SQL = r"'[ROLE=' || replace(lower(trim(role)), ' ', '_') || '] ' || trim(regexp_replace(text, '\s+', ' ', 'g'))"
UNIT_SQL = "(('0x' || substr(sha256('{salt}|' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def unit_sql(key: str, salt: str) -> str:
    return UNIT_SQL.format(salt=salt, key=key)


def line() -> Column:
    return text.format_turn(F.col("role"), F.col("text"))


@query(f"SELECT conv_id, turn, {LINE_SQL} AS line FROM conversations")
def turn_format(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", line().alias("line"))


@query(f"SELECT conv_id, count(*) AS n_turns, string_agg({LINE_SQL}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conv_text(t: Tables) -> DataFrame:
    return sequence.conversation_texts(t.conversations, line())


@query("SELECT conv_id, sha256(string_agg(role || ':' || lower(text), chr(10) ORDER BY turn)) AS exact_sha256 FROM conversations GROUP BY conv_id")
def exact_fingerprint(t: Tables) -> DataFrame:
    said = sequence.conversation_texts(t.conversations, text.transcript_line(F.col("role"), F.lower("text")))
    return said.select("conv_id", F.sha2("text", 256).alias("exact_sha256"))


PLAIN_SQL = "lower(text)"
for _pattern, _mark in text.PLAIN_MASKS:
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT doc_id, sha256({PLAIN_SQL}) AS template_sha256 FROM documents")
def template_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.mask(F.lower("text"), text.PLAIN_MASKS), 256).alias("template_sha256"))


@query("SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY text) <> doc_id THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents")
def exact_dedup_first(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.first_of_equals(rows, F.col("h"), "doc_id").select("doc_id", "duplicate_of")


@query("SELECT doc_id, 'documents:' || substr(sha256('documents|' || doc_id), 1, 20) AS stable_id FROM documents")
def stable_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.stable_id("documents", F.col("doc_id").cast("string")).alias("stable_id"))


SPLIT_SQL = f"""CASE WHEN {unit_sql("conv_id", "split")} < 0.7 THEN 'train' WHEN {unit_sql("conv_id", "split")} < 0.85 THEN 'validation' ELSE 'test' END"""


def split_of(key: Column, salt: str = "split") -> Column:
    at = hashing.unit32(key.cast("string"), salt)
    return F.when(at < 0.7, "train").when(at < 0.85, "validation").otherwise("test")


@query(f"SELECT DISTINCT conv_id, {SPLIT_SQL} AS split FROM conversations")
def hash_split(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().withColumn("split", split_of(F.col("conv_id")))


SIMHASH_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_]+') AS w FROM documents),
features AS (
  SELECT doc_id, unnest(w) AS f FROM words UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words WHERE len(w) > 1),
counted AS (SELECT doc_id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT doc_id, n, ('0x' || substr(sha256(f), 1, 16))::UBIGINT AS h FROM counted),
bits AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM hashed, range(64) r(b) GROUP BY doc_id, b),
prints AS (SELECT doc_id, sum(CASE WHEN v >= 0 THEN 1::HUGEINT << b ELSE 0 END)::UBIGINT AS fp FROM bits GROUP BY doc_id),
every AS (SELECT d.doc_id, coalesce(fp, 18446744073709551615) AS fp, d.source FROM documents d LEFT JOIN prints p USING (doc_id))
"""


def doc_prints(t: Tables) -> DataFrame:
    ascii_words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z_]+"), F.lit(0)), " ")
    return t.documents.select(F.col("doc_id").alias("id"), "source", dedup.simhash64(ascii_words).alias("fp"))


@query(SIMHASH_SQL + "SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS simhash FROM every")
def simhash64(t: Tables) -> DataFrame:
    return doc_prints(t).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("simhash"))


PAIRS_SQL = SIMHASH_SQL + """,
reps AS (SELECT source, fp, min(doc_id) AS id FROM every GROUP BY source, fp),
pairs AS (SELECT l.id AS a, r.id AS b, bit_count(xor(l.fp, r.fp))::INT AS distance FROM reps l JOIN reps r
          ON l.source IS NOT DISTINCT FROM r.source AND l.id < r.id WHERE bit_count(xor(l.fp, r.fp)) <= 6)
"""


@query(PAIRS_SQL + "SELECT a, b, distance FROM pairs")
def near_dup_pairs(t: Tables) -> DataFrame:
    return dedup.near_pairs(doc_prints(t), ["source"])


GROUPS_SQL = PAIRS_SQL.replace("WITH words", "WITH RECURSIVE words", 1) + """,
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT id, id AS root FROM reps UNION SELECT l.a, r.root FROM links l JOIN reach r ON r.id = l.b),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
grouped AS (SELECT e.doc_id AS id, x.root FROM every e JOIN reps USING (source, fp) JOIN least x ON x.id = reps.id)
"""


@query(GROUPS_SQL + "SELECT id, root FROM grouped")
def dup_components(t: Tables) -> DataFrame:
    prints = materialize(doc_prints(t), "prints")
    return dedup.groups_of(prints, dedup.near_links(prints, ["source"]), ["source"])


@query(GROUPS_SQL + "SELECT root, count(*) AS n, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)) AS group_id FROM grouped GROUP BY root")
def group_ids(t: Tables) -> DataFrame:
    return dedup.group_hash(dup_components(t))


SPLIT_GROUP_SQL = f"""CASE WHEN {unit_sql("root", "split")} < 0.7 THEN 'train' WHEN {unit_sql("root", "split")} < 0.85 THEN 'validation' ELSE 'test' END"""


@query(GROUPS_SQL + f""", placed AS (SELECT {SPLIT_GROUP_SQL} AS split, d.source, l.toxic AS label FROM grouped g
JOIN documents d ON d.doc_id = g.id LEFT JOIN labels l ON l.doc_id = g.id)
SELECT split, source, label, count(*) AS n FROM placed GROUP BY GROUPING SETS ((split, source), (split, label))""")
def split_breakdown(t: Tables) -> DataFrame:
    placed = dup_components(t).withColumn("split", split_of(F.col("root")))
    rows = placed.join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id").join(t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), "id", "left")
    return dedup.split_breakdown(rows)


@query(f"""WITH g AS (SELECT doc_id, sha256(text) AS group_id,
CASE WHEN {unit_sql("doc_id", "split")} < 0.7 THEN 'train' WHEN {unit_sql("doc_id", "split")} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT group_id, count(DISTINCT split) AS splits FROM g GROUP BY group_id HAVING count(DISTINCT split) > 1""")
def split_leakage(t: Tables) -> DataFrame:
    return dedup.leaking_groups(t.documents.select(F.sha2("text", 256).alias("group_id"), split_of(F.col("doc_id")).alias("split")))


PREFIX_SQL = f"""
p AS (SELECT conv_id, turn, role, count(*) OVER w AS size, string_agg({LINE_SQL}, chr(10)) OVER w AS prefix FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, {unit_sql("prefix", "17")} AS score FROM p)
"""


def scored_prefixes(t: Tables) -> DataFrame:
    return sequence.prefixes(t.conversations, line()).withColumn("score", hashing.unit32(F.col("prefix"), "17"))


@query(f"WITH {PREFIX_SQL} SELECT conv_id, turn, size, sha256(prefix) AS prefix_sha256, score FROM s")
def prefix_texts(t: Tables) -> DataFrame:
    return scored_prefixes(t).select("conv_id", "turn", "size", F.sha2("prefix", 256).alias("prefix_sha256"), "score")


STABLE_SQL = f"""WITH {PREFIX_SQL},
m AS (SELECT *, count(*) FILTER (role IN ('caller', 'scammer', 'fraudster', 'user')) OVER (PARTITION BY conv_id ORDER BY size ROWS UNBOUNDED PRECEDING) AS calls,
  score >= 0.7 AND min(score) OVER (PARTITION BY conv_id ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 0.56 AS stable FROM s),
f AS (SELECT conv_id, count(*) AS n_turns, min(CASE WHEN stable THEN size END) AS stable_turn FROM m GROUP BY conv_id),
found AS (SELECT f.conv_id, f.n_turns, f.stable_turn, CASE WHEN m.calls > 0 THEN m.calls ELSE f.stable_turn END AS caller_turn
          FROM f LEFT JOIN m ON m.conv_id = f.conv_id AND m.size = f.stable_turn)
"""


@query(STABLE_SQL + "SELECT * FROM found")
def stable_detection(t: Tables) -> DataFrame:
    return sequence.stable_turn(scored_prefixes(t), 0.7, 0.56)


@query(STABLE_SQL + """SELECT count(*) AS n, count(stable_turn) AS detected, avg((stable_turn IS NULL)::INT) AS undetected_rate,
median(stable_turn)::DOUBLE AS median_turn, min(stable_turn) AS min_turn, max(stable_turn) AS max_turn FROM found""")
def detection_summary(t: Tables) -> DataFrame:
    return sequence.detection_summary(stable_detection(t))


@query(f"""WITH {PREFIX_SQL},
r AS (SELECT conv_id, size, score >= 0.7 AS hit, count(*) OVER w AS n, min(CASE WHEN score >= 0.7 THEN size END) OVER w AS first FROM s WINDOW w AS (PARTITION BY conv_id)),
a AS (SELECT r.*, fraction FROM r, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(fraction) WHERE size = greatest(1, ceil(n * fraction)))
SELECT fraction, count(*) AS n, avg(coalesce(first <= size, false)::INT) AS latched_rate, avg(hit::INT) AS point_rate FROM a GROUP BY fraction""")
def early_detection(t: Tables) -> DataFrame:
    return sequence.early_detection(scored_prefixes(t), 0.7)


@query(f"""WITH {PREFIX_SQL} SELECT conv_id, count(*) AS n_turns, min(CASE WHEN score >= 0.7 THEN size END) AS first_turn,
min(CASE WHEN score >= 0.7 THEN size END)::DOUBLE / count(*) AS first_fraction FROM s GROUP BY conv_id""")
def first_detection(t: Tables) -> DataFrame:
    return sequence.first_detection(scored_prefixes(t), 0.7)


@query(f"""WITH c AS (SELECT conv_id, list({LINE_SQL} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, l, greatest(1, ceil(len(l) * f))::INT AS size FROM c, (VALUES (0.25::DOUBLE), (0.5), (1.0)) v(f))
SELECT conv_id, size, array_to_string(l[1:size], chr(10)) AS text FROM w""")
def prefix_windows(t: Tables) -> DataFrame:
    return sequence.prefix_windows(t.conversations, line())


@query("SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) WHERE turn <> place")
def turn_contiguity(t: Tables) -> DataFrame:
    return sequence.gaps(t.conversations)


TACTIC_SQL = ", ".join(f"max(CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)})' for w in ws)} THEN 1 END)::INT AS {k}" for k, ws in signals.WEAK_TACTICS.items())


@query(f"WITH c AS (SELECT conv_id, lower(text) AS low FROM conversations) SELECT conv_id, {TACTIC_SQL} FROM c GROUP BY conv_id")
def tactic_flags(t: Tables) -> DataFrame:
    tactics = signals.weak_tactics(F.col("text"))
    flat = t.conversations.select("conv_id", *(tactics[k].alias(k) for k in signals.WEAK_TACTICS))
    return flat.groupBy("conv_id").agg(*(F.max(k).alias(k) for k in signals.WEAK_TACTICS))


STAGE_SQL = """CASE WHEN financial_demand = 1 OR credential_otp_request = 1 THEN 'payment_extraction'
WHEN isolation = 1 OR secrecy = 1 OR surveillance_control = 1 THEN 'isolation_control' WHEN fear_threat = 1 THEN 'threat'
WHEN accusation = 1 THEN 'accusation' WHEN authority_impersonation = 1 THEN 'authority_claim' WHEN turn = 0 THEN 'contact' ELSE 'none_unknown' END"""


@query(f"WITH c AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), f AS (SELECT conv_id, turn, {TACTIC_SQL} FROM c GROUP BY conv_id, turn) SELECT conv_id, turn, {STAGE_SQL} AS stage FROM f")
def turn_stages(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", signals.weak_stage(signals.weak_tactics(F.col("text")), F.col("turn")).alias("stage"))


@query(f"""WITH c AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), f AS (SELECT conv_id, turn, {TACTIC_SQL} FROM c GROUP BY conv_id, turn),
s AS (SELECT *, {STAGE_SQL} AS stage FROM f),
o AS (SELECT *, list_position(['contact','authority_claim','accusation','threat','isolation_control','payment_extraction','post_payment'], stage) AS r FROM s)
SELECT conv_id, turn, count(*) OVER w AS size, max(urgency) OVER w AS urgency, max(financial_demand) OVER w AS financial_demand,
(['contact','authority_claim','accusation','threat','isolation_control','payment_extraction','post_payment'])[max(CASE WHEN r > 0 THEN r END) OVER w] AS stage
FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def prefix_labels(t: Tables) -> DataFrame:
    from ..schema import STAGES

    tactics = signals.weak_tactics(F.col("text"))
    turns = t.conversations.select("conv_id", "turn", tactics["urgency"].alias("urgency"), tactics["financial_demand"].alias("financial_demand"), signals.weak_stage(tactics, F.col("turn")).alias("stage"))
    return sequence.prefix_labels(turns, ["urgency", "financial_demand"], STAGES[:-1])


_TYPE_CASES = []
for _words, _kind in signals.TYPE_RULES:
    _any = " OR ".join(f"contains(low, '{w}')" for w in _words)
    _value = "CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in signals.TAKEOVER_WORDS) + f" THEN 'otp_account_takeover' ELSE '{_kind}' END" if _kind == "fake_kyc_bank" else f"'{_kind}'"
    _TYPE_CASES.append(f"WHEN {_any} THEN {_value}")


@query(f"SELECT doc_id, CASE {' '.join(_TYPE_CASES)} ELSE 'other_scam' END AS scam_type FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def scam_types(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", signals.scam_type(F.col("text")).alias("scam_type"))


@query()
def entity_spans(t: Tables) -> DataFrame:
    """Every entity with offsets, redacted; greedy overlap has no SQL form."""
    found = t.documents.select("doc_id", F.explode(entities.public_view(entities.extract(F.col("text")))).alias("e"))
    return found.select("doc_id", "e.*")


@query()
def entity_counts(t: Tables) -> DataFrame:
    found = t.documents.select(F.explode(F.transform(entities.extract(F.col("text")), lambda e: e["entity_type"])).alias("entity_type"))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"))


@query()
def risk_features(t: Tables) -> DataFrame:
    hits = {k: v.alias(f"_{k}") for k, v in signals.lexical_hits(F.col("text")).items()}
    found = t.documents.select("doc_id", "text", entities.extract(F.col("text")).alias("e"), *hits.values())
    row = signals.risk_features(F.col("text"), hashing.unit32(F.col("doc_id").cast("string"), "17"), F.col("e"), {k: F.col(f"_{k}") for k in hits})
    return found.select("doc_id", *(v.alias(k) for k, v in row.items()))


EMAIL, URL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", r"https?://[^ \n\t]+", r"\+[0-9]+ \([0-9]+\) [0-9]+-[0-9]+"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS emails, len(regexp_extract_all(text, '{URL}')) AS urls, len(regexp_extract_all(text, '{PHONE.replace(chr(92), chr(92))}')) AS phones FROM documents")
def email_url_entities(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n(EMAIL).alias("emails"), n(URL).alias("urls"), n(PHONE).alias("phones"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{URL}', '[URL]', 'g'), '{EMAIL}', '[EMAIL]', 'g')) AS redacted_sha256 FROM documents")
def redacted_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.mask(F.col("text"), [(URL, "[URL]"), (EMAIL, "[EMAIL]")]), 256).alias("redacted_sha256"))


# DuckDB's edit distance counts bytes, so letters beyond ASCII are written as control characters
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßàäçèéêíñóôöûü"
_MARKS = " || ".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 14 + len(_LETTERS) - 10)])
_BYTES = f"translate(text, '{_LETTERS}', {_MARKS})"


@query(f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, {_BYTES} AS x FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN trim(a.x) = '' AND trim(b.x) = '' THEN 0.0 WHEN trim(a.x) = '' THEN 1.0 ELSE levenshtein(a.x, b.x)::DOUBLE / a.n END AS cer
FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def cer(t: Tables) -> DataFrame:
    """Character error rate of a turn against the next."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("ref"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", metrics.edit_rates(a, "ref", "hyp")["cer"].alias("cer"))


@query()
def wer(t: Tables) -> DataFrame:
    """Word error rate of a turn against the next; words have no edit distance in SQL."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("ref"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", metrics.edit_rates(a, "ref", "hyp")["wer"].alias("wer"))


@query("SELECT item_id FROM benchmark WHERE sha256(lower(text)) IN (SELECT sha256(lower(text)) FROM documents)")
def benchmark_leakage(t: Tables) -> DataFrame:
    key = F.sha2(F.lower("text"), 256)
    return gates.leaks(t.benchmark, t.documents, key, key).select("item_id")


@query("SELECT DISTINCT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages")
def url_hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host")).distinct()


@query("""SELECT doc_id FROM documents
WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(?:token|password|license|card|payment|loan)([^A-Za-z0-9_]|$)')""")
def keyword_overlap(t: Tables) -> DataFrame:
    return t.documents.where(views.ascii_overlap(F.col("text"), "token|password|license|card|payment|loan")).select("doc_id")
