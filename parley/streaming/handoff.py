"""Hand-off events and sessions: signing, freshness, replays, the gate, session budgets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import hmac_sha256
from ..operators.joins import null_safe

# fixed values: what is signed, in order (the decision is part of it)
SIGNED = ["event_id", "conversation_id", "issued_at", "scam_score", "threshold", "detector_status", "production_eligible", "decision_source", "is_scam"]
STALE_S, AHEAD_S = 300, 60


@dataclass(frozen=True)
class Policy:
    enabled: bool = False
    research_mode: bool = False
    require_production_eligible: bool = True
    minimum_scam_score: float = 0.0
    maximum_turns: int = 20
    maximum_session_seconds: int = 1800


def payload() -> Column:
    """The signed fields as one line, numbers with six decimals and times in microseconds."""

    def shown(c: str) -> Column:
        if c == "issued_at":
            return F.unix_micros(F.col(c)).cast("string")
        return F.format_string("%.6f", F.col(c)) if c in ("scam_score", "threshold") else F.col(c).cast("string")

    return F.to_json(F.struct(*(shown(c).alias(c) for c in sorted(SIGNED))))


def sign(df: DataFrame, secret: str) -> DataFrame:
    return df.withColumn("signature", hmac_sha256(payload(), secret))


def micros(t: Column) -> Column:
    """Microseconds of a time with or without a zone; one without counts in the session's."""
    return F.unix_micros(t.cast("timestamp"))


def freshness(issued: Column, now: Column) -> Column:
    age = (micros(now) - micros(issued)) / 1e6
    return F.when(issued.isNull(), "bad_time").when(age > STALE_S, "stale").when(age < -AHEAD_S, "future").otherwise("fresh")


def verify(df: DataFrame, secret: str, now: Column) -> DataFrame:
    """Adds `rejected`: unsigned, forged, bad_time, stale or future; null if the event holds."""
    given, state = F.col("signature"), freshness(F.col("issued_at"), now)
    reason = (
        F.when(F.coalesce(given, F.lit("")) == "", "unsigned").when(given != hmac_sha256(payload(), secret), "forged")
        .when(state != "fresh", state)
    )
    return df.withColumn("rejected", reason)


def gate(policy: Policy) -> Column:
    """Struct allowed, mode, reason: may an engagement start? Refusal unless all agrees."""
    row = lambda ok, mode, why: F.struct(F.lit(ok).alias("allowed"), F.lit(mode).alias("mode"), F.lit(why).cast("string").alias("reason"))
    out = F.when(~F.coalesce(F.col("is_scam"), F.lit(False)), row(False, "blocked", "detector_did_not_flag_scam"))
    out = out.when(F.coalesce(F.col("scam_score"), F.lit(0.0)) < policy.minimum_scam_score, row(False, "blocked", "scam_score_below_minimum"))
    if not policy.enabled:
        last = row(True, "research_only", "operator_enabled_research_mode") if policy.research_mode else row(False, "blocked", "honeypot_disabled_by_policy")
        return out.otherwise(last)
    if policy.require_production_eligible:
        unready = row(True, "research_only", "detector_not_promoted_research_mode") if policy.research_mode else row(False, "blocked", "detector_is_research_only")
        out = out.when(~F.coalesce(F.col("production_eligible"), F.lit(False)), unready)
    return out.otherwise(row(True, "live", None))


def recommendation(decision: Column, eligible: Column, enabled: bool) -> Column:
    """Struct handoff, blocked_reason of a detection."""
    reason = F.when(~decision, "detector_did_not_cross_threshold").when(~eligible, "detector_is_research_only")
    reason = reason if enabled else reason.otherwise("handoff_disabled_by_policy")
    return F.struct(reason.isNull().alias("handoff"), reason.alias("blocked_reason"))


def admitted(events: DataFrame, secret: str, policy: Policy, now: Column | None = None) -> DataFrame:
    """A stream (or table) of signed events to those that may open a session: verified, once per
    event id, through the gate. Late events are rejected, not waited for."""
    checked = verify(events, secret, F.current_timestamp() if now is None else now).where("rejected is null").drop("rejected")
    if events.isStreaming:
        once = checked.withWatermark("issued_at", f"{STALE_S + AHEAD_S} seconds").dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = checked.dropDuplicates(["event_id"])
    return once.withColumn("gate", gate(policy)).where("gate.allowed")


STATE = "turns int, started long, closed boolean"
ANSWER = "conversation_id string, turn int, answered boolean, reason string"


def sessions(turns: DataFrame, policy: Policy) -> DataFrame:
    """Each turn of a streamed session (conversation_id, at, disengage) with whether it is
    answered: not after the turn budget, the time budget or a disengaged turn. Rows of a batch
    are taken in time order; the state is three numbers per session and goes when the session's
    time is over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, started, closed = state.get if state.exists else (0, -1, False)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, leave in zip(rows["at"], rows["disengage"]):
            now = int(at.timestamp())
            started = now if started < 0 else started
            reason = None
            if closed:
                reason = "disengaged"
            elif done >= policy.maximum_turns:
                reason = "maximum_turns_reached"
            elif now - started > policy.maximum_session_seconds:
                reason = "maximum_session_time_reached"
            done += reason is None
            closed = closed or bool(leave)
            out.append((key[0], done, reason is None, reason))
        state.update((done, started, closed))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (started + 2 * policy.maximum_session_seconds) * 1000))
        yield pd.DataFrame(out, columns=["conversation_id", "turn", "answered", "reason"])

    timed = turns.withWatermark("at", "10 minutes")
    return timed.groupBy("conversation_id").applyInPandasWithState(step, ANSWER, STATE, "append", GroupStateTimeout.EventTimeTimeout)


LATCH_STATE = "size int, fired_at int"
LATCH = "conversation_id string, turn int, size int, latched boolean"


def latched(turns: DataFrame, threshold: float, idle_s: int | None = None) -> DataFrame:
    """A stream of scored turns (conversation_id, turn, score) with a decision that stays once
    a score has reached the threshold. With `idle_s` a conversation's state goes when no turn has
    come for so many seconds of processing time, as a stream that never ends needs; a run over
    what is there now (availableNow) would wait for such timeouts for ever, so it has none."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, fired = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        out = []
        for turn, score in zip(rows["turn"], rows["score"]):
            size += 1
            fired = size if fired < 0 and score >= threshold else fired
            out.append((key[0], int(turn), size, fired > 0))
        state.update((size, fired))
        if idle_s is not None:
            state.setTimeoutDuration(idle_s * 1000)
        yield pd.DataFrame(out, columns=["conversation_id", "turn", "size", "latched"])

    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("conversation_id").applyInPandasWithState(step, LATCH, LATCH_STATE, "append", timeout)


def append_unseen(batch: DataFrame, path: str, key: str) -> None:
    """A foreachBatch sink that appends rows whose key the table lacks; a replayed batch adds
    nothing."""
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    known = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    new = batch.dropDuplicates([key])
    if known:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)


def user_sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Sessions of a user: events at most the gap apart. Order is found within a user's days and
    carried over the days, so a user with a third of all events is no single task."""
    day = ["user_id", "_day"]
    w = W.partitionBy(*day).orderBy("ts", "event_id")
    over_days = W.partitionBy("user_id").orderBy("_day")
    placed = events.withColumn("_day", F.to_date("ts"))
    days = placed.groupBy(*day).agg(F.max("ts").alias("_last")).select(*day, F.lag("_last").over(over_days).alias("_before"))
    joined = null_safe(placed, days, day)
    gap = micros(F.col("ts")) - micros(F.coalesce(F.lag("ts").over(w), F.col("_before")))
    marked = joined.withColumn("_new", F.coalesce((gap > gap_s * 1_000_000).cast("int"), F.lit(1))).withColumn("_own", F.sum("_new").over(w))
    starts = marked.groupBy(*day).agg(F.sum("_new").alias("_starts"))
    earlier = F.sum("_starts").over(over_days.rowsBetween(W.unboundedPreceding, -1))
    bases = starts.select(*day, F.coalesce(earlier, F.lit(0)).alias("_base"))
    numbered = null_safe(marked, bases, day).withColumn("session", F.col("_base") + F.col("_own"))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def identity_check(digits: Column, multiply: list[list[int]], permute: list[list[int]]) -> Column:
    """Verhoeff's checksum of a digit string, from the last digit on."""
    table = lambda rows: F.array(*(F.array(*(F.lit(x) for x in r)) for r in rows))
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    at = F.transform(d, lambda x, i: F.element_at(F.element_at(table(permute), (i % 8 + 1).cast("int")), x + 1))
    return F.aggregate(at, F.lit(0), lambda a, x: F.element_at(F.element_at(table(multiply), a + 1), x + 1))


def dihedral_tables() -> tuple[list[list[int]], list[list[int]]]:
    """Verhoeff's tables from their rules: the dihedral group of the pentagon, and the powers of
    its permutation."""
    multiply = [[(a + b) % 5 + 5 * (b > 4) if a < 5 and b < 5 else ((a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5) for b in range(10)] for a in range(10)]
    base, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        rows.append([base[x] for x in rows[-1]])
    return multiply, rows


def synthetic_identity(name: Column, seed: Column) -> Column:
    """Struct phone, identity, account, upi: made from the seed's digest and false by their own
    rules (an area code that cannot be given out, a wrong check digit, a reserved account, an
    address that goes nowhere)."""
    multiply, permute = dihedral_tables()
    digits = F.rpad(F.regexp_replace(F.sha2(seed, 256), "[^0-9]", ""), 24, "7")
    part = lambda a, b: F.substring(digits, a + 1, b - a)
    wrong = (identity_check(F.concat(part(0, 11), F.lit("0")), multiply, permute) + 5) % 10
    return F.struct(
        F.concat(F.lit("+91 0"), part(0, 4), F.lit(" "), part(4, 9)).alias("phone"),
        F.concat(part(0, 4), F.lit(" "), part(4, 8), F.lit(" "), part(8, 11), wrong.cast("string")).alias("identity"),
        F.concat(F.lit("0000"), part(11, 17)).alias("account"),
        F.concat(F.lower(F.element_at(F.split(name, " "), 1)), F.lit("."), part(17, 21), F.lit("@invalid")).alias("upi"),
    )


def redact_output(text: Column, allowed: list[str]) -> Column:
    """Text with identifiers masked, but for the allowed ones."""
    # fixed values: patterns of identifiers and what stands for them, in order
    leaks = [
        (r"\+?91[\s-]?[6-9]\d{4}[\s-]?\d{5}", "[REDACTED_PHONE]"),
        (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[REDACTED_ID]"),
        (r"\b[\w.\-]+@(?!invalid\b)[\w\-]{2,}\b", "[REDACTED_HANDLE]"),
        (r"\b\d{9,18}\b", "[REDACTED_ACCOUNT]"),
    ]
    for i, v in enumerate(allowed):
        text = F.replace(text, F.lit(v), F.lit(f"\x00ALLOWED{chr(65 + i)}\x00"))
    for pattern, mark in leaks:
        text = F.regexp_replace(text, "(?U)" + pattern, mark)
    for i, v in enumerate(allowed):
        text = F.replace(text, F.lit(f"\x00ALLOWED{chr(65 + i)}\x00"), F.lit(v))
    return text
