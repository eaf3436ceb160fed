"""Secret scans with multipart credential linking, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

# fixed values: the patterns of the base kinds and of the parts that count only in company.
# kind: (pattern, group that must be long, its least length, cheap test before the scan)
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4, 12, r"(?i)password|passwd|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]+", 2, 18, "AKIA"),
    "hex": (r"[0-9a-f]+", 2, 16, r"[0-9a-f]{16}"),
}
WEAK = {
    "weak_id": (r"""(?i:(access_?key_?id|client_?id|username|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 4, 3, r"(?i)access_?key|client_?id|user|login|account"),
    "weak_secret": (r"""(?i:(pwd|pass|auth|credential|private_?key|secret|token|password))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4, 6, r"(?i)pwd|pass|auth|credential|private_?key|secret|token"),
    "endpoint": (r"""(?i:https?)://([A-Za-z0-9._~:/?#@!&*+,;=%-]+)""", 3, 4, r"(?i)https?://"),
}
KINDS = [*BASE, *WEAK]
CLASSES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}


def found(text: Column, kind: str) -> Column:
    """Array of (gap, length, value length) of the leftmost non-overlapping matches. Each search
    starts where the last match ended and nowhere else, so a tail without matches is read once."""
    pattern, group, _, test = (BASE | WEAK)[kind]
    whole = F.lit(rf"\G(?s)(.*?)({pattern})")
    each = lambda g: F.regexp_extract_all(text, whole, F.lit(g))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    parts = F.arrays_zip(lengths(each(1)).alias("gap"), lengths(each(2)).alias("n"), lengths(each(group)).alias("v"))
    return F.when(text.rlike(test), parts)


def part_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row_id and doc_id of every row; row_id, kind, first, end of every match
    whose value is long enough. Positions are running sums over a row's matches of a kind, in
    code points, end exclusive. Texts are read once and do not move."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = materialize(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), *(found(text, k).alias(k) for k in KINDS)), "matches"
    )
    long = None
    for k in KINDS:
        one = hits.where(F.size(k) > 0).select("row_id", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m"))
        long = one if long is None else long.unionByName(one)
    least = F.create_map(*(F.lit(x) for k in KINDS for x in (k, (BASE | WEAK)[k][2])))
    spans = long.selectExpr(
        "row_id", "kind", "m.v as v", "m.n as n",
        "sum(m.gap + m.n) over (partition by row_id, kind order by i) as end",
    ).where(F.col("v") >= least[F.col("kind")]).selectExpr("row_id", "kind", "end - n as first", "end")
    return hits.select("row_id", "doc_id"), spans


def linked_weak(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans with complementary parts in scope: an identifier needs a secret, a secret
    an identifier, an endpoint both. A part is in scope if it starts within `scope` characters
    before the candidate's start to `scope` after its end.

    The interval join meets on (row, scope-wide bucket); partners come as the least and greatest
    start of each class per bucket, so a candidate meets a few rows however dense the text is.
    """
    kind_of = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    parts = spans.withColumn("class", kind_of[F.col("kind")])
    partners = (
        parts.where("class <> 'endpoint'").withColumn("bucket", F.expr(f"first div {scope}"))
        .groupBy("row_id", "bucket", "class").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    )
    weak = parts.where(F.col("kind").isin(list(WEAK))).withColumn("bucket", F.explode(F.expr(f"sequence((first - {scope}) div {scope} - 1, (end + {scope}) div {scope})")))
    met = (
        weak.join(partners.withColumnRenamed("class", "other"), ["row_id", "bucket"])
        .where(f"other <> class and low <= end + {scope} and high >= first - {scope}")
        .groupBy("row_id", "kind", "class", "first", "end")
        .agg(F.max(F.expr("other = 'id'")).alias("an_id"), F.max(F.expr("other = 'secret'")).alias("a_secret"))
    )
    return met.where("(class = 'id' and a_secret) or (class = 'secret' and an_id) or (class = 'endpoint' and an_id and a_secret)").select("row_id", "kind", "first", "end")


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans read kind:start:end, by start, then kind in the order of KINDS. Base kinds are always
    reported; weak parts only when complementary parts co-occur (see linked_weak). Null and
    empty texts have no spans; repeated rows and rows without a doc_id get a row each; an empty
    table gives an empty result.
    """
    rows, spans = part_spans(docs)
    spans = materialize(spans, "spans")
    every = spans.where(F.col("kind").isin(list(BASE))).unionByName(linked_weak(spans, scope))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    told = every.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("first", order[F.col("kind")].alias("rank"), "end", "kind"))).alias("s"))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["end"].cast("string"))), ",")
    s = F.coalesce(F.col("s"), F.expr("array()").cast("array<struct<first:bigint,rank:int,end:bigint,kind:string>>"))
    number = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return rows.join(told, "row_id", "left").select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in BASE),
        F.sha2(line(F.filter(s, lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        line(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["rank"] >= len(BASE))).cast("long").alias("n_linked"),
    )
