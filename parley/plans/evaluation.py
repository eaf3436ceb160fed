"""Queries over labelled, scored rows: documents with labels and a hash score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.numeric import wilson
from ..operators import gates, loaders, metrics, reports, sampling, thresholds, views
from .conversations import unit_sql
from .registry import Tables, query

SEEDS = ("17", "42", "93")


def score(key: Column, label: Column, salt: str) -> Column:
    """A stand-in for a model's score in thousandths: hash noise moved by the label."""
    return F.floor((hashing.unit32(key.cast("string"), salt) * 0.7 + label * 0.3) * 1000) / 1000


def scored(t: Tables, salt: str = "17") -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").where("toxic is not null")
    return rows.select("doc_id", "source", "lang", "text", F.col("toxic").alias("label"), "quality", score(F.col("doc_id"), F.col("toxic"), salt).alias("score"))


def seeded(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").where("toxic is not null").select("doc_id", "source", F.col("toxic").alias("label"))
    each = F.array(*(F.struct(F.lit(s).alias("seed"), score(F.col("doc_id"), F.col("label"), s).alias("score")) for s in SEEDS))
    return rows.select("*", F.explode(each).alias("x")).select("doc_id", "source", "label", "x.seed", "x.score")


def _score_sql(salt: str) -> str:
    return f"floor(({unit_sql('doc_id', salt)} * 0.7 + toxic * 0.3) * 1000) / 1000"


SCORED = f"""scored AS (SELECT doc_id, source, lang, text, toxic AS label, quality, {_score_sql('17')} AS score
FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"""
SEEDED = "seeded AS (" + " UNION ALL ".join(f"SELECT doc_id, source, toxic AS label, '{s}' AS seed, {_score_sql(s)} AS score FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL" for s in SEEDS) + ")"
CONFUSION = """count(*) AS n, count(*) FILTER (label = 1 AND score >= {t}) AS tp, count(*) FILTER (label = 0 AND score >= {t}) AS fp,
count(*) FILTER (label = 1 AND score < {t}) AS fn, count(*) FILTER (label = 0 AND score < {t}) AS tn"""


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


def f_sql(p: str, r: str, b2: int) -> str:
    return div(f"{1 + b2}::DOUBLE * {p} * {r}", f"({b2}::DOUBLE * {p} + {r})")


P, R, S, NP = div("tp", "(tp + fp)"), div("tp", "(tp + fn)"), div("tn", "(tn + fp)"), div("tn", "(tn + fn)")
RATES = f"""{div('tp + tn', '(tp + fp + fn + tn)')} AS accuracy, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ({R} + {S}) / 2 END AS balanced_accuracy,
{P} AS "precision", {R} AS recall, {S} AS specificity, {div('fp', '(fp + tn)')} AS fpr, {f_sql(P, R, 1)} AS f1, ({f_sql(P, R, 1)} + {f_sql(NP, S, 1)}) / 2 AS macro_f1,
{f_sql(P, R, 4)} AS f2, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN {div('tp::DOUBLE * tn - fp::DOUBLE * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} END AS mcc"""
COLUMNS = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "fpr", "f1", "macro_f1", "f2", "mcc"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


def round_sql(names: list[str], source: str, keep: str = "") -> str:
    return f"SELECT {keep}{', ' if keep else ''}{', '.join(f'round({chr(34)}{c}{chr(34)}, 6) AS {chr(34)}{c}{chr(34)}' for c in names)} FROM ({source})"


@query(f"WITH {SCORED}, c AS (SELECT {CONFUSION.format(t='0.5')}, avg((score - label) * (score - label)) AS brier FROM scored), m AS (SELECT *, {RATES} FROM c) " + round_sql(["brier", *COLUMNS], "SELECT * FROM m", "n, tp, fp, fn, tn"))
def binary_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.binary_metrics(scored(t), 0.5), "brier", *COLUMNS)


GROUPED = ["mean_score", "precision", "recall", "fpr", "f1"]


@query(f"""WITH {SCORED}, g AS (
SELECT 'source' AS kind, source AS value, {CONFUSION.format(t='0.5')}, avg(score) AS mean_score FROM scored GROUP BY source UNION ALL
SELECT 'language', lang, {CONFUSION.format(t='0.5')}, avg(score) FROM scored GROUP BY lang UNION ALL
SELECT 'all', 'all', {CONFUSION.format(t='0.5')}, avg(score) FROM scored UNION ALL
SELECT 'type', lang, {CONFUSION.format(t='0.5')}, avg(score) FROM scored WHERE label = 1 GROUP BY lang), m AS (SELECT *, {RATES} FROM g) """ + round_sql(GROUPED, "SELECT * FROM m", "kind, value, n, tp, fp, fn, tn"))
def metrics_by_group(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("languages", F.array("lang")).withColumn("kind_of", F.col("lang"))
    return rounded(metrics.grouped_metrics(rows, 0.5), *GROUPED)


@query(f"""WITH {SCORED}, r AS (SELECT *, count(*) FILTER (label = 0) OVER (PARTITION BY source ORDER BY score RANGE UNBOUNDED PRECEDING)
 - 0.5 * count(*) FILTER (label = 0) OVER (PARTITION BY source, score) AS below FROM scored)
SELECT source, round(sum(below) FILTER (label = 1) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6)::DOUBLE AS roc_auc FROM r GROUP BY source""")
def roc_auc(t: Tables) -> DataFrame:
    return rounded(metrics.roc_auc(scored(t), ["source"]), "roc_auc")


@query(f"""WITH {SCORED}, s AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY score),
c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p * (tp::DOUBLE / seen)) / nullif(sum(p), 0), 6)::DOUBLE AS pr_auc FROM c""")
def pr_auc(t: Tables) -> DataFrame:
    return rounded(metrics.average_precision(scored(t)), "pr_auc")


@query(f"WITH {SCORED} SELECT source, round(avg((score - label) * (score - label)), 6) AS brier FROM scored GROUP BY source")
def brier(t: Tables) -> DataFrame:
    return rounded(scored(t).groupBy("source").agg(metrics.brier()), "brier")


@query(f"""WITH {SCORED}, c AS (SELECT score FROM scored UNION SELECT 0.0 UNION SELECT 1.0),
s AS (SELECT c.score AS threshold, count(*) FILTER (label = 1 AND x.score >= c.score) AS tp, count(*) FILTER (label = 0 AND x.score >= c.score) AS fp,
count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM c, scored x GROUP BY c.score),
m AS (SELECT threshold, tp, fp, {div('tp', '(tp + fp)')} AS "precision", {div('tp', 'p')} AS recall, {div('fp', 'n')} AS fpr FROM s)
SELECT threshold, tp, fp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM m WHERE fpr <= 0.05
ORDER BY m.recall DESC, m."precision" DESC, m.fpr, threshold LIMIT 1""")
def threshold_at_fpr(t: Tables) -> DataFrame:
    return rounded(thresholds.at_fpr(scored(t), 0.05), "precision", "recall", "fpr")


def _grid_sql(grid: str, f: str, order: str, columns: str) -> str:
    return f"""WITH {SCORED}, g AS ({grid}), s AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1) AS p FROM g, scored GROUP BY threshold),
m AS (SELECT threshold, tp, fp, {div('tp', '(tp + fp)')} AS pr, {div('tp', 'p')} AS re FROM s), k AS (SELECT *, {f} AS f FROM m)
SELECT {columns} FROM k ORDER BY {order} LIMIT 1"""


@query(_grid_sql("SELECT round(0.01 + i * (0.98 / 196), 6) AS threshold FROM range(197) r(i)", f_sql("pr", "re", 4), "(pr >= 0.3) DESC, round(f, 12) DESC, re DESC, pr DESC, threshold",
                 'threshold, tp, fp, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f, pr >= 0.3 AS satisfied'))
def threshold_fbeta(t: Tables) -> DataFrame:
    return rounded(thresholds.by_f_beta(scored(t), 2, 0.3), "precision", "recall", "f")


@query(_grid_sql("SELECT DISTINCT unnest([0.0, 0.5, 1.0] || quantile_cont(score, list_transform(range(201), lambda i: i / 200.0))) AS threshold FROM scored", f_sql("pr", "re", 1),
                 "round(f, 12) DESC, pr DESC, re DESC, threshold DESC", 'round(threshold, 6) AS threshold, tp, fp, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1'))
def threshold_f1(t: Tables) -> DataFrame:
    return rounded(thresholds.by_f1(scored(t)), "threshold", "precision", "recall", "f1")


@query(f"""WITH {SEEDED}, n AS (SELECT seed, source, score, row_number() OVER (PARTITION BY seed, source ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY seed, source) AS n
FROM seeded WHERE label = 0), b AS (SELECT seed, source, score FROM n WHERE n >= 10 AND k = floor(0.05 * n + 1e-12) + 1)
SELECT max(score) AS bound, count(*) AS groups FROM b""")
def shared_threshold(t: Tables) -> DataFrame:
    return thresholds.shared_bound(seeded(t), 0.05, 10, ["seed", "source"])


PER_SEED = f"""{SEEDED}, c AS (SELECT seed, source, {CONFUSION.format(t='0.5')} FROM seeded GROUP BY seed, source),
per AS (SELECT *, {R} AS recall, {div('fp', '(fp + tn)')} AS fpr FROM c)"""


def per_seed(t: Tables) -> DataFrame:
    return metrics.binary_metrics(seeded(t), 0.5, ["seed", "source"])


@query(f"WITH {PER_SEED} SELECT source, count(recall) AS n, round(avg(recall), 6) AS mean, round(coalesce(stddev_samp(recall), 0), 6) AS sd, round(min(recall), 6) AS low, round(max(recall), 6) AS high FROM per GROUP BY source")
def seed_summary(t: Tables) -> DataFrame:
    return rounded(metrics.seed_summary(per_seed(t), "recall", ["source"]), "mean", "sd", "low", "high")


@query(f"""WITH {PER_SEED}, s AS (SELECT seed, avg(recall) AS recall, avg(fpr) AS fpr, max(fpr) AS worst FROM per GROUP BY seed)
SELECT round(avg(recall), 6) AS recall_mean, round(coalesce(stddev_samp(recall), 0), 6) AS recall_sd, round(avg(fpr), 6) AS fpr_mean, round(max(worst), 6) AS worst_fpr FROM s""")
def source_macro(t: Tables) -> DataFrame:
    return rounded(metrics.source_macro(per_seed(t)), "recall_mean", "recall_sd", "fpr_mean", "worst_fpr")


Z2 = 1.959963984540054**2
_W = "(fp::DOUBLE / nullif(negatives, 0))"
_MID = f"({_W} + {Z2} / (2 * negatives)) / (1 + {Z2} / negatives)"
_HALF = f"1.959963984540054 * sqrt({_W} * (1 - {_W}) / negatives + {Z2} / (4.0 * negatives * negatives)) / (1 + {Z2} / negatives)"


@query(f"""WITH {PER_SEED}, f AS (SELECT source, avg(recall) AS recall_mean, stddev_pop(recall) AS recall_sd, avg(fpr) AS fpr_mean, stddev_pop(fpr) AS fpr_sd,
sum(fp)::BIGINT AS fp, sum(fp + tn)::BIGINT AS negatives FROM per GROUP BY source)
SELECT source, round(recall_mean, 6) AS recall_mean, round(recall_sd, 6) AS recall_sd, round(fpr_mean, 6) AS fpr_mean, round(fpr_sd, 6) AS fpr_sd, fp, negatives,
round(greatest(0, {_MID} - {_HALF}), 6) AS fpr_low, round(least(1, {_MID} + {_HALF}), 6) AS fpr_high, negatives >= 20 AS sufficient FROM f""")
def fold_summary(t: Tables) -> DataFrame:
    return rounded(metrics.fold_summary(per_seed(t), 20), "recall_mean", "recall_sd", "fpr_mean", "fpr_sd", "fpr_low", "fpr_high")


@query(f"""WITH {SEEDED}, f AS (SELECT source, seed, count(*) FILTER (score >= 0.5) AS hits, count(*) AS n FROM seeded WHERE label = 0 GROUP BY source, seed),
g AS (SELECT source, round_even(avg(hits), 0)::BIGINT AS fp, max(n) AS negatives FROM f GROUP BY source)
SELECT source, fp, negatives, round({_W}, 6) AS fpr, round(greatest(0, {_MID} - {_HALF}), 6) AS low, round(least(1, {_MID} + {_HALF}), 6) AS high FROM g""")
def wilson_fpr(t: Tables) -> DataFrame:
    per = seeded(t).where("label = 0").groupBy("source", "seed").agg(F.count_if(F.col("score") >= 0.5).alias("hits"), F.count("*").alias("n"))
    g = per.groupBy("source").agg(F.bround(F.avg("hits")).cast("long").alias("fp"), F.max("n").alias("negatives"))
    low, high = wilson(F.col("fp"), F.col("negatives"))
    return rounded(g.select("source", "fp", "negatives", (F.col("fp") / F.col("negatives")).alias("fpr"), low.alias("low"), high.alias("high")), "fpr", "low", "high")


@query(f"WITH {SCORED} SELECT source, count(*) AS n, min(score) AS low, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, max(score) AS high FROM scored GROUP BY source")
def score_quantiles(t: Tables) -> DataFrame:
    return rounded(metrics.score_quantiles(scored(t), ["source"]), "p25", "median", "p75")


@query(f"""WITH {SEEDED} SELECT doc_id, round(avg(score), 6) AS score FROM seeded GROUP BY doc_id""")
def mean_seed_scores(t: Tables) -> DataFrame:
    return rounded(seeded(t).groupBy("doc_id").agg(F.avg("score").alias("score")), "score")


@query(f"""WITH {SCORED}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY label), k AS (SELECT sum(n) AS a, count(*) AS k FROM c)
SELECT doc_id, round(greatest(0.5, least(3.0, sqrt(a::DOUBLE / (k * n)))), 6) AS weight FROM scored JOIN c USING (label), k""")
def class_weights(t: Tables) -> DataFrame:
    return rounded(sampling.class_weights(scored(t), "label", F.lit(1.0), 3.0).select("doc_id", "weight"), "weight")


@query(f"""WITH {SCORED}, c AS (SELECT source, label, count(*) AS cell FROM scored GROUP BY source, label), l AS (SELECT label, count(*) AS s FROM c GROUP BY label),
k AS (SELECT sum(cell) AS n, count(DISTINCT label) AS ls FROM c)
SELECT doc_id, round(n::DOUBLE / (ls * s * cell), 6) AS weight FROM scored JOIN c USING (source, label) JOIN l USING (label), k""")
def cell_weights(t: Tables) -> DataFrame:
    return rounded(sampling.cell_weights(scored(t)).select("doc_id", "weight"), "weight")


ROWS = "eligible AS (SELECT d.doc_id, d.source, d.lang, d.text, l.toxic AS label, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
WORDS = "token|password|license|card|payment|loan"


@query(f"""WITH {ROWS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN 'missing_binary_label' WHEN quality = 0 THEN 'not_training_eligible'
WHEN lang NOT IN ('en', 'de', 'fr') THEN 'disallowed_provenance' WHEN trim(text) = '' THEN 'empty_text' END AS reason FROM eligible) GROUP BY reason""")
def eligibility_reasons(t: Tables) -> DataFrame:
    rules = [
        (F.col("toxic").isNull(), "missing_binary_label"), (F.col("quality") == 0, "not_training_eligible"),
        (~F.col("lang").isin("en", "de", "fr"), "disallowed_provenance"), (F.trim("text") == "", "empty_text"),
    ]
    rows = t.documents.join(t.labels, "doc_id", "left").select(views.first_reason(rules).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


OVERLAP = f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(?:{WORDS})([^A-Za-z0-9_]|$)')"


@query(f"WITH {SCORED} SELECT doc_id, label = 0 AND {OVERLAP} AS hard_negative, label = 1 OR {OVERLAP} AS is_primary FROM scored")
def primary_view(t: Tables) -> DataFrame:
    return views.with_primary(scored(t), views.ascii_overlap(F.col("text"), WORDS)).select("doc_id", "hard_negative", "is_primary")


COUNTS = "n AS (SELECT source, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM scored GROUP BY source)"


@query(f"WITH {SCORED}, {COUNTS} SELECT * FROM n")
def source_label_counts(t: Tables) -> DataFrame:
    return views.label_counts(scored(t))


@query(f"WITH {SCORED}, {COUNTS} SELECT * FROM n WHERE least(n0, n1) >= 5")
def mixed_sources(t: Tables) -> DataFrame:
    return views.mixed_sources(scored(t), 5)


@query(f"WITH {SCORED}, {COUNTS}, a AS (SELECT sum(n0 + n1) AS t, sum(n1) AS p FROM n) SELECT source AS held_out, (t - n0 - n1)::BIGINT AS train_rows, (p - n1)::BIGINT AS train_pos, n0 + n1 AS test_rows, n1 AS test_pos FROM n, a WHERE least(n0, n1) >= 5")
def loso_folds(t: Tables) -> DataFrame:
    return views.held_out_folds(scored(t), 5)


@query(f"WITH {SCORED}, {COUNTS} SELECT source, n0 AS n FROM n WHERE n1 = 0 AND n0 > 0")
def unseen_sources(t: Tables) -> DataFrame:
    return views.unseen_sources(scored(t))


@query(f"WITH {SCORED} SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rank FROM scored) WHERE rank <= 10")
def stable_first_n(t: Tables) -> DataFrame:
    return sampling.first_n(scored(t), "doc_id", 10, ["source"]).select("doc_id", "source", "rank")


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, source, label, sha256('calibration|' || doc_id) AS h, count(*) OVER (PARTITION BY source, label) AS n,
row_number() OVER (PARTITION BY source, label ORDER BY sha256('calibration|' || doc_id), doc_id) AS k FROM scored)
SELECT doc_id, CASE WHEN n = 1 THEN CASE WHEN ('0x' || substr(h, 64, 1))::INT % 2 = 0 THEN 'calibration' ELSE 'threshold' END
WHEN k <= greatest(1, least(n - 1, round_even(n * 0.5, 0))) THEN 'calibration' ELSE 'threshold' END AS part FROM r""")
def calibration_halves(t: Tables) -> DataFrame:
    return sampling.halves(scored(t), "doc_id", ["source", "label"]).select("doc_id", "part")


@query(f"""WITH {SCORED}, p AS (SELECT source, count(*) FILTER (label = 1) AS pos FROM scored GROUP BY source),
k AS (SELECT doc_id, source, pos, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS k FROM scored JOIN p USING (source) WHERE label = 0),
m AS (SELECT doc_id FROM k WHERE pos > 0 AND k <= ceil(pos * 1.0)),
need AS (SELECT greatest(0, (SELECT ceil(count(*) * 2.0) FROM scored WHERE label = 1) - (SELECT count(*) FROM m)) AS need),
o AS (SELECT doc_id, row_number() OVER (ORDER BY k, source) AS i FROM k WHERE pos = 0)
SELECT doc_id FROM scored WHERE label = 1 UNION ALL SELECT doc_id FROM m UNION ALL SELECT doc_id FROM o, need WHERE i <= need""")
def balanced_negatives(t: Tables) -> DataFrame:
    return sampling.balanced_negatives(scored(t), "doc_id", 1.0, 2.0).select("doc_id")


@query("""WITH g AS (SELECT label AS truth, (label + vec_id % 3 % 2)::INT % 10 AS predicted FROM embeddings),
c AS (SELECT i::INT AS class FROM range(12) r(i)), s AS (SELECT class, (SELECT count(*) FROM g WHERE truth = class) AS support,
(SELECT count(*) FROM g WHERE truth = class AND predicted = class) AS tp, (SELECT count(*) FROM g WHERE predicted = class) AS said FROM c)
SELECT class, support, round(CASE WHEN said = 0 THEN 0 ELSE tp::DOUBLE / said END, 6) AS "precision", round(CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END, 6) AS recall,
round(CASE WHEN said + support = 0 THEN 0 ELSE 2.0 * tp / (said + support) END, 6)::DOUBLE AS f1 FROM s""")
def multiclass_report(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("truth"), ((F.col("label") + F.col("vec_id") % 3 % 2).cast("int") % 10).alias("predicted"))
    classes = t.spark.range(12).select(F.col("id").cast("int").alias("class"))
    return rounded(metrics.multiclass_report(rows, classes), "precision", "recall", "f1")


@query("""SELECT 'doc_id' AS column_name, count(doc_id) AS n, count(DISTINCT doc_id) AS n_distinct FROM documents UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang) FROM documents
UNION ALL SELECT 'source', count(source), count(DISTINCT source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars), count(DISTINCT n_chars) FROM documents""")
def column_profile(t: Tables) -> DataFrame:
    return gates.column_profile(t.documents.select("doc_id", "lang", "source", "n_chars"))


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 30")
def value_counts(t: Tables) -> DataFrame:
    return gates.value_counts(t.documents, "source")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = l.doc_id)")
def orphans(t: Tables) -> DataFrame:
    """Labels whose id no conversation has."""
    return gates.orphans(t.labels, t.conversations.select(F.col("conv_id").alias("doc_id")), "doc_id").select("doc_id")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def label_orphans(t: Tables) -> DataFrame:
    """Labels of no document."""
    return gates.orphans(t.labels, t.documents, "doc_id").select("doc_id")


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = 0)")
def turn_orphans(t: Tables) -> DataFrame:
    """Turns of a conversation that has no opening turn."""
    return gates.orphans(t.conversations, t.conversations.where("turn = 0"), "conv_id").select("conv_id", "turn")


@query("""SELECT doc_id, 'left' AS only_in FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)""")
def set_checks(t: Tables) -> DataFrame:
    return gates.set_difference(t.documents.select("doc_id"), t.labels.select("doc_id"))


ANNOTATORS = ("a", "b", "c")


@query(f"""WITH a AS (SELECT doc_id, who, toxic, quality * (({unit_sql("doc_id || who", "notes")} < 0.9)::INT) AS answer FROM labels, (VALUES ('a'), ('b'), ('c')) v(who)
WHERE {unit_sql("doc_id || who", "present")} < 0.7), j AS (SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')),
p AS (SELECT doc_id, count(DISTINCT who) AS annotators, count(DISTINCT toxic || '/' || answer) AS answers FROM a GROUP BY doc_id)
SELECT p.doc_id, annotators, answers, CASE WHEN annotators < 2 THEN 'needs_annotators' WHEN answers = 1 THEN 'agreed' WHEN j.doc_id IS NOT NULL THEN 'adjudicated'
ELSE 'needs_adjudication' END AS status FROM p LEFT JOIN j USING (doc_id)""")
def annotation_consensus(t: Tables) -> DataFrame:
    each = t.labels.withColumn("who", F.explode(F.array(*(F.lit(x) for x in ANNOTATORS))))
    key = F.concat(F.col("doc_id").cast("string"), F.col("who"))
    notes = each.where(hashing.unit32(key, "present") < 0.7).withColumn("answer", F.col("quality") * (hashing.unit32(key, "notes") < 0.9).cast("int"))
    return gates.consensus(notes, t.labels.join(t.documents.where("lang in ('en', 'fr')"), "doc_id"), "doc_id", "who", ["toxic", "answer"])


@query("""WITH q(lang, wanted) AS (VALUES ('en', 300), ('de', 300), ('fr', 300), ('es', 300), ('hi', 10)), h AS (SELECT lang, count(*) AS have FROM documents GROUP BY lang)
SELECT q.lang, wanted, coalesce(have, 0) AS have, wanted - coalesce(have, 0) AS missing FROM q LEFT JOIN h USING (lang) WHERE coalesce(have, 0) < wanted""")
def quota_gaps(t: Tables) -> DataFrame:
    quotas = t.spark.createDataFrame([("en", 300), ("de", 300), ("fr", 300), ("es", 300), ("hi", 10)], "lang string, wanted int")
    return gates.quota_gaps(t.documents, quotas, "lang").select("lang", "wanted", "have", "missing")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS actual, CASE WHEN json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') <> '1' THEN 'failed' ELSE 'passed' END AS status FROM events""")
def json_checks(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("props").alias("payload"), F.lit("$.k").alias("path"), F.lit("1").alias("expected"))
    return gates.json_checks(rows).select("event_id", "actual", "status")


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM scored")
def describe_pool(t: Tables) -> DataFrame:
    return reports.pool(scored(t))


def _split_sql(key: str, salt: str, train: float, validation: float) -> str:
    u = unit_sql(key, salt)
    return f"CASE WHEN {u} < {train} THEN 'train' WHEN {u} < {validation} THEN 'validation' ELSE 'test' END"


@query(f"""WITH {SCORED}, g AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test')) s(split), (VALUES (0), (1)) l(label)),
c AS (SELECT {_split_sql('doc_id', 'split', 0.7, 0.85)} AS split, label, count(*) AS n FROM scored GROUP BY ALL)
SELECT split, label, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (split, label)""")
def split_label_counts(t: Tables) -> DataFrame:
    from .conversations import split_of

    return reports.split_label_counts(scored(t).withColumn("split", split_of(F.col("doc_id"))))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages),
u AS (SELECT page_id, ('0x' || substr(sha256('content-v1|' || host), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM p)
SELECT page_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM u""")
def source_partition(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("source_url"), F.col("page_id").cast("string").alias("conversation_id"))
    return loaders.partition_external(rows).select("page_id", "split")


@query(f"""WITH {SCORED} SELECT source, count(*) FILTER (label = 1 AND quality > 0) AS positives FROM scored GROUP BY source HAVING count(*) FILTER (label = 1 AND quality > 0) >= 2""")
def support_gate(t: Tables) -> DataFrame:
    return reports.supported(scored(t).withColumn("mask", F.col("quality")), "source", 2)


@query(f"""WITH {SCORED}, m AS (SELECT * FROM scored WHERE quality = 1),
c AS (SELECT lang, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM m GROUP BY lang),
s AS (SELECT lang, score, sum(label) AS p, count(*) AS n FROM m GROUP BY lang, score),
k AS (SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT lang, round(sum(p * (tp::DOUBLE / seen)) / nullif(sum(p), 0), 6)::DOUBLE AS pr_auc FROM k GROUP BY lang)
SELECT lang, round({div('tp', '(tp + fp)')}, 6) AS "precision", round({div('tp', '(tp + fn)')}, 6) AS recall,
round({f_sql(div('tp', '(tp + fp)'), div('tp', '(tp + fn)'), 1)}, 6) AS f1, pr_auc FROM c JOIN a USING (lang)""")
def supervised_metrics(t: Tables) -> DataFrame:
    return rounded(reports.supervised_metrics(scored(t).withColumn("mask", F.col("quality")), "lang"), "precision", "recall", "f1", "pr_auc")


@query(f"""WITH {SCORED} SELECT lang AS language, count(*) AS n, round(avg(CASE WHEN (score >= 0.5)::INT = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((lang), ())""")
def suite_accuracy(t: Tables) -> DataFrame:
    rows = scored(t).select(F.col("lang").alias("language"), F.col("label").alias("expected"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return rounded(reports.suite_accuracy(rows), "accuracy")


@query(f"""WITH {SCORED}, l AS (SELECT * FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(doc_id::VARCHAR), doc_id) AS k FROM scored) WHERE k <= 15) SELECT doc_id, label FROM l""")
def capped_halves(t: Tables) -> DataFrame:
    return sampling.capped_halves(scored(t), "doc_id", 30).select("doc_id", "label")


@query(f"""WITH m AS (SELECT doc_id::VARCHAR AS conversation_id, {_split_sql('doc_id', 'split', 0.7, 0.85)} AS a, {_split_sql('doc_id', 'split', 0.7, 0.8)} AS b FROM documents)
SELECT conversation_id, a AS manifest_split, CASE WHEN doc_i IS NOT NULL THEN b END AS listed_split FROM (SELECT *, CASE WHEN conversation_id::BIGINT IN (SELECT doc_id FROM labels) THEN 1 END AS doc_i FROM m)
WHERE a IS DISTINCT FROM CASE WHEN doc_i IS NOT NULL THEN b END""")
def manifest_agreement(t: Tables) -> DataFrame:
    """A manifest against lists that were cut elsewhere and hold labelled ids only."""
    at = hashing.unit32(F.col("doc_id").cast("string"), "split")
    cut = lambda top: F.when(at < 0.7, "train").when(at < top, "validation").otherwise("test")
    key = F.col("doc_id").cast("string").alias("conversation_id")
    return reports.manifest_agreement(t.documents.select(key, cut(0.85).alias("split")), t.labels.select("doc_id").distinct().select(key, cut(0.8).alias("split")))


@query("""SELECT o_orderpriority AS name, o_orderkey AS conversation_id, o_totalprice AS score FROM
(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def best_row(t: Tables) -> DataFrame:
    """The best row of each group by a composite key, without a sort of the group."""
    order = F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))
    best = t.orders.groupBy("o_orderpriority").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), order).alias("x"))
    return best.select(F.col("o_orderpriority").alias("name"), F.col("x.o_orderkey").alias("conversation_id"), F.col("x.o_totalprice").alias("score"))
