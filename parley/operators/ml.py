"""Text classifiers with pyspark.ml: features, linear and boosted models, calibration, folds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizer, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logit
from .metrics import roc_auc
from .sampling import with_rank


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of words padded with a blank on both sides, within words only."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def of_size(n: int) -> Column:
        starts = lambda w: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1))
        return F.flatten(F.transform(padded, lambda w: F.transform(starts(w), lambda i: F.substr(w, i, F.lit(n)))))

    return F.concat(*map(of_size, sizes))


def tfidf_stages(vocabulary: int = 80_000, least_docs: int = 2, most_share: float = 0.995) -> list:
    """Counts of words, word pairs and character n-grams. Inverse document frequencies are fitted
    by fit_tfidf, as MLlib's own lacks the smoothing term."""
    counter = lambda name: CountVectorizer(inputCol=name, outputCol=f"{name}_tf", vocabSize=vocabulary, minDF=least_docs, maxDF=most_share)
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"), counter("words"), counter("pairs"), counter("chars"),
    ]


def fit_tfidf(df: DataFrame, vocabulary: int = 80_000) -> Callable[[DataFrame], DataFrame]:
    """A transform that adds `features`: sublinear term frequency times smoothed inverse document
    frequency, unit length. The frequencies held by the driver are as long as the vocabulary."""
    prepared = df.withColumn("chars", char_ngrams(F.col("text")))
    counts = Pipeline(stages=tfidf_stages(vocabulary)).fit(prepared)
    assemble = VectorAssembler(inputCols=["words_tf", "pairs_tf", "chars_tf"], outputCol="tf")
    tf = assemble.transform(counts.transform(prepared))
    n = tf.count()
    width = tf.first()["tf"].size

    @F.udf("array<int>")
    def places(v):
        return [int(i) for i in v.indices]

    df_rows = tf.select(F.explode(places("tf")).alias("i")).groupBy("i").count().collect()
    idf = [0.0] * width
    for r in df_rows:
        idf[r["i"]] = math.log((1 + n) / (1 + r["count"])) + 1

    @F.udf(VectorUDT())
    def weigh(v):
        return Vectors.sparse(v.size, [int(i) for i in v.indices], [(1 + math.log(x)) * idf[int(i)] for i, x in zip(v.indices, v.values)])

    unit = Normalizer(inputCol="raw", outputCol="features", p=2.0)

    def transform(rows: DataFrame) -> DataFrame:
        ready = assemble.transform(counts.transform(rows.withColumn("chars", char_ngrams(F.col("text")))))
        out = unit.transform(ready.withColumn("raw", weigh("tf")))
        return out.drop("words", "pairs", "chars", "words_tf", "pairs_tf", "chars_tf", "tf", "raw")

    return transform


def linear(weight: str | None = None) -> LogisticRegression:
    model = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=0.05, regParam=1e-4, maxIter=50)
    return model.setWeightCol(weight) if weight else model


def boosted(features: str = "features", rounds: int = 20) -> GBTClassifier:
    return GBTClassifier(featuresCol=features, labelCol="label", maxIter=rounds, maxDepth=4, seed=42)


def per_class(base) -> OneVsRest:
    return OneVsRest(classifier=base, featuresCol="features", labelCol="label")


def positive_score(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_run(spark, path: str, model: PipelineModel | None, tables: dict[str, DataFrame], facts: dict) -> None:
    """A training run: the model, its tables, and the facts about it (settings, threshold,
    metrics) as one JSON row with the versions that made it."""
    import json
    import platform

    if model is not None:
        save_model(model, f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    told = json.dumps(facts | {"spark": spark.version, "python": platform.python_version()}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def platt(df: DataFrame, score: str = "score") -> Callable[[Column], Column]:
    """Logistic regression on the logit, with the penalty of C = 1; gives an expression."""
    rows = df.select(F.col("label").cast("double").alias("label"), logit(F.col(score)).alias("x"))
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    n = ready.count()
    m = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False).fit(ready)
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda s: 1 / (1 + F.exp(-(F.lit(a) * logit(s) + F.lit(b))))


def isotonic(df: DataFrame, score: str = "score"):
    rows = df.select(F.col("label").cast("double").alias("label"), F.col(score).alias("features"))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)


def calibrated_isotonic(model, df: DataFrame, score: str = "score") -> DataFrame:
    """Adds `calibrated`; scores outside the fitted range take its ends."""
    out = model.transform(df.withColumn("features", F.col(score)))
    return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("features", "prediction")


def with_folds(df: DataFrame, key: str, folds: int = 5, label: str = "label") -> DataFrame:
    """A fold by hash rank within each label, so that every fold has its share of each."""
    ranked = with_rank(df, key, [label], "fold|", "_k")
    return ranked.withColumn("fold", F.pmod(F.col("_k"), F.lit(folds)).cast("int")).drop("_r", "_n", "_k")


def out_of_fold(df: DataFrame, key: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int = 5) -> DataFrame:
    """Scores of every row by a model of the other folds; representation and model are fitted
    anew for each fold."""
    held = with_folds(df, key, folds)
    out = None
    for k in range(folds):
        scored = fit(held.where(F.col("fold") != k))(held.where(F.col("fold") == k))
        out = scored if out is None else out.unionByName(scored)
    return out


def leave_one_source_out(df: DataFrame, sources: list[str], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """ROC-AUC on each source by a model of the others."""
    out = None
    for s in sources:
        scored = fit(df.where(F.col("source") != s))(df.where(F.col("source") == s))
        auc = roc_auc(scored).withColumn("held_out", F.lit(s))
        out = auc if out is None else out.unionByName(auc)
    return out


def truncated_svd(df: DataFrame, k: int = 128, features: str = "features") -> Callable[[DataFrame], DataFrame]:
    """A projection on the k leading right singular vectors, without centring; adds `reduced`.
    The vectors are as large as features times k."""
    from pyspark.ml.linalg import DenseMatrix
    from pyspark.mllib.linalg import Vectors as OldVectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = df.select(features).rdd.map(lambda r: OldVectors.fromML(r[0]))
    v = RowMatrix(rows).computeSVD(k, computeU=False).V
    basis = DenseMatrix(v.numRows, v.numCols, v.toArray().flatten("F").tolist()).toArray()

    @F.udf(VectorUDT())
    def project(x):
        return Vectors.dense(basis[x.indices].T @ x.values if hasattr(x, "indices") else basis.T @ x.toArray())

    return lambda d: d.withColumn("reduced", project(features))


def fit_detector(df: DataFrame, vocabulary: int = 80_000, weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Features and a linear model on the rows given; a transform that adds `score`."""
    features = fit_tfidf(df, vocabulary)
    model = linear(weight).fit(features(df))
    return lambda rows: positive_score(model.transform(features(rows))).drop("features", "rawPrediction", "probability", "prediction")


def ablate(df: DataFrame, sources: list[str], variants: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]]) -> str:
    """The variant of the highest mean ROC-AUC over held-out sources; ties go to the first name."""
    means = {}
    for name, fit in variants.items():
        means[name] = leave_one_source_out(df, sources, fit).agg(F.avg("roc_auc")).first()[0] or 0.0
    return min(means, key=lambda n: (-means[n], n))


def calibrate_and_select(calibration: DataFrame, selection: DataFrame, most_fpr: float, least_negatives: int, keys: list[str]) -> dict:
    """For one seed, of no calibration and Platt's, the one of the lower Brier score on the selection rows, and
    the bound that calibrated scores must exceed there."""
    from .metrics import brier
    from .thresholds import shared_bound

    best = None
    for name, expression in (("none", lambda s: s), ("platt", platt(calibration))):
        rows = selection.withColumn("score", expression(F.col("score")))
        made = {"method": name, "brier": rows.agg(brier()).first()[0], "bound": shared_bound(rows, most_fpr, least_negatives, keys).first()["bound"]}
        best = made if best is None or made["brier"] < best["brier"] else best
    return best


def select_calibration(runs: list[tuple[DataFrame, DataFrame]], most_fpr: float, least_negatives: int, keys: list[str], methods: tuple[str, ...] = ("none", "platt", "isotonic")) -> dict:
    """The calibration for all seeds: runs holds each seed's calibration and selection rows.

    A method is eligible if some bound below 1 keeps every group of enough negatives within its
    FPR for every seed; of those the one of the highest mean recall above its bound wins, then of
    the highest least recall of a seed, then of the lowest mean Brier score, then Platt's."""
    from .metrics import brier
    from .thresholds import shared_bound

    def calibrated(method: str, fitted: DataFrame, rows: DataFrame) -> DataFrame:
        if method == "isotonic":
            return calibrated_isotonic(isotonic(fitted), rows).withColumn("score", F.col("calibrated")).drop("calibrated")
        return rows.withColumn("score", platt(fitted)(F.col("score"))) if method == "platt" else rows

    eligible = []
    for method in methods:
        rows = None
        for seed, (fitted, selection) in enumerate(runs):
            made = calibrated(method, fitted, selection).withColumn("seed", F.lit(seed))
            rows = made if rows is None else rows.unionByName(made)
        bound = shared_bound(rows, most_fpr, least_negatives, ["seed", *keys]).first()["bound"]
        if bound is None:
            raise ValueError("no group has enough negatives for the FPR gate")
        if bound >= 1:
            continue
        recall = F.avg(F.when(F.col("label") == 1, (F.col("score") > bound).cast("double"))).alias("recall")
        seeds = rows.groupBy("seed").agg(recall, brier().alias("brier")).collect()
        mean = lambda name: sum(r[name] for r in seeds) / len(seeds)
        eligible.append({"method": method, "bound": bound, "recall": mean("recall"), "least_recall": min(r["recall"] for r in seeds), "brier": mean("brier")})
    if not eligible:
        raise RuntimeError("no calibration satisfies the shared FPR gate")
    return max(eligible, key=lambda m: (m["recall"], m["least_recall"], -m["brier"], m["method"] == "platt"))


def choose_family(runs: list[dict]) -> str:
    """Candidates by name; a later one wins if its recall gains more than the pooled spread,
    and within the spread by lower latency, then macro F1, then bytes."""
    ordered = sorted(runs, key=lambda r: r["name"])
    best = ordered[0]
    for r in ordered[1:]:
        spread = ((best["recall_sd"] ** 2 + r["recall_sd"] ** 2) / 2) ** 0.5
        gain = r["recall"] - best["recall"]
        if gain > spread:
            best = r
        elif abs(gain) <= spread:
            rank = lambda x: (x["latency"] if x["latency"] is not None else float("inf"), -x["macro_f1"], x["bytes"])
            best = min(best, r, key=rank)
    return best["name"]


def class_probabilities(p: Column, ids: list[int], k: int) -> Column:
    """Probabilities of local classes placed at their global ids, others 0, sum 1."""
    placed = F.array(*(p[ids.index(i)] if i in ids else F.lit(0.0) for i in range(k)))
    total = F.aggregate(placed, F.lit(0.0), lambda a, x: a + x)
    return F.transform(placed, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def head_outputs(heads: dict[str, tuple[Column, list[str], float | None]]) -> Column:
    """One struct of the heads: a single-label head gives its likeliest label and probability, a
    multi-label head (with a threshold) the labels that reach it; an unavailable one is null."""
    made = []
    for name, (p, labels, threshold) in heads.items():
        names = F.array(*(F.lit(x) for x in labels))
        if threshold is None:
            best = F.array_max(p)
            value = F.struct(F.element_at(names, F.array_position(p, best).cast("int")).alias("label"), best.alias("probability"))
        else:
            value = F.filter(F.arrays_zip(names.alias("label"), p.alias("probability")), lambda x: x["probability"] >= threshold)
        made.append(F.when(p.isNotNull(), value).alias(name))
    return F.struct(*made)
