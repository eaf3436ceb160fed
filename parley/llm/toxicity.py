"""Toxicity grades by cumulative-link (proportional-odds) regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import materialize

WORD = re.compile(r"\w+")
STEM, CLIP = 5, 3.0
SCORES = "expected_severity double, severity int, toxic boolean"


def counts(text: str) -> tuple[Counter, int]:
    """Words and word beginnings (^ and five letters) with their counts, and the words in all."""
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out["^" + w[:STEM]] += n
    return out, sum(words.values())


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]); x is the square root of a feature's
    share of the words in percent, clipped at CLIP, so that few words in a long text still tell.
    All thresholds share the weights and rise with k. A text is toxic if P(grade > 0) reaches
    the cut, which is below one half as the toxic are few and to be caught."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [4.0, 6.0])
    cut: float = 0.4

    def score(self, text: str) -> tuple[float, int, bool]:
        """Expected severity, the likeliest grade, and whether P(grade > 0) reaches the cut."""
        get, stem, z = self.weights.get, STEM, 0.0
        words = WORD.findall(text.lower())
        stems: Counter = Counter()
        if words:
            per = 100.0 / len(words)
            for w, n in Counter(words).items():
                v = get(w)
                if v is not None:
                    z += v * min(CLIP, math.sqrt(per * n))
                if len(w) > stem:
                    s = "^" + w[:stem]
                    if s in self.weights:
                        stems[s] += n
            for s, n in stems.items():
                z += self.weights[s] * min(CLIP, math.sqrt(per * n))
        over = [1.0 / (1.0 + np.exp(-max(-40.0, min(40.0, z - t)))) for t in self.thresholds]
        chances = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
        return float(sum(over)), int(np.argmax(chances)), bool(over[0] >= self.cut)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, width: int, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam on sparse triples. Thresholds
    are a first one and positive gaps, so they stay ordered."""
    top = int(grades.max()) if len(grades) else 1
    k = max(1, top)
    w, first, gaps = np.zeros(width), np.array([1.0]), np.full(k - 1, 0.5)
    n = max(1, len(grades))
    moments = [np.zeros(width + k), np.zeros(width + k)]
    sig = lambda v: 1.0 / (1.0 + np.exp(-np.clip(v, -40, 40)))
    for t in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, weights=vals * w[cols], minlength=len(grades))
        edge = np.concatenate([np.full((len(grades), 1), 1.0), sig(z[:, None] - theta[None, :]), np.zeros((len(grades), 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(len(grades))
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        # d log p / d z, and for each threshold
        upper, lower = slope[at, grades], slope[at, grades + 1]
        gz = (upper - lower) / p
        gt = np.zeros(k)
        for j in range(k):
            gt[j] = -(upper / p)[grades == j + 1].sum() + (lower / p)[grades == j].sum()
        gw = np.bincount(cols, weights=vals * gz[rows], minlength=width) / n - l2 * w
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [tail[0] / n], tail[1:] / n * np.exp(gaps)])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        step = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w, first, gaps = w + step[:width], first + step[width : width + 1], gaps + step[width + 1 :]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_features: int = 1024, least_docs: int = 3) -> Model:
    """Fit on a bounded sample: the `max_rows` labelled documents of the smallest id hashes.

    Labels say toxic or not. The grade of a toxic one is an extension of them: 1 or 2, by whether
    the share of its words that speak for toxicity (log odds over 2 in the sample) is below or
    at least the median of the toxic documents. Features are the words and word beginnings of the highest
    absolute log odds times root frequency. Labels that are null, or whose document is missing,
    are left out; of repeated labels the highest counts. Without toxic labels, or without
    features, the model rejects nothing.
    """
    sample = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = materialize(found.select("text", F.col("toxic").cast("int")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = counts(text)[0].keys()
                seen.update(found)
                if y:
                    bad.update(found)
        seen[""] += 0
        yield pa.RecordBatch.from_pydict({"f": list(seen), "n": list(seen.values()), "bad": [bad[f] for f in seen]}, schema=pa.schema([("f", pa.string()), ("n", pa.int64()), ("bad", pa.int64())]))

    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic")), F.lit(0)).alias("bad")).first()
    if not totals["bad"] or totals["bad"] == totals["n"]:
        return Model()
    good = totals["n"] - totals["bad"]
    odds = F.log((F.col("bad") + 0.5) / (totals["bad"] + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
    table = (
        texts.mapInArrow(count, "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where((F.col("n") >= least_docs) & (F.col("f") != "")).withColumn("odds", odds)
        .orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "f").limit(max_features).collect()
    )
    if not table:
        return Model()
    index = {r["f"]: i for i, r in enumerate(table)}
    speak = {r["f"] for r in table if r["odds"] > 2 and not r["f"].startswith("^")}

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, words = counts(text)
                own = [(index[f], min(CLIP, math.sqrt(100.0 * n / words))) for f, n in found.items() if f in index] if words else []
                rows.append((y, sum(found[f] for f in speak) / max(1, words), [i for i, _ in own], [v for _, v in own]))
            kinds = [("y", pa.int32()), ("share", pa.float64()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=[k for k, _ in kinds])

    sampled = texts.mapInArrow(shares, "y int, share double, i array<int>, v array<double>").toPandas()
    sampled = sampled.assign(key=[tuple(x) for x in sampled["i"]]).sort_values(["y", "share", "key"], kind="stable").reset_index(drop=True)
    toxic = sampled["y"].to_numpy() == 1
    middle = float(np.median(sampled["share"].to_numpy()[toxic]))
    grades = np.where(toxic, np.where(sampled["share"].to_numpy() >= middle, 2, 1), 0)
    sizes = [len(x) for x in sampled["i"]]
    rows = np.repeat(np.arange(len(sampled)), sizes)
    cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in sampled["i"]]) if sum(sizes) else np.zeros(0, dtype=np.int64)
    vals = np.concatenate([np.asarray(x, dtype=float) for x in sampled["v"]]) if sum(sizes) else np.zeros(0)
    weights, thresholds = fit_ordinal(rows, cols, vals, grades, max(1, len(index)))
    return Model({f: float(weights[i]) for f, i in index.items()}, [float(t) for t in thresholds])


def severity(model: Model, text: Column) -> Column:
    """Struct of expected_severity, severity and toxic for each text; null counts as empty."""

    @pandas_udf(SCORES)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = [model.score(t or "") for t in texts]
        return pd.DataFrame(rows, columns=["expected_severity", "severity", "toxic"])

    return score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, expected_severity, severity, toxic of every row of docs, repeated rows and rows
    without a doc_id too; an empty table gives an empty result."""
    model = train(docs, labels, **params)
    return docs.select("doc_id", severity(model, F.col("text")).alias("s")).select("doc_id", "s.*")


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns.

    Null and empty texts have no words and stay, very long ones are read whole, repeated rows
    and rows without a doc_id are judged each by its text; an empty table gives an empty
    result."""
    model = train(docs, labels, **params)
    return docs.where(~severity(model, docs["text"])["toxic"])
