"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the labelled good documents and the unlabelled text is every document; labels of other documents
are never read. For the logistic loss l and a linear score z over counts of the text, the risk is
prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]). The class prior is estimated from positives and unlabelled
text: where scores are high enough all documents are good, so there the share of all documents over the share of
positives is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import full_text, prepare, written
from groundspark.llm.textstats import COUNTS, counts

#: Newton steps at most, halvings of the weight at the risk's edge, ridge, and the bound on standardised features.
STEPS, HALVINGS, RIDGE, BOUND = 12, 8, 1e-3, 8.0
#: The prior that the first scores are made with, bins of scores, and the chance that the estimate's bound fails.
START, BINS, DELTA = 0.5, 1024, 0.1


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; their labels are never read."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _features() -> list[Column]:
    c = lambda k: F.col(f"_{k}").cast("double")
    ratio = lambda a, b: F.least(c(a) / F.greatest(c(b), F.lit(1.0)), F.lit(4.0))
    root = lambda a, b: F.sqrt(ratio(a, b))
    return [
        F.log1p(c("n_words")), F.least(c("word_chars") / F.greatest(c("n_words"), F.lit(1.0)), F.lit(50.0)),
        root("n_symbols", "n_words"), root("n_bang", "n_words"), root("n_upper", "n_letters"), root("n_adjacent", "n_words"),
        ratio("n_distinct", "n_words"), root("n_repeat_words", "n_words"), root("n_pipe", "n_words"), root("n_stops", "n_words"),
        root("n_digits", "n_letters"), root("n_dup_lines", "n_lines"),
    ]


N = 12


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and the counts of the whole text, as _n_words and so on."""
    kept = docs.select(*keep, full_text().alias("_text"))
    fields = [T.StructField(f"_{k}", T.LongType()) for k in COUNTS]
    schema = T.StructType([f for f in kept.schema.fields if f.name != "_text"] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = counts(batch.column("_text"))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(c[k], pa.int64()) for k in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def with_features(counted: DataFrame, keep: list[str]) -> DataFrame:
    return counted.select(*keep, *(f.alias(f"_f{k}") for k, f in enumerate(_features())))


class Model:
    """weights[0] + sum of weights[k + 1] * standardised feature k; a score is its logistic function."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def linear(self) -> Column:
        z = F.lit(float(self.weights[0]))
        for k in range(N):
            x = (F.col(f"_f{k}") - F.lit(float(self.mean[k]))) / F.lit(float(self.scale[k]))
            z = z + F.lit(float(self.weights[k + 1])) * F.least(F.greatest(x, F.lit(-BOUND)), F.lit(BOUND))
        return z

    def score(self) -> Column:
        return F.round(1 / (1 + F.exp(-self.linear())), 6)


def _inputs(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(batch.column(f"_f{i}")) for i in range(N)], 1)
    x = np.concatenate([np.ones((len(x), 1)), np.clip((x - model.mean) / model.scale, -BOUND, BOUND)], 1)
    return x, np.asarray(batch.column("_positive"), float)


class Sums:
    """What risk, gradient and curvature need at one model: means over all rows and over the positives."""

    def __init__(self, table: DataFrame, model: Model):
        k = N + 1

        def one(x: np.ndarray, weight: np.ndarray, s: np.ndarray, loss: np.ndarray) -> list:
            return [[weight.sum(), weight @ loss], weight @ x, (weight * s) @ x, ((x * (weight * s * (1 - s))[:, None]).T @ x).ravel()]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * (2 + 2 * k + k * k))
            for batch in batches:
                x, positive = _inputs(batch, model)
                z = x @ model.weights
                s, loss = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
                total += np.concatenate(one(x, np.ones(len(x)), s, loss) + one(x, positive, s, loss))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

        rows = table.mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a few hundred numbers
        flat = np.zeros(2 * (2 + 2 * k + k * k))
        for r in rows:
            flat[r["k"]] = r["v"]
        self.n, self.positives = flat[0], flat[len(flat) // 2]
        self.all, self.good = ({"loss": f[1], "x": f[2 : 2 + k], "s": f[2 + k : 2 + 2 * k], "h": f[2 + 2 * k :].reshape(k, k)} for f in (
            flat[: len(flat) // 2] / max(self.n, 1), flat[len(flat) // 2 :] / max(self.positives, 1)
        ))

    def negative_risk(self, prior: float) -> float:
        return self.all["loss"] - prior * self.good["loss"]

    def step(self, prior: float, share: float, weights: np.ndarray) -> np.ndarray:
        """Newton's step on prior * E_p[l(z)] + share * (E_u[l(-z)] - prior * E_p[l(-z)]), convex for shares from 0 to 1."""
        gradient = prior * ((1 - share) * self.good["s"] - self.good["x"]) + share * self.all["s"] + RIDGE * weights
        curvature = prior * (1 - share) * self.good["h"] + share * self.all["h"] + RIDGE * np.eye(N + 1)
        return np.linalg.solve(curvature, gradient)


def minimised(table: DataFrame, start: Model, prior: float) -> Model:
    """The model of least non-negative risk at this prior.

    That risk is the larger of two convex functions, prior * E_p[l(z)] and the unbiased risk. Where the latter's minimum
    has a negative part below 0, the minimum of both lies where that part is 0, and minimises their mix at some share of
    the latter; halving finds the share.
    """

    def at(share: float, model: Model) -> tuple[Model, Sums]:
        for _ in range(STEPS):
            sums = Sums(table, model)
            step = sums.step(prior, share, model.weights)
            if np.abs(step).max() < 1e-3:
                return model, sums
            model = Model(model.mean, model.scale, model.weights - step * min(1.0, 4.0 / np.abs(step).max()), prior)
        return model, Sums(table, model)

    model, sums = at(1.0, Model(start.mean, start.scale, start.weights, prior))
    low, high = 0.0, 1.0
    for _ in range(HALVINGS if sums.negative_risk(prior) < 0 else 0):
        share = (low + high) / 2
        model, sums = at(share, model)
        edge = sums.negative_risk(prior)
        if abs(edge) < 1e-3:
            break
        low, high = (share, high) if edge > 0 else (low, share)
    return model


def prior_from(shares: np.ndarray, n_all: float, n_positive: float) -> float:
    """The prior from shares (bins, 2) of all rows and of positives by score, highest first.

    Among all thresholds it takes the one with the least upper bound of (share of all above) / (share of positives above),
    where the bound widens as few positives are above (Dvoretzky, Kiefer and Wolfowitz, at chance DELTA).
    """
    above = np.cumsum(shares, 0)
    above = above[above[:, 1] > 0]
    slack = np.sqrt(np.log(4 / DELTA) / 2 / n_all) + np.sqrt(np.log(4 / DELTA) / 2 / n_positive)
    best = int(np.argmin((above[:, 0] + slack) / above[:, 1]))
    return float(np.clip(above[best, 0] / above[best, 1], 0.01, 0.99))


def estimated_prior(table: DataFrame, model: Model) -> float:
    """The share of good documents among all, from the scores of positives and of all rows in BINS bins."""
    z = model.linear()
    ends = table.agg(F.min(z).alias("lo"), F.max(z).alias("hi")).first()
    wide = max(ends["hi"] - ends["lo"], 1e-9)
    at = F.least(F.floor((F.lit(ends["hi"]) - z) * (BINS / wide)), F.lit(BINS - 1)).alias("at")
    found = table.select(at, "_positive").groupBy("at").agg(F.count("*").alias("n"), F.sum("_positive").alias("p")).collect()
    count = np.zeros((BINS, 2))
    for r in found:
        count[r["at"]] = r["n"], r["p"]
    n_all, n_positive = count.sum(0)
    return prior_from(count / count.sum(0), n_all, n_positive)


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """The model from features (doc_id, _f0 ...) of all documents and labels (doc_id, quality) outside the held-out rows.

    Without a labelled positive every weight is 0 and every score 0.5. A document labelled both ways isn't trusted.
    """
    trusted = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    positive = trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_positive"))
    joined = features.join(positive, F.col("doc_id") == F.col("_id"), "left")
    table = written(joined.select(*(f"_f{k}" for k in range(N)), F.coalesce("_positive", F.lit(0)).alias("_positive")))
    stats = table.agg(*(F.avg(f"_f{k}").alias(f"a{k}") for k in range(N)), *(F.stddev_pop(f"_f{k}").alias(f"s{k}") for k in range(N)), F.sum("_positive").alias("positives")).first()
    mean = np.array([stats[f"a{k}"] or 0.0 for k in range(N)])
    scale = np.array([max(stats[f"s{k}"] or 0.0, 1e-6) for k in range(N)])
    model = Model(mean, scale, np.zeros(N + 1), START)
    if not stats["positives"]:
        return model
    first = minimised(table, model, START)
    return minimised(table, first, estimated_prior(table, first))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, score and predicted.

    Labels, lang, source and doc_id aren't inputs of a score. A null text counts as empty and gets a score too; a null
    doc_id is kept, unlabelled and not held out; repeated rows get equal results; an empty table gives none.
    """
    prepare(docs.sparkSession)
    counted = with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    features = written(with_features(counted, ["doc_id"]))
    score = fit(features, labels).score()
    return features.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that the classifier predicts to be good; texts are counted where they lie."""
    prepare(docs.sparkSession)
    counted = with_counts(docs.select("doc_id", "text"), ["doc_id"])
    score = fit(written(with_features(counted, ["doc_id"])), labels).score()
    own = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called, they keep clear of counts and features
    rows = docs.toDF(*own).withColumn("text", F.col(own[[c.lower() for c in docs.columns].index("text")]))
    return with_features(with_counts(rows, own), own).where(score >= 0.5).select(*own).toDF(*docs.columns)
