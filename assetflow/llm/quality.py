"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of labelled documents, one of label 1 and one of label 0, are preferences.  Weights are learned by the logistic loss
of the pairs' feature differences; a document's strength is the weighted sum of its features.  The threshold is the quantile
of the training strengths at the share of label 0.  The score is the logistic function of the strength's distance from the
threshold, moved so that the threshold has the score ``cut``.

Features are counted from the text alone (never from labels, language, source or id): shares of symbols, of letter
cases and of digits, repeated words, word and sentence lengths.  Learning uses at most ``sample`` labelled
rows, those of least hash, so what the driver holds is bounded; scoring is one pass that shuffles nothing.

Defined cases: null and empty texts have all features 0 and are scored like any other; labels that are null or other than
0 and 1 are not learned from; a document labelled twice counts with its least label, and one row is learned from where an id is repeated; without both labels every score
is 0.5; very long texts are read whole; repeated rows get their own scores; empty tables give no rows; columns that clash
with the results are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.base import llm_query
from assetflow.llm.common import WHITE, Words, chunks, python_ready
from assetflow.session import table

FOLDS, SAMPLE, PAIRS, CUT = 5, 20_000, 60_000, 0.3
FEATURES = [
    "odd_symbols", "bars", "marks", "capitals", "digits", "repeats", "distinct", "word_bytes", "word_spread", "stops", "lines", "control", "size",
]


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    words = Words(texts, WHITE)
    raw, off, first, h = words.raw, words.offsets, words.first, words.hashes
    size, count = np.diff(off), np.diff(first)
    per = lambda hits: np.diff(np.concatenate([[0], np.cumsum(hits)])[off])  # noqa: E731  how many bytes of each text are hits
    among = lambda chars: np.isin(raw, np.frombuffer(chars, np.uint8))
    upper, lower = per((raw >= 65) & (raw <= 90)), per((raw >= 97) & (raw <= 122))
    bytes_, n = np.maximum(size, 1), np.maximum(count, 1)
    owner = np.repeat(np.arange(len(count)), count)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    sums = lambda x: np.bincount(owner, weights=x, minlength=len(count))
    black = per(WHITE[raw])
    gap = np.diff(np.append(words.starts, len(raw))).astype(float)
    mean = sums(gap) / n
    spread = np.sqrt(np.maximum(sums(gap**2) / n - mean**2, 0))
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])], float)
    columns = [
        np.sqrt(per(among(b"#$%&*+<=>@[]\\^_`{}~")) / bytes_),
        np.sqrt(per(among(b"|")) / bytes_),
        np.sqrt(per(among(b"!?")) / bytes_),
        upper / np.maximum(upper + lower, 1),
        np.sqrt(per((raw >= 48) & (raw <= 57)) / bytes_),
        sums(same) / n,
        distinct / n,
        np.minimum(black / n, 40) / 10,
        np.minimum(spread, 40) / 10,
        per(among(b".")) / n,
        np.sqrt(per(among(b"\n")) / n),
        np.sqrt(per((raw < 32) & WHITE[raw]) / bytes_),
        np.log1p(count) / 10,
    ]
    table_ = np.stack(columns, 1) if len(count) else np.zeros((0, len(FEATURES)))
    table_[size == 0] = 0
    return table_


@dataclass
class Ranking:
    """Weights of standardised features, and where the threshold lies."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float = CUT

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength + np.log(self.cut / (1 - self.cut)), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, cut: float = CUT, seed: int = 7) -> Ranking | None:
    """Bradley-Terry weights from rows of features and labels; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / np.where(scale > 0, scale, 1)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = np.sort(z @ w)
    k = len(bad)  # the threshold lies between the strengths at the share of label 0
    threshold = (strength[k - 1] + strength[min(k, len(strength) - 1)]) / 2
    return Ranking(mean, np.where(scale > 0, scale, 1), w, float(threshold), cut)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ranking | None:
    """Fit on the labelled documents outside the held-out fold, at most ``sample`` of them."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # ``chosen`` has at most ``sample`` rows of two numbers
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text).alias("_t")).join(F.broadcast(chosen), F.col("_i") == F.col("_id")).select("_id", "_y", "_t")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "_t"):
                x = features(batch.column("_t"))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    kinds = dict(rows.dtypes)
    measured = python_ready(rows).mapInArrow(measure, f"i {kinds['_id']}, y {kinds['_y']}, x array<double>")
    # of the rows that share an id one reaches the driver, so ``sample`` bounds the rows too
    got = measured.groupBy("i").agg(F.min(F.struct("y", "x")).alias("m")).select("i", "m.y", "m.x").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["i", "y"], kind="stable")
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def score_documents(docs: DataFrame, ranking: Ranking | None, text: str = "text") -> DataFrame:
    """``docs`` with score."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                n = len(batch)
                own = ranking.scores(features(batch.column(text))) if ranking else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(own, pa.float64())], names=schema.names)

    return python_ready(docs.select(*kept)).mapInArrow(score, schema)


@llm_query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, ranking)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
