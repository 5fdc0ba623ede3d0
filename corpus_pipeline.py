"""From raw documents to a training mix: five operators, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.common import keyed, written
from assetflow.llm.decontaminate import decontaminate
from assetflow.llm.line_dedup import dedup_lines
from assetflow.llm.ngram_join import keep_one
from assetflow.llm.quality import CUT, learn, score_documents
from assetflow.llm.source_mix import take_mix
from assetflow.session import table


OWN = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def guarded(stage: Stage) -> Stage:
    """The stage on the columns of ``documents`` alone.  Others travel in one struct, so that no name they have can meet a name that an
    operator uses, and come back as they were, unless the stage's result has a column of that name."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        if not others:
            return stage(spark, docs, sf_dir)
        held = F.struct(*[F.col(f"`{c}`") for c in others]).alias("extra_columns")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in OWN], held), sf_dir)
        new = [c for c in out.columns if c not in OWN and c != "extra_columns"]
        back = [F.col(f"extra_columns.`{c}`") if c in others else F.col(c) for c in docs.columns if c not in new]
        return out.select(*back, *new)

    return run


@guarded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.  It learns from the labels of ``docs``."""
    ranking = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, ranking).filter(F.col("score") >= CUT).select(*docs.columns)


@guarded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; one of which nothing else is left goes."""
    out = dedup_lines(keyed(docs, "doc_id"))
    changed = F.col("_dropped") > 0
    left = out.filter(~(changed & (F.trim("text") == "")))
    return left.select(*[F.when(changed, F.length("text")).otherwise(F.col(c)).cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@guarded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8)."""
    return keep_one(docs)


@guarded
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@guarded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with the number of the copy."""
    return take_mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mix", mix),
]

# A learned classifier and a suffix array are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
