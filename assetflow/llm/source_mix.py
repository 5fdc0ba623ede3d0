"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops at
``most`` times its source's words and the excess is shared again by weight.  Every document of a source is expected
``target / words`` times.  With the expected copies added up in order of size, a document is taken once for
each whole number its interval crosses, shifted by one random offset of the source.  Sorted by size the sample is spread
over all sizes, so the words taken stay within about one long document of the target.

A source's documents never meet in one task: a rank is the number of documents in smaller sizes, plus those of the same
size in earlier of 4096 hash blocks, plus the place in the block.  Only sums over aggregated tables are windowed: sizes of a
source, blocks of a size, and the table of sources itself.

Defined cases: a null or empty text has size 0 and adds nothing to what is taken; a null source is a source of its own; a
source without words has target 0; repeated rows and ids are documents of their own; empty tables give no rows; columns that
clash with the results are replaced, others stay.  The offset depends on the seed and the source's name: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import KEY, fresh, keyed, written
from assetflow.session import table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def source_key(source: Column) -> Column:
    """A non-null text that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("w"))


def _digits(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source_size, target) of (skey, source_size), one row a source.

    The level is what one unit of weight gets while no further source is full: each round sums up the full
    ones, until their number stays.  Only these sums reach the driver."""
    nth = F.row_number().over(Window.orderBy("skey")) - 1
    weigh = F.get(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int"))
    rows = written(sizes.select("skey", "source_size", weigh.alias("w")), "sources")
    level, before = -1.0, -1
    while True:
        full = F.col("source_size") * most < F.lit(level) * F.col("w")
        got = rows.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.sum(F.when(~full, F.col("w"))).alias("w"),
            F.count_if(full).alias("n"),
        ).first()
        if got["n"] == before or not got["w"]:
            break
        before = got["n"]
        level = (share * got["all"] - most * got["full"]) / got["w"]
    return rows.select("skey", "source_size", F.least(F.lit(level) * F.col("w"), F.col("source_size") * most).alias("target"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **rule) -> DataFrame:
    """A row for each row of ``df`` (that has ``_key``): _key, the id, size, source_size, target, copies and taken."""
    docs = df.select(
        KEY,
        id_col,
        source_key(F.col(source)).alias("skey"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        _digits(F.col(KEY).cast("string"), 3).alias("blk"),
    )
    docs = written(docs, "sizes")  # the texts are read once
    blocks = docs.groupBy("skey", "size", "blk").agg(F.count(F.lit(1)).alias("n"))
    same = blocks.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    smaller = same.select("skey", "size", F.coalesce(F.sum("n").over(before("skey", "size")), F.lit(0)).alias("smaller"))
    earlier = blocks.select("skey", "size", "blk", F.coalesce(F.sum("n").over(before("skey", "size", "blk")), F.lit(0)).alias("earlier"))
    aims = targets(same.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **rule)
    place = F.row_number().over(Window.partitionBy("skey", "size", "blk").orderBy(KEY))
    rank = docs.withColumn("place", place).join(earlier, ["skey", "size", "blk"]).join(smaller.join(aims, "skey"), ["skey", "size"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    nth = F.col("smaller") + F.col("earlier") + F.col("place")
    offset = _digits(F.concat(F.lit(seed + ":"), F.col("skey")), 8) / F.lit(4294967296.0)
    copies = F.floor(rate * nth + offset) - F.floor(rate * (nth - 1) + offset)
    return rank.select(KEY, id_col, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **rule) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, with ``copy`` counting from 1."""
    rows = keyed(df, id_col)
    copies = fresh(rows, "copies")
    plan = mix_plan(rows, id_col, text, source, **rule).filter("copies > 0").select(KEY, F.col("copies").alias(copies))
    taken = rows.join(plan.hint("shuffle_hash"), KEY)
    kept = [c for c in df.columns if c.lower() != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))).alias("copy"))


@llm_query(
    "op5_source_mix",
    r"""
    WITH d AS (SELECT doc_id, coalesce('v' || source, 'w') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
    w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY skey) - 1) % 3)]::DOUBLE AS w FROM s),
    p AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_size,
      sum(w) OVER (ORDER BY source_size / w DESC, skey DESC ROWS UNBOUNDED PRECEDING) AS rest, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w),
    l AS (SELECT min_by((1.5 * total - 2.0 * full_size) / rest, source_size / w) FILTER (source_size * 2.0 >= (1.5 * total - 2.0 * full_size) / rest * w) AS level FROM p),
    t AS (SELECT skey, source_size, least(level * w, source_size * 2.0) AS target,
      ('0x' || substr(md5('mix:' || skey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM w, l),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY skey ORDER BY size, substr(md5(doc_id::VARCHAR), 1, 3), doc_id)::DOUBLE AS nth FROM d),
    c AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, u FROM r JOIN t USING (skey))
    SELECT doc_id, size, source_size, target, ((floor(rate * nth + u) - floor(rate * (nth - 1) + u)) * size)::BIGINT AS taken FROM c
    """,
)
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")
