"""Line dedup by a suffix array over line identifiers.

The lines of all documents, in order of the documents, are one sequence; lines that occur only once cut it, since no repeat goes
through them.  What is left of a document from a line on, up to the next cut, is a suffix.  Equal suffixes have one
identifier, made backwards from the end, and are one row with the place where they occur first: whole copies of
documents cost nothing in what follows.  Prefix doubling sorts the distinct suffixes: the first ranks are by the first eight
lines (the head), and a round of ranks by the first 2h lines comes from the rank by the first h and the rank of what follows after h lines.
Neighbours in the order get the length of their longest common prefix (LCP) from the ranks of all rounds and, for what
is less than eight lines, from the heads.

A line is deleted if it lies in a run of lines, of at least ``min_words`` words together, that also begins at an earlier place.  The longest
such run at a place is given by the LCP intervals that hold an earlier place: the neighbours to the left and right, in suffix order, that
occur earlier, and the least LCP on the way.  Blocks of the order find these alone; only what a block leaves open (its
running minima) goes on to larger blocks, each time a small share.

No group of suffixes, lines or ranks meets in one task: counts are taken before ranks are given, ranks inside a group are numbered by
blocks, and the blocks of the order have a fixed size.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; lines are equal if their
characters are, up to white space at the end; very long texts are read whole; order is by id (see ``keyed`` for nulls and
repeats), so of repeated rows the later ones lose their lines; an empty table gives no rows; columns named like the two results are
replaced, others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import KEY, Steps, chunks, fresh, keyed, python_ready, settled, written
from assetflow.session import table

MIN_WORDS = 50
BLOCK, FAN = 8192, 64  # suffixes of a block of the order; blocks that become one in the next round
RANK_BITS = 16  # ranks inside a group are numbered in blocks of so many bits
HEAD, ID_BYTES = 8, 16  # lines that the first ranks compare; bytes of a line's identifier


def _lines(df: DataFrame, text: str) -> DataFrame:
    """(key, line, id, words) of every line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                keys, at, ids, words = [], [], [], []
                for key, t in zip(batch.column(KEY).to_pylist(), batch.column(text).to_pylist()):
                    if t is None:
                        continue
                    own = [x.rstrip() for x in t.encode().split(b"\n")]
                    keys += [key] * len(own)
                    at += range(len(own))
                    ids += [md5(x).digest() for x in own]
                    words += [len(x.split()) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(ids, pa.binary()), pa.array(words, pa.int32())],
                    names=["key", "line", "id", "words"],
                )

    return python_ready(df.select(KEY, text)).mapInArrow(read, "key bigint, line int, id binary, words int")


def _suffixes(live: DataFrame) -> DataFrame:
    """(key, line, words, head, suffix, next, length): ``suffix`` names the lines from here to the next cut, ``head`` holds the
    identifiers of its first HEAD lines, and ``next`` names what follows after them."""
    per_doc = live.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "words", "id"))).alias("ls"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "line", "words", "head", "suffix", "next", "length"]
        for batch in batches:
            rows = []
            for key, ls in zip(batch.column("key").to_pylist(), batch.column("ls").to_pylist()):
                after, head, length, since = -1, b"", 0, []
                for x in reversed(ls):
                    if after != x["line"] + 1:
                        head, length, since = b"", 0, []
                    since.append(md5(x["id"] + (since[-1] if since else b"")).digest())
                    after, head, length = x["line"], (x["id"] + head)[: HEAD * ID_BYTES], length + 1
                    rows.append((key, after, x["words"], head, since[-1], since[-1 - HEAD] if length > HEAD else None, length))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return per_doc.mapInArrow(chain, "key bigint, line int, words int, head binary, suffix binary, next binary, length int")


def _before(*by: str) -> Window:
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(*by: str):
    return F.coalesce(F.sum("n").over(_before(*by)), F.lit(0))


def _first_ranks(classes: DataFrame) -> DataFrame:
    """Rank of every suffix by its head: (suffix, ptr, r, n, rs, ps), n suffixes sharing the rank r."""
    each = classes.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    # distinct heads in ranges of even size, whatever line many of them begin with; positions are summed up in blocks
    each = each.repartitionByRange("head").sortWithinPartitions("head").withColumn("pos", F.monotonically_increasing_id())
    each = written(each, "heads").withColumn("blk", F.shiftright("pos", RANK_BITS))
    blocks = each.groupBy("blk").agg(F.sum("n").alias("n")).select("blk", _sum_before("blk").alias("base"))
    ranked = each.withColumn("own", _sum_before("blk", "pos")).join(blocks, "blk").select("head", "n", (F.col("base") + F.col("own") + 1).alias("r"))
    return classes.join(ranked, "head").select(
        "suffix", F.col("next").alias("ptr"), "r", "n", F.array("r").alias("rs"), F.array(F.col("next")).alias("ps")
    )


def suffix_order(classes: DataFrame) -> DataFrame:
    """(suffix, r, rs, ps) of the distinct suffixes: r is the place in the order, from 1; rs and ps are rank and
    following suffix after 1, 2, 4, ... times HEAD lines, as far as the suffix was not alone."""
    rounds = Steps(classes, "ranks")
    last = rounds.add(_first_ranks(classes))
    while not (open_ := last.filter("n > 1")).isEmpty():
        # what is settled stays as it is; the rest is as the last round left it
        every = rounds.all().filter("n = 1").select("suffix", "r", "ptr").unionByName(open_.select("suffix", "r", "ptr"))
        target = every.select(F.col("suffix").alias("ptr"), F.col("r").alias("r2"), F.col("ptr").alias("ptr2"))
        ended = open_.filter("ptr is null").select("*", F.lit(0).cast("bigint").alias("r2"), F.lit(None).cast("binary").alias("ptr2"))
        both = ended.drop("ptr", "n").unionByName(open_.drop("n").join(target, "ptr").drop("ptr"))
        each = both.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).withColumn("blk", F.shiftright("r2", RANK_BITS))
        blocks = each.groupBy("r", "blk").agg(F.sum("n").alias("n")).select("r", "blk", _sum_before("r", "blk").alias("base"))
        own = each.withColumn("own", _sum_before("r", "blk", "r2")).join(blocks, ["r", "blk"])
        own = own.select("r", "r2", "n", (F.col("r") + F.col("base") + F.col("own")).alias("new"))
        last = rounds.add(
            both.join(own, ["r", "r2"]).select(
                "suffix",
                F.col("ptr2").alias("ptr"),
                F.col("new").alias("r"),
                "n",
                F.concat("rs", F.array("new")).alias("rs"),
                F.concat("ps", F.array("ptr2")).alias("ps"),
            )
        )
    return rounds.all().filter("n = 1").select("suffix", "r", "rs", "ps")


def _shared_head(one: str, other: str) -> Column:
    """How many lines two heads share, from the first on."""
    part = lambda head, i: F.substring(F.col(head), F.lit(1), i * ID_BYTES)
    counts = F.array(*[F.lit(i) for i in range(1, HEAD + 1)])
    same = F.filter(counts, lambda i: (part(one, i) == part(other, i)) & (F.octet_length(part(one, i)) == i * ID_BYTES))
    return F.size(same).cast("bigint")


def neighbour_prefixes(order: DataFrame) -> DataFrame:
    """(r, lcp): lines that the suffix at r of ``order`` (suffix, r, rs, ps, head) shares with the one before it; pairs that
    share none are left out."""
    side = lambda n: order.select(*[F.col(c).alias(f"{c}{n}") for c in ("suffix", "r", "rs", "ps", "head")])
    steps = Steps(order, "prefixes")
    ready = side(0).join(side(1), F.col("r0") == F.col("r1") + 1).withColumns({"r": F.col("r0"), "lcp": F.lit(0).cast("bigint")})
    while True:
        # equal ranks up to level k: HEAD * 2**k lines are shared, fewer than twice as many; no equal rank: fewer than HEAD
        level = F.size(F.filter(F.zip_with("rs0", "rs1", lambda x, y: x == y), lambda e: e)) - 1
        shared = F.call_function("shiftleft", F.lit(HEAD).cast("bigint"), F.col("level"))
        step = ready.withColumn("level", level).select(
            "r",
            (F.col("lcp") + F.when(F.col("level") < 0, _shared_head("head0", "head1")).otherwise(shared)).alias("lcp"),
            F.when(F.col("level") >= 0, F.get("ps0", F.col("level"))).alias("a"),
            F.when(F.col("level") >= 0, F.get("ps1", F.col("level"))).alias("b"),
        )
        more = steps.add(step.filter("lcp > 0")).filter("a is not null and b is not null")
        if more.isEmpty():
            return steps.all().filter("a is null or b is null").select("r", "lcp")
        ready = more.join(side(0), F.col("a") == F.col("suffix0")).join(side(1), F.col("b") == F.col("suffix1"))


def _nearest_earlier(p: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place, the least link on the way back to the nearest smaller p (or to the start), and whether there is one.
    ``link[i]`` joins i - 1 and i; ``link[0]`` leads out of the block."""
    least, found = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    stack: list[tuple[int, int]] = []
    for i, (own, m) in enumerate(zip(p.tolist(), link.tolist())):
        while stack and stack[-1][0] > own:
            m = min(m, stack.pop()[1])
        least[i], found[i] = m, bool(stack)
        stack.append((own, m))
    return least, found


def earlier_runs(first: DataFrame, lcp: DataFrame) -> DataFrame:
    """(r, run): for distinct suffixes (r, key, line) the lines of the longest run from there that occurs earlier."""
    after = lcp.select((F.col("r") - 1).alias("r"), F.col("lcp").alias("next"))
    rows = first.join(lcp.withColumnRenamed("lcp", "prev"), "r", "left").join(after, "r", "left")
    rows = rows.filter("prev is not null or next is not null")  # others share nothing
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    flags = [F.lit(True).alias("left"), F.lit(True).alias("right"), F.lit(0).cast("bigint").alias("run"), F.lit(True).alias("open")]
    rows = rows.select("r", "key", "line", zero("prev"), zero("next"), *flags)
    schema = "r bigint, key bigint, line int, prev bigint, next bigint, left boolean, right boolean, run bigint, open boolean"

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("r").reset_index(drop=True)
        p = np.empty(len(g), np.int64)
        p[np.lexsort((g["line"], g["key"]))] = np.arange(len(g))
        prev, follow = g["prev"].to_numpy(), g["next"].to_numpy()
        least, found = _nearest_earlier(p, prev)
        back, behind = (x[::-1] for x in _nearest_earlier(p[::-1], follow[::-1]))
        run = np.maximum(g["run"], np.maximum(np.where(found, least, 0), np.where(behind, back, 0)))
        left = g["left"].to_numpy() & ~found & (least > 0)
        right = g["right"].to_numpy() & ~behind & (back > 0)
        keep = np.flatnonzero(left | right)
        out = g.assign(left=left, right=right, run=run, open=left | right)
        if len(keep):  # links between what is kept are the least of those skipped
            starts = np.concatenate([[0], keep[:-1] + 1])
            out.loc[keep, "prev"] = np.minimum.reduceat(prev[: keep[-1] + 1], starts)
            out.loc[keep, "next"] = np.minimum.reduceat(follow, keep)
        return out

    last = rows.agg(F.max("r")).first()[0]
    if last is None:
        return rows.select("r", "run")
    steps, size = Steps(rows, "runs"), BLOCK
    while True:
        found = rows.groupBy(F.floor(F.col("r") / size).alias("b")).applyInPandas(settle, schema)
        if size > last:  # one block: nothing lies beyond
            steps.add(found.withColumn("open", F.lit(False)))
            return steps.all().filter("not open").select("r", "run")
        rows = steps.add(found).filter("open")
        size *= FAN


def repeated_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, mask) of :func:`_masks`, as a written table."""
    return settled(docs.sparkSession, "masks", lambda: _masks(docs, text, min_words))


def _masks(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """(_key, mask) for the documents that lose lines: mask[i] is false where line i goes; lines beyond the mask stay."""
    lines = written(_lines(docs, text), "lines")
    twice = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    suffixes = written(_suffixes(lines.join(twice, "id")), "suffixes")
    classes = suffixes.groupBy("suffix").agg(
        F.min(F.struct("key", "line")).alias("at"), F.first("head").alias("head"), F.first("next").alias("next")
    )
    classes = written(classes.select("suffix", "at.key", "at.line", "head", "next"), "classes")
    order = written(suffix_order(classes).join(classes.drop("next"), "suffix"), "order")
    first = order.select("r", "key", "line")
    runs = earlier_runs(first, neighbour_prefixes(order))
    firsts = first.join(runs, "r", "left").select("key", "line", F.coalesce("run", F.lit(0)).alias("run"))
    # a suffix that is not the first of its kind occurs earlier as a whole
    places = suffixes.select("key", "line", "words", "length").join(firsts, ["key", "line"], "left")
    places = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "words", F.coalesce("run", "length").alias("run")))).alias("ls"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, masks = [], []
            for key, ls in zip(batch.column("key").to_pylist(), batch.column("ls").to_pylist()):
                n = ls[-1]["line"] + 1
                words, run = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
                for x in ls:
                    words[x["line"] + 1], run[x["line"]] = x["words"], x["run"]
                words = np.cumsum(words)
                start = np.flatnonzero(run)
                stop = start + run[start]
                long_ = words[stop] - words[start] >= min_words
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, start[long_], 1)
                np.add.at(depth, stop[long_], -1)
                mask = np.cumsum(depth)[:n] == 0
                if not mask.all():
                    keys.append(key)
                    masks.append(mask.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(masks, pa.list_(pa.bool_()))], names=[KEY, "mask"])

    return places.mapInArrow(cut, f"{KEY} bigint, mask array<boolean>")


def dedup_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (with ``_key``) with _lines and _dropped (numbers of lines) and the text without the lines deleted."""
    mask, columns = fresh(docs, "mask"), [c for c in docs.columns if c.lower() not in ("_lines", "_dropped")]
    masks = repeated_lines(docs, text, min_words).withColumnRenamed("mask", mask)
    joined = docs.join(masks.hint("shuffle_hash"), KEY, "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get(F.col(mask), i), F.lit(True))), "\n")
    lost = F.coalesce(F.size(F.filter(mask, lambda m: ~m)), F.lit(0)).cast("bigint")
    return joined.select(
        *[F.when(F.col(mask).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("_lines"),
        F.when(F.col(mask).isNull(), 0).otherwise(lost).alias("_dropped"),
    )


@llm_query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = dedup_lines(docs)
    return out.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
        F.length("text").cast("bigint").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )
