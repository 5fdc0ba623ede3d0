"""Benchmark decontamination by winnowing.

A window is ``size`` (10) consecutive words of a benchmark item; an item of fewer words is one window.  Both sides keep, in every
run of ``size - k + 1`` neighbouring k-grams, the one of least hash (of equal ones the last).  Texts that share a window share such a
fingerprint: it is selected by the hashes inside the window alone.  Document fingerprints go through a bitmap of the benchmark's
fingerprints, of fixed size, inside the task that reads the text; the few that pass are joined with the benchmark on
the fingerprint together with each window around it, which extends the hit to a whole shared window.  All windows that
cover a fingerprint are tried, so every shared window, and so every longer shared span, is found.

The bitmap only thins out what is shuffled: it has ``BITMAP_BITS`` bits however large the benchmark is, and the join decides.
A window that very many items hold is one row of the joined side; items are put back afterwards, by distinct (document, window).

Defined cases: a null or empty text has no words, no hits and is kept; a null or empty item has no window; an item of fewer than
``size`` words is looked for as a whole; repeated items each count; repeated rows and null ids of documents get their own
results; empty tables on either side give no hits; columns of ``docs`` that clash with the results are replaced, others stay.
Hashes have 64 bits; windows are compared by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import ALNUM, KEY, Words, chunks, keyed, mix, python_ready, written
from assetflow.session import table

SIZE, K = 10, 5
BITMAP_BITS = 1 << 23


def winnow(grams: np.ndarray, owner: np.ndarray, run: int) -> np.ndarray:
    """Positions of the fingerprints: the last least gram of every ``run`` neighbouring grams of one text."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    if run == 1:
        return np.arange(len(grams))
    inside = np.flatnonzero(owner[: len(owner) - run + 1] == owner[run - 1 :])
    if not len(inside):
        return inside
    backwards = sliding_window_view(grams, run)[inside, ::-1]
    return np.unique(inside + run - 1 - backwards.argmin(1))


class Spans:
    """Fingerprints and windows of ``size`` words in a run of texts."""

    def __init__(self, words: Words, size: int):
        self.k = k = min(K, size)
        self.size = size
        self.reach = size - k  # a window with the fingerprint at p starts at p - reach ... p
        n = np.diff(words.first)
        owner = np.repeat(np.arange(len(n)), n)
        self.first = words.first
        total = len(words.hashes)
        inside = lambda m: np.flatnonzero(owner[: max(total - m + 1, 0)] == owner[m - 1 :]) if total >= m else np.zeros(0, np.int64)
        at = inside(k)  # grams that stay in one text
        grams = words.grams(k)[at] if len(at) else np.zeros(0, np.uint64)
        # neighbours in ``at`` are neighbours in the text wherever the owner is the same
        picked = winnow(grams, owner[at], self.reach + 1)
        self.at, self.prints = at[picked], grams[picked]
        self.owner = owner
        windows = words.grams(size)
        self.w1 = windows
        self.w2 = mix(windows_second(words.hashes, size)) if len(windows) else windows

    def around(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``keep``, window start) of the windows inside the text that cover the kept fingerprints."""
        at = self.at[keep]
        starts = (at[:, None] - np.arange(self.reach + 1)[None, :]).ravel()
        which = np.repeat(np.arange(len(at)), self.reach + 1)
        text = self.owner[at][which]
        ok = (starts >= self.first[text]) & (starts + self.size <= self.first[text + 1])
        return which[ok], starts[ok]


def windows_second(h: np.ndarray, n: int) -> np.ndarray:
    """A second hash of n words, independent of the first by its multiplier."""
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xA24BAED4963EE407) + (h[i : len(h) - n + 1 + i] ^ np.uint64(0x9FB21C651E98DF25))
    return total


def _bits(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(17)) % np.uint64(BITMAP_BITS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def benchmark_windows(items: DataFrame, item: str, text: str, size: int = SIZE) -> DataFrame:
    """(len, fp, w1, w2, item): every window of every item, with each fingerprint it holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                words = Words(batch.column(text), ALNUM)
                counts = np.diff(words.first)
                for n in np.unique(np.minimum(counts, size)):
                    if n == 0:
                        continue
                    own = Spans(words, int(n))
                    chosen = counts >= size if n == size else counts == n
                    keep = np.flatnonzero(chosen[own.owner[own.at]])
                    which, starts = own.around(keep)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(starts), n, np.int32)),
                            _signed(own.prints[keep][which]),
                            _signed(own.w1[starts]),
                            _signed(own.w2[starts]),
                            batch.column(item).take(pa.array(own.owner[starts])),
                        ],
                        names=["len", "fp", "w1", "w2", "item"],
                    )

    kind = dict(items.dtypes)[item]
    rows = items.select(F.col(item), F.col(text))
    return python_ready(rows).mapInArrow(read, f"len int, fp bigint, w1 bigint, w2 bigint, item {kind}").distinct()


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """``BITMAP_BITS`` bits, packed; at most one number for each byte that is not 0 reaches the driver."""
    at = windows.select(F.pmod(F.shiftrightunsigned("fp", 17), F.lit(BITMAP_BITS)).alias("p")).distinct()
    by = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v"))
    words = np.zeros(BITMAP_BITS // 64, np.int64)
    got = by.toArrow()
    words[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return words.view(np.uint64)


def contamination(docs: DataFrame, items: DataFrame, id_cols: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """A row for each row of ``docs`` (that has ``_key``): ``id_cols``, n_words, n_hit, spans (the windows found, as
    word ranges in order, array<struct<start, stop>>) and items (identifiers as text, sorted)."""
    windows = written(benchmark_windows(items, item, item_text, size), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    context = docs.sparkSession.sparkContext
    bitmap = context.broadcast(fingerprint_bitmap(windows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for whole in batches:
            for batch in chunks(whole, text):
                words = Words(batch.column(text), ALNUM)
                keys = batch.column(KEY).to_numpy()
                counts = np.diff(words.first)
                none = np.zeros(len(keys), np.int64)
                out = [(keys, none.astype(np.int32), none, none, none, counts)]
                for n in lengths:
                    own = Spans(words, n)
                    p = _bits(own.prints)
                    keep = np.flatnonzero((marks[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
                    which, starts = own.around(keep)
                    text_of = own.owner[starts]
                    fields = [own.prints[keep][which], own.w1[starts], own.w2[starts]]
                    out.append((keys[text_of], np.full(len(starts), n, np.int32), *[f.view(np.int64) for f in fields], starts - own.first[text_of]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "len", "fp", "w1", "w2", "at"])

    rows = python_ready(docs.select(KEY, text)).mapInArrow(read, "key bigint, len int, fp bigint, w1 bigint, w2 bigint, at bigint")
    rows = written(rows, "prints")
    counts = rows.filter("len = 0").select(F.col("key").alias(KEY), F.col("at").alias("n_words"))
    # fingerprints meet and are extended to whole windows in one step
    known = windows.select("len", "fp", "w1", "w2").distinct()
    found = written(rows.filter("len > 0").join(known, ["len", "fp", "w1", "w2"], "left_semi").select("key", "len", "w1", "w2", "at").distinct(), "hits")
    starts = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "len"))).alias("s"))
    # words hit: what each window adds beyond the furthest end before it
    empty = F.expr("cast(struct(0L as hit, 0L as stop) as struct<hit:bigint,stop:bigint>)")
    end = lambda s: s["at"] + s["len"]
    hits = F.aggregate(
        "s",
        empty,
        lambda a, s: F.struct((a["hit"] + F.greatest(end(s) - F.greatest(s["at"], a["stop"]), F.lit(0))).alias("hit"), F.greatest(end(s), a["stop"]).alias("stop")),
    )
    per_doc = starts.select(F.col("key").alias(KEY), hits["hit"].alias("n_hit"), "s")
    owners = windows.select("len", "w1", "w2", "item").distinct()
    items_of = found.select("key", "len", "w1", "w2").distinct().join(owners, ["len", "w1", "w2"]).select("key", F.col("item").cast("string").alias("item")).distinct()
    items_of = items_of.groupBy(F.col("key").alias(KEY)).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        docs.select(KEY, *id_cols)
        .join(counts, KEY)
        .join(per_doc, KEY, "left")
        .join(items_of, KEY, "left")
        .select(
            KEY,
            *id_cols,
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce(F.transform("s", lambda s: F.struct(s["at"].alias("start"), end(s).alias("stop"))), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")).alias("spans"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark."""
    rows = keyed(docs, id_col)
    bad = contamination(rows, items, [], text, item, item_text).filter("n_hit > 0").select(KEY)
    return rows.join(bad.hint("shuffle_hash"), KEY, "left_anti").select(*docs.columns)


@llm_query(
    "op4_decontaminate",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bs),
    ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
    h AS (SELECT doc_id, i, ds.n, k.s FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM ds) ds JOIN (SELECT DISTINCT n, s FROM bw) k ON ds.n = k.n AND ds.s = k.s),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    own AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h JOIN bw ON h.n = bw.n AND h.s = bw.s) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
    """,
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows in every document."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
