"""N-gram Jaccard join with rare-first prefix filtering.

A document is the set of its distinct word n-grams; two link if their Jaccard similarity reaches ``num / den``.  Documents
of equal sets are one node.  N-grams are ordered from rare to frequent, so that similar sets share one of the first
``size - ceil(size * num / den) + 1`` of each: only these prefixes are joined.  Frequencies come from a table of counts by hash of
a fixed size, added up over all documents; any order that all documents share gives right results, a good one keeps groups small.

An n-gram whose documents are all too unlike in size for the length filter goes at once, and later so does each row (n-gram, document)
without another of a fitting size: in a large table many n-grams are shared by chance, and rows would grow faster than the input.
Candidates pass a length filter, a positional filter (what may still follow the shared n-gram) and a suffix filter in two steps, each
of which bounds the difference of two sets from below: rows carry for each of 128 parts by hash whether the set has an odd number of
n-grams there, and pairs are compared by their numbers in parts of some eight n-grams, however long the texts are.  Then each pair is
verified once on its whole sets.  First every group's documents are compared with the group's first one.  Afterwards only pairs of
documents that are not yet connected are compared, all of them: no link between groups is lost, and a large group of near copies does
not have to be written out as pairs.

Defined cases: null, empty and blank texts have no set and link with nothing; a text of fewer words than n is one n-gram; repeated
rows and ids are documents of their own and link like any copies; very long texts are read whole; an empty table gives
no rows; other columns are ignored.  N-grams are compared by 64-bit hashes, equal sets by their size and two sums of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import KEY, WHITE, Words, bitmap, chunks, in_bitmap, keyed, mix, python_ready, settled, written
from assetflow.llm.components import components
from assetflow.session import table

COUNTERS, COUNTER_BLOCK = 1 << 22, 1 << 14
ODD, IN_PART = 128, 8  # parts of which rows carry whether they are odd; n-grams in a part whose number pairs are compared by
LISTED = 8  # n-grams before one's own that a row of a shared n-gram carries
FAN = 64  # tasks whose counts are added up at once
KEY_BITS, GRAM_BITS = 23, 26  # of the bitmaps of wanted keys and shared n-grams, which only thin out what is read


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = Words(texts, WHITE)
    grams = words.grams(n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            few = mix(words.hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append(mix(few.sum(keepdims=True, dtype=np.uint64) ^ np.uint64(b - a)) if b > a else few)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parts(size: int) -> int:
    """Into how many parts by hash a set is split, a power of two."""
    return 1 << max(4, (size // IN_PART).bit_length())


def _by_hash(grams: np.ndarray, parts: int) -> np.ndarray:
    """How many n-grams are in each part of the hashes' range."""
    return np.bincount((grams >> np.uint64(65 - parts.bit_length())).astype(np.int64), minlength=parts)


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of n-grams that only one of two sets has, by their numbers (255 at most) in parts."""
    s, t = (np.frombuffer(b, np.uint8).astype(np.int64) for b in (x, y))
    parts = min(len(s), len(t))
    s, t = (np.minimum(v.reshape(parts, -1).sum(1), 255) for v in (s, t))
    return int(np.abs(s - t).sum())


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a block; most are small, so they shrink to a tenth."""
    return pa.compress(counts.astype(np.uint32, copy=False).tobytes(), codec="zstd", asbytes=True)


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, COUNTER_BLOCK * 4, codec="zstd"), np.uint32)


@dataclass(frozen=True)
class Rule:
    """n-grams and threshold, and what tasks do with batches of texts."""

    text: str
    n: int
    num: int
    den: int

    def measure(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["key", "size", "s1", "s2", "odd1", "odd2", "parts", "task", "block", "counts"]
        seen = False
        for whole in batches:
            for batch in chunks(whole, self.text):
                sets = gram_sets(batch.column(self.text), self.n)
                size = np.array([len(s) for s in sets], np.int64)
                total = lambda f: np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                if size.any():
                    seen = True
                    np.add.at(counts, (np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), 1)
                fields = [batch.column(KEY), pa.array(size), _signed(total(lambda s: s)), _signed(total(lambda s: mix(s ^ np.uint64(0x5DEECE66D))))]
                odd = np.packbits(np.stack([_by_hash(s, ODD) & 1 for s in sets]).astype(np.uint8), axis=1).view(np.int64)
                split = [np.minimum(_by_hash(s, _parts(len(s))), 255).astype(np.uint8).tobytes() for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                fields += [*map(pa.array, odd.T.copy()), pa.array(split, pa.binary()), none, none, pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(fields, names=names)
        if seen:
            parts = counts.reshape(-1, COUNTER_BLOCK)
            empty, none = pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary())
            task = pa.array(np.full(len(parts), TaskContext.get().partitionId(), np.int64))
            fields = [*[empty] * 6, none, task, pa.array(np.arange(len(parts))), pa.array([_packed(p) for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, names=names)

    def sets(self, batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The sets of the documents whose key the bitmap ``wanted`` holds."""
        for whole in batches:
            own = whole.filter(pa.array(in_bitmap(wanted, whole.column(KEY).to_numpy())))
            for batch in chunks(own, self.text):
                found = gram_sets(batch.column(self.text), self.n)
                yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "grams"])

    def prefixes(
        self, batches: Iterator[pa.RecordBatch], frequency: np.ndarray, wanted: np.ndarray, shared: np.ndarray | None = None
    ) -> Iterator[pa.RecordBatch]:
        """The rare n-grams of each set whose key the bitmap ``wanted`` holds; with ``shared`` only those that it may hold."""
        for whole in batches:
            own = whole.filter(pa.array(in_bitmap(wanted, whole.column(KEY).to_numpy())))
            for batch in chunks(own, self.text):
                keys = batch.column(KEY).to_numpy()
                grams, owner, size, place = [], [], [], []
                for k, s in zip(keys, gram_sets(batch.column(self.text), self.n)):
                    if not len(s):
                        continue
                    take = len(s) - -(-len(s) * self.num // self.den) + 1
                    rare = np.argsort(frequency[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[:take]
                    grams.append(s[rare])
                    owner.append(np.full(take, k))
                    size.append(np.full(take, len(s), np.int32))
                    place.append(np.arange(1, take + 1, dtype=np.int32))
                if grams:
                    columns = [np.concatenate(grams).view(np.int64), *[np.concatenate(c) for c in (owner, size, place)]]
                    if shared is not None:
                        keep = in_bitmap(shared, columns[0])
                        columns = [c[keep] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "key", "size", "place"])


class JaccardJoin:
    """The join of one table ``docs`` (_key, text)."""

    def __init__(self, docs: DataFrame, rule: Rule):
        self.docs, self.rule, self.held = docs.select(KEY, rule.text), rule, []

    def _everywhere(self, values: np.ndarray) -> Broadcast:
        self.held.append(self.docs.sparkSession.sparkContext.broadcast(values))
        return self.held[-1]

    def release(self) -> None:
        """Free what was broadcast, on the driver too, once the result is written."""
        while self.held:
            self.held.pop().destroy()

    # -------------------------------------------------------------- sizes, equal sets, frequencies
    def measure(self) -> None:
        schema = "key bigint, size bigint, s1 bigint, s2 bigint, odd1 bigint, odd2 bigint, parts binary, task bigint, block bigint, counts binary"
        rows = written(python_ready(self.docs).mapInArrow(self.rule.measure, schema), "sets")
        self.sizes = rows.filter("key is not null").select(F.col("key").alias(KEY), "size", "s1", "s2", "odd1", "odd2", "parts")
        same = self.sizes.filter("size > 0").groupBy("size", "s1", "s2").agg(F.min(KEY).alias("rep"))
        self.reps = written(self.sizes.join(same, ["size", "s1", "s2"]).select(KEY, "size", "odd1", "odd2", "rep"), "reps")

        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(COUNTER_BLOCK, np.uint64)
            for c in group.column("counts"):
                total += _counts(c.as_py())
            total = _packed(np.minimum(total, 2**32 - 1))
            return pa.table({"task": group.column("task")[:1], "block": group.column("block")[:1], "counts": pa.array([total], pa.binary())})

        sums = rows.filter("block is not null").select("task", "block", "counts")
        last = rows.agg(F.max("task")).first()[0] or 0
        while True:  # up to FAN tasks at a time, until all are in one sum
            last //= FAN
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN))
            sums = sums.groupBy("task", "block").applyInArrow(add, "task bigint, block bigint, counts binary")
            if not last:
                break
        got = sums.toArrow()  # COUNTERS numbers
        frequency = np.zeros(COUNTERS, np.uint32)
        for block, counts in zip(got.column("block").to_pylist(), got.column("counts").to_pylist()):
            frequency[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK] = _counts(counts)
        self.frequency = self._everywhere(frequency)

    # -------------------------------------------------------------- prefixes and candidates
    def candidates(self) -> None:
        """Prefix n-grams that different sets share, at least two of them of fitting sizes."""
        rule, frequency = self.rule, self.frequency
        kinds = "gram bigint, key bigint, size int, place int"
        firsts = self.reps.filter(F.col(KEY) == F.col("rep")).select(F.col(KEY).alias("key"), "odd1", "odd2")
        heads = self._everywhere(bitmap(firsts.select(F.col("key").alias("value")), KEY_BITS))
        every = self.docs.mapInArrow(lambda batches: rule.prefixes(batches, frequency.value, heads.value), kinds)
        twice = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        marks = self._everywhere(bitmap(twice.select(F.col("gram").alias("value")), GRAM_BITS))
        likely = self.docs.mapInArrow(lambda batches: rule.prefixes(batches, frequency.value, heads.value, marks.value), kinds)
        fitting = likely.withColumn("fits", self._fits(F.lag)).withColumn("fits", F.max("fits").over(Window.partitionBy("gram")))
        some = fitting.filter("fits").drop("fits")
        self.shared = some.join(firsts, "key")  # the bitmap lets copies of equal sets pass

    def _fits(self, beside: Callable[[Column], Column]) -> Column:
        """Whether the row before (``lag``) or after (``lead``), by size among those of an n-gram, passes the length filter."""
        size = F.col("size").cast("bigint")
        other = beside(size).over(Window.partitionBy("gram").orderBy("size"))
        return other.isNotNull() & (F.least(size, other) * self.rule.den >= F.greatest(size, other) * self.rule.num)

    def _overlap(self, a: Column, b: Column) -> Column:
        """The least number of shared n-grams with which two sizes link."""
        return F.ceil((a + b) * self.rule.num / (self.rule.num + self.rule.den))

    def _may_link(self, a: str, b: str) -> Column:
        """Length and positional filter and first step of the suffix filter on two rows of ``shared``."""
        c = lambda side, name: F.col(f"{side}.{name}")
        need = self._overlap(c(a, "size"), c(b, "size"))
        length = F.least(c(a, "size"), c(b, "size")) * self.rule.den >= F.greatest(c(a, "size"), c(b, "size")) * self.rule.num
        # before the shared n-gram at most what both have there can be shared as well
        rest = lambda s: c(s, "size") - c(s, "place")
        position = F.least(c(a, "place"), c(b, "place")) + F.least(rest(a), rest(b)) >= need
        # a part that is odd in one set only holds an n-gram that the other lacks
        apart = F.bit_count(c(a, "odd1").bitwiseXOR(c(b, "odd1"))) + F.bit_count(c(a, "odd2").bitwiseXOR(c(b, "odd2")))
        return length & position & (apart <= c(a, "size") + c(b, "size") - 2 * need)

    def _near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the second step of the suffix filter."""
        num, both = self.rule.num, self.rule.num + self.rule.den

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, of_a, of_b = (batch.column(c) for c in ("sizes", "of_a", "of_b"))
                keep = [_apart(x.as_py(), y.as_py()) <= n + 2 * (-n * num // both) for n, x, y in zip(sizes.to_pylist(), of_a, of_b)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        of = lambda side: self.sizes.select(F.col(KEY).alias(side), F.col("size").alias(f"n_{side}"), F.col("parts").alias(f"of_{side}"))
        met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "of_a", "of_b")
        return met.mapInArrow(near, "a bigint, b bigint")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        num, both = self.rule.num, self.rule.num + self.rule.den

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                    keep.append(int((s[at] == t).sum()) * both >= num * (len(s) + len(t)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def links() -> DataFrame:
            some = written(pairs, "pairs")
            if some.isEmpty():
                return some.select("a", "b")
            own = written(some.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
            rule, wanted = self.rule, self._everywhere(bitmap(own.withColumnRenamed("key", "value"), KEY_BITS))
            sets = self.docs.mapInArrow(lambda batches: rule.sets(batches, wanted.value), "key bigint, grams binary")
            sets = written(sets.join(own, "key", "left_semi"), "sets")
            x = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
            y = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
            return some.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")

        return settled(self.docs.sparkSession, "links", links)  # the sets are deleted

    def _between(self, named: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows (gram, key, size, place, odd1, odd2, group) in different groups that may link.  A pair that also shares one of
        the LISTED n-grams before this one, on both sides, comes from there: similar documents share most of their rare n-grams."""
        earlier = Window.partitionBy("key").orderBy("place").rowsBetween(-LISTED, -1)
        rows = written(named.withColumn("earlier", F.collect_list("gram").over(earlier)), "open")
        pairs = rows.alias("a").join(
            rows.alias("b"),
            (F.col("a.gram") == F.col("b.gram"))
            & (F.col("a.key") < F.col("b.key"))
            & (F.col("a.group") != F.col("b.group"))
            & self._may_link("a", "b")
            & ~F.arrays_overlap("a.earlier", "b.earlier"),
        )
        return pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(node, component) by the links with a group's first document, and (node, component) of those components by all other links."""
        rows = written(self.shared, "rows")
        least = F.first(F.struct("key", "size", "place", "odd1", "odd2")).over(Window.partitionBy("gram").orderBy("key"))
        met = rows.select(least.alias("a"), F.struct("key", "size", "place", "odd1", "odd2").alias("b"))
        pairs = met.filter((F.col("a.key") < F.col("b.key")) & self._may_link("a", "b"))
        pairs = self._near(pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct())
        pairs = written(pairs, "first-pairs")
        known = written(components(self.verify(pairs)), "known")
        named = rows.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key")).drop("component")
        of_gram = Window.partitionBy("gram")
        open_ = (F.min("group").over(of_gram) < F.max("group").over(of_gram)) & (self._fits(F.lag) | self._fits(F.lead))
        named = named.withColumn("open", open_).filter("open").drop("open")
        later = self._between(named).distinct()
        # pairs that failed above are not verified again
        found = self.verify(self._near(later.join(pairs, ["a", "b"], "left_anti")))
        between = found.join(known.toDF("a", "ga"), "a", "left").join(known.toDF("b", "gb"), "b", "left")
        return known, components(between.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))

    def run(self) -> DataFrame:
        """(_key, size, component): a row for each document."""
        self.measure()
        self.candidates()
        known, above = self.groups()
        of_rep = self.reps.join(known, F.col("rep") == F.col("node"), "left").select(KEY, F.coalesce("component", "rep").alias("group"))
        of_rep = of_rep.join(above, F.col("group") == F.col("node"), "left").select(KEY, F.coalesce("component", "group").alias("component"))
        return self.sizes.select(KEY, "size").join(of_rep, KEY, "left").select(KEY, "size", F.coalesce("component", KEY).alias("component"))


def jaccard_components(docs: DataFrame, text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(_key, size, component) for ``docs`` with ``_key``."""
    join = JaccardJoin(docs, Rule(text, n, num, den))
    try:
        return settled(docs.sparkSession, "alike", join.run)
    finally:
        join.release()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that are connected with a row of a smaller id."""
    rows = keyed(docs, id_col)
    extra = jaccard_components(rows, text, n, num, den).filter(F.col("component") < F.col(KEY)).select(KEY)
    return rows.join(extra.hint("shuffle_hash"), KEY, "left_anti").select(*docs.columns)


@llm_query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles are alike by 0.9 or more."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = jaccard_components(docs, "text", 3, 90, 100)
    names = docs.select(F.col(KEY).alias("component"), F.col("doc_id").alias("component_id"))
    return docs.select(KEY, "doc_id").join(out, KEY).join(names, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
