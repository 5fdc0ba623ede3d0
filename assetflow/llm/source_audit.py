"""How the sources of a language differ in their words, by sorting pointers to the starts of words.

A task takes its texts in slices of Arrow buffers.  A slice gets one pointer for each word start; multikey quicksort orders the
pointers by the bytes they point at, eight at a time: pointers with the same eight bytes form a run, and only runs whose words go on
are ordered by the next eight.  What is left as an equal run is one word; its pointers' texts give the document frequency and the
counts of the sources.  The slices' sums meet in one aggregation.

Words kept in a language (in ``least`` of its documents) give every group (language, source) a smoothed share of each, in billionths.
Pairs of sources are compared in blocks of words: a task gets a block's shares of all sources as a matrix of about
``CELLS`` cells (or as many words as sources, where that is more) and hands on one partial sum for each pair; a source without the word has a share that depends on the source alone.
Nothing is broadcast by hand, and a hot source is pre-aggregated by slices.

Defined cases: null text, language and source are ''; a text without words still makes its group occur; without kept words all
pair values are 0 and there are no terms; a language with one source has no pairs; very long texts are sorted in parts and
count as one document; repeated rows are documents of their own; ids are not read; empty tables give no rows; other
columns are not read, so their names cannot clash.  All arithmetic is on integers or decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import LOWER, python_ready, written
from assetflow.llm.slices import runs, slices
from assetflow.session import table

LEAST, TOP, CELLS = 30, 50, 1 << 17
SMOOTH, SCALE = 5, 1_000_000_000
LETTER = np.zeros(256, bool)  # fixed value: words are runs of ASCII letters and non-ASCII characters
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of words by their bytes: (pointers in order, number of the equal run of each).

    Words hold no zero byte, so a word that ends inside eight bytes is filled up with zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    length = ends - starts
    order, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    open_, depth = np.ones(len(starts), bool), 0  # by place in ``order``: runs whose words may still differ
    while open_.any():
        at = np.flatnonzero(open_)
        which = order[at]
        left = length[which] - depth
        key = eight[starts[which] + depth].astype(np.uint64)
        short = (np.clip(8 - left, 0, 7) * 8).astype(np.uint64)
        key, longer = key >> short << short, left > 8
        place = np.lexsort((longer, key, run[at]) if depth else (longer, key))
        key, longer, part = key[place], longer[place], run[at][place]
        order[at] = which[place]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (longer[1:] != longer[:-1])])
        head = np.concatenate([[True], run[1:] != run[:-1]])
        head[at] = new
        run = np.cumsum(head) - 1
        # a run goes on where it has more than one word and these are longer
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        open_ = np.zeros(len(order), bool)
        open_[at] = (np.repeat(size, size) > 1) & longer
        depth += 8
    return order, run


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: the distinct words in order, and (word, text, count) of each pair that occurs."""
    starts, ends, owner = runs(LETTER[data], offsets)
    if not len(starts):
        return [], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    order, run = sort_pointers(data, starts, ends)
    first = order[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))]
    held = data.tobytes()
    words = [held[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    texts = len(offsets)
    pair, count = np.unique(run * texts + owner[order], return_counts=True)
    return words, pair // texts, pair % texts, count


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each word in each group; term '' stands for the group itself, n and
    df 0."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")}).group_by(["lang", "source"]).aggregate([])
            number = {k: i for i, k in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist()))}
            group = np.array([number[k] for k in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)

            def out(g: np.ndarray, words: list[bytes], n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
                at = pa.array(g)
                columns = [groups["lang"].combine_chunks().take(at), groups["source"].combine_chunks().take(at)]
                return pa.RecordBatch.from_arrays(
                    [*columns, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )

            none = np.zeros(len(number), np.int64)
            yield out(np.arange(len(number)), [b""] * len(number), none, none)
            parts: dict[bytes, int] = {}  # of a text that comes in several parts
            for part in slices(batch, "text", ~LETTER):
                words, word, text_, n = word_runs(LOWER[part.data], part.offsets)
                if not part.last or parts:
                    for w, c in zip(words, np.bincount(word, n, len(words)).astype(np.int64).tolist()):
                        parts[w] = parts.get(w, 0) + c
                    if part.last:
                        one = np.full(len(parts), group[part.first])
                        yield out(one, list(parts), np.fromiter(parts.values(), np.int64), np.ones(len(parts), np.int64))
                        parts = {}
                    continue
                if not len(words):
                    continue
                key, place, df = np.unique(word * len(number) + group[part.first + text_], return_inverse=True, return_counts=True)
                total = np.bincount(place, n, len(key)).astype(np.int64)
                yield out(key % len(number), [words[w] for w in (key // len(number)).tolist()], total, df)

    got = python_ready(rows).mapInArrow(count, "lang string, source string, term string, n bigint, df bigint")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, words: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 words)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH).cast("decimal(1,0)"))
    below = wide(total) + F.lit(SMOOTH).cast("decimal(1,0)") * wide(words)
    return F.when(words > 0, F.call_function("div", above, below) + 1)


def pair_sums(table_: pa.Table) -> pa.Table:
    """Sum of the differences over one block of words for each pair of sources.  Rows without a term carry what a source gives a
    word it lacks."""
    term, source, p = (table_.column(c).combine_chunks() for c in ("term", "source", "p"))
    plain = np.array([t == "" for t in term.to_pylist()], bool) if len(term) else np.zeros(0, bool)
    p, lang = p.to_numpy(zero_copy_only=False), table_.column("lang")[0]
    held = source.filter(pa.array(plain))
    order = np.argsort(np.array([s.encode() for s in held.to_pylist()], object), kind="stable")
    names = held.take(pa.array(order))
    row = {s: i for i, s in enumerate(names.to_pylist())}
    words = term.filter(pa.array(~plain)).dictionary_encode()
    cells = np.repeat(p[plain][order][:, None], len(words.dictionary), 1)
    cells[[row[s] for s in source.filter(pa.array(~plain)).to_pylist()], words.indices.to_numpy()] = p[~plain]
    a, b, f = [], [], []
    for i in range(len(cells) - 1):
        a.append(np.full(len(cells) - 1 - i, i))
        b.append(np.arange(i + 1, len(cells)))
        f.append(np.abs(cells[i + 1 :] - cells[i]).sum(1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    a, b, f = join(a), join(b), join(f)
    return pa.table({"lang": pa.repeat(lang, len(a)), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "f": pa.array(f, pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counted = written(count_words(docs, text, lang, source), "word-counts")
    words = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("docs"), F.sum("n").alias("t"))
    kept = written(words.filter(F.col("docs") >= least).select("lang", "term", "t"), "kept-words")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("t").alias("all"))
    entries = written(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "t"), "kept-counts")
    groups = counted.filter("term = ''").select("lang", "source")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "all"])
    groups = written(groups.withColumn("p", share(F.lit(0), F.col("total"), F.col("v"))), "word-groups")
    shared = entries.join(groups.drop("p"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    terms = shared.withColumn("value", F.col("p") - share(F.col("t"), F.col("all"), F.col("v"))).filter(F.col("value") > 0)
    rank = lambda part: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.select("*", rank("term")).filter(F.col("rank") <= top)

    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("v"))
    blocks = sources.select("lang", F.ceil(F.col("v") * F.col("s") / F.greatest(F.lit(CELLS), F.col("s") * F.col("s"))).cast("int").alias("blocks"))
    plain = groups.filter("v > 0").join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit("").alias("term"), "p")
    placed = shared.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    sums = python_ready(plain.unionByName(placed)).groupBy("lang", "block").applyInArrow(pair_sums, "lang string, a string, b string, f bigint")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    # languages without kept words: every pair of their sources differs by 0
    bare = groups.filter("v = 0").select("lang", "source")
    bare = bare.alias("x").join(bare.alias("y"), F.expr("x.lang = y.lang and x.source < y.source"))
    bare = bare.select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.lit(0).cast("bigint").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.unionByName(bare).select("lang", both.alias("e"), "value")
    pairs = pairs.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return pairs.select("*", rank("pair")).unionByName(terms)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@llm_query(
    "op13_source_audit",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS t FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST}),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(t)::HUGEINT AS n FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
    tot AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cnt GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + {SCALE}::HUGEINT * (coalesce(c.c, 0) + {SMOOTH}) // (coalesce(tot.n, 0) + {SMOOTH} * l.v) AS p,
        1 + {SCALE}::HUGEINT * (k.t + {SMOOTH}) // (l.n + {SMOOTH} * l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN tot USING (lang, source) LEFT JOIN cnt c USING (lang, source, term)),
    diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN diff f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= {TOP}
    """,
)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the words that set each apart."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
