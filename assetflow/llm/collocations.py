"""Phrase collocations by marginalising the longest windows.

Every word begins one window of ``LONGEST`` words, its lead columns w1 to w4; where the piece ends the window is padded with ''.  Only these
windows are counted.  How often a shorter phrase occurs is the sum over the windows it opens: Spark's ROLLUP over (lang, w1, w2, w3, w4)
gives the frequencies of all phrases of 1 to 4 words, and of the words of each language, from the one table of windows.

Most windows of a big table occur once, and none of them matters: all parts of a candidate are as frequent as it.  So windows first
meet in buckets by their first two words, packed: a task sorts a slice's windows by bucket and hands on one compressed block for each.  A
bucket holds all windows of a pair, so it knows how often each phrase of two to four words that opens a window occurs, and pads
windows after the last word with which they still occur ``least`` times.  What is left for ROLLUP is small.  Nothing is estimated, and
what is shuffled is in proportion to the words.

A very common pair would fill its bucket: pairs that make up a good part of a bounded sample are dealt out by three words, and such
triples by four.  A pair found ``least`` times in the sample occurs as often in the table, so it needs no bucket of its own; the sample
decides where windows meet, never what is counted.  Tasks count the windows of a slice before they pack them, so a very common
window is one entry of each slice.

Defined cases: a null or empty text has no words; a null language is ``und``, together with rows that say so; a very long text is
read in parts cut between pieces; repeated rows count as often as they occur; empty tables give no rows; other columns are not
read, so their names cannot clash; equal scores are ordered by frequency and then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import LOWER, Words, mix, python_ready, written
from assetflow.llm.slices import runs, slices, strings
from assetflow.session import table

LONGEST, LEAST, TOP = 4, 30, 2000
SLICE_BYTES, PARTS = 4 << 20, 256
SAMPLE_BYTES, HEAVY = 16 << 20, 0.002  # the sample that finds common pairs, and the share of its words from which a pair is one
# Pieces end at these characters, words are divided by blanks and tabs.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
ANY = np.ones(256, bool)
COLUMNS = [f"w{i + 1}" for i in range(LONGEST)]
CODEC = "zstd"


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """For each slice of a batch (text, lang): its words, their texts' rows, and whether the next word is in the same piece."""
    for part in slices(batch, "text", ENDS, SLICE_BYTES):
        data = LOWER[part.data]
        inside = WORD[data]
        starts, ends, owner = runs(inside, part.offsets)
        if not len(starts):
            continue
        words = strings(data, inside, starts, ends).dictionary_encode()
        piece = np.concatenate([[0], np.cumsum(ENDS[data])])[starts]
        goes_on = np.append((piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False)
        yield words, owner + part.first, goes_on


def prefix_keys(words: pa.DictionaryArray, lang: np.ndarray, goes_on: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word's first two, three and four words, with the language; a window ends with its piece."""
    own = Words(words.dictionary, ANY).hashes[words.indices.to_numpy()]
    key, reach, out = mix(own + lang), np.ones(len(own), bool), []
    for i in range(1, LONGEST):
        reach = reach & np.append(goes_on[i - 1 :], np.zeros(i - 1, bool))
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(reach, np.append(own[i:], np.zeros(i, np.uint64)), np.uint64(0)))
        out.append(key)
    return out


def lang_codes(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The batch's languages, the language of each row by number, and a hash of it."""
    names = batch.column("lang").dictionary_encode()
    code = names.indices.to_numpy()
    hashes = np.array([hash_text(s) for s in names.dictionary.to_pylist()], np.uint64)
    return names.dictionary, code, hashes[code] if len(code) else np.zeros(0, np.uint64)


def hash_text(s: str) -> np.uint64:
    own = Words(pa.array([s + "\x00"]), ANY).hashes
    return own[0]


def common_prefixes(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """Hashes of pairs and triples that make up ``HEAVY`` of a sample and occur ``least`` times in it; 2 / ``HEAVY`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, hashes = lang_codes(batch)
            for words, row, goes_on in tokens(batch):
                keys = prefix_keys(words, hashes[row], goes_on)
                for key in keys[:2]:
                    key, n = np.unique(key, return_counts=True)
                    often = n > 1 + len(words) * HEAVY / 8
                    yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([len(words)])], names=["key", "n"])

    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    some = rows if share == 1.0 else rows.sample(share, 11)
    counts = python_ready(some).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    total = counts.filter("key is null").first()
    if total is None:
        return np.zeros(0, np.uint64)
    got = counts.filter(F.col("key").isNotNull() & (F.col("n") >= max(least, total.n * HEAVY))).select("key").toArrow()
    return np.sort(got.column("key").to_numpy().view(np.uint64))


def packed(words: list[str], codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Windows (rows of places in ``words``) and their counts as one compressed block."""
    text = "\n".join(words).encode()  # a line feed ends a piece, so no word holds one
    place = codes.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
    n = counts.astype(np.uint8 if counts.max() < 256 else np.int64)
    body = place.T.tobytes() + n.tobytes() + text
    head = np.array([len(codes), len(words), place.itemsize, n.itemsize, len(body)], np.int64).tobytes()
    return head + pa.compress(body, CODEC, asbytes=True)


def unpacked(block: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows, _, wide, high, size = np.frombuffer(block, np.int64, 5).tolist()
    body = pa.decompress(block[40:], size, CODEC, asbytes=True)
    at = rows * LONGEST * wide
    codes = np.frombuffer(body, f"u{wide}", rows * LONGEST).reshape(LONGEST, rows).astype(np.int64)
    return body[at + rows * high :].decode().split("\n"), codes, np.frombuffer(body, f"{'u' if high == 1 else 'i'}{high}", rows, at).astype(np.int64)


def windows(rows: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, lang, level, block): padded windows, counted slice by slice; all windows with the same first ``level`` words share a bucket."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code, hashes = lang_codes(batch)
            for words, row, goes_on in tokens(batch):
                two, three, four = prefix_keys(words, hashes[row], goes_on)
                level = np.where(np.isin(two, held.value), np.where(np.isin(three, held.value), 4, 3), 2)
                bucket = (np.choose(level - 2, [two, three, four]) % np.uint64(buckets)).astype(np.int64)
                index, pad = words.indices.to_numpy(), len(words.dictionary)
                lead, reach = {"bucket": bucket, "lang": code[row], "level": level, COLUMNS[0]: index}, np.ones(len(index), bool)
                for i, c in enumerate(COLUMNS[1:], 1):  # the word i places on, or the padding
                    reach = reach & np.append(goes_on[i - 1 :], np.zeros(i - 1, bool))
                    lead[c] = np.where(reach, np.append(index[i:], np.zeros(i, index.dtype)), pad)
                got = pa.table(lead).group_by(list(lead)).aggregate([([], "count_all")])
                column = {c: got[c].to_numpy() for c in got.column_names}
                order = np.lexsort([column[c] for c in [*COLUMNS[::-1], "level", "lang", "bucket"]])
                column = {c: v[order] for c, v in column.items()}
                codes = np.stack([column[c] for c in COLUMNS], 1)
                new = np.zeros(len(order), bool)
                new[:1] = True
                for c in ("bucket", "lang", "level"):
                    new[1:] |= column[c][1:] != column[c][:-1]
                text = [*words.dictionary.to_pylist(), ""]
                at = np.append(np.flatnonzero(new), len(order)).tolist()
                blocks = []
                for a, b in zip(at[:-1], at[1:]):
                    own, place = np.unique(codes[a:b], return_inverse=True)
                    blocks.append(packed([text[i] for i in own.tolist()], place.reshape(b - a, LONGEST), column["count_all"][a:b]))
                firsts = np.array(at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column["bucket"][firsts]), names.take(pa.array(column["lang"][firsts])), pa.array(column["level"][firsts]), pa.array(blocks, pa.binary())],
                    names=["bucket", "lang", "level", "block"],
                )

    return python_ready(rows).mapInArrow(pack, "bucket bigint, lang string, level bigint, block binary")


def settled_windows(blocks: DataFrame, least: int) -> DataFrame:
    """(lang, w1, ..., w4, n): the windows of each bucket, padded after the last word with which they occur ``least`` times."""
    kinds = pa.schema([("lang", pa.string()), *[(c, pa.string()) for c in COLUMNS], ("n", pa.int64())])

    def settle(group: pa.Table) -> pa.Table:
        out = []
        langs, levels, blocks_ = (group.column(c).to_pylist() for c in ("lang", "level", "block"))
        for lang, level in sorted(set(zip(langs, levels))):
            text, codes, counts, base = [], [], [], 0
            for other, other_level, block in zip(langs, levels, blocks_):
                if (other, other_level) == (lang, level):
                    words, place, n = unpacked(block)
                    text.append(pa.array(words))
                    codes.append(place + base)
                    counts.append(n)
                    base += len(words)
            known = pa.concat_arrays(text).dictionary_encode()
            column = known.indices.to_numpy()[np.concatenate(codes, 1)].astype(np.int64)
            pad, n = len(known.dictionary), np.concatenate(counts)
            empty = known.dictionary.index("").as_py()
            column[column == empty] = pad
            order = np.lexsort(column[::-1])
            column, n = column[:, order], n[order]
            new = np.zeros(len(n), bool)
            new[:1] = True
            for k in range(LONGEST):  # runs of the first k + 1 words, and how often they occur
                new[1:] |= column[k, 1:] != column[k, :-1]
                if k + 1 >= level:
                    head = np.flatnonzero(new)
                    few = np.repeat(np.add.reduceat(n, head) < least, np.diff(np.append(head, len(n))))
                    column[k:, few] = pad
                    new[1:] = False  # words beyond are padded now: runs are taken anew from what is left
                    for j in range(k + 1):
                        new[1:] |= column[j, 1:] != column[j, :-1]
            texts = pa.concat_arrays([known.dictionary, pa.array([""])])
            got = pa.table({**{c: column[i] for i, c in enumerate(COLUMNS)}, "n": n}).group_by(COLUMNS).aggregate([("n", "sum")])
            words_ = [texts.take(got[c].combine_chunks()) for c in COLUMNS]
            out.append(pa.Table.from_arrays([pa.repeat(lang, len(got)), *words_, got["n_sum"].combine_chunks()], schema=kinds))
        return pa.concat_tables(out)

    return blocks.groupBy("bucket").applyInArrow(settle, ", ".join(["lang string", *[f"{c} string" for c in COLUMNS], "n bigint"]))


def phrase_counts(rows: DataFrame, least: int, buckets: int | None = None) -> DataFrame:
    """(lang, words, f) of all phrases of 1 to 4 words with f >= ``least``, and of no words: all word occurrences of the language."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if buckets is None:  # of a megabyte of text, or of 64 where that makes very many
        buckets = max(-(-size >> 26), min(-(-size >> 20), 1024), 1)
    counted = settled_windows(windows(rows, common_prefixes(rows, size, least), buckets), least)
    rolled = counted.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # level k has the first k columns; a padded column is no phrase of that level
    whole = F.col("lang").isNotNull()
    for c in COLUMNS:
        whole = whole & F.coalesce(F.col(c) != "", F.lit(True))
    rolled = rolled.filter(whole & ((F.col("f") >= least) | (F.col("g") == (1 << LONGEST) - 1)))
    return rolled.select("lang", F.filter(F.array(*COLUMNS), lambda w: w.isNotNull()).alias("words"), "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    phrases = written(phrase_counts(rows, least, buckets), "phrases")
    size, joined = F.size("words"), lambda w: F.array_join(w, " ")
    totals = phrases.filter(size == 0).select("lang", F.col("f").alias("n"))
    known = phrases.filter(size > 0).select("lang", joined("words").alias("part"), "f")
    many = phrases.filter(size > 1).select("lang", "words", joined("words").alias("phrase"), F.col("f").alias("a"))

    cut = many.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.slice("words", 1, F.col("k"))).alias("first"), joined(F.slice("words", F.col("k") + 1, LONGEST)).alias("rest"))
    cut = cut.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = lambda c, digits=19: c.cast(f"decimal({digits},0)")
    score = F.call_function("div", wide(F.lit(2_000_000), 7) * wide(F.col("a")), wide(F.col("l")) + wide(F.col("r")))
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    parts = lambda i: F.transform(F.sequence(F.lit(1), F.size("words") - i + 1), lambda at: joined(F.slice("words", at, i)))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), parts))
    longer = many.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = best.join(longer, ["lang", "phrase"], "left")
    held = held.filter(F.col("f").isNull() | (wide(F.col("f")) * 100 < wide(F.col("a")) * 80))
    held = held.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # a language is divided, and each part hands on its first ``top``; the totals come to what is left
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    within = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best_first))
    first = held.withColumn("rank", within).filter(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").withColumn("rank", F.col("rank").cast("bigint"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@llm_query(
    "op12_collocations",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
    piece AS (SELECT i, lang, unnest(s) AS p, generate_subscripts(s, 1) AS j FROM (SELECT i, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS s FROM d)),
    word AS (SELECT i, j, lang, unnest(s) AS w1, generate_subscripts(s, 1) AS k FROM (SELECT i, j, lang, regexp_extract_all(p, '[^\x20\x09]+') AS s FROM piece)),
    win AS (SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4 FROM word WINDOW x AS (PARTITION BY i, j ORDER BY k)),
    f AS (SELECT lang, 1 AS size, w1 AS phrase, [w1] AS words, count(*)::HUGEINT AS a FROM win GROUP BY ALL
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, [w1, w2], count(*) FROM win WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, [w1, w2, w3], count(*) FROM win WHERE w3 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, [w1, w2, w3, w4], count(*) FROM win WHERE w4 IS NOT NULL GROUP BY ALL),
    total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE size > 1 AND a >= {LEAST}),
    cut AS (SELECT lang, phrase, a, k, array_to_string(words[:k], ' ') AS l, array_to_string(words[k + 1:], ' ') AS r
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
    scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (2000000 * cut.a) // (x.a + y.a) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.l JOIN f y ON y.lang = cut.lang AND y.phrase = cut.r),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT b.lang, b.phrase FROM best b JOIN c ON c.lang = b.lang AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
        AND c.phrase <> b.phrase AND 100 * c.a >= 80 * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a,
      l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM best JOIN total USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)
    QUALIFY rank <= {TOP}
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to four words of each language."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
