"""Language identification by rank-order profiles.

A language's profile holds its most frequent character n-grams (1 to 4 bytes of UTF-8, words padded with a blank) in order of
frequency.  A text gets the same list of its own n-grams; its distance to a profile is the sum, over the text's n-grams, of
how far the two ranks are apart, and an n-gram that the profile lacks counts as far as the profile is long.  The
nearest profile names the language.

Texts are lower-cased and every run of characters other than letters and marks is one blank.  N-grams of up to four bytes are
numbers of 32 bits, so a slice of texts is counted by sorting numbers.  N-grams that are equally frequent in a text share
their middle rank.  Profiles are learned from about ``sample`` labelled texts at most, dealt out evenly over the languages by a hash
(a rare language gives all its texts); only the profiles reach the driver, ``depth`` n-grams for each language.  Prediction is
one pass that shuffles nothing; a row's slice needs memory in proportion to ``CHUNK_BYTES``, and the parts of a longer text are counted one by one.

Defined cases: ``und`` with score 0 where the text is null or has no letter, or where no language was learned; the score is
otherwise the second smallest distance as a share of the sum of the two smallest (1 less the relative distance where only one language was learned);
equal distances go to the first language by code point; rows with null text or null language are not learned from; a null id is
in no fold, so such rows are learned from; repeated rows count as often as they occur; empty tables give no rows;
columns that clash with the results are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.base import llm_query
from assetflow.llm.common import chunks, python_ready
from assetflow.llm.quality import held_out
from assetflow.llm.slices import slices
from assetflow.session import table

DEPTH, SAMPLE, LONGEST = 1000, 20_000, 4
FEW_LANGUAGES = 100_000  # so many names and counts are broadcast; more are joined by a shuffle
UNKNOWN = "und"
BLANK = np.zeros(256, bool)
BLANK[0x20] = True


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case words with one blank before and after each; null is a blank."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    out = pc.replace_substring_regex(low, pattern=r"[^\p{L}\p{M}]+", replacement=" ")
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim(out, " "), blank, pa.scalar("", pa.large_string()))


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of the texts as :func:`letters` gives them, sorted by text and n-gram."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    for part in slices(batch, "t", BLANK):
        owner = np.repeat(np.arange(part.first, part.first + len(part.offsets) - 1, dtype=np.uint64), np.diff(part.offsets))
        data, n = part.data, len(part.data)
        blank = data == 0x20
        gram = np.zeros(n, np.uint64)
        whole = np.ones(n, bool)  # the n-gram lies in one text, and a blank only at its ends
        for size in range(1, LONGEST + 1):
            m = n - size + 1
            if m <= 0:
                break
            gram, whole = gram[:m] << np.uint64(8) | data[size - 1 :].astype(np.uint64), whole[:m]
            whole &= owner[:m] == owner[size - 1 :]
            if size > 2:
                whole &= ~blank[size - 2 : n - 1]
            use = whole & ~blank[:m] if size == 1 else whole
            key, count = np.unique(owner[:m][use] << np.uint64(32) | gram[use], return_counts=True)
            keys.append(key)
            counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.add.reduceat(count, head) if len(head) else count
    key = key[head]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count


def ranked(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank) of each text's ``depth`` most frequent n-grams; equal counts share their middle rank."""
    order = np.lexsort((gram, -count, owner))
    owner, gram, count = owner[order], gram[order], count[order]
    at = np.arange(len(owner))
    first = np.searchsorted(owner, owner)
    rank = at - first
    keep = rank < depth
    owner, gram, count, rank = owner[keep], gram[keep], count[keep], rank[keep]
    if not len(owner):
        return owner, gram, rank.astype(float)
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (count[1:] != count[:-1])]))
    size = np.diff(np.append(head, len(owner)))
    return owner, gram, np.repeat(rank[head] + (size - 1) / 2, size)


@dataclass
class Profiles:
    """Languages by code point; ``ranks[i, l]`` is the rank of the i-th n-gram in language l, ``depth`` where it lacks it."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    depth: int

    @staticmethod
    def of(rows: list[tuple[str, int, int]], depth: int) -> Profiles:
        languages = sorted({lang for lang, _, _ in rows}, key=lambda s: s.encode())
        grams = np.array(sorted({g for _, g, _ in rows}), np.int64)
        ranks = np.full((len(grams) + 1, len(languages)), depth, np.int32)  # the last row is for unknown n-grams
        number = {lang: i for i, lang in enumerate(languages)}
        for lang, gram, rank in rows:
            ranks[np.searchsorted(grams, gram), number[lang]] = rank
        return Profiles(languages, grams, ranks, depth)

    def distances(self, texts: pa.Array) -> np.ndarray:
        """Mean displacement of each text's n-grams in each language, as a share of ``depth``; 1 for texts without n-grams."""
        owner, gram, rank = ranked(*gram_counts(texts), self.depth)
        out = np.ones((len(texts), len(self.languages)))
        if not len(owner) or not self.languages:
            return out
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(head, len(owner)))
        for i in range(len(self.languages)):
            theirs = self.ranks[at, i]
            apart = np.where(theirs < self.depth, np.abs(theirs - rank), self.depth)
            out[owner[head], i] = np.add.reduceat(apart, head) / (size * self.depth)
        return out

    def name(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The nearest language of each raw text, and the score."""
        known = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        far = self.distances(letters(texts))
        best = far.argmin(1)
        near = np.partition(far, 1, axis=1)[:, :2] if far.shape[1] > 1 else np.stack([far[:, 0], 1 - far[:, 0]], 1)
        total = near.sum(1)
        score = np.where(known, np.where(total > 0, near[:, 1] / np.where(total > 0, total, 1), 0.5), 0.0)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best, known)], score


def learn_profiles(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", depth: int = DEPTH, sample: int = SAMPLE
) -> Profiles:
    """Profiles from rows with text and language outside the held-out fold, about ``sample`` of them at most."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    # languages by the power of two above their size: 63 rows at most tell the largest even share
    tall = sizes.groupBy(F.ceil(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).collect()
    share = 1
    while any(r.k > np.log2(share) for r in tall) and sum(r.n if 2**r.k <= 2 * share else r.c * 2 * share for r in tall) <= sample:
        share *= 2
    place = F.pmod(F.xxhash64("i", F.length("t")), F.lit(1 << 30)) / (1 << 30) * F.col("n")
    sizes = F.broadcast(sizes) if sum(r.c for r in tall) <= FEW_LANGUAGES else sizes
    chosen = rows.join(sizes, "l").filter(place < share).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "t"):
                names = batch.column("l").dictionary_encode()
                owner, gram, n = gram_counts(letters(batch.column("t")))
                key, place = np.unique(names.indices.to_numpy()[owner].astype(np.int64) << 32 | gram, return_inverse=True)
                total = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.cast(pa.string()).take(pa.array(key >> 32)), pa.array(key & 0xFFFFFFFF), pa.array(total)], names=["l", "g", "n"]
                )

    counts = python_ready(chosen).mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    top = counts.withColumn("r", F.row_number().over(order) - 1).filter(F.col("r") < depth)
    return Profiles.of([(r.l, r.g, r.r) for r in top.select("l", "g", "r").collect()], depth)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") and (keep_text or c != text)]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*[docs.schema[c] for c in kept], *added])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "_t"):
                names, score = profiles.name(batch.column("_t"))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return python_ready(docs.select(*kept, F.col(text).alias("_t"))).mapInArrow(name, schema)


@llm_query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), learn_profiles(docs), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
