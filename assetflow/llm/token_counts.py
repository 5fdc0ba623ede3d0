"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For merges applied by rank, the tokens of a prefix of a text end with one certain token, and a token may follow
another exactly if the two together are encoded as those two.  So ``count[i] = count[i - len(t)] + 1`` for the only
vocabulary entry ``t`` that ends at ``i`` and may follow the last token at ``i - len(t)``: one left-to-right pass
stores the exact number of tokens of every prefix, and a question about a truncation or a budget reads the
array in place of encoding again.  The pass runs once for each distinct piece of the pre-tokeniser's
pattern; pieces repeat, and a task keeps a bounded table of their arrays.

Defined cases: a null or empty text has 0 tokens; very long texts and pieces take time in proportion and are not cut;
repeated rows each get their own row; empty tables give no rows; columns that clash with the results are replaced,
others stay.  The vocabulary is a parameter; a path is opened by every task, like the installed package it belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.base import llm_query
from assetflow.llm.common import chunks, python_ready
from assetflow.session import table

# Fixed value: the pre-tokeniser's pattern of byte-level BPE vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points whose class is the same in all Unicode versions that this module's and the vocabulary library's pattern
# engines may follow; a text with others is cut by the library.
SETTLED = regex.compile(r"[\x00-\u0557\u2000-\u206f\u20a0-\u2bff\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001faff]*+")
WHITE_RUN = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
KEPT_PIECES, KEPT_COUNTS = 400_000, 1 << 23
LIMIT = 512


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Exact token counts of prefixes under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.merges, self.parts_of = {}, {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            a, b = as_bytes(a), as_bytes(b)
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
            self.parts_of.setdefault(self.vocab[a + b], (rank, self.vocab[a], self.vocab[b]))
        made = lambda t: self.parts_of[t][0] if t in self.parts_of else -1
        # as training leaves it: a pair is merged after both its parts are made, and each token is made by one pair
        self.in_order = all(r > made(a) and r > made(b) for (a, b), (r, _) in self.merges.items()) and len(self.parts_of) == len(self.merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.ends = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if self.encode(t) == [i]:  # others never come out of the merges
                self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.follows: dict[int, bool] = {}
        self._forget()

    def encode(self, data: bytes) -> list[int]:
        """Merge by rank; for short strings only."""
        ids = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            rank, at = best
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two tokens.  Back in time from the end, the tokens at the border are undone one by
        one, the latest made first; a merge of two that stood there together, before either went into a longer one, would have crossed."""
        made, end = self.parts_of.get, len(self.merges)
        until_a = until_b = end
        while True:
            merge = self.merges.get((a, b))
            # of equal merges the one further left comes first
            if merge is not None and merge[0] < until_a and merge[0] <= until_b:
                return False
            left, right = made(a), made(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                until_a, _, a = left
            else:
                until_b, b, _ = right

    def may_follow(self, a: int, b: int) -> bool:
        both = self.tokens[a] + self.tokens[b]
        known = self.stays(a, b) if self.in_order else self.encode(both) == [a, b]
        if len(self.follows) > KEPT_PIECES:
            self.follows.clear()
        self.follows[a << 32 | b] = known
        return known

    def piece_prefixes(self, piece: str) -> list[int]:
        """count[i]: tokens of the first i bytes of a piece."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        count, last, follows = [0] * (len(data) + 1), [-1] * (len(data) + 1), self.follows.get
        # matches come in order of their ends; at each end exactly one token fits
        for end, (token, size) in self.ends.iter(data):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            before = last[start]
            if start == 0:
                last[end], count[end] = token, 1
            elif before >= 0:
                fits = follows(before << 32 | token)
                if fits or fits is None and self.may_follow(before, token):
                    last[end], count[end] = token, count[start] + 1
        return count

    def _forget(self) -> None:
        """An empty table of pieces: the piece's number, where its counts begin in ``flat`` and how many there are."""
        self.number: dict[str, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.int32), 0

    def _learn(self, piece: str) -> int:
        """The number of a piece; its tokens after each character are kept."""
        counts = self.piece_prefixes(piece)
        if piece in ("'re", "'ve", "'ll"):  # "'r" alone is two pieces
            ends = [self._last("'"), self._last("'") + self._last(piece[1]), counts[-1]]
        elif piece.isascii():
            ends = counts[1:]
        else:
            ends, at = [], 0
            for c in piece:
                at += len(c.encode())
                ends.append(counts[at])
        n, to = len(self.number), self.used + len(ends)
        if n == len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        if to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ends)), np.int32)])
        self.number[piece], self.begin[n], self.size[n], self.flat[self.used : to], self.used = n, self.used, len(ends), ends, to
        return n

    def _last(self, piece: str) -> int:
        n = self.number.get(piece)
        n = self._learn(piece) if n is None else n
        return int(self.flat[self.begin[n] + self.size[n] - 1])

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these (True)."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def library_pieces(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total = 0
        special = any(s in text for s in self.special)
        for part, whole in self.parts(text) if special else ((text, False),):
            if whole:
                total += 1
                continue
            for piece in self.pieces.findall(part) if part.isascii() or SETTLED.fullmatch(part) else self.library_pieces(part):
                total += self._last(piece)
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """count[i]: tokens of the first i characters of the text, each as if the text ended there."""
        if not any(t in text for t in self.special):
            return self._ordinary_prefixes(text)
        out, base, ordinary = [np.zeros(1, np.int64)], 0, ""
        for part, whole in self.parts(text):
            if whole:  # until it is complete, a special string is ordinary text after what came before
                inner = self._ordinary_prefixes(ordinary + part)
                out.append(base + inner[len(ordinary) + 1 : len(ordinary) + len(part)])
                base += int(inner[len(ordinary)]) + 1
                out.append(np.array([base]))
                ordinary = ""
            else:
                ordinary = part
                out.append(base + self._ordinary_prefixes(part)[1:])
        return np.concatenate(out)

    def _ordinary_prefixes(self, text: str) -> np.ndarray:
        if len(self.number) > KEPT_PIECES or self.used > KEPT_COUNTS:
            self._forget()
        pieces = self.pieces.findall(text) if text.isascii() or SETTLED.fullmatch(text) else self.library_pieces(text)
        which = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        for i in np.flatnonzero(which < 0).tolist():
            known = self.number.get(pieces[i])
            which[i] = self._learn(pieces[i]) if known is None else known
        # a piece's counts go on from those of the pieces before it
        begin, size = self.begin[which], self.size[which]
        stop = np.cumsum(size)
        out = np.zeros(len(text) + 1, np.int64)
        out[1:] = self.flat[np.arange(len(text)) + np.repeat(begin - stop + size, size)]
        last = out[stop]
        out[1:] += np.repeat(np.cumsum(last) - last, size)
        return self._white_runs(text, out)

    def _white_runs(self, text: str, out: np.ndarray) -> np.ndarray:
        """A run of white space before a word is cut before its last character; a prefix that ends with that
        character has the run as one piece."""
        for m in WHITE_RUN.finditer(text):
            out[m.end()] = out[m.start()] + self._last(m[0])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """``df`` without the text, with n_bytes, n_tokens, over_limit and fit_chars, the characters of the longest prefix of at most
    ``limit`` tokens, all read from the counts of the prefixes; with ``prefixes`` also these, prefix_counts array<int>, one entry for
    each character."""
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fit_chars", T.LongType())]
    if prefixes:
        added += [("prefix_counts", T.ArrayType(T.IntegerType()))]
    kept = [c for c in df.columns if c != text and c.lower() not in {n for n, _ in added}]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for batch in chunks(whole, text):
                columns = [batch.column(c) for c in kept]
                texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
                sizes = [len(t.encode()) for t in texts]
                totals, fits, each = [], [], []
                for t in texts:
                    counts = own.prefixes(t)
                    totals.append(int(counts[-1]))
                    fits.append(len(t) if counts[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1]))
                    if prefixes:
                        each.append(counts[1:])
                columns += [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(fits, pa.int64())]
                if prefixes:
                    columns.append(pa.array(each, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return python_ready(df.select(*kept, text)).mapInArrow(count, schema)


@llm_query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document, and how much of it fits the limit."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
