"""Language profiles, phrase collocations and the source audit, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetflow.llm import collocations, slices, source_audit
from assetflow.llm.base import LLM_QUERIES
from assetflow.llm.language_id import Profiles, gram_counts, identify, learn_profiles, letters, ranked
from tests.llm.helpers import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- parts of texts
def test_long_texts_are_divided_at_cuts():
    cuts = np.zeros(256, bool)
    cuts[ord(" ")] = True
    texts = ["ab cd", None, "", "x" * 50 + " yy zz " + "q" * 9, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = defaultdict(list)
    for part in slices.slices(batch, "t", cuts, 8):
        for i, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
            got[part.first + i].append(part.data[a:b].tobytes().decode())
    assert {k: "".join(v) for k, v in got.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert len(got[3]) == 2 and all(p.endswith(" ") for p in got[3][:-1])


# ---------------------------------------------------------------- languages
def grams_of(text: str, depth: int) -> list[tuple[int, float]]:
    """The text's most frequent n-grams and their ranks, one n-gram at a time."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    data, count = (" " + " ".join(words) + " ").encode(), Counter()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if g != b" " and b" " not in g[1:-1] and g != b"  ":
                count[int.from_bytes(g, "big")] += 1
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:depth]
    places = defaultdict(list)
    for i, (_, n) in enumerate(top):
        places[n].append(i)
    return [(g, sum(places[n]) / len(places[n])) for g, n in top]


def test_profiles_against_brute_force():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcß é.1 X\n") for _ in range(rnd.randint(0, 80))) for _ in range(60)] + ["A", "a-b", "x" * 40]
    for depth in (5, 40):
        owner, gram, rank = ranked(*gram_counts(letters(pa.array(texts))), depth)
        for i, t in enumerate(texts):
            assert list(zip(gram[owner == i].tolist(), rank[owner == i].tolist())) == grams_of(t, depth), t
    rows = [(lang, g, i) for lang, t in (("q", texts[0]), ("p", texts[1])) for i, (g, _) in enumerate(grams_of(t, 20))]
    profiles = Profiles.of(rows, 20)
    names, score = profiles.name(pa.array(texts))
    for t, name, s in zip(texts, names, score):
        if not re.search(r"[^\W\d_]", t):
            assert (name, s) == ("und", 0.0)
            continue
        own = grams_of(t, 20)
        far = {}
        for lang in ("p", "q"):
            theirs = {g: i for x, g, i in rows if x == lang}
            far[lang] = sum(abs(theirs[g] - r) if g in theirs else 20 for g, r in own) / (20 * len(own))
        assert name == ("p" if far["p"] <= far["q"] else "q")
        assert s == pytest.approx(max(far.values()) / sum(far.values()) if sum(far.values()) else 0.5)


def test_language_query_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    rows = LLM_QUERIES["op11_language_id"].run(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    kinds = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "en", "s"), (1, "the cat and the dog", "en", "s"), (None, "der hund und die katze", "de", None), (3, None, "en", "s"), (4, "12 - €", None, "s")]
    rows += [(5, "und der", None, "s"), (6, "the " * 30_000, None, "s"), (7, "", "de", "s"), (8, "THE DOG", "en", "s")]
    docs = spark.createDataFrame(rows, kinds)
    profiles = learn_profiles(docs)
    assert profiles.languages == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in identify(docs, profiles).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (None, "de"), (3, "und"), (4, "und"), (5, "de"), (6, "en"), (7, "und"), (8, "en")], key=str)
    assert identify(docs, profiles).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    none = learn_profiles(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.limit(0), profiles).count() == 0
    one = learn_profiles(docs.filter("lang = 'de'"))
    assert {(r.doc_id, r.lang_pred) for r in identify(docs, one).collect()} >= {(1, "de"), (3, "und")}


def test_language_sample_is_even(spark):
    rows = [(i, f"wort{i % 7} der die", "de") for i in range(3000)] + [(5000 + i, "the of", "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn_profiles(docs, sample=200, depth=50)
    assert profiles.languages == ["de", "en"]  # the rare language is not lost


# ---------------------------------------------------------------- collocations
def best_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in many.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        rows_ = []
        for p, a in many.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("buckets, heavy", [(1, 1.0), (7, 0.01)])  # all windows in one bucket; many, and common pairs and triples divided
def test_collocations_against_brute_force(spark, monkeypatch, buckets, heavy):
    own = collocations.common_prefixes
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    found = []
    monkeypatch.setattr(collocations, "common_prefixes", lambda *a: found.append(own(*a)) or found[-1])
    rnd = random.Random(buckets)
    words = ["a", "B", "b", "c", "é", "\x00", "d-e", "a\xa0b", "zz", "ß"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rnd.randint(0, 60)))
    rows = [(text(), rnd.choice(["x", "y", None, "und"])) for _ in range(120)] + [(None, "x"), ("", "w"), (".,", None), ("a b c a b c " * 400, "long")]
    df = spark.createDataFrame([(t, lang, "q", 1) for t, lang in rows], "text string, lang string, w1 string, n int").repartition(3)
    got = collocations.collocations(df, least=5, top=15, buckets=buckets)
    fields = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in fields) for r in got.collect()) == best_phrases(rows, 5, 15)
    assert (len(found[0]) > 5) == (heavy < 1)


def test_blocks_of_windows():
    rng = np.random.default_rng(1)
    for words in (["", "a", "é"], [f"w{i}" for i in range(70_000)]):
        codes, counts = rng.integers(0, len(words), (50, 4)), rng.integers(1, 300, 50)
        text, place, n = collocations.unpacked(collocations.packed(words, codes, counts))
        assert text == words and (place == codes.T).all() and (n == counts).all()


def test_collocations_of_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 40)
    rows = [("one two three four. five six " * 60 + "seven" * 30 + " one two, " * 9, "en"), ("one two", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    own = list(collocations.tokens(pa.RecordBatch.from_pandas(df.toPandas())))
    assert len(own) > 5
    words = [w for part, _, _ in own for w in part.to_pylist()]
    assert words == [w for t, _ in rows for w in re.findall(r"[^ .,]+", t)]


# ---------------------------------------------------------------- source audit
def audit_rows(rows, least, top):
    groups, count, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for w, d in docs[lang].items() if d >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in sources:
            total.update({w: count[lang, s][w] for w in kept})
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        own, q = {s: p(count[lang, s]) for s in sources}, p(total)
        for s in sources:
            pairs = [(-sum(abs(own[s][w] - own[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[w] - own[s][w], w.encode(), w) for w in kept if count[lang, s][w] and own[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_audit_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    rnd = random.Random(cells)
    words = ["a", "A", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "éé", "naïve", "zebra", "q"]
    text = lambda: rnd.choice([" ", "1", "_"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
    rows = [(text(), rnd.choice(["x", "y", None]), rnd.choice(["s", "t", "é", None])) for _ in range(150)]
    rows += [("rare words", "bare", s) for s in ("u", "v", "w")] + [(None, "x", "empty"), ("", "alone", "one"), ("a b " * 500, "x", "s")]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "text string, lang string, source string, p int, term string").repartition(3)
    got = source_audit.audit(df, least=8, top=3)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got.collect()) == audit_rows(rows, 8, 3)


def test_audit_of_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit(empty).count() == 0


def test_audit_counts_a_long_text_once(spark, monkeypatch):
    own = slices.slices
    monkeypatch.setattr(source_audit, "slices", lambda b, t, cuts: own(b, t, cuts, 20))
    texts = ["ab ba " * 20 + "c", "x", "ab", "d" * 90 + " ab", ""]
    held = []
    df = spark.createDataFrame([(t, "l", "s") for t in texts], "text string, lang string, source string")

    class Rows:  # the task's function, run here
        def mapInArrow(self, fn, _):
            held.extend(fn(iter([pa.RecordBatch.from_pandas(df.select("lang", "source", "text").toPandas())])))
            return df.selectExpr("lang", "source", "text as term", "1L as n", "1L as df")

    monkeypatch.setattr(source_audit, "python_ready", lambda rows: Rows())
    source_audit.count_words(df)
    n, docs = Counter(), Counter()
    for batch in held:
        for r in batch.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["df"]
    assert n == {"": 0, "ab": 22, "ba": 20, "c": 1, "x": 1, "d" * 90: 1}
    assert docs == {"": 0, "ab": 3, "ba": 1, "c": 1, "x": 1, "d" * 90: 1}


def test_pointers_are_sorted_by_their_words():
    rnd = random.Random(1)
    for _ in range(60):
        words = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 7, 8, 9, 16, 17, 25]))) if rnd.random() < 0.5 else "a" * rnd.randint(1, 30) for _ in range(200)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = slices.runs(source_audit.LETTER[data], np.array([0, len(data)]))
        order, run = source_audit.sort_pointers(data, starts, ends)
        got = [data[starts[i] : ends[i]].tobytes().decode() for i in order]
        assert got == sorted(words)
        assert [a == b for a, b in zip(got, got[1:])] == [a == b for a, b in zip(run, run[1:])]
