"""Operators that compare rows with each other, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetflow.llm import embedding_dedup, line_dedup, ngram_join
from assetflow.llm.base import LLM_QUERIES
from assetflow.llm.common import KEY, keyed
from assetflow.llm.components import components
from assetflow.llm.decontaminate import contamination, decontaminate
from assetflow.llm.source_mix import mix_plan, take_mix
from tests.llm.helpers import SF


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(60)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    assert got == union_find({x for p in linked for x in p}, linked)
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


# ---------------------------------------------------------------- line dedup
def lines_left(docs, least):
    """All pairs of places, one line at a time."""
    seq, pos = [], []
    for k, t in enumerate(docs):
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            seq.append(line.rstrip())
            pos.append((k, j))
        seq.append(None)
        pos.append(None)
    drop = set()
    for i in range(len(seq)):
        best = 0
        for j in range(i if seq[i] is not None else 0):
            n = 0
            while seq[i + n] is not None and seq[j + n] == seq[i + n]:
                n += 1
            best = max(best, n)
        if best and sum(len(x.split()) for x in seq[i : i + best]) >= least:
            drop |= set(pos[i : i + best])
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in drop) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1])
def test_line_dedup_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)  # many blocks and rounds on few lines
    monkeypatch.setattr(line_dedup, "FAN", 2)
    monkeypatch.setattr(line_dedup, "RANK_BITS", 2)
    monkeypatch.setattr(line_dedup, "HEAD", 1 + seed % 3)  # also captured by the tasks
    rnd = random.Random(seed)
    lines = [" ".join("w" * rnd.randint(0, 4)) + c for c in "abcde"]
    docs = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 9))) for _ in range(9)] + [None, "", ""]
    base = [f"u{i} z" for i in range(30)]
    for i in range(4):
        part = base[rnd.randint(0, 8) : rnd.randint(15, 30)]
        part[rnd.randrange(len(part))] = f"changed {i}"
        docs.append("\n".join(part))
    docs += [docs[0], docs[-1] + " "]
    df = keyed(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], "doc_id long, text string, mask string, _lines string"), "doc_id")
    out = line_dedup.dedup_lines(df, "text", 7)
    assert out.columns == ["doc_id", "text", "mask", KEY, "_lines", "_dropped"]
    rows = out.orderBy(KEY).collect()
    assert [r.text for r in rows] == lines_left(docs, 7)
    assert {r.mask for r in rows} == {"x"} and [r._lines for r in rows] == [0 if t is None else t.count("\n") + 1 for t in docs]


def test_line_dedup_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(keyed(empty, "doc_id")).count() == 0
    long_ = "word " * 60
    rows = spark.createDataFrame([(5, long_), (5, long_), (None, long_), (1, "short\nother")], "doc_id long, text string")
    got = line_dedup.dedup_lines(keyed(rows, "doc_id")).orderBy(KEY).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "short\nother"), (5, long_), (5, ""), (None, "")]


def lines_left_hashed(docs, least):
    """As ``lines_left``, trying only places of the same line."""
    seq, pos, at, drop = [], [], {}, set()
    for k, t in enumerate(docs):
        for j, line in enumerate(t.split("\n")):
            seq.append(line.rstrip())
            pos.append((k, j))
        seq.append(None)
        pos.append(None)
    for i, x in enumerate(seq):
        if x is None:
            continue
        best = 0
        for j in at.get(x, []):
            n = 0
            while seq[i + n] is not None and seq[j + n] == seq[i + n]:
                n += 1
            best = max(best, n)
        at.setdefault(x, []).append(i)
        if best and sum(len(y.split()) for y in seq[i : i + best]) >= least:
            drop |= set(pos[i : i + best])
    return ["\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in drop) for k, t in enumerate(docs)]


# ---------------------------------------------------------------- vectors
def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)  # most buckets are dealt out
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [v + rng.normal(size=24) * s for v in base for s in (0, 0, 0.15, 0.3)] + [base[0] + rng.normal(size=24) * 0.05 for _ in range(60)]
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] * 12), (904, [float("inf")] + [1.0] * 23), (905, []), (906, [1.0, 2.0])]
    df = spark.createDataFrame(data + [(i, v, "x") for i, v in odd], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = union_find(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert len(got) == len(data) + len(odd)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * (near.sum() - len(x))
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.98
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_hash_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = embedding_dedup.buckets(u), embedding_dedup.buckets(0.9 * u + np.sqrt(1 - 0.81) * v)
    hit = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
    assert hit.mean() > 0.99


# ---------------------------------------------------------------- n-grams
def gram_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, n, num):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(200)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rnd.randint(0, 1 + len(b) // 40)):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            docs.append(" ".join(c))
    docs += ["", None, " \n ", "One two", "one  TWO", "one two three", "\xa0", docs[0], " ".join(words * 30)]
    df = keyed(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string"), "doc_id")
    got = {r[KEY]: r for r in ngram_join.jaccard_components(df, "text", n, num, 100).collect()}
    sets = [gram_set(t, n) for t in docs]
    alike = lambda a, b: 100 * len(a & b) >= num * len(a | b) and len(a | b) > 0
    want = union_find(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if alike(sets[i], sets[j])])
    assert {i: got[i].component for i in got} == want
    assert [got[i]["size"] for i in range(len(docs))] == [len(s) for s in sets]


def test_keep_one_edges(spark):
    rows = spark.createDataFrame([(2, "a b c d e f", 1), (2, "a b c d e f", 1), (None, "A b c d e f", 2), (1, None, 3), (3, "", 3)], "doc_id long, text string, size int")
    assert sorted((r.doc_id or 0) for r in ngram_join.keep_one(rows).collect()) == [1, 2, 3]
    assert ngram_join.keep_one(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- benchmark
def test_contamination_edges(spark):
    item = " ".join(f"k{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, ""), (5, item), (6, "solo")], "item_id long, text string")
    docs = [
        ("x " * 30 + item.upper().replace(" ", ", ") + " y", 14, ["1", "5"]), (" ".join(item.split()[:10]), 10, ["1", "5"]), (" ".join(item.split()[:9]), 0, []),
        ("a short-item b short item", 4, ["2"]), (None, 0, []), ("", 0, []), ("solo " * 3, 3, ["6"]), ("z " * 40_000 + " ".join(item.split()[3:13]), 10, ["1", "5"]),
    ]
    df = keyed(spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(docs)], "doc_id long, text string, n_hit string"), "doc_id")
    got = contamination(df.drop("n_hit"), items, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"]) for r in got] == [(n, x) for _, n, x in docs]
    plain = df.select("doc_id", "text", "n_hit")
    assert sorted(r.doc_id for r in decontaminate(plain, items).collect()) == [2, 4, 5]
    assert decontaminate(plain, items.limit(0)).count() == len(docs)
    assert decontaminate(plain.limit(0), items).count() == 0
    twice = decontaminate(plain.unionByName(plain).unionByName(plain.withColumn("doc_id", F.lit(None).cast("long"))), items)
    assert twice.count() == 9


# ---------------------------------------------------------------- mix
def test_mix_targets_and_copies(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", "c", "d", None]), "w " * rnd.choice([0, 1, 5, 30, 200])) for i in range(1500)] + [(9000 + i, "tiny", "w " * 7) for i in range(3)] + [(9100, "void", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mix_plan(keyed(df, "doc_id")).toPandas()
    assert len(plan) == len(rows) and (plan.taken <= 2 * plan["size"]).all()
    names = {r[0]: r[1] for r in rows}
    per = plan.assign(source=plan.doc_id.map(names).fillna("~")).groupby("source").agg(size=("size", "sum"), full=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.full).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()
    assert ((per.taken - per.target).abs() <= 400).all()
    copies = Counter(r.doc_id for r in take_mix(df).collect())
    assert copies == Counter({k: int(c) for k, c in zip(plan.doc_id, plan.copies) if c})
    again = mix_plan(keyed(df.repartition(7), "doc_id")).toPandas()
    assert dict(zip(plan.doc_id, plan.copies)) == dict(zip(again.doc_id, again.copies))
    assert take_mix(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a", "w w", 9)] * 4 + [(None, "a", "w", 9)], "doc_id long, source string, text string, copy int")
    assert "copy" in take_mix(same).columns and mix_plan(keyed(same, "doc_id")).count() == 5


# ---------------------------------------------------------------- pipeline
def test_pipeline_on_the_smallest_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in LLM_QUERIES["op7_quality_classifier"].run(spark, SF).filter("predicted = 0").collect()}
    kept = p.quality(spark, docs, SF).cache()
    rows = {r.doc_id: r.text for r in sorted(kept.collect(), key=lambda r: r.doc_id)}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected

    digest = {r.doc_id: r.kept_chars for r in LLM_QUERIES["op1_line_dedup"].run(spark, SF).collect()}
    first = {r.doc_id: r.text for r in sorted(docs.collect(), key=lambda r: r.doc_id)}
    assert digest == {k: len(t) for k, t in zip(first, lines_left_hashed(list(first.values()), 50))}
    clean = {r.doc_id: r.text for r in p.line_dedup(spark, kept, SF).collect()}
    want = dict(zip(rows, lines_left_hashed(list(rows.values()), 50)))
    assert clean == {k: t for k, t in want.items() if t == rows[k] or t.strip(" ")}

    left = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    sets = {k: gram_set(t, 5) for k, t in clean.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = union_find(sets, pairs)
    assert {r.doc_id for r in p.near_duplicates(spark, left, SF).collect()} == {k for k, g in groups.items() if k == g}

    apart = spark.createDataFrame([(k, clean[k], "s", 0) for k, g in groups.items() if k == g], "doc_id long, text string, source string, n_chars int")
    fair = p.benchmark(spark, apart, SF)
    assert fair.columns == apart.columns and 0 < fair.count() < apart.count()
    mixed = p.mix(spark, fair, SF)
    assert mixed.columns == [*apart.columns, "copy"] and mixed.count() > fair.count()
    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "source mix"]


# ---------------------------------------------------------------- clashes, bounds
def test_mix_with_clashing_columns(spark):
    rows = [(i, "a b c", "s", f"c{i}", 7) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, copy int")
    got = take_mix(df)
    assert got.columns == ["doc_id", "text", "source", "copies", "copy"]
    assert {(r.doc_id, r.copies) for r in got.collect()} <= {(i, f"c{i}") for i in range(6)}
    assert got.count() == take_mix(df.drop("copies", "copy")).count() > 0


def test_learning_reads_one_row_of_a_repeated_id(spark, monkeypatch):
    from assetflow.llm import quality

    docs = spark.range(2000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.shape) or None)
    quality.learn(docs, labels, sample=2)
    assert all(n <= 2 for n, _ in seen)


def test_vectors_of_any_scale_link(spark):
    rnd = np.random.default_rng(3)
    v, w = rnd.normal(size=24), rnd.normal(size=24)
    w -= v * (v @ w) / (v @ v)
    rows = [(i, (v * s).tolist()) for i, s in enumerate([1e200, 3e200, 1.0, 5.0, 1e-200, 3e-200])] + [(9, (w * 1e-200).tolist()), (10, [1e-320] * 24), (10, [1e-320] * 24)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect())
    assert out == [(i, 5, 0) for i in range(6)] + [(9, 0, 9), (10, 1, 10), (10, 1, 10)]


def test_pairs_are_verified_once(spark, monkeypatch):
    seen = []
    own = ngram_join.JaccardJoin.verify

    def verify(self, pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return own(self, pairs)

    monkeypatch.setattr(ngram_join.JaccardJoin, "verify", verify)
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 60)}" for _ in range(20)] for _ in range(4)]
    texts = []
    for i in range(24):
        t = list(base[i % 4])
        for _ in range(i // 4):
            t[rnd.randrange(20)] = f"x{rnd.randint(0, 9)}"
        texts.append(" ".join(t))
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    ngram_join.jaccard_components(docs, "text", 1, 70, 100).collect()
    assert seen and len(seen) == len(set(seen))


def test_join_passes_links_on_once_and_frees_its_broadcasts(spark, monkeypatch):
    passed, sent = [], []
    own, send = ngram_join.components, type(spark.sparkContext).broadcast

    def counted(edges):
        passed.append(edges.count())
        return own(edges)

    def noted(context, value):
        sent.append((value, send(context, value)))
        return sent[-1][1]

    monkeypatch.setattr(ngram_join, "components", counted)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", noted)
    long_ = [f"w{i}" for i in range(60)]
    texts = [" ".join([*long_, f"x{i}"]) for i in range(5)] + ["one two three", "another text"]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    got = {r[KEY]: r.component for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}
    assert passed == [4, 0]  # those with the group's first document; no others are left, and these are not passed on again
    freed = [not b._jbroadcast.isValid() for value, b in sent if isinstance(value, np.ndarray)]
    assert freed and all(freed)


def test_counts_of_many_tasks_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAN", 2)
    texts = [" ".join(f"w{i}-{j}" for j in range(10)) for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), f"{KEY} long, text string").repartition(9, KEY)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        join = ngram_join.JaccardJoin(docs, ngram_join.Rule("text", 5, 80, 100))
        join.measure()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert join.frequency.value.sum() == 9 * 6
    join.release()


def test_pairs_come_from_one_shared_gram(spark, monkeypatch):
    made = []
    own = ngram_join.JaccardJoin._between

    def between(self, named):
        out = own(self, named)
        made.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(ngram_join.JaccardJoin, "_between", between)
    few, many = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(90)]
    # the first document shares the rare words of the next four and is too long to link with them
    texts = [" ".join(few + many)] + [" ".join([*few, f"c{i}", f"d{i}"]) for i in range(4)] + [" ".join([*many, f"e{i}"]) for i in range(7)]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    got = {r[KEY]: r.component for r in ngram_join.jaccard_components(docs, "text", 1, 50, 100).collect()}
    sets = [set(t.split()) for t in texts]
    want = union_find(range(12), [(i, j) for i in range(12) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j])])
    assert got == want
    assert made and len(made) == len(set(made))


def test_grams_of_no_fitting_sizes_are_dropped(spark):
    rare = [[f"{c}{i}" for i in range(4)] for c in "ab"]
    texts = [" ".join([*rare[i // 2], *(f"{i}-{j}" for j in range(n))]) for i, n in enumerate((20, 40, 80, 82))]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    join = ngram_join.JaccardJoin(docs, ngram_join.Rule("text", 1, 9, 10))
    join.measure()
    frequency = np.ones(ngram_join.COUNTERS, np.uint32)  # the shared words come first
    frequency[(ngram_join.gram_sets(pa.array([" ".join(sum(rare, []))]), 1)[0] % np.uint64(ngram_join.COUNTERS)).astype(np.int64)] = 0
    join.frequency = join._everywhere(frequency)
    join.candidates()
    assert sorted(r.key for r in join.shared.collect()) == [2] * 4 + [3] * 4
    join.release()


def test_parts_bound_the_difference_of_sets():
    rnd = np.random.default_rng(3)
    split = lambda s: np.minimum(ngram_join._by_hash(s, ngram_join._parts(len(s))), 255).astype(np.uint8).tobytes()
    for size in (1, 3, 40, 511, 512, 2000, 30000):
        s = np.unique(rnd.integers(0, 2**64, size, np.uint64))
        for lost in (0, 1, size // 20, size // 10):
            t = np.unique(np.concatenate([s[lost:], rnd.integers(0, 2**64, lost // 2, np.uint64)]))
            assert ngram_join._apart(split(s), split(t)) <= len(np.setxor1d(s, t))
        if size > 100:  # sets that share nothing are told apart, whatever their size
            assert ngram_join._apart(split(s), split(np.unique(rnd.integers(0, 2**64, size, np.uint64)))) > 0.3 * size
    same = np.arange(5000, dtype=np.uint64)  # all in one part
    assert ngram_join._apart(split(same), split(same[:4000])) <= 1000


def test_long_texts_that_share_rare_grams_are_not_verified(spark, monkeypatch):
    asked = []
    own = ngram_join.JaccardJoin.verify

    def verify(self, pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return own(self, pairs)

    monkeypatch.setattr(ngram_join.JaccardJoin, "verify", verify)
    frequent = [f"w{i}" for i in range(30000)]
    texts = [" ".join(frequent)] * 8
    for c in "abcd":  # two of them share 700 rare words of 12,000 and half of the frequent ones
        rare = [f"r{i}" for i in range(700)]
        mine = random.Random(c).sample(frequent, 11300)
        texts.append(" ".join(rare + mine))
    texts.append(texts[-1] + " more")
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    got = {r[KEY]: r.component for r in ngram_join.jaccard_components(docs, "text", 1, 90, 100).collect()}
    assert got == {**dict.fromkeys(range(8), 0), 8: 8, 9: 9, 10: 10, 11: 11, 12: 11}
    assert asked == [(11, 12)]


def test_counts_of_a_task_are_packed(spark):
    docs = spark.createDataFrame([(i, f"{i} one two three four five") for i in range(50)], f"{KEY} long, text string").coalesce(1)
    rule = ngram_join.Rule("text", 3, 90, 100)
    kinds = "key bigint, size bigint, s1 bigint, s2 bigint, odd1 bigint, odd2 bigint, parts binary, task bigint, block bigint, counts binary"
    rows = docs.mapInArrow(rule.measure, kinds).filter("block is not null").select(F.sum(F.length("counts")), F.count("*")).first()
    assert rows[1] == ngram_join.COUNTERS // ngram_join.COUNTER_BLOCK
    assert rows[0] < ngram_join.COUNTERS * 4 / 100  # 16 MB for any task before


def test_pipeline_stages_keep_extra_columns(spark):
    import corpus_pipeline

    names = "mask string, copies string, _key string, _lines string, score string, copy string, size string, extra string"
    long_ = "word other thing here and there again on the way " * 8
    rows = [(1, long_, "en", "s", 5), (2, None, "en", "s", 0), (3, "", None, None, 0), (4, long_, "en", "s", 5), (4, "short text", "en", "t", 5)]
    clash = [f"{n}0" for n in range(8)]
    docs = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == docs.columns[:5] and len(set(out.columns)) == len(out.columns), name
        for r in out.collect():
            assert all(r[c.split()[0]] == clash[i] for i, c in enumerate(names.split(", ")) if not (name == "source mix" and c.startswith("copy "))), name
        assert stage(spark, docs.limit(0), SF).count() == 0
