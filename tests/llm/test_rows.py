"""Operators that look at one row or conversation: chat formats, URLs, licences, token counts, quality scores."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetflow.llm.base import LLM_QUERIES
from assetflow.llm.chat_format import TEST_TEXT, format_conversations, read_loss_texts, read_turns
from assetflow.llm.license_scan import scan_licenses
from assetflow.llm.quality import Ranking, features, fit, held_out, learn, score_documents
from assetflow.llm.token_counts import PrefixCounter, token_counts
from assetflow.llm.url_filter import RULES, Cascade, filter_urls, url_parts
from tests.llm.helpers import SF, table_rows


# ---------------------------------------------------------------- chat
def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "&lt;|", "&amp;", "<|im_sep|>", "a\nb", "<", "|>", "", None, TEST_TEXT, "é\U0001f600"]
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "sys\ntem", None]), rnd.choice(odd), "clash") for c in range(40) for t in range(rnd.randint(1, 7))]
    out = format_conversations(chats(spark, rows))
    got = out.select("conv_id", read_turns(F.col("formatted")).alias("ts"), read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("ls"), "formatted").collect()
    assert len(got) == 40
    for r in got:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.ts] == want
        assert list(r.ls) == [t for role, t in want if role == "assistant"]
        heads = sum(1 for i, (role, _) in enumerate(want) if i == 0 or want[i - 1][0] != role)
        assert r.formatted.count("<|im_start|>") == heads == r.formatted.count("<|im_end|>")


def test_chat_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "b", None), (None, 1, "user", "a", None), (1, None, "user", "x", None), (1, 0, "user", "y", None), (1, 0, "user", "y", None)]
    got = {r.conv_id: [t.text for t in r.ts] for r in format_conversations(chats(spark, rows)).select("conv_id", read_turns(F.col("formatted")).alias("ts")).collect()}
    assert got == {None: ["a", "b"], 1: ["x", "y", "y"]}
    assert format_conversations(chats(spark, [])).count() == 0
    long_ = format_conversations(chats(spark, [(1, i, "assistant", "<|" * 500, None) for i in range(300)]))
    assert long_.select(F.length(F.array_join(read_loss_texts(F.col("formatted"), F.col("loss_spans")), ""))).first()[0] == 300_000


def test_chat_query_holds_the_test_conversation(spark):
    own = LLM_QUERIES["op3_chat_format"].run(spark, SF).filter("conv_id = -1").first()
    assert own.n_turns == 2 and own.loss_sha256 == hashlib.sha256(TEST_TEXT.encode()).hexdigest()


# ---------------------------------------------------------------- URLs
def test_url_rules(spark):
    urls = [
        ("http://a.net/fr/1", "net/fr/", "block"), ("https://www.example.com/en/x", "www.example.com/en/", "allow"), ("https://m.EXAMPLE.com/en/x?y", "example.com/en/", "block"),
        ("http://example.com", None, "allow"), ("http://example.com/de/", "com/", "allow"), ("http://notexample.com/en/", "com/", "allow"), ("http://net/es/", "net/es/", "block"),
        ("ftp://a.net:80/es/", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("x://" + "a." * 3000 + "net/fr/", "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(urls)], "id int, url string, rule string")
    got = filter_urls(df, RULES).orderBy("id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(r, v) for _, r, v in urls]
    assert filter_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in filter_urls(df, []).collect()} == {"allow"}
    host, path = url_parts(F.lit("http://A.b/c?d://e"))
    assert tuple(spark.range(1).select(host, path).first()) == ("a.b", "/c")


def test_cascade_is_exact(spark):
    universe = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("key % 7 = 3")
    cascade = Cascade(listed, universe, 6000)
    assert len(cascade.levels) >= 2
    marked = universe.withColumns(cascade.columns("_l")).select("key", cascade.contains(F.col("key"), "_l").alias("in"))
    assert marked.filter("in <> (key % 7 = 3)").count() == 0
    with pytest.raises(ValueError):
        Cascade(listed, universe, 6000, max_bits=64)


# ---------------------------------------------------------------- licences
def test_license_rules(spark):
    gpl = "This program is free software: you can redistribute it; you can redistribute it and/or modify it\nunder"
    texts = [
        ("x. Released under the MIT License. y", ["MIT"]), ("LICENSED under the Apache License,  Version 2.0!", ["Apache-2.0"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
        (gpl, []), (None, []), ("", []), ("All rights reserved\nAll rights reserved", ["Proprietary"]), ("word " * 50_000 + "\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(texts)], "id int, text string, matches string")
    got = scan_licenses(df).orderBy("id").collect()
    assert [r.licenses for r in got] == [x for _, x in texts]
    assert len(got[6].matches) == 2
    assert scan_licenses(df.limit(0)).count() == 0
    ordered = scan_licenses(spark.createDataFrame([("one. two. one",)], "text string"), known={"one": "a", "two": "b"}, rules=[("L", ["a", "b"]), ("M", ["b", "a"]), ("N", ["a", "c"])]).first()
    assert [(m.at, m.license) for m in ordered.matches] == [(0, "L"), (1, "M")]


MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
GPL3 = """Tool: does things
Copyright (C) 2020 A. Person

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
APACHE = """Licensed under the Apache License,
Version 2.0 (the "License"); you may not use this file except in
compliance with the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_license_notices_as_printed(spark):
    whole = [(MIT, ["MIT"]), (BSD, ["BSD"]), (GPL3, ["GPL-3.0-or-later"]), (GPL2, ["GPL-2.0-or-later"]), (APACHE, ["Apache-2.0"])]
    texts = [(t, x) for t, x in whole]
    # wrapped, in a comment, with Windows' line ends, on one line, and on one line in a comment
    texts += [("/*\n" + "".join(f" * {line}\n" for line in t.splitlines()) + " */\n", x) for t, x in whole]
    texts += [(t.replace("\n", "\r\n"), x) for t, x in whole]
    paragraphs = [("\n".join(" ".join(p.split("\n")) for p in t.split("\n\n")), x) for t, x in whole]
    texts += paragraphs + [(f"# {t[t.index('Licensed' if t.startswith('Licensed') else 'Permission'):]}", x) for t, x in paragraphs[:1]]
    texts += [("note: released under the\nMIT License: see below", ["MIT"]), ("All rights reserved.\n|:|\n::: : :\n" + " : " * 30_000, ["Proprietary"])]
    texts += [("Licensed under the Apache License, Version 2.0\nThe License\n", ["Apache-2.0"]), (GPL3.replace("modify", "sell"), [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, text string")
    got = scan_licenses(df).orderBy("id").collect()
    assert [(i, r.licenses) for i, r in enumerate(got)] == [(i, x) for i, (_, x) in enumerate(texts)]
    assert [m.license for m in got[1].matches] == ["Proprietary", "BSD"]


# ---------------------------------------------------------------- tokens
def test_token_prefixes_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    own, lib = PrefixCounter(path), tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "re", "ll", "é", "ß", "23", "!", "<|", "<|endoftext|>", "中", "the ", "ing", "\U0001f600", "'ve", "\u0558", "\xa0"]
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert own.prefixes(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t
        assert own.count(t) == count(t)
    texts = [r.text for r in table_rows(spark, "documents")] + [None, "", "x" * 30_000, " " * 5000]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id int, text string, over_limit boolean")
    got = token_counts(df, path).orderBy("id").collect()
    assert [r.n_tokens for r in got] == [count(t or "") for t in texts]
    assert [r.over_limit for r in got] == [count(t or "") > 512 for t in texts]
    few = token_counts(df.filter("id < 5").withColumn("text", F.substring("text", 1, 300)), path, limit=20, prefixes=True).orderBy("id").collect()
    for r, t in zip(few, [(t or "")[:300] for t in texts]):
        assert r.prefix_counts == [count(t[:i]) for i in range(1, len(t) + 1)]
        assert r.fit_chars == max(i for i in range(len(t) + 1) if count(t[:i]) <= 20)
    assert token_counts(df.limit(0), path).count() == 0


def test_token_query_reads_prefix_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = {r.doc_id: r.text for r in table_rows(spark, "documents")}
    rows = LLM_QUERIES["op6_token_counts"].run(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.over_limit for r in rows)
    for r in rows:
        t = texts[r.doc_id]
        assert r.n_tokens == count(t) and r.over_limit == (r.n_tokens > 512) == (r.fit_chars < len(t))
        assert count(t[: r.fit_chars]) <= 512
        assert not r.over_limit or all(count(t[:i]) > 512 for i in range(r.fit_chars + 1, min(len(t), r.fit_chars + 20)))
    assert PrefixCounter(str(public.path("byte_bpe_50k.json"))).prefixes("a" + " " * 200_000)[-1] == count("a" + " " * 200_000)


# ---------------------------------------------------------------- quality
def test_quality_held_out_accuracy(spark):
    run = LLM_QUERIES["op7_quality_classifier"].run(spark, SF.replace("0.001", "0.01"))
    labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    both = run.join(labels, "doc_id").filter("held_out").collect()
    assert len(both) > 30
    assert np.mean([r.predicted == r.quality for r in both]) >= 0.95


def test_quality_edges(spark):
    x = features(pa.array(["", None, "a b c", "word " * 100_000, "!!! ### |||", "a b c"]))
    assert x.shape[0] == 6 and np.isfinite(x).all() and not x[:2].any() and (x[2] == x[5]).all()
    assert features(pa.array([], pa.string())).shape == (0, x.shape[1])
    assert fit(x, np.ones(6)) is None
    ranking = fit(x, np.array([0, 0, 1, 1, 0, 1]))
    assert isinstance(ranking, Ranking) and ((ranking.scores(x) >= 0) & (ranking.scores(x) <= 1)).all()
    docs = spark.createDataFrame([(1, "a b", 5.0), (None, None, None), (1, "", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert learn(docs, none) is None
    assert [r.score for r in score_documents(docs, None).collect()] == [0.5] * 3
    assert score_documents(docs.limit(0), ranking).count() == 0
    assert score_documents(docs, ranking).columns == ["doc_id", "text", "score"]
    from zlib import crc32

    ids = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in ids] == [crc32(str(r.id).encode()) % 5 == 0 for r in ids]
