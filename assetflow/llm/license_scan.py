"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences at line feeds and at ``.``, ``;``, ``!`` or ``?`` before white space; a sentence is normalised
(lower case, every run of characters other than letters and digits becomes one space).  Known licence sentences have an
identifier; the others get none.  Notices are often wrapped at a line's width or go on after a colon, so a line feed or a colon may also
lie inside a known sentence, and a known sentence may begin or end at a colon: pieces between such marks that together are a known
sentence count as that one sentence.  A licence rule is an ordered list of identifiers: it matches where its identifiers
follow each other in the text's sequence of sentences, with nothing between.  Where rules match at the same place the
longest wins and the others do not count there.  "All rights reserved" stands in the head of open licences too: its rule is listed among the
matches, but names a text's licence only where no other rule does.

Everything stays within the row: nothing is shuffled, and a hot licence costs what any other sentence costs.  The known
sentences sit in a constant of hash buckets, so a look-up does not depend on how many there are.

Defined cases: a null or empty text has no sentences and no licence; a very long text is read whole; repeated rows and
ids each get their own result; columns that clash with the results are replaced, others stay; no rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.session import table

# Opening sentences of public licence notices, in normalised form, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-line",
    "licensed under the apache license version 2 0 the license": "apache-2.0-head",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-limits",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-line",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-line",
    "licensed under cc by 4 0": "cc-by-4.0-line",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-line",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "all rights reserved": "all-rights-reserved",
}
# Licence rules, each an ordered list of sentence identifiers.
RULES = [
    ("Apache-2.0", ["apache-2.0-head", "apache-2.0-comply"]),
    ("Apache-2.0", ["apache-2.0-comply", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-line"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0", ["gpl-3.0-line"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl-3.0-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl-2.0-later"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-line"]),
    ("CC-BY-4.0", ["cc-by-4.0-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-line"]),
    ("BSD", ["bsd-grant"]),
    ("Proprietary", ["all-rights-reserved"]),
]
# Whole sentences of notices as they are printed, where those above hold an opening, and the rules on them.
NOTICE_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-terms",
}
NOTICE_RULES = [
    ("MIT", ["mit-notice"]),
    ("BSD", ["bsd-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3.0-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2.0-terms"]),
    ("Apache-2.0", ["apache-2.0-head"]),
]
WEAK = ["Proprietary"]  # names that count only where no other is found


def marked(text: Column) -> Column:
    """A text's words with one space, or one mark, between them and a mark around all: ``|`` for the end of a sentence,
    a line feed, or a colon before white space.  Every pattern is linear in the text."""
    out = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "|", " ")
    out = F.regexp_replace(out, r"[.;!?](?=\s|$)", "|")
    out = F.regexp_replace(out, r":(?![\s|]|$)", " ")
    out = F.concat(F.lit("|"), F.regexp_replace(out, r"[^\p{L}\p{N}|:\n]+", " "), F.lit("|"))
    for run, mark in ((r"[ :]*:[ :]*", ":"), (r"[ :]?\n[ :\n]*", "\n"), (r"[ :\n]?\|[ :\n|]*", "|")):
        out = F.regexp_replace(out, run, mark)
    return out


def joined(marks: Column, known: dict[str, str]) -> Column:
    """``marks`` with each known sentence as one piece between ``|``; the longest are looked for first."""
    pattern = lambda words: r"[|\n:]" + r"[ \n:]".join(re.escape(w) for w in words)
    if not known:
        return marks
    out = marks
    for s in sorted(known, key=lambda s: (-len(s), s)):
        out = F.regexp_replace(out, pattern(s.split(" ")) + r"(?=[|\n:])", re.sub(r"([\\$])", r"\\\1", f"|{s}|"))
    openings = sorted({pattern(s.split(" ")[:3]) for s in known})
    return F.when(marks.rlike("|".join(openings)), out).otherwise(marks)


def sentences(marks: Column) -> Column:
    """Normalised sentences of a marked text, in order, without empty ones."""
    return F.filter(F.transform(F.split(marks, r"[|\n]", -1), lambda s: F.trim(F.translate(s, ":", " "))), lambda s: s != "")


def sentence_ids(found: Column, known: dict[str, str], buckets: int = 64) -> Column:
    """The identifier of each sentence, "" for a sentence that is not known."""
    # a sentence's bucket is the number of its characters: cheap to tell and spread well enough
    lists: list[dict[str, str]] = [{} for _ in range(buckets)]
    for s, i in known.items():
        lists[len(s) % buckets][s] = i
    entry = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.expr("cast(map() as map<string,string>)")
    constant = F.array(*[entry(d) for d in lists])
    return F.transform(found, lambda s: F.coalesce(F.get(constant, F.length(s) % buckets)[s], F.lit("")))


def scan_licenses(
    df: DataFrame, text: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None
) -> DataFrame:
    """``df`` with n_sentences, known_ids (identifiers in order), matches array<struct<at, size, license>> (``at`` counts
    sentences from 0) and licenses (names, each once, sorted)."""
    known = SENTENCES | NOTICE_SENTENCES if known is None else known
    rules = RULES + NOTICE_RULES if rules is None else rules
    names = ("n_sentences", "known_ids", "matches", "licenses", "_ids", "_marks")
    kept = [c for c in df.columns if c.lower() not in names]
    rows = df.select(*kept, marked(F.col(text)).alias("_marks"))
    rows = rows.select(*kept, joined(F.col("_marks"), known).alias("_marks"))
    rows = rows.select(*kept, sentence_ids(sentences(F.col("_marks")), known).alias("_ids"))
    # sequences that differ only in their licence's name count once, for the first name
    ordered = sorted(dict(reversed([(tuple(ids), name) for name, ids in rules])).items(), key=lambda r: -len(r[0]))

    def best(i: Column) -> Column:
        """The longest rule that matches from sentence i on."""
        options = []
        for ids, name in ordered:
            same = F.lit(True)
            for j, want in enumerate(ids):
                same = same & (F.get(F.col("_ids"), i + j) == want)
            options.append(F.when(same, F.struct(i.alias("at"), F.lit(len(ids)).alias("size"), F.lit(name).alias("license"))))
        return F.coalesce(*options)

    places = F.filter(F.sequence(F.lit(0), F.size("_ids") - 1), lambda i: F.get(F.col("_ids"), i) != "")
    spots = F.when(F.size("_ids") > 0, places).otherwise(F.expr("cast(array() as array<int>)"))
    out = rows.withColumn("matches", F.filter(F.transform(spots, best), lambda m: m.isNotNull()))
    found = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    strong = F.filter(found, lambda x: ~x.isin(WEAK))
    return out.select(
        *kept,
        F.size("_ids").cast("bigint").alias("n_sentences"),
        F.filter("_ids", lambda i: i != "").alias("known_ids"),
        "matches",
        F.when(F.size(strong) > 0, strong).otherwise(found).alias("licenses"),
    )


_ONE = {ids[0]: name for name, ids in RULES if len(ids) == 1}
_SENTENCE_ROWS = ", ".join(f"('{s}', '{i}', '{_ONE.get(i, '')}')" for s, i in SENTENCES.items())
_PAIRS = [(ids, name) for name, ids in RULES if len(ids) > 1]
_RUNS = " ".join(
    "WHEN " + " AND ".join([f"id = '{ids[0]}'", *[f"lead(id, {j}) OVER w = '{x}'" for j, x in enumerate(ids) if j]]) + f" THEN '{name}'"
    for ids, name in sorted(_PAIRS, key=lambda p: -len(p[0]))
)


@llm_query(
    "op10_license_scan",
    rf"""
    WITH known(s, id, one) AS (VALUES {_SENTENCE_ROWS}),
    cut AS (SELECT doc_id, unnest(c) AS s, generate_subscripts(c, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.;!?](\s|$)', chr(10) || '\1', 'g'), chr(10)) AS c FROM documents)),
    norm AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM cut),
    named AS (SELECT doc_id, i, n.s, coalesce(k.id, '') AS id, k.one FROM norm n LEFT JOIN known k ON n.s = k.s WHERE n.s <> ''),
    matched AS (SELECT doc_id, i, id, CASE {_RUNS} WHEN one <> '' THEN one END AS license FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (id <> '') AS k, count(license) AS m,
        string_agg(id, ',' ORDER BY i) FILTER (id <> '') AS ids, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
      FROM matched GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(k, 0)::BIGINT AS n_known, coalesce(m, 0)::BIGINT AS n_matches,
      coalesce(ids, '') AS known_ids, coalesce(licenses, '') AS licenses
    FROM documents d LEFT JOIN per USING (doc_id)
    """,
)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences named in every document."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_sentences",
        F.size("known_ids").cast("bigint").alias("n_known"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join("known_ids", ",").alias("known_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )
