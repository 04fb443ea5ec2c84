r"""License scans by an exact set-similarity join (operator 5), DataFrame functions only.

Blocks are runs of RUN words that begin at every RUN / 2 words of a text, whatever its line breaks, so a statement of
RUN / 2 words or fewer lies whole in one; templates are known license statements; both are sets of words. A block
meets a template if it holds at least `need` = ceil(0.8 |T|) of the template's |T| words, among them those that tell
the license from others (`must`), and none that names a license which the template is only a part of (`other`).

Only words of templates can be shared, so a block is cut down to them. Both sides order their words by the counts over
all documents, rarest first. Prefix filter: a pair that shares `need` words shares one of the template's first
|T| - need + 1 and of the block's first |B| - least need + 1 words; only those are joined. Length filter: the block has
`need` words of templates or more. Positional filter: if the first word they share is the template's i-th and the
block's j-th, at most 1 + min(|T| - i - 1, |B| - j - 1) words are shared. What is left is verified by the whole
intersection, so the join finds every pair and no other.

Texts are cut into words once for the counts and once for the rest; only texts with a word of some template's prefix
are cut into blocks. Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.

Defined results: a null text is empty: no words, no labels, score zero. Repeated rows give repeated results; rows
with one id and several texts, or a null id, are judged each on its own text. Extra columns are not read. Empty
tables give empty tables; without any document every template word counts zero and the order is alphabetical.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, settled, small

LEAST, RUN = 0.8, 64
#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License statements: label, words that must stand there, words of other licenses, statement.
TEMPLATES = (
    ("agpl-3.0", "affero", "", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "affero", "", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "apache", "", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "law writing", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "redistribution binary", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "attribution", "noncommercial sharealike noderivatives", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "by nc", "", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "by sa", "", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "general", "affero lesser", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "general", "affero lesser", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "purpose fee", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", "lesser", "", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", "lesser", "", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "mit", "", "Released under the MIT License."),
    ("mit", "obtaining", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "mozilla", "", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "rights reserved", "", "All rights reserved."),
)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def template_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))


def counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in all documents; a row for each template word."""
    found = docs.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


class Index:
    """The templates as lists of word numbers, rarest first; a number is the word's place in the global order."""

    def __init__(self, docs: DataFrame, templates=TEMPLATES, least: float = LEAST):
        named = [(label, template_words(must), template_words(other), template_words(t)) for label, must, other, t in templates]
        vocabulary = sorted({w for _, must, other, ws in named for w in (*must, *other, *ws)})
        often = counts(docs, vocabulary)
        self.words = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
        number = {w: i for i, w in enumerate(self.words)}
        self.rows = []
        for k, (label, must, other, ws) in enumerate(named):
            tokens = sorted(number[w] for w in ws)
            need = -(-len(tokens) * round(least * 100) // 100)
            of = ([number[w] for w in must], [number[w] for w in other])
            self.rows += [(w, k, label, i, need, tokens, *of) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
        self.least_need = min((r[4] for r in self.rows), default=1)
        #: Words of prefixes: a text without any of them meets no template.
        self.prefix = sorted({self.words[r[0]] for r in self.rows})

    def frame(self, docs: DataFrame) -> DataFrame:
        schema = "w int, template int, label string, i int, need int, tokens array<int>, must array<int>, other array<int>"
        return small(docs.sparkSession.createDataFrame(self.rows, schema), len(self.rows))


def matches(cut: DataFrame, index: Index, filters: bool = True) -> DataFrame:
    """doc_id, row_hash, at, label, shared, of_words: every block that meets a template; cut: doc_id, row_hash, ws.

    Without `filters` the prefixes are whole and positions do not count: the same pairs from more candidates.
    """
    known = F.array(*map(F.lit, index.words))
    step = RUN // 2
    begins = F.sequence(F.lit(0), F.greatest(F.size("ws") - step - 1, F.lit(0)), F.lit(step))
    runs = F.transform(begins, lambda k: F.struct(k.alias("at"), F.array_intersect(known, F.slice(F.col("ws"), k + 1, RUN)).alias("held")))
    blocks = cut.select("doc_id", "row_hash", F.explode(runs).alias("b")).select("doc_id", "row_hash", "b.at", F.col("b.held").alias("held"))
    # the intersection keeps the order of `known`, which is the global one
    blocks = blocks.where(F.size("held") >= index.least_need)
    blocks = settled(blocks, "held", F.transform("held", lambda w: (F.array_position(known, w) - 1).cast("int")))
    reach = F.size("held") - index.least_need + 1 if filters else F.size("held")
    probes = blocks.select("*", F.posexplode(F.slice("held", F.lit(1), reach)).alias("j", "w"))
    of = index.frame(cut)
    joined = probes.join(of, "w").where(F.size("held") >= F.col("need"))
    if filters:
        joined = joined.where(1 + F.least(F.size("tokens") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need"))
    joined = joined.withColumn("common", F.array_intersect("tokens", "held"))
    first = F.get("common", F.lit(0)) == F.col("w")  # of several shared words of the prefixes the first one counts
    good = joined.where(first & (F.size("common") >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0) & ~F.arrays_overlap("other", "held"))
    return good.select("doc_id", "row_hash", "at", "template", "label", F.size("common").alias("shared"), F.size("tokens").alias("of_words"))


def phrase_places(ws: Column, phrase: str) -> Column:
    """Starts of a phrase's words standing consecutively in an array of words."""
    parts = phrase.split(" ")
    at = F.sequence(F.lit(0), F.greatest(F.size(ws) - len(parts), F.lit(0)))
    return F.filter(at, lambda i: _all([F.get(ws, i + k) == p for k, p in enumerate(parts)]))


def _all(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score: 1 if a phrase stands there, else the largest share of a met template's words in a block, else 0.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = Index(docs, templates, least)
    cut = settled(docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text"), "ws", words(F.col("text")))
    nothing = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(phrases):
        may = F.lit(True)
        for part in phrase.split(" "):
            may = may & F.array_contains("ws", part)
        cut = cut.withColumn(f"p{k}", F.when(may, phrase_places(F.col("ws"), phrase)).otherwise(nothing))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, (_, label) in enumerate(phrases)]))
    may = F.arrays_overlap("ws", F.array(*map(F.lit, index.prefix)))
    cut = durable(
        cut.select(
            "doc_id",
            "row_hash",
            F.size("ws").cast("long").alias("n_words"),
            F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            base.alias("base"),
            F.when(may, F.col("ws")).alias("ws"),  # words of the few texts that can meet a template
        ),
        "words",
    )
    found = matches(cut.where("ws is not null").select("doc_id", "row_hash", "ws"), index)
    by_row = found.groupBy("doc_id", "row_hash").agg(F.collect_set("label").alias("met"), F.max(F.col("shared") / F.col("of_words")).alias("share"))
    by_row = by_row.select(F.col("doc_id").alias("found_id"), F.col("row_hash").alias("found_hash"), "met", "share")
    both = cut.join(by_row, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_hash") == F.col("found_hash")), "left")
    said = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        said(F.col("base")).alias("base_labels"),
        said(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def sql(templates=TEMPLATES, phrases=PHRASES) -> str:
    """The same result in SQL, every block against every template."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cut = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    listed = lambda t: f"[{', '.join(map(quoted, template_words(t)))}]::VARCHAR[]"
    known = ", ".join(f"({k}, {quoted(label)}, {listed(must)}, {listed(other)}, {listed(t)})" for k, (label, must, other, t) in enumerate(templates))
    tests = []
    for phrase, label in phrases:
        parts = phrase.split(" ")
        tests.append(f"SELECT rid, k - 1 AS k, {quoted(label)} AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d) WHERE " + " AND ".join(f"w[k + {n}] = {quoted(p)}" for n, p in enumerate(parts)))
    return f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT rid, doc_id, {cut.format("text")} AS w FROM rows),
places AS ({" UNION ALL ".join(tests)}),
base AS (SELECT rid, count(*) AS n, min(k) AS a, max(k) AS z, list(DISTINCT label) AS ls FROM places GROUP BY rid),
t(t, label, must, other, ws) AS (VALUES {known}),
blocks AS (SELECT DISTINCT rid, list_distinct(w[k + 1 : k + 64]) AS b FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 32, 1), 32)) AS k FROM d)),
met AS (SELECT rid, label, len(list_intersect(ws, b))::DOUBLE / len(ws) AS share FROM blocks, t WHERE len(list_intersect(ws, b)) >= ceil(len(ws) * 0.8) AND list_has_all(b, must) AND NOT list_has_any(b, other)),
by_row AS (SELECT rid, list(DISTINCT label) AS ls, max(share) AS share FROM met GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.z::BIGINT AS last_word,
coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(by_row.ls, [])))), ','), '') AS labels,
CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(by_row.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN by_row USING (rid)
"""
