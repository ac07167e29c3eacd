"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column
from etlspec.llm.decontaminate import words

# Wordings of public license notices, by label.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2": (
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": (
        "Licensed under the GNU General Public License, version 3",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}
# Wordings that count only where their words stand one after another, by label.
PHRASES: dict[str, tuple[str, ...]] = {
    "apache-2": ("apache license version 2",),
    "cc-by-nc": ("cc by nc",),
    "mit": ("under the mit license",),
}
#: Part of a notice's distinct words that a block must hold.
LEAST_CONTAINMENT = 0.9
#: Words of all templates together, since their table is broadcast and their words stand in the plan.
MAX_TEMPLATE_WORDS = 20_000
#: Words that two blocks side by side do not share, at least; the longest template may need more.
STEP_WORDS = 32

_MATCH = "struct<label:string,template:string,start:int,end:int,containment:double,places:array<int>>"


def template_words(text: str) -> list[str]:
    """The words of a template, as ``decontaminate.words`` finds them in a document."""
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def step(notices: Mapping[str, Sequence[str]], phrases: Mapping[str, Sequence[str]]) -> int:
    """Words from one block's start to the next one's: every template fits in so many words."""
    texts = [t for named in (notices, phrases) for some in named.values() for t in some]
    return max([STEP_WORDS, *(len(template_words(t)) for t in texts)])


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scan(
    docs: DataFrame,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    phrases: Mapping[str, Sequence[str]] = PHRASES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = LEAST_CONTAINMENT,
) -> DataFrame:
    """One row per document: every block of its text that holds enough of a license template.

    Columns: ``id_col``; ``text_key`` (a hash of the text); ``n_words``;
    ``matches``, sorted, array<struct<label, template, start, end, containment,
    places>>. A block is ``2 * step`` words, and blocks start every ``step``
    words, so each run of ``step`` words (no template is longer) lies in one.
    ``start`` and ``end`` are the block's word positions, end exclusive. A
    notice matches if the block has at least ``threshold`` of its distinct words:
    ``containment`` is that part. A phrase matches if all its words stand in the
    block one after another; ``places`` are the word positions where it starts
    in the block's first ``step`` words, so each place is told once.

    An exact set-similarity join. The templates' words are put in the order of
    the number of documents that have them, rarest first, which is one pass over
    the texts. Of a template of n words, o of which are needed, one of the first
    n - o + 1 must be in the block, and it must be one of the block's first
    words with o - 1 to follow (words that are in no template are left out of
    blocks); so blocks meet templates by these words only. Pairs too short for o,
    or with too few words after the places of the first shared one, go; for the
    rest the shared words are counted. The templates' table is broadcast: its
    words are at most ``MAX_TEMPLATE_WORDS``. One row per document, and its
    matches, are shuffled; no block is.

    Null and wordless texts have no words and no matches. Repeated rows give
    repeated rows, documents with equal ids are told apart by their texts, null
    ids work. No templates find nothing; an empty table gives no rows. Other
    columns are not used.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    spark = docs.sparkSession
    kinds = [(label, text, False) for label, some in notices.items() for text in some]
    kinds += [(label, text, True) for label, some in phrases.items() for text in some]
    templates = [(label, text, run, phrase) for label, text, phrase in kinds if (run := template_words(text))]
    if sum(len(t[2]) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
    stride = step(notices, phrases)
    text = column(docs, text_col)
    vocabulary = sorted({w for t in templates for w in t[2]})
    # the outer form keeps the optimizer from testing the array for emptiness on a second copy of it
    met = docs.select(F.explode_outer(F.array_intersect(_strings(vocabulary), words(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in met.collect()} if templates else {}  # a row for each template word, and one null
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}

    entries = []
    for number, (label, template, run, phrase) in enumerate(templates):
        tokens = sorted(set(run), key=place.__getitem__)
        need = len(tokens) if phrase else max(1, math.ceil(round(threshold * len(tokens), 9)))
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            entries.append((token, i, number, label, template, tokens, need, run if phrase else None))
    least = min((e[6] for e in entries), default=1)
    fields = [
        F.struct(
            F.lit(token).alias("token"),
            F.lit(i).alias("i"),
            F.lit(label).alias("label"),
            F.lit(template).alias("template"),
            _strings(tokens).alias("wanted"),
            F.lit(need).alias("need"),
            (_strings(run) if run else F.lit(None).cast("array<string>")).alias("run"),
        )
        for token, i, number, label, template, tokens, need, run in entries
    ]
    nothing = F.array().cast("array<struct<token:string,i:int,label:string,template:string,wanted:array<string>,need:int,run:array<string>>>")
    index = spark.range(1).select(F.inline(F.array(*fields) if fields else nothing))

    keys = [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]
    base = docs.select(column(docs, id_col).alias("doc"), *keys, words(text).alias("w"))
    heads = _strings(sorted({e[0] for e in entries}, key=place.__getitem__))
    block = lambda b: F.slice("w", b * stride + 1, F.lit(2 * stride))
    numbers = F.filter(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / stride).cast("int")), lambda b: F.arrays_overlap(block(b), heads))
    blocks = F.transform(numbers, lambda b: F.struct(b.alias("b"), block(b).alias("text"), F.array_intersect(_strings(order), block(b)).alias("tokens")))
    none = F.array().cast("array<struct<b:int,text:array<string>,tokens:array<string>>>")
    # every document also has one null block, which stands for itself
    some = F.concat(F.when(F.arrays_overlap("w", heads), blocks).otherwise(none), F.array(F.lit(None).cast("struct<b:int,text:array<string>,tokens:array<string>>")))
    rows = base.select("doc", "key", "key2", F.size("w").alias("n_words"), F.explode_outer(some).alias("block"))
    first = F.slice("block.tokens", 1, F.greatest(F.size("block.tokens") - (least - 1), F.lit(0)))
    rows = rows.select("doc", "key", "key2", "n_words", "block", F.posexplode_outer(first).alias("j", "token"))
    size = F.size("block.tokens")
    after = 1 + F.least(F.size("wanted") - 1 - F.col("i"), size - 1 - F.col("j"))
    own = rows["token"] == index["token"]
    pairs = rows.join(F.broadcast(index), own & (size >= F.col("need")) & (after >= F.col("need")), "left")
    shared = F.array_intersect("wanted", "block.tokens")
    pairs = pairs.select("doc", "key", "key2", "n_words", "block", rows["token"], "label", "template", "wanted", "need", "run", shared.alias("shared"))
    enough = (F.size("shared") >= F.col("need")) & (F.get("shared", F.lit(0)) == F.col("token"))
    pairs = pairs.where(F.col("block").isNull() | enough)
    begin = F.col("block.b") * stride
    starts = F.sequence(F.lit(0), F.least(F.lit(stride), F.size("block.text")) - 1)
    stands = F.filter(starts, lambda p: F.slice("block.text", p + 1, F.size("run")) == F.col("run"))
    places = F.when(F.col("run").isNotNull(), F.transform(stands, lambda p: p + begin))
    match = F.struct(
        "label",
        "template",
        begin.alias("start"),
        (begin + F.size("block.text")).alias("end"),
        (F.size("shared") / F.size("wanted")).alias("containment"),
        places.alias("places"),
    ).cast(_MATCH)
    told = pairs.select("doc", "key", "key2", "n_words", F.col("block").isNull().alias("itself"), F.when(F.col("block").isNotNull(), match).alias("match"))
    told = told.where(F.col("itself") | F.col("match.places").isNull() | (F.size("match.places") > 0))
    grouped = told.groupBy("doc", "key", "key2", "n_words").agg(F.count_if("itself").alias("copies"), F.sort_array(F.collect_set("match")).alias("matches"))
    out = grouped.select("doc", "key", F.col("n_words").cast("long").alias("n_words"), "matches", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(F.col("doc").alias(id_col), F.col("key").alias("text_key"), "n_words", "matches")


def labels(matches: Column | str) -> Column:
    """The distinct labels of ``matches``, sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"])))


def scan_sql(notices: Mapping[str, Sequence[str]] = NOTICES, phrases: Mapping[str, Sequence[str]] = PHRASES, threshold: float = LEAST_CONTAINMENT) -> str:
    """SQL over ``documents`` for the query of this operator: every block against every template."""
    stride = step(notices, phrases)
    value = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda named: ", ".join(
        f"({value(label)}, [{', '.join(map(value, template_words(t)))}])" for label, some in named.items() for t in some
    )
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    notices(label, t) AS (VALUES {listed(notices)}),
    phrases(label, t) AS (VALUES {listed(phrases)}),
    blocks AS (SELECT doc_id, w[b + 1 : b + {2 * stride}] AS x FROM (SELECT doc_id, w, unnest(range(0, len(w), {stride})) AS b FROM d)),
    near AS (SELECT doc_id, label, max(part) AS part FROM (
        SELECT doc_id, label, len(list_intersect(t, x)) / len(list_distinct(t)) AS part FROM blocks, notices) WHERE part >= {threshold} GROUP BY doc_id, label),
    base AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, label, t, unnest(range(1, len(w) - len(t) + 2)) AS i FROM d, phrases WHERE len(w) >= len(t))
        WHERE w[i] = t[1] AND w[i : i + len(t) - 1] = t),
    places AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM base GROUP BY doc_id),
    told AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls, max(part) AS score
        FROM (SELECT doc_id, label, part FROM near UNION ALL SELECT doc_id, label, 1.0 FROM base) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_base, p.a AS first_word, p.z AS last_word,
        coalesce(p.ls, '') AS base_labels, coalesce(t.ls, '') AS labels, CAST(coalesce(t.score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN told t USING (doc_id)
    """
