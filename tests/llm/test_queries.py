"""The registered queries: against their SQL, and the pipeline's stages against what they promise."""

import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

import corpus_pipeline
from etlspec.llm import quality
from etlspec.llm.queries import QUERIES, SQL, word_tokenizer
from tests.conftest import SMALL
from tests.oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert compare(out, connect(SMALL), SQL[name]) is None
    else:
        assert out.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= before.count(), name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == ids


def _kept_quality(spark, docs):
    model = quality.fit(spark.createDataFrame(docs), spark.read.parquet(f"{SMALL}/labels.parquet"))
    return [d for d in docs if model.scores([(d.text or "").encode()])[0] >= 0.3]


def _without_boilerplate(docs):
    pages, out = {}, []
    for d in docs:
        if d.text is not None:
            pages.setdefault(d.source, set()).add(d.text)
    seen = {s: Counter(x for t in texts for x in {line.strip(" ") for line in t.split("\n")}) for s, texts in pages.items()}
    for d in docs:
        lines = [] if d.text is None else d.text.split("\n")
        keep = [x for x in lines if not x.strip(" ") or seen[d.source][x.strip(" ")] < max(5, 0.02 * len(pages[d.source]) + 1e-9)]
        changed = len(keep) < len(lines)
        text = "\n".join(keep) if changed else d.text
        out.append(Row(**{**d.asDict(), "text": text, "n_chars": len(text) if changed else d.n_chars}))
    return out


def _one_of_each_group(docs):
    sets, prints, group = [], [], list(range(len(docs)))
    for d in docs:
        w = (d.text or "").encode().lower().split()
        runs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        sets.append(set(runs))
        prints.append(sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in runs) > len(runs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        near = a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
        if group[i] != group[j] and ((prints[i] ^ prints[j]).bit_count() <= 3 or near):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {}
    for d, g in zip(docs, group):
        least[g] = min(least.get(g, d.doc_id), d.doc_id)
    return [d for d, g in zip(docs, group) if d.doc_id == least[g]]


def _clean(spark, docs):
    def runs(text, n):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, w

    windows, short = set(), set()
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        ten, w = runs(item.text, 10)
        windows |= ten
        short |= {tuple(w)} if 0 < len(w) < 10 else set()
    return [d for d in docs if not (runs(d.text, 10)[0] & windows) and not any(s in runs(d.text, len(s))[0] for s in short)]


def test_pipeline_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    steps = [lambda d: _kept_quality(spark, d), _without_boilerplate, _one_of_each_group, lambda d: _clean(spark, d)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps):
        frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sorted(map(tuple, stage(spark, frame, SMALL).collect()))
        want = sorted(map(tuple, plain(docs)))
        assert got == want, name
        assert 0 < len(want) <= len(docs)
        docs = [Row(**dict(zip(frame.columns, r))) for r in want]
    pieces = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(docs), SMALL).collect()
    tokenizer, ids = Tokenizer.from_buffer(word_tokenizer()), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids[p.doc_id] = ids.get(p.doc_id, b"") + bytes(p.ids)
    assert ids == {d.doc_id: np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d in docs}
