"""Language identification of mixed-language text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, held_out, without

BITS = 17
#: Characters that are scored at once.
BLOCK_CHARS = 1 << 20
#: Languages that a model may have: its table is sent to every executor.
MAX_LANGUAGES = 200
#: Documents that a language may have in the sample, whatever its share.
LEAST_ROWS = 50
#: First code points of script ranges and the script each starts; 0 is any other.
RANGES = (
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 10), (0x0C80, 0), (0x0E00, 11),
    (0x0E80, 0), (0x10A0, 12), (0x1100, 13), (0x1200, 14), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 15),
    (0x3100, 0), (0x3400, 16), (0x4DC0, 0), (0x4E00, 16), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0), (0x20000, 16), (0x32000, 0),
)
SCRIPTS = 17
STARTS = np.array([a for a, _ in RANGES])
NAMES = np.array([b for _, b in RANGES])


@dataclass(frozen=True)
class Words:
    """Words of several texts: the text, first and last + 1 character in it, letters' n-gram keys, each word's first key."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    script: np.ndarray


class Reader:
    """Splits texts into words, runs of letters; every letter has the key of the three characters around it."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x32000)), bool, 0x32000)
        self.lower = np.arange(0x32000, dtype=np.uint32)
        for i in range(0x32000):
            if len(low := chr(i).lower()) == 1 and low != chr(i) and ord(low) < 0x32000:
                self.lower[i] = ord(low)

    def __call__(self, texts: list[str]) -> Words:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.cumsum(sizes) - sizes
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lower[np.where(codes < 0x32000, codes, 10)]
        letter = self.letter[codes]
        at = np.flatnonzero(letter)
        marked = np.where(letter, codes, 0).astype(np.uint64)
        padded = np.concatenate(([0], marked, [0])).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = (padded[at] * np.uint64(0x9E3779B1) + padded[at + 1]) * np.uint64(0x85EBCA77) + padded[at + 2]
            keys = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        first = np.flatnonzero(new)
        start = at[first]
        end = at[np.concatenate((first[1:], [len(at)])) - 1] + 1 if len(at) else start
        doc = np.searchsorted(offsets, start, side="right") - 1
        script = NAMES[np.searchsorted(STARTS, codes[start], side="right") - 1] if len(at) else start
        return Words(doc, start - offsets[doc], end - offsets[doc], keys, first, script)


def blocks(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts to score together: of like length, so that their words are walked in step."""
    block, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        block.append(i)
        size += len(texts[i])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@dataclass(frozen=True)
class Model:
    """languages; log-probabilities by n-gram key and language; which languages use a script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray
    penalty: float

    def labels(self, words: Words, n: int) -> np.ndarray:
        """The language number of each word: the best path of Viterbi's algorithm over each text's words."""
        scores = np.add.reduceat(self.table[words.keys], words.first, axis=0)
        fits = self.uses[words.script]
        none = ~fits.any(1)
        scores = np.where(none[:, None], 0, np.where(fits, scores, scores.min(1, keepdims=True) - 50))
        counts = np.bincount(words.doc, minlength=n)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        lengths = counts[order]
        begin = (np.cumsum(counts) - counts)[order]
        best_before = np.zeros(len(scores), np.int64)
        moved = np.zeros(scores.shape, bool)
        value = scores[begin].astype(np.float64)
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        for t in range(1, lengths[0]):
            k = alive[t]
            rows = begin[:k] + t
            past = value[:k]
            top = past.argmax(1)
            other = past[np.arange(k), top][:, None] - self.penalty
            switch = other > past
            best_before[rows], moved[rows] = top, switch
            value[:k] = np.where(switch, other, past) + scores[rows]
        out = np.zeros(len(scores), np.int64)
        now = value.argmax(1)
        for t in range(lengths[0] - 1, -1, -1):
            k = alive[t]
            rows = begin[:k] + t
            out[rows] = now[:k]
            now[:k] = np.where(moved[rows, now[:k]], best_before[rows], now[:k])
        return out

    def spans(self, texts: list[str], read: Reader) -> list[tuple[str, float, list[dict]]]:
        """(language, share of letters, spans) of each text."""
        words = read(texts)
        found: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
        if not len(words.start):
            return found
        label = self.labels(words, len(texts))
        letters = words.end - words.start
        share = np.zeros((len(texts), len(self.languages)))
        np.add.at(share, (words.doc, label), letters)
        top = share.argmax(1)
        sums = share.sum(1)
        cut = np.ones(len(label), bool)
        cut[1:] = (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])
        heads = np.flatnonzero(cut)
        tails = np.concatenate((heads[1:], [len(label)])) - 1
        spans: dict[int, list[dict]] = {}
        for d, l, a, b in zip(words.doc[heads].tolist(), label[heads].tolist(), words.start[heads].tolist(), words.end[tails].tolist()):
            spans.setdefault(d, []).append({"lang": self.languages[l], "start": a, "end": b})
        for d in spans:
            found[d] = (self.languages[top[d]], float(share[d, top[d]] / sums[d]), spans[d])
        return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = Reader()
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for block in blocks(texts):
            for lang in {langs[i] for i in block}:
                words = read([texts[i] for i in block if langs[i] == lang])
                total = grams.setdefault(lang, np.zeros((1 << BITS) + SCRIPTS, np.int64))
                total[: 1 << BITS] += np.bincount(words.keys, minlength=1 << BITS)
                total[1 << BITS :] += np.bincount(words.script, minlength=SCRIPTS)
    for lang, total in grams.items():
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(total[keys])], ["lang", "key", "n"])


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 12_000, penalty: float = 10.0
) -> Model:
    """Learn n-gram frequencies of each language from documents outside the held-out fifth.

    Each language has an equal share of ``sample_rows``, ``LEAST_ROWS`` at
    least: all its documents are used if they are no more than that, else about
    so many, chosen by a hash of their id; so no language is lost in a large
    table. They are counted in parallel and added up by Spark; the table of counts, languages times 2^17 at most, is what comes
    to the driver. A language uses a script if it writes a hundredth of its
    words in it. ``penalty`` is the cost of a change of language, in nats.
    """
    usable = docs.where(column(docs, lang_col).isNotNull() & column(docs, id_col).isNotNull()).where(~held_out(column(docs, id_col)))
    lang, ids = column(docs, lang_col), column(docs, id_col)
    sizes = usable.groupBy(lang.cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"there are more than {MAX_LANGUAGES} languages")
    share = max(LEAST_ROWS, sample_rows // max(1, len(sizes)))
    cuts = [F.lit(x) for r in sizes if r["n"] > share for x in (r["lang"], int((1 << 30) * share / r["n"]))]
    if cuts:
        below = F.coalesce(F.create_map(*cuts)[lang.cast("string")], F.lit(1 << 30))
        usable = usable.where(F.pmod(F.xxhash64(ids, F.lit("sample")), F.lit(1 << 30)) < below)
    texts = usable.select(column(docs, lang_col).alias("lang"), column(docs, text_col).alias("text")).repartition(8)
    counts = texts.mapInArrow(_counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.zeros(((1 << BITS) + SCRIPTS, max(1, len(languages))))
    table[counts["key"].to_numpy(np.int64), counts["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(np.int64)] = counts["n"].to_numpy()
    grams, scripts = table[: 1 << BITS] + 0.5, table[1 << BITS :]
    uses = scripts >= np.maximum(0.01 * scripts.sum(0), 1)
    return Model(languages or ["und"], np.log(grams / grams.sum(0)).astype(np.float32), uses, penalty)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with ``out_col``: struct<lang, score, spans>.

    ``spans`` is array<struct<lang, start, end>>: stretches of the text, in
    characters, with the language of their words. The script of a word leaves
    the languages that use it; the best path through the words' scores, with a
    penalty for each change, gives the labels. ``lang`` has most letters and
    ``score`` is its share of them. Null texts and texts without letters are
    ``und`` with score 0 and no span. The text alone decides. An ``out_col``
    already present is replaced; other columns and repeated rows pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, spans array<struct<lang:string,start:int,end:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for batch in batches:
            texts = [t or "" for t in batch]
            found: list = [None] * len(texts)
            for block in blocks(texts):
                for i, x in zip(block, shared.value.spans([texts[i] for i in block], read)):
                    found[i] = x
            yield pd.DataFrame(found, columns=["lang", "score", "spans"])

    return without(docs, [out_col]).withColumn(out_col, of(column(docs, text_col)))
