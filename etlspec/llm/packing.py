"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from etlspec.llm.common import column

#: Windows that one task holds open; beyond it the fullest is filled up from the emptiest.
OPEN_WINDOWS = 2048
#: Bytes of words and ids that a worker remembers, about; beyond it, it begins anew.
CACHE_BYTES = 32 << 20
#: Bytes of text that are split and encoded at a time, about.
TEXT_BYTES = 1 << 20
#: Bytes a tokenizer file may have, since it is broadcast.
MAX_TOKENIZER_BYTES = 64 << 20
#: White space that ends a word.
BLANK = re.compile(r"[ \t\n\x0b\f\r]")
# Fixed value: a split pattern by which any run of letters is one piece.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of small letters that no normal form changes, and the signs after it; special tokens are written with < and |.
LETTERS = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@\\[-`{}~]*)")


class SumOfSquares:
    """Online packing of pieces into windows of ``capacity`` tokens.

    ``level[h]`` counts the open windows that hold h tokens. A piece of s tokens
    goes to the level h (0: a new window) that makes the sum of the squared
    counts of partly filled levels smallest; of equal ones the fullest. A full
    window is closed. Pieces are (document, start, length, ids).
    """

    def __init__(self, capacity: int, close) -> None:
        self.capacity, self.close = capacity, close
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def add(self, doc: int, start: int, ids: bytes) -> None:
        s, room = len(ids) // 4, self.capacity - len(ids) // 4
        if not room:
            self.close([(doc, start, ids)])
            return
        levels = np.flatnonzero(self.level[: room + 1])  # level[0] is never counted
        best, change = 0, 2 * self.level[s] + 1
        if len(levels):
            after = np.where(levels == room, 0, 2 * self.level[levels + s] + 1) - 2 * self.level[levels] + 1
            k = len(levels) - 1 - int(np.argmin(after[::-1]))
            if after[k] <= change:
                best = int(levels[k])
        window = self._take(best) if best else []
        window.append((doc, start, ids))
        if best == room:
            self.close(window)
        else:
            self._put(best + s, window)
            if self.n_open > OPEN_WINDOWS:
                self.relieve()

    def _take(self, fill: int) -> list[tuple]:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.windows[fill].pop()

    def _put(self, fill: int, window: list[tuple]) -> None:
        self.level[fill] += 1
        self.n_open += 1
        self.windows.setdefault(fill, []).append(window)

    def _move(self, source: list[tuple], window: list[tuple], tokens: int) -> None:
        while tokens:
            doc, start, ids = source.pop()
            keep = max(0, len(ids) // 4 - tokens)
            window.append((doc, start + keep, ids[4 * keep :]))
            tokens -= len(ids) // 4 - keep
            if keep:
                source.append((doc, start, ids[: 4 * keep]))

    def relieve(self) -> None:
        """Fill the fullest open window with pieces cut from the emptiest, and close it."""
        fill = int(np.flatnonzero(self.level)[-1])
        window = self._take(fill)
        while fill < self.capacity:
            spare = int(np.flatnonzero(self.level)[0])
            source, move = self._take(spare), min(self.capacity - fill, spare)
            self._move(source, window, move)
            fill += move
            if spare > move:
                self._put(spare - move, source)
        self.close(window)

    def top_off(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest; at most one stays open."""
        open_ = [(fill, w) for fill in np.flatnonzero(self.level).tolist() for w in self.windows[fill]]
        self.level[:] = 0
        self.windows, self.n_open = {}, 0
        low, high = 0, len(open_) - 1
        while low < high:
            (fill, window), (spare, source) = open_[high], open_[low]
            move = min(self.capacity - fill, spare)
            fill, spare = fill + move, spare - move
            self._move(source, window, move)
            open_[high], open_[low] = (fill, window), (spare, source)
            if fill == self.capacity:
                self.close(window)
                high -= 1
            if not spare:
                low += 1
        if low == high:
            self._put(*open_[low])

    def finish(self) -> None:
        self.top_off()
        for windows in self.windows.values():
            for window in windows:
                self.close(window)
        self.windows, self.n_open = {}, 0
        self.level[:] = 0


class WordEncoder:
    """Token ids of texts, as unsigned 32-bit numbers.

    Tokenizers that never join text across ASCII white space, and drop it, give
    a text the ids of its words one after another; any other is refused. Arrow
    splits a batch of texts and numbers its distinct words, each unknown word is
    encoded once, and the ids of the texts are gathered by number.

    Where the file's rules make any run of letters one piece as it stands, words
    of letters go past these rules to the rest of the tokenizer, and signs after
    them are encoded apart.

    As a broadcast value it lives as long as a Python worker, so what it
    remembers serves all tasks of that worker. Only the file is sent.
    """

    def __init__(self, file: bytes) -> None:
        self.file = file
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"file": self.file, "tokenizer": None}

    def _open(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(self.file)
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        for blank in " \t\n":
            if ids(f"{blank}the{blank * 2}of") != ids("the") + ids("of"):
                raise ValueError("the tokenizer must drop white space and not join text across it")
        self.small = ids("ABCXYZ The") == ids("abcxyz the")
        self.letters = _letters(json.loads(self.file)) if self.small else None
        self.tokenizer = tokenizer
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> dict[str, list[int]]:
        out = {}
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            out.update(zip(some, (e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return out

    def _learn(self, words: list[str]) -> None:
        if self.letters:
            parts = [(m[1], m[2]) if m else ("", w) for w, m in zip(words, map(LETTERS.fullmatch, words))]
        else:
            parts = [("", w) for w in words]
        plain = {p: self.letters(p) if p else [] for p in {p for p, _ in parts}}
        whole = self._encode(list({w for _, w in parts if w}))
        new = [plain[p] + whole[w] if w else plain[p] for p, w in parts]
        length = np.fromiter(map(len, new), np.int64, len(new))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.uint32, int(length.sum()))])
        self.bytes += sum(map(len, words)) + 130 * len(words) + 4 * int(length.sum())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and where each text's ids end."""
        if self.tokenizer is None:
            self._open()
        if self.bytes > CACHE_BYTES:
            self._forget()
        texts = pc.fill_null(texts, "")
        if self.small:  # special tokens are told apart by case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.array([self.known.get(w, -1) for w in distinct], np.int64)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            numbers[unknown] = len(self.known) + np.arange(len(unknown))
            self._learn([distinct[i] for i in unknown.tolist()])
        number = numbers[coded.indices.to_numpy()]
        length = self.length[number]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(self.start[number] - ends[:-1], length) + np.arange(ends[-1])]
        offsets = words.offsets.to_numpy()
        return ids, ends[offsets[1:] - offsets[0]]


def _letters(spec: dict):
    """A function from a word of LETTERS to its ids, if the tokenizer's rules leave such words as they are and in one piece."""
    from tokenizers import models, pre_tokenizers

    normalizer, splitter, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    changes = normalizer.get("normalizers", [normalizer] if normalizer else [])
    harmless = all(c["type"] in ("NFC", "Lowercase") or (c["type"] == "Replace" and c["pattern"] == {"Regex": r"\s+"}) for c in changes)
    steps = splitter.get("pretokenizers", [])
    known = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": LETTER_RUNS}
    if not (harmless and known and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and model["type"] == "BPE"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    kept = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
    tokenize = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **kept).tokenize
    by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
    return lambda word: [t.id for t in tokenize(word if word.isascii() else word.translate(table))]


def _stretches(texts: pa.Array) -> Iterator[tuple[range, pa.Array, bool]]:
    """(rows, their texts, whether they end here), about TEXT_BYTES at a time; longer texts come in parts cut at white space."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first = held = 0
    for row, size in enumerate(sizes):
        if row > first and held + size > TEXT_BYTES:
            yield range(first, row), texts.slice(first, row - first), True
            first, held = row, 0
        held += size
        if size > TEXT_BYTES:
            text, at = texts[row].as_py(), 0
            while at < len(text):
                cut = BLANK.search(text, at + TEXT_BYTES)
                to = cut.start() if cut else len(text)
                yield range(row, row), pa.array([text[at:to]], texts.type), False
                at = to
            yield range(row, row + 1), pa.array([""], texts.type), True
            first, held = row + 1, 0
    if first < len(sizes):
        yield range(first, len(sizes)), texts.slice(first), True


def _pack(batches: Iterator[pa.RecordBatch], encode: WordEncoder, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], dtype="<u4").tobytes()
    first = TaskContext.get().partitionId() << 40
    closed: list[list[tuple]] = []
    packer = SumOfSquares(capacity, closed.append)
    names = {}  # of documents with a piece that has not left yet
    n_docs = n_windows = 0

    def leave() -> pa.RecordBatch:
        nonlocal n_windows
        columns: dict[str, list] = {n: [] for n in ("doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for window in closed:
            offset = 0
            for doc, start, ids in window:
                name, total, left = names[doc]
                length = len(ids) // 4
                if left == length:
                    del names[doc]
                else:
                    names[doc] = (name, total, left - length)
                for n, v in zip(columns, (name, start, length, ids, total, first + n_windows, offset)):
                    columns[n].append(v)
                offset += length
            n_windows += 1
        closed.clear()
        types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types)], names=list(columns))

    kind = None
    pool = pa.default_memory_pool()
    pool.release_unused()  # what earlier tasks left in this worker
    for batch in batches:
        kind = batch.schema.field(0).type
        row_names, held = batch.column(0).to_pylist(), []
        for rows, texts, last in _stretches(batch.column(1)):
            ids, ends = encode(texts)
            raw = ids.astype("<u4").tobytes()
            pool.release_unused()  # what splitting took, or the worker keeps its sum
            if not last:
                held.append(raw)
                continue
            low = 0
            for row, high in zip(rows, ends.tolist()):
                own = b"".join([*held, raw[4 * low : 4 * high], end])
                held, low, total = [], high, len(own) // 4
                names[n_docs] = (row_names[row], total, total)
                for start in range(0, total, capacity):
                    packer.add(n_docs, start, own[4 * start : 4 * (start + capacity)])
                n_docs += 1
            if len(closed) >= 512:
                yield leave()
    packer.finish()
    if closed:
        yield leave()


def pack(
    docs: DataFrame,
    tokenizer: bytes,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``capacity`` tokens.

    A document is the ids of its text, then ``end_id``. Columns: ``id_col``,
    ``start`` (its ids before the piece), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``. ``tokenizer``
    is a tokenizer file's content. It must drop ASCII white space and never join
    text across it; any other is refused by the first task.

    Each input partition is packed as it is read, with no shuffle: a document
    longer than a sequence fills whole ones, and the rest goes where the
    sum-of-squares rule says. The last open sequences of a partition are topped
    off by cutting, so each partition ends with one partly filled sequence at
    most. A task holds the open sequences only, ``OPEN_WINDOWS`` at most: beyond
    it, the fullest is filled up with pieces cut from the emptiest. Rows read
    again after a lost executor give the same pieces.

    Null and blank texts are documents of ``end_id`` alone. Repeated rows are
    documents of their own, an empty table gives no rows, and other columns are
    not used.
    """
    if len(tokenizer) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is too large to send to every executor")
    if capacity < 2:
        raise ValueError("capacity is 2 or more")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(WordEncoder(tokenizer))
    slim = docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).cast("string").alias("text"))
    schema = f"doc {slim.schema['doc'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = slim.mapInArrow(lambda batches: _pack(batches, shared.value, end_id, capacity), schema)
    return pieces.withColumnRenamed("doc", id_col)
