"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, fresh, settled
from etlspec.llm.components import components

#: Rows of a block that are compared in one task; a larger block is compared in pairs of such parts.
PART_ROWS = 1024
#: Min-hashes of a sketch, of which one byte each is kept, and the first of them that form block keys: bands times rows.
SKETCH, BANDS, BAND_ROWS = 512, 16, 5
#: As PART_ROWS, for sketches: pairs that are linked already cost little.
SKETCH_PART_ROWS = 4096
#: Sketches pick pairs down to so much below the similarity asked for, over four standard errors at 0.8.
MARGIN = 0.08
#: As PART_ROWS, for sets of shingles, and the bytes of sets in such a part.
SET_PART_ROWS, SET_PART_BYTES = 512, 32 << 20


def _hashes(data: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every run of ``shingle_words`` words, repeats included; of all words if there are fewer, of none if none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = data.lower().split() if data else ()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([digest(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle_words + 1].tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts, stops)], dtype="<u8")


def fingerprint(text: Column, shingle_words: int) -> Column:
    """The 64-bit SimHash of a text, as a signed long.

    A-Z are lower-cased, words are split at ASCII white space, and every run of
    ``shingle_words`` words counts, repeats included; a text of fewer words is
    one run. Hash: XXH64 of the UTF-8 bytes, seed 42. A bit is set if it is set
    in over half of the hashes. Null and blank texts give zero.
    """

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_majority(_hashes(x, shingle_words)) for x in batch], dtype="int64")

    return of(text.cast("binary"))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    if not len(hashes):
        return 0
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(parts) < 2000:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        bits_of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        counts = np.concatenate([np.bincount(parts[:, k], minlength=256) @ bits_of_byte for k in range(8)])
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def blocks(max_bits: int, equal_blocks: int = 3) -> list[int]:
    """Masks such that fingerprints at most ``max_bits`` apart are equal under one of them.

    The 64 bits are cut into ``max_bits`` + ``equal_blocks`` pieces. At most
    ``max_bits`` of them hold a differing bit, so ``equal_blocks`` pieces at
    least are equal; there is a mask for every choice of so many. More equal
    blocks give longer keys, with fewer chance meetings, and more of them.
    """
    if not 0 <= max_bits <= 16:
        raise ValueError("max_bits is 0 to 16")
    n = max_bits + equal_blocks
    ends = [64 * i // n for i in range(n + 1)]
    pieces = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    masks = [sum(chosen) for chosen in combinations(pieces, equal_blocks)]
    assert len(masks) == comb(n, equal_blocks)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def sketch(text: Column, shingle_words: int) -> Column:
    """(fp, sketch, bands, digest): the ``fingerprint`` of a text, one byte of each of ``SKETCH`` min-hashes over its set of shingles, its block keys, a hash of the set.

    Words and shingles are those of ``fingerprint``. The share of equal bytes of
    two sketches estimates the Jaccard similarity of the two sets, with a
    standard error below two points at 0.8, so it picks pairs and decides none.
    Texts whose similarity is 0.8 share a block with a probability of 0.998.
    All but ``fp`` are null for texts without a word.

    The fingerprint is found here too, since each function of its own takes one
    more Python worker for every task, and hashes the shingles again.
    """
    rng = np.random.default_rng(42)
    masks = rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)[:, None]
    factors = (rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * 2 + 1)[:, None]

    @F.pandas_udf("fp long, sketch binary, bands array<long>, digest long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        def one(data: bytes | None) -> tuple:
            every = _hashes(data, shingle_words)
            if not len(every):
                return 0, None, None, None
            runs = np.unique(every)
            hashes = (runs >> np.uint64(32)).astype(np.uint32)
            least = np.full(SKETCH, (1 << 32) - 1, np.uint32)
            for i in range(0, len(hashes), 1024):
                least = np.minimum(least, ((hashes[i : i + 1024] ^ masks) * factors).min(1))
            rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
            keys = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]
            return _majority(every), _kept_byte(least).tobytes(), keys, xxhash.xxh64_intdigest(runs.tobytes(), 7) - (1 << 63)

        for batch in batches:
            prints, sketches, bands, digests = zip(*map(one, batch)) if len(batch) else ((), (), (), ())
            # whole numbers beside nulls would pass through floats and lose digits
            yield pd.DataFrame(
                {"fp": pd.Series(prints, dtype="int64"), "sketch": pd.Series(sketches, dtype=object), "bands": pd.Series(bands, dtype=object), "digest": pd.array(digests, dtype="Int64")}
            )

    return of(text.cast("binary"))


def _kept_byte(least: np.ndarray) -> np.ndarray:
    """A byte that depends on all 32 bits: minima of long texts are small numbers."""
    x = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (x >> np.uint32(24)).astype(np.uint8)


def shingle_set(text: Column, shingle_words: int) -> Column:
    """The set of a text's shingles, as their sorted 64-bit hashes, eight bytes each."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(_hashes(x, shingle_words)).tobytes() for x in batch], dtype=object)

    return of(text.cast("binary"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, each a sorted array that is not empty."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _close(rows: Iterator[pa.RecordBatch], near: Callable[[np.ndarray, np.ndarray], np.ndarray], mark: np.dtype) -> Iterator[pa.RecordBatch]:
    """Links within blocks. ``rows(key, p, q, id, mark)`` come sorted by key, p and q; ``near`` compares marks.

    Of each block a spanning forest of its links leaves, not all pairs.
    """

    def links(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        label = np.arange(len(ids))
        at, step = np.arange(len(ids)), 1
        while True:
            at = at[at + step < len(ids)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            # pairs that are linked already need no test
            a = at[label[at] != label[at + step]]
            a = a[near(marks[a], marks[a + step])]
            b = a + step
            # one link for each row and step at most: joined as they come, so that few are held
            while len(a):
                x, y = label[a], label[b]
                low, high = np.minimum(x, y), np.maximum(x, y)
                np.minimum.at(label, high, low)
                while not np.array_equal(label, flat := label[label]):
                    label = flat
                left = label[a] != label[b]
                a, b = a[left], b[left]
            step += 1
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["a", "b"])

    held: list[np.ndarray] = []
    weight = 0  # bytes of marks since the last links

    def parts(block: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.ones(len(block), bool)
        new[1:] = (block["key"][1:] != block["key"][:-1]) | (block["p"][1:] != block["p"][:-1]) | (block["q"][1:] != block["q"][:-1])
        return np.cumsum(new), block["id"], block["mark"]

    kind = np.dtype([("key", "i8"), ("p", "i4"), ("q", "i4"), ("id", "i8"), ("mark", mark)])
    for batch in rows:
        block = np.empty(batch.num_rows, kind)
        for name in kind.names[:-1]:
            block[name] = batch.column(name).to_numpy(zero_copy_only=False)
        marks = batch.column("mark")
        if mark == object:
            block["mark"] = marks.to_pylist()
            weight += marks.nbytes
        else:
            block["mark"] = np.frombuffer(b"".join(marks.to_pylist()) if pa.types.is_binary(marks.type) else marks.to_numpy().tobytes(), mark)
        held.append(block)
        if not len(block) or (sum(map(len, held)) < 8 * PART_ROWS and weight < SET_PART_BYTES):
            continue
        weight = 0
        block = np.concatenate(held)
        last = block[-1]
        same = (block["key"] == last["key"]) & (block["p"] == last["p"]) & (block["q"] == last["q"])
        cut = int(np.argmax(same))  # the last block may go on in the next batch
        held = [block[cut:]]
        if cut:
            yield links(*parts(block[:cut]))
    if held and sum(map(len, held)):
        yield links(*parts(np.concatenate(held)))


def _block_links(keyed: DataFrame, marks: DataFrame, near: Callable, mark: np.dtype, part_rows: int, part_bytes: int | None = None) -> DataFrame:
    """Edges (a, b) between rows of ``keyed(key, id)`` that share a key and whose marks in ``marks(id, mark)`` are near.

    Only rows that share a key with another take their mark along. A block of
    more than ``part_rows`` rows is cut into parts and compared part against
    part in different tasks, so no task holds more than two parts and no pair is
    lost. With ``part_bytes``, ``keyed`` has the ``bytes`` of each row too, and
    parts hold about so many.
    """
    width = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.sum("bytes") / part_bytes if part_bytes else F.lit(0.0)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), heavy.alias("heavy")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / part_rows, "heavy")).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("part")), parts.cast("long")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    small = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    rows = (
        keyed.join(sizes, "key")
        .join(marks, "id")
        .select("key", "id", "mark", parts.alias("parts"), own.alias("own"))
        .select("key", "id", "mark", F.explode(F.when(F.col("parts") == 1, small).otherwise(met)).alias("at"))
        .select("key", "at.p", "at.q", "id", "mark")
    )
    return (
        rows.repartition(width, "key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
        .mapInArrow(lambda batches: _close(batches, near, mark), "a long, b long")
    )


def close_links(nodes: DataFrame, max_bits: int, equal_blocks: int = 3) -> DataFrame:
    """Edges (a, b) that connect all ``nodes(id, fp)`` whose fingerprints are at most ``max_bits`` apart.

    Fingerprints must be distinct. The edges have the components of all close
    pairs, with fewer than one edge for each row of a block.
    """
    key = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(blocks(max_bits, equal_blocks))]
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(width, "id")  # a small table, about to grow
    keyed = nodes.select("id", F.explode(F.array(*key)).alias("key"))
    near = lambda a, b: np.bitwise_count(a ^ b) <= max_bits
    return _block_links(keyed, nodes.select("id", F.col("fp").alias("mark")), near, np.dtype("u8"), PART_ROWS)


def likely_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all ``nodes(id, sketch, bands)`` that share a band and whose sketches agree in nearly that share of bytes."""
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    near = lambda a, b: (a == b).sum(1, dtype=np.int32) >= (similarity - MARGIN) * SKETCH
    marks = nodes.where("sketch IS NOT NULL").select("id", F.col("sketch").alias("mark"))
    return _block_links(keyed, marks, near, np.dtype(("u1", (SKETCH,))), SKETCH_PART_ROWS)


def similar_links(nodes: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between ``nodes(id, sketch, bands, text_key)`` whose sets of shingles have that Jaccard similarity.

    The components of likely pairs are the blocks. In a block, each pair whose
    sketches nearly agree, and that links don't connect yet, is decided by the
    sets themselves. ``texts(text_key, text)`` may repeat; only texts of likely
    pairs give sets.
    """
    likely = components(likely_links(nodes, similarity)).withColumnsRenamed({"node": "id", "component": "key"})
    wanted = nodes.join(likely, "id").select("id", "key", "sketch", "text_key")
    one = texts.groupBy("text_key").agg(F.first("text").alias("text"))  # combines copies before the shuffle
    sets = settled(wanted.join(one, "text_key").select("id", "key", F.concat("sketch", shingle_set(F.col("text"), shingle_words)).alias("mark")))

    heads = lambda marks: np.frombuffer(b"".join([x[:SKETCH] for x in marks]), np.uint8).reshape(-1, SKETCH)
    whole = lambda mark: np.frombuffer(mark, "<u8", offset=SKETCH)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (heads(a) == heads(b)).sum(1, dtype=np.int32) >= (similarity - MARGIN) * SKETCH
        for i in np.flatnonzero(out):
            out[i] = jaccard(whole(a[i]), whole(b[i])) >= similarity
        return out

    keyed = sets.select("id", "key", F.octet_length("mark").cast("long").alias("bytes"))
    return _block_links(keyed, sets.select("id", "mark"), near, np.dtype(object), SET_PART_ROWS, SET_PART_BYTES)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    max_bits: int = 3,
    equal_blocks: int = 3,
    similarity: float | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (long) and ``component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id that links reach, itself included. With
    ``similarity``, documents whose sets of shingles have that Jaccard
    similarity link as well, which few bits of a fingerprint can't tell: min-hash
    sketches pick likely pairs, see ``sketch``, and the sets decide. ``docs`` is
    read twice then. Equal fingerprints meet in an aggregation before anything
    else, so copies never form pairs. Null and blank texts have fingerprint zero and link like
    any other. A null id counts as no id: such a row keeps its group's
    component, which is null if the group has no id at all. Repeated rows give
    repeated rows, an empty table gives none, and other columns are not used.
    """
    marked, classes = _classes(docs, id_col, text_col, shingle_words, max_bits, equal_blocks, similarity)
    return marked.join(classes, "node").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _classes(
    docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int, equal_blocks: int, similarity: float | None, keyed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The documents (id, fp, node), ``keyed`` also by text_key, and each node's class (node, root, component_id)."""
    text = column(docs, text_col)
    plain = docs.select(column(docs, id_col).cast("long").alias("id"), text.alias("text"))
    # a fingerprint, or one with a set of shingles, is its own node, so that documents without an id link others too
    if similarity is None:
        key = [F.xxhash64("text").alias("text_key")] if keyed else []
        marked = plain.withColumn("fp", fingerprint(F.col("text"), shingle_words))
        marked = settled(marked.select("id", "fp", F.col("fp").alias("node"), *key))
        links = close_links(marked.select(F.col("fp").alias("id"), "fp").distinct(), max_bits, equal_blocks)
    else:
        texts = plain.select(F.xxhash64("text").alias("text_key"), "text")
        sketched = plain.withColumn("s", sketch(F.col("text"), shingle_words))
        sketched = sketched.select("id", "s.fp", "s.sketch", "s.bands", F.xxhash64("s.fp", "s.digest").alias("node"), F.xxhash64("text").alias("text_key"))
        marked = settled(sketched)
        nodes = marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "sketch", "bands", "text_key")]).withColumnRenamed("node", "id")
        nodes = settled(nodes)
        prints = nodes.groupBy("fp").agg(F.min("id").alias("id"))
        equal = nodes.select("id", "fp").join(prints.withColumnRenamed("id", "b"), "fp").where("id <> b").select(F.col("id").alias("a"), "b")
        links = close_links(prints, max_bits, equal_blocks).unionByName(equal).unionByName(similar_links(nodes, texts, shingle_words, similarity))
    found = components(links)
    least = marked.groupBy("node").agg(F.min("id").alias("least"))
    placed = least.join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, placed.select("node", "root").join(lowest, "root").select("node", "root", "component_id")


def keep_one(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    max_bits: int = 3,
    equal_blocks: int = 3,
    similarity: float | None = None,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group.

    Of each group the row with the smallest id stays, rows without an id last.
    Where an id has several texts the row with the smaller hash of its text
    stays, and of rows equal in both one of them. So a text that has no copy
    stays, whatever other rows share its id or have none. Rows of a group are
    counted by id and text before they meet, so copies never gather in one task.
    """
    marked, classes = _classes(docs, id_col, text_col, shingle_words, max_bits, equal_blocks, similarity, keyed=True)
    rows = marked.groupBy("node", "id", "text_key").agg(F.count("*").alias("n"))
    placed = rows.join(classes.select("node", "root"), "node").groupBy("root", "id", "text_key").agg(F.sum("n").alias("n"))
    placed = settled(placed)
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("kept"))
    mine = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("text_key") == F.col("kept.text_key"))
    judged = placed.join(first, "root").select("id", "text_key", "n", mine.alias("stays")).where("NOT stays OR n > 1")
    judged = settled(judged)
    i, t = fresh(docs, "judged_id", "judged_text")
    same = column(docs, id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(column(docs, text_col)) == F.col(t))
    touched = judged.select(F.col("id").alias(i), F.col("text_key").alias(t))
    repeated = judged.where("stays").select(F.col("id").alias(i), F.col("text_key").alias(t))
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    whole, order = F.struct(*[column(docs, c) for c in docs.columns]), F.xxhash64(*[column(docs, c) for c in plain])
    one = docs.join(repeated, same).groupBy(i, t).agg(F.min_by(whole, order).alias("row")).select("row.*")
    return docs.join(touched, same, "left_anti").unionByName(one)
