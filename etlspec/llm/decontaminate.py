"""Benchmark decontamination: word windows of a benchmark, looked up in every document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import ascii_lower, column, fresh, settled

#: A run of digits, letters a-z, and anything beyond ASCII; Java matches a class of what belongs to it several times as fast as its negation.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The same before A-Z are lower-cased.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Bytes of windows sent to every executor at once; more are looked up in several passes.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _window_key(hashes: Column, at: Column | int, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, F.lit(at) + k if isinstance(at, int) else at + k) for k in range(length)])


def _window_keys(length: int) -> Column:
    """The keys of all windows of the words ``w`` with the given ``hashes``."""
    starts = F.sequence(F.lit(0), F.size("w") - length)
    keys = F.transform(starts, lambda i: _window_key(F.col("hashes"), i, length))
    return F.when(F.size("w") >= length, keys).otherwise(F.array().cast("array<long>"))


def windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", length: int = 10) -> DataFrame:
    """(window, size, key, items): every window of the benchmark once, with the items that have it.

    A window is ``length`` consecutive words; an item of fewer words, but not
    none, is one window. Items without an id are looked up like any other but
    can't be named.
    """
    items = benchmark.select(column(benchmark, id_col).cast("string").alias("item"), words(column(benchmark, text_col)).alias("w"))
    n = F.size("w")
    runs = F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: F.slice("w", i + 1, length))).when(n > 0, F.array("w"))
    one = items.select("item", F.explode(runs).alias("run"))
    named = one.groupBy(F.array_join("run", " ").alias("window"), F.size("run").alias("size")).agg(F.collect_set("item").alias("items"))
    hashes = F.transform(F.split("window", " "), lambda x: F.xxhash64(x))
    keyed = named.withColumn("hashes", hashes)
    key = reduce(lambda rest, k: F.when(F.col("size") == k, _window_key(F.col("hashes"), 0, k)).otherwise(rest), range(1, length + 1), F.lit(None).cast("long"))
    return keyed.select("window", "size", key.alias("key"), "items")


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = 10,
) -> DataFrame:
    """One row per document: what of the benchmark it holds.

    Columns: ``id_col``; ``text_key`` (a hash of the text); ``n_words``;
    ``spans``, the hit words as array<struct<start, end>> of word positions, end
    exclusive, joined where windows overlap or touch; ``n_hit``, the words in
    them; ``items``, the ids of the items found, as sorted strings.

    A-Z are lower-cased and words are runs of digits, letters and non-ASCII
    characters. Every window of every document is looked up by key in a
    broadcast hash table of the benchmark's windows, and each hit is compared
    word for word. The table is sent in slices of at most ``BROADCAST_BYTES``,
    each a pass over the documents. Only hits, and one row a document, are
    shuffled.

    Null and wordless texts have no words and no hits. Repeated rows give
    repeated rows. An empty benchmark finds nothing; an empty table gives no
    rows. Other columns are not used.
    """
    found = settled(windows(benchmark, id_col=item_col, text_col=item_text_col, length=length))
    bound = found.agg(
        F.coalesce(F.sum(F.octet_length("window") + 64 + F.coalesce(F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16), F.lit(0))), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("size")).alias("sizes"),
    ).first()
    sizes, slices = bound["sizes"], 1 + bound["bytes"] // BROADCAST_BYTES
    text = column(docs, text_col)
    base = docs.select(column(docs, id_col).alias("doc"), F.xxhash64(text).alias("text_key"), words(text).alias("w"))
    base = base.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    keys = [_window_keys(k) for k in sizes]
    # the last key stands for the document itself, so that those without a hit stay; no array is empty,
    # and the outer form keeps the optimizer from testing that on a second copy of the expression
    rows = base.select("doc", "text_key", "w", F.concat(*keys, F.array(F.lit(0).cast("long"))).alias("keys"))
    rows = rows.select("doc", "text_key", "w", F.size("w").alias("n_words"), F.size("keys").alias("n_keys"), F.posexplode_outer("keys").alias("pos", "key"))
    start, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    begins, whens = F.lit(0), []
    for k in sizes:
        count = F.greatest(F.col("n_words") - k + 1, F.lit(0))
        whens.append((k, begins, begins + count))
        begins = begins + count
    for k, low, high in reversed(whens):
        inside = F.col("pos") < high
        start, size = F.when(inside, F.col("pos") - low).otherwise(start), F.when(inside, F.lit(k)).otherwise(size)
    rows = rows.select("doc", "text_key", "w", "n_words", "key", start.alias("start"), size.alias("k"))
    mark = found.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("key"), F.array().cast("array<string>").alias("items"))
    hits = []
    for s in range(slices):
        part = found.where(F.pmod("key", F.lit(slices)) == s)
        table = F.broadcast(part.unionByName(mark) if s == 0 else part)
        own = (F.coalesce(F.col("k"), F.lit(0)) == F.col("size")) & (
            F.col("k").isNull() | (F.array_join(F.slice("w", F.coalesce(F.col("start"), F.lit(0)) + 1, F.coalesce(F.col("k"), F.lit(0))), " ") == F.col("window"))
        )
        hits.append(rows.join(table, "key").where(own).select("doc", "text_key", "n_words", "start", "k", "items"))
    span = F.when(F.col("k").isNotNull(), F.struct("start", (F.col("start") + F.col("k")).alias("end")))
    grouped = (
        reduce(DataFrame.unionByName, hits)
        .groupBy("doc", "text_key", "n_words")
        .agg(
            F.count_if(F.col("k").isNull()).alias("copies"),
            F.sort_array(F.collect_set(span)).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "hit",
        F.struct(empty.alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b")),
        lambda s, x: F.when(x["start"] <= s["b"], F.struct(s["done"].alias("done"), s["a"].alias("a"), F.greatest(s["b"], x["end"]).alias("b"))).otherwise(
            F.struct(
                F.when(s["b"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["done"]).alias("done"),
                x["start"].alias("a"),
                x["end"].alias("b"),
            )
        ),
        lambda s: F.when(s["b"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["done"]),
    )
    out = grouped.select("doc", "text_key", F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), "items", "copies")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    out = out.select("doc", "text_key", "n_words", "spans", n_hit.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(F.col("doc").alias(id_col), "text_key", "n_words", "spans", "n_hit", "items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = 10,
    remove: str = "documents",
) -> DataFrame:
    """``docs`` without what they share with the benchmark.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` cuts the
    hit words and what stands between them, and keeps the rest of the text.
    Rows, columns and null texts without a hit are as they were. Null ids work.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = find(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, length=length)
    doc, key, spans = fresh(docs, "hit_doc", "hit_key", "hit_spans")
    hits = settled(found.where("n_hit > 0").select(column(found, id_col).alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans)).distinct())
    text = column(docs, text_col)
    same = column(docs, id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key))
    if remove == "documents":
        return docs.join(hits.select(doc, key), same, "left_anti")
    joined = docs.join(hits, same, "left")
    gaps, parts = F.split(text, RAW_WORD, -1), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    gone = lambda i: F.exists(F.col(spans), lambda s: (s["start"] <= i) & (i < s["end"]))
    pieces = F.transform(
        parts, lambda w, i: F.concat(F.when(gone(i) & gone(i - 1), "").otherwise(F.get(gaps, i)), F.when(gone(i), "").otherwise(w))
    )
    clean = F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
    return joined.select(*[F.when(F.col(spans).isNull(), text).otherwise(clean).alias(c) if c == text_col else column(docs, c) for c in docs.columns])
