"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, fresh, settled

#: Line keys of all hosts together that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, *, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines, settled.

    A page is a distinct text of its host: copies of a page count once, in the
    line's pages and in the host's total. Counting is two aggregations that
    combine before they shuffle, over (host, line key, page key); a host is
    never gathered in one task. A line above the ratio is on more than
    ``max_ratio`` of the pages, so a host has at most its mean number of lines a
    page divided by ``max_ratio`` of them.
    """
    pages = docs.select(
        column(docs, host_col).alias("host"), F.xxhash64(column(docs, text_col)).alias("page"), column(docs, text_col).alias("text")
    ).where(F.col("text").isNotNull())
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.when(F.trim(x) != "", line_key(x))))
    seen = pages.select("host", "page", F.explode_outer(keys).alias("line")).where("line IS NOT NULL").distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_pages))
    hits = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    frequent = hits.where(F.col("n") > F.lit(float(max_ratio)) * F.col("pages"))
    return settled(frequent.groupBy("c.host").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def dedup_lines(
    docs: DataFrame,
    *,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.02,
    min_pages: int = 5,
    dropped_col: str = "n_dropped_lines",
) -> DataFrame:
    """``docs`` without the lines that are on more than ``max_ratio`` of their host's pages.

    Lines are compared without the spaces around them, as 64-bit keys. A line
    goes if at least ``min_pages`` pages of its host hold it and they are more
    than that share of the host's pages; every occurrence goes. Blank lines
    stay. ``dropped_col`` is added (long): the number of lines taken out.

    A null text stays null with 0 dropped and is no page. Rows with a null host
    are one host. Repeated rows are kept; as copies of a page they count once.
    Other columns pass through, and a ``dropped_col`` already present is replaced.
    """
    if not 0 <= max_ratio <= 1:
        raise ValueError("max_ratio is a share, from 0 to 1")
    bad = boilerplate(docs, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages)
    held = bad.agg(F.coalesce(F.sum(F.size("lines") + 2), F.lit(0)).alias("n")).first()["n"]
    host, lines = fresh(docs, "bad_host", "bad_lines")
    bad = bad.select(F.col("host").alias(host), F.col("lines").alias(lines))
    if held <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    text = column(docs, text_col)
    joined = docs.join(bad, column(docs, host_col).eqNullSafe(F.col(host)), "left")
    good = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col(lines), line_key(x)) | (F.trim(x) == ""))
    clean = F.when(F.col(lines).isNull(), text).otherwise(F.array_join(good, "\n"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    kept, had = fresh(docs, "clean_text", "had_breaks")
    out = joined.withColumns({kept: clean, had: breaks})
    left = F.octet_length(F.col(kept)) - F.octet_length(F.replace(F.col(kept), F.lit("\n"), F.lit("")))
    # an empty result has no line left where something was dropped
    gone = F.col(had) - left + F.when((F.col(kept) == "") & (text != ""), 1).otherwise(0)
    columns = [F.col(kept).alias(c) if c == text_col else column(docs, c) for c in docs.columns if c.lower() != dropped_col.lower()]
    return out.select(*columns, F.coalesce(gone, F.lit(0)).cast("long").alias(dropped_col))
