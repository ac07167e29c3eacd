"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etlspec.llm.common import column

#: Rows of a block of candidates, which one index covers, of a block of queries, and queries scored at a time, about.
BLOCK_ROWS, QUERY_ROWS, SCORED_ROWS = 16_384, 8192, 256
#: Shares of the largest component down to which a segment of postings reaches, in the order they are processed.
LEVELS = (0.25, 0.08, 0.0)
#: Possible members, for each wanted result, at which scoring stops and rescoring begins.
FEW = 40


class ImpactIndex:
    """Postings of a block of integer vectors, in segments by descending impact.

    A posting is a component of a row, its impact the component's size. A
    segment holds the postings from one share of the largest impact down to the
    next as a matrix of the rows and dimensions that occur in it, so one product
    adds it to the scores of many queries. Scores are kept from segment to
    segment. What is not yet processed of a row adds no more than its extremes
    in each dimension allow, and no more than its length times the query's, so
    every row has an upper bound.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.segments = vectors, []
        sizes, rest = np.abs(vectors), vectors.copy()
        for share in LEVELS:
            here = (sizes >= share * sizes.max(initial=0)) & (rest != 0)
            rows, dims = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
            postings = np.where(here, vectors, 0)[np.ix_(rows, dims)]
            rest[here] = 0
            length = np.sqrt(np.square(rest, dtype=np.float64).sum(axis=1))
            self.segments.append((rows, dims, postings, rest.min(axis=0, initial=0), rest.max(axis=0, initial=0), length))

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the rows that may be among its k best and their exact scores; rows of its ``own`` take no part."""
        n = len(self.vectors)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        still = np.array([i for i, rows in enumerate(own) if len(rows) < n], np.int64)
        scores = np.zeros((len(still), n), queries.dtype)
        for at, i in enumerate(still.tolist()):
            scores[at, own[i]] = -np.inf
        for step, (rows, dims, postings, low, high, length) in enumerate(self.segments, 1):
            asked = queries[still]
            gains = asked[:, dims] @ postings.T
            if len(rows) == n:
                scores += gains
            else:
                scores[:, rows] += gains
            most = np.maximum(asked * low, asked * high).sum(axis=1, dtype=np.float64)
            reach = np.sqrt(np.square(asked, dtype=np.float64).sum(axis=1))
            kept = []
            for at, i in enumerate(still.tolist()):
                upper = scores[at] + np.minimum(most[at], reach[at] * length)
                wanted = min(k, n - len(own[i]))
                front = np.argpartition(upper, n - wanted)[n - wanted :]
                proof = int((self.vectors[front] @ queries[i]).min())  # k rows score as much: no row below can be a member
                members = np.flatnonzero(upper >= proof - 1e-6 * abs(proof) - 1)
                if len(members) <= FEW * k or step == len(self.segments):
                    found[i] = members, (self.vectors[members] @ queries[i]).astype(np.int64)
                else:
                    kept.append(at)
            if not kept:
                break
            still, scores = still[kept], scores[kept]
        return found


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    lengths = pc.list_value_length(vectors).to_numpy()
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.concatenate([c.flatten().to_numpy() for c in vectors.chunks])
    return out


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    names = ["query_key", "query_id", "vec_id", "score"]
    empty = pa.table({n: pa.array([], pa.int64()) for n in names})
    if not left.num_rows or not right.num_rows:
        return empty
    dims = max(pc.max(pc.list_value_length(t["v"])).as_py() for t in (left, right))
    block, asked = _matrix(left["v"], dims), _matrix(right["v"], dims)
    largest = float(np.abs(block).max(initial=0)) * float(np.abs(asked).max(initial=0)) * dims
    if largest >= 1 << 52:
        raise OverflowError("scores of these vectors are beyond exact arithmetic")
    exact = np.float32 if max(largest, np.abs(block).max(initial=0), np.abs(asked).max(initial=0)) < 1 << 22 else np.float64
    ids = left["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, block, asked = ids[order], block[order].astype(exact), asked.astype(exact)
    index = ImpactIndex(block)
    keys, query_ids = right["key"].to_numpy(), right["id"].to_numpy()
    first, past = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    found = []
    for at in range(0, len(asked), SCORED_ROWS):
        some = range(at, min(at + SCORED_ROWS, len(asked)))
        own = [np.arange(first[i], past[i]) for i in some]
        for i, (rows, scores) in zip(some, index.search(asked[some.start : some.stop], own, k)):
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), keys[i]), np.full(len(best), query_ids[i]), ids[rows[best]], scores[best]))
    return pa.table({n: np.concatenate([f[i] for f in found]).astype(np.int64) for i, n in enumerate(names)})


def quantised(vector: Column, levels: int = 256) -> Column:
    """Each component x as floor(levels * x), a long; null for a null vector or one with a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(levels)) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, levels: int = 256) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product, for every row of ``queries``.

    Columns: query_id, rank (int, from 1), vec_id, score, all but rank long;
    equal scores go to the smaller id. Components are quantised to floor(levels
    * x). Rows with the query's own id are no candidates of it. Exact: a block's
    index stops only when upper bounds prove that no other row can be a member,
    and possible members are rescored in full.

    Both tables are cut into blocks by a hash of the id, and each pair of blocks
    is one task of bounded size that returns k rows a query. The work is that of
    the stated queries against all rows.

    Null vectors, vectors with null or non-finite components and rows without
    an id take no part. A shorter vector counts as filled up with zeros.
    Repeated candidates are candidates each; repeated queries count once.
    Components whose scores would not be exact raise an error. Empty tables
    give no rows; other columns are not used.
    """

    def rows(df: DataFrame) -> DataFrame:
        out = df.select(column(df, id_col).cast("long").alias("id"), quantised(column(df, vector_col), levels).alias("v"))
        return out.where("id IS NOT NULL AND v IS NOT NULL")

    asked = rows(queries).distinct().withColumn("key", F.xxhash64("id", "v"))
    n_left, n_right = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK_ROWS), (queries, QUERY_ROWS)))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows(vectors).select(F.lit(0).alias("key"), "id", "v", part(n_left).alias("a")).withColumn("b", every(n_right))
    right = asked.select("key", "id", "v", part(n_right).alias("b")).withColumn("a", every(n_left))
    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
    found = pairs.applyInArrow(lambda x, y: _search(x, y, k), "query_key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
