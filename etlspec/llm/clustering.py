"""Centroid clustering in whole numbers, with distances filtered by rotated coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.llm.common import column, stored

#: Leading rotated coordinates that are kept for each vector.
LEAD = 16
#: Centroids and components, since k x dims numbers go to every task and come back from it.
MAX_CENTROIDS, MAX_DIMS = 1024, 4096
#: A lower bound is lowered by this part of both squared lengths, far above what rounding can do to it.
SLACK = 1e-9


@dataclass
class Clusters:
    """``assigned`` (id, cluster int, distance long), the final centroids, and each one's inertia."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


class Rotation:
    """Where a vector lies along the main axes, and how far from their span."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray) -> None:
        self.mean, self.axes = mean, axes

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = vectors - self.mean
        lead = centred @ self.axes
        return lead, np.linalg.norm(centred - lead @ self.axes.T, axis=1)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, width)


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims + 1, dims))
    for batch in batches:
        v = _matrix(batch, "v", dims).astype(float)
        total[:dims] += v.T @ v
        total[dims] += v.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "x"])


def _rotated(batches: Iterator[pa.RecordBatch], rotation: Rotation, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead, rest = rotation(_matrix(batch, "v", dims).astype(float))
        flat = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1], lead.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(rest)], names=["id", "v", "lead", "rest"])


class Nearest:
    """The nearest of a few centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation) -> None:
        self.centroids = centroids
        self.lead, self.rest = rotation(centroids.astype(float))
        self.length = (centroids.astype(float) ** 2).sum(axis=1)

    def __call__(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row.

        Rotation keeps distances, so the squared distance along the leading axes
        plus the squared difference of the residual norms is no more than the
        whole one. The centroid with the least bound is measured first; of the
        others only those whose bound is no more than that distance.
        """
        n = len(v)
        bound = np.empty((n, len(self.centroids)))
        length = (v.astype(float) ** 2).sum(axis=1)
        for c in range(len(self.centroids)):
            bound[:, c] = ((lead - self.lead[c]) ** 2).sum(axis=1) + (rest - self.rest[c]) ** 2 - SLACK * (length + self.length[c]) - 1
        cluster = bound.argmin(axis=1)
        distance = ((v - self.centroids[cluster]) ** 2).sum(axis=1)
        first = cluster.copy()
        for c, centroid in enumerate(self.centroids):
            left = np.flatnonzero((bound[:, c] <= distance) & (first != c))
            exact = ((v[left] - centroid) ** 2).sum(axis=1)
            nearer = (exact < distance[left]) | ((exact == distance[left]) & (c < cluster[left]))
            cluster[left[nearer]], distance[left[nearer]] = c, exact[nearer]
        return cluster, distance


def _batches(batches: Iterator[pa.RecordBatch], nearest: Nearest, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            v, lead = _matrix(batch, "v", dims), _matrix(batch, "lead", nearest.lead.shape[1])
            yield batch, v, *nearest(v, lead, batch.column(3).to_numpy())


def _sums(batches: Iterator[pa.RecordBatch], nearest: Nearest, dims: int) -> Iterator[pa.RecordBatch]:
    """(at, x) of a task: for each cluster its component sums, its inertia and its count."""
    total = np.zeros((len(nearest.centroids), dims + 2), np.int64)
    for _, v, cluster, distance in _batches(batches, nearest, dims):
        for c in np.unique(cluster):
            own = cluster == c
            total[c, :dims] += v[own].sum(axis=0)
            total[c, dims:] += distance[own].sum(), own.sum()
    at = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "x"])


def _assigned(batches: Iterator[pa.RecordBatch], nearest: Nearest, dims: int) -> Iterator[pa.RecordBatch]:
    for batch, _, cluster, distance in _batches(batches, nearest, dims):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])


def cluster(
    vectors: DataFrame,
    k: int = 8,
    *,
    rounds: int = 10,
    scale: int = 1024,
    dims: int = 64,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clusters:
    """Cluster the vectors that have exactly ``dims`` components, none of them null or not finite.

    Components x become the whole numbers floor(scale * x). The first centroids
    are the ``k`` vectors with the smallest SHA-256 of ``seed:id``; each round
    puts every vector to the nearest centroid (squared Euclidean distance; ties:
    the smaller number) and then moves each centroid that has vectors to the
    floor of their mean, component by component; at last every vector is put to
    its centroid once more.

    One pass adds up second moments; their main axes are the rotation. A second
    pass stores each vector with its ``LEAD`` first rotated coordinates and the
    norm of the rest, as Parquet in shared storage. Each round reads only that:
    bounds from these few numbers rule most centroids out, and the rest are
    measured in whole numbers, so rounding decides nothing. A task sends
    back k x (dims + 2) sums whatever it reads, Spark adds them up, and the
    driver gets k x (dims + 2) numbers a round. A lost executor costs its tasks.

    Repeated rows and equal vectors are vectors of their own; equal ids are
    ordered by their vectors, null ids come last. Fewer vectors than ``k`` make
    fewer centroids; no vectors give no rows. Components so large that a squared
    distance may pass 64 bits are an error. Other columns are not used.
    """
    if not 1 <= k <= MAX_CENTROIDS or not 1 <= dims <= MAX_DIMS:
        raise ValueError(f"k is 1 to {MAX_CENTROIDS}, dims 1 to {MAX_DIMS}")
    vector = column(vectors, vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    kept = vectors.select(column(vectors, id_col).alias("id"), F.when((F.size(vector) == dims) & finite, whole).alias("v")).where("v IS NOT NULL")
    id_type = kept.schema["id"].dataType.simpleString()

    most = kept.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    if most["n"] == 0:
        return Clusters(kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false").withColumnRenamed("id", id_col), [], [])
    if 4 * dims * most["most"] ** 2 >= 1 << 63:
        raise ValueError("the components are too large for squared distances of 64 bits")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = kept.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64)

    moments = kept.mapInArrow(lambda b: _moments(b, dims), "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros((dims + 1) * dims)
    for r in moments.collect():  # dims x (dims + 1) numbers
        total[r["at"]] = r["x"]
    second, mean = total[: dims * dims].reshape(dims, dims), total[dims * dims :] / most["n"]
    axes = np.linalg.eigh(second / most["n"] - np.outer(mean, mean))[1][:, ::-1][:, : min(LEAD, dims)]
    rotation = Rotation(mean, np.ascontiguousarray(axes))
    schema = f"id {id_type}, v array<long>, lead array<double>, rest double"
    table = stored(kept.mapInArrow(lambda b: _rotated(b, rotation, dims), schema))

    def sums(nearest: Nearest) -> np.ndarray:
        parts = table.mapInArrow(lambda b: _sums(b, nearest, dims), "at long, x long")
        out = np.zeros((len(nearest.centroids), dims + 2), object)
        for r in parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            out[divmod(r["at"], dims + 2)] = int(r["x"])
        return out

    for _ in range(rounds):
        found = sums(Nearest(centroids, rotation))
        centroids = np.array([[s // row[-1] for s in row[:dims]] if row[-1] else old for row, old in zip(found.tolist(), centroids.tolist())], np.int64)
    last = Nearest(centroids, rotation)
    inertia = [row[dims] for row in sums(last).tolist()]
    assigned = table.mapInArrow(lambda b: _assigned(b, last, dims), f"id {id_type}, cluster int, distance long")
    return Clusters(assigned.withColumnRenamed("id", id_col), centroids.tolist(), inertia)


def cluster_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> str:
    """SQL over ``embeddings`` for the query of this operator: every vector against every centroid in each round."""
    order = f"sha256('{seed}:' || vec_id)"
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) - 1 AS c, v FROM v ORDER BY {order} LIMIT {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
                SELECT vec_id, v.v, c, CAST(list_sum(list_transform(list_zip(v.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} m) GROUP BY vec_id)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY pos) AS v FROM (
                    SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c)"""
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return f"""WITH {', '.join(ctes)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} m USING (c)
    """
