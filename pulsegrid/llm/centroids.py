"""Centroid clustering of integer vectors with an incremental distance matrix.

Each vector keeps its exact dot product with every centroid.  When a centroid moves, only its components
that changed are multiplied, and the products are added to the kept ones; the nearest centroid is then the
argmin of ``|c|^2 - 2 v.c``.  The state (vector, products, cluster) is a table of the shared folder, written
once for each round; the round before it is removed when it is no longer read.  The driver holds the
centroids and the clusters' sums: as many rows as there are centroids, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, remove
from .common import table

SIZE, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Components of larger integers would take products of 64 components beyond 64 bits.
MOST = 1 << 27
#: Vectors whose products are held at a time.
ROWS = 8192

STATE = "id long, v array<int>, dots array<long>, cluster int, distance long"


def integers(vectors: DataFrame, id_col: str, vector_col: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of the rows whose vector has ``size`` components, none null or non-finite; components as ``floor(scale * x)``."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == size) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fits = F.forall(v, lambda x: F.abs(x) * scale < MOST)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("array<int>"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), checked.alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """Vectors of the smallest hashes of their ids, in that order; equal hashes by their components.  Rows without an id start no cluster."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    top = rows.where("id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in top], np.int64)


def column(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of ``width`` numbers a row as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def moved(v: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The products after the centroids changed: each takes up its nonzero component changes only."""
    out = dots.copy()
    for c in np.flatnonzero(change.any(axis=1)).tolist():
        at = np.flatnonzero(change[c])
        out[:, c] += v[:, at].astype(np.int64) @ change[c, at]
    return out


def update(state: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """The next state: products with the changed centroids, nearest centroid (ties: the smaller number), squared distance."""
    k, size = centroids.shape
    norms = (centroids * centroids).sum(1)
    fresh = "dots" not in state.columns

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                v = column(batch, "v", size)
                dots = moved(v, np.zeros((len(v), k), np.int64) if fresh else column(batch, "dots", k), change)
                far = norms[None, :] - 2 * dots
                near = far.argmin(1)
                square = far[np.arange(len(v)), near] + (v.astype(np.int64) ** 2).sum(1)
                edges = pa.array(np.arange(0, len(v) * k + 1, k, dtype=np.int32))
                yield table(id=batch.column("id"), v=batch.column("v"), dots=pa.ListArray.from_arrays(edges, pa.array(dots.ravel())), cluster=near.astype(np.int32), distance=square)

    return state.select(*([] if fresh else ["dots"]), "id", "v").mapInArrow(run, STATE)


def sums(state: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors and exact sums of components of each cluster, added up in the tasks first."""

    def run(batches):
        count, total = np.zeros(clusters, np.int64), np.zeros((clusters, size), np.int64)
        for batch in batches:
            own, v = batch.column("cluster").to_numpy(), column(batch, "v", size).astype(np.int64)
            count += np.bincount(own, minlength=clusters)
            for c in np.unique(own).tolist():
                total[c] += v[own == c].sum(0)
        has = np.flatnonzero(count)
        at = np.repeat(has, size)
        yield table(cluster=at, place=np.tile(np.arange(size), len(has)), n=count[at], total=total[has].ravel())

    parts = state.select("cluster", "v").mapInArrow(run, "cluster long, place long, n long, total long")
    got = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    count, total = np.zeros(clusters, object), np.zeros((clusters, size), object)
    for r in got:
        count[r["cluster"]] = r["n"]
        total[r["cluster"], r["place"]] = int(r["total"])
    return count, total


@dataclass
class Clusters:
    """Final state (STATE) and centroids."""

    state: DataFrame
    centroids: np.ndarray


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> Clusters:
    """Assign, move and assign again: ``rounds`` moves of vectors ``(id, v)`` from ``integers``.

    With fewer vectors than clusters there are as many centroids as vectors with an id.  A centroid without vectors stays.
    """
    rows = materialise(rows, "vectors")
    now = first_centroids(rows, clusters, salt)
    if not len(now):
        # No vector has an id: nothing starts a cluster.
        return Clusters(rows.limit(0).selectExpr("id", "v", "array() as dots", "0 as cluster", "0L as distance"), now)
    state, change = rows, now
    for k in range(rounds + 1):
        last, state = state, materialise(update(state, now, change), "cluster-state")
        remove(last)
        if k == rounds:
            return Clusters(state, now)
        count, total = sums(state, len(now), now.shape[1])
        new = now.copy()
        for c in np.flatnonzero(count).tolist():
            new[c] = [int(t) // int(count[c]) for t in total[c]]
        now, change = new, new - now


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Vectors that are null, of another length, or with a null or non-finite component are left out.  Repeated rows
    count each; a row with a null id is assigned and moves its centroid, but starts none.  No row, or no
    id at all, gives no row.  A component beyond 2**27 after scaling ends the job with an error that says so, as its
    products would not be exact in 64 bits.  Other columns are not read.
    """
    kind = dict(vectors.dtypes)[id_col]
    got = fit(integers(vectors, id_col, vector_col, size, scale), clusters, rounds, salt)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in got.centroids]
    inertia = {r["cluster"]: int(r["d"]) for r in got.state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    each = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(names))]) if names else F.array().cast("array<long>")
    shas = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return got.state.select(
        F.col("id").cast(kind).alias(id_col), "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(shas, F.col("cluster")).alias("centroid_sha256"),
    )


def cluster_sql(size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> str:
    """DuckDB SQL for ``cluster`` of ``embeddings(vec_id, embedding)``: whole distances in each round."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v AS c FROM (SELECT sha256('{salt}' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {clusters})"]
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS (SELECT r, vec_id, v, cluster, c, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, c{k}),
a{k} AS MATERIALIZED (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            parts.append(f"""s{k} AS (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(x) / count(*)) AS f, ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS m
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN s{k} USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""
