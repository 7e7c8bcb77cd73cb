"""Operator 12: k-means over whole numbers with an incremental matrix of exact dot products.

Every vector carries its dot product with every centroid, as whole numbers, in a table that is written anew each round.
When centroids move, only the components that differ change the products: ``x . new = x . old + sum(x_d * (new_d - old_d))``
over the components d with a difference, so a centroid that stays costs nothing. The distance is
``|x|^2 - 2 x . c + |c|^2``, of which the nearest centroid is recomputed (ties: the smaller number). All arithmetic is exact
in 64 bits, so neither partitions nor retries can change a result.

A round is one pass over the vectors and one aggregation of 64 sums for each cluster, summed in parts before the shuffle:
a vector that fills a third of the table weighs no more than any other. The driver holds the centroids only
(``centroids * DIMS`` whole numbers); tasks get them and their changes with the function.

Defined results: vectors that are null, have another length, or hold a null or non-finite component are left out; rows that
repeat are clustered each (as centroids, too: repeated ids have the same hash, and equal hashes stand in the order of their
components); a null id is clustered but never a starting centroid; with fewer vectors than centroids there are as many
centroids as vectors; an empty table gives no rows; a component beyond plus or minus ``LARGEST`` after scaling can't be
squared in 64 bits and ends the job with a message; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, table, written

DIMS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: 64 squares of a difference of two such components stay below 2 ** 63.
LARGEST = 1 << 27
KEPT = "vec_id long, x array<long>"
STATE = "vec_id long, x array<long>, dots array<long>, cluster int, distance long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x: the kept vectors as whole numbers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == DIMS)).filter(~F.coalesce(bad, F.lit(True)))
    large = F.exists(x, lambda v: F.abs(v) * SCALE > LARGEST)
    exact = F.when(large, F.raise_error(F.lit(f"a component lies beyond {LARGEST} / {SCALE}")).cast("array<bigint>")).otherwise(F.transform(x, lambda v: F.floor(v * SCALE)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), exact.alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1)))


def _assigned(ids: pa.Array, x: np.ndarray, dots: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
    far = norms[None, :] - 2 * dots
    near = far.argmin(axis=1)
    distance = (x * x).sum(axis=1) + far[np.arange(len(x)), near]
    return pa.RecordBatch.from_arrays([ids, _lists(x), _lists(dots), pa.array(near.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "dots", "cluster", "distance"])


def first_products(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with all its dot products and its nearest centroid."""
    norms = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["x"], DIMS)
                yield _assigned(batch["vec_id"], x, x @ centroids.T, norms)

    return kept.mapInArrow(freeing(run), STATE)


def moved_products(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after centroids moved from ``old`` to ``new``: products change by the components that differ."""
    norms = (new * new).sum(axis=1)
    changes = [(j, at, (new[j] - old[j])[at]) for j in range(len(new)) if len(at := np.flatnonzero(new[j] != old[j]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, dots = _matrix(batch["x"], DIMS), _matrix(batch["dots"], len(norms)).copy()
                for j, at, by in changes:
                    dots[:, j] += x[:, at] @ by
                yield _assigned(batch["vec_id"], x, dots, norms)

    return state.select("vec_id", "x", "dots").mapInArrow(freeing(run), STATE)


def first_centroids(kept: DataFrame, n: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes of their ids."""
    ranked = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r["x"] for r in ranked.orderBy("h", "x").limit(n).collect()], dtype=np.int64).reshape(-1, DIMS)


def means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors stays."""
    new = old.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(d))).alias(f"s{d}") for d in range(DIMS)]).collect():
        new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(DIMS)]
    return new


def cluster(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The written state after ``rounds`` moves of the centroids (vec_id, x, dots, cluster, distance), and the centroids."""
    kept = written(whole_vectors(vectors), "vectors")
    centroids = first_centroids(kept, n, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], STATE), centroids
    state = written(first_products(kept, centroids), "products")
    for _ in range(rounds):
        new = means(state, centroids)
        if (new == centroids).all():
            break
        state, centroids = written(moved_products(state, centroids, new), "products"), new
    return state, centroids


def report(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256. At most one row a centroid is broadcast."""
    digests = [(j, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = state.sparkSession.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), h) for j, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*cluster(table(spark, sf_dir, "embeddings")))


def _sql(n: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same by distances computed anew in every round."""
    near = """n{k} AS (SELECT v.i, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m FROM v, c{k} c GROUP BY v.i)"""
    move = """u{k} AS (SELECT m.c AS c, p, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM n{k}) GROUP BY ALL),
a{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM u{k} GROUP BY c),
c{next} AS (SELECT c.c, coalesce(a.x, c.x) AS x FROM c{k} c LEFT JOIN a{k} a ON a.c = c.c)"""
    parts = [
        """v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"h AS (SELECT sha256('2:' || vec_id::VARCHAR) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {n})",
        "c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS c, x FROM h)",
    ]
    for k in range(rounds):
        parts += [near.format(k=k), move.format(k=k, next=k + 1)]
    parts.append(near.format(k=rounds))
    return f"""WITH {", ".join(parts)}
SELECT n.vec_id, n.m.c AS "cluster", n.m.d AS distance, (sum(n.m.d) OVER (PARTITION BY n.m.c))::BIGINT AS cluster_inertia, (sum(n.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM n{rounds} n JOIN c{rounds} c ON c.c = n.m.c"""


OP12_SQL = _sql()
