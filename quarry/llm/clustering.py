"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are turned into whole numbers once and written narrow. Each round tabulates, for every dimension, value that occurs there and centroid,
the squared difference; the distance of a vector is the sum of what it finds in the tables. Sums and counts are added up in tasks, so a round
moves a row for each task, centroid and dimension, and the driver gets one for each centroid and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read, release

#: A component's whole number is held within this bound, so that squares of differences over 64 dimensions fit in a long.
MOST = 1 << 27
#: What stands in place of a dimension in a round's sums: the number of vectors, the sum of their distances.
COUNT, SPREAD = -1, -2


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vectors (vec_id, embedding array) -> (vec_id, cells array<int>): those with exactly `dims` components, none null or non-finite, as floor(scale * x)."""
    x = F.col("embedding")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    cell = lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale))).cast("int")
    return vectors.where(x.isNotNull() & sound).select("vec_id", F.transform(x, cell).alias("cells"))


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and the place of each row's value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low > 8 * len(values) + 65_536:
        return np.unique(values, return_inverse=True)
    there = np.zeros(high - low + 1, dtype=bool)
    there[values - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[values - low]


def distances(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids), gathered from a table for each dimension."""
    out = np.zeros((len(cells), len(centroids)), dtype=np.int64)
    for d in range(cells.shape[1]):
        values, at = occurring(cells[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[at]
    return out


def _cells(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("cells")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), dims)


def _round_sums(table: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(centroid, dimension, COUNT or SPREAD) -> exact sum over the vectors nearest to the centroid (of equal ones the first)."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, spread = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), [0] * k
        for batch in batches:
            if not len(batch):
                continue
            cells = _cells(batch, dims)
            away = distances(cells, centroids)
            nearest = away.argmin(axis=1)
            for c in range(k):
                mine = nearest == c
                total[c] += cells[mine].sum(axis=0)
                count[c] += int(mine.sum())
                spread[c] += sum(away[mine, c].tolist())
        rows = [(c, d, str(total[c, d])) for c in range(k) if count[c] for d in range(dims)]
        rows += [(c, COUNT, str(count[c])) for c in range(k) if count[c]] + [(c, SPREAD, str(spread[c])) for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], ["cluster", "dim", "total"])

    found = table.select("cells").mapInArrow(sums, "cluster int, dim int, total string")
    return {(r[0], r[1]): int(r[2]) for r in found.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The k vectors with the smallest SHA-256 of "<seed>:<vec_id>" start as centroids; of vectors with one id the smaller vector comes first, and
    a null id is written as nothing. With fewer than k vectors all of them start. A vector goes to the nearest centroid, of equally near ones to
    the smaller number; a centroid without vectors stays. Equal rows are vectors like any other; an empty table, or one without sound vectors,
    gives no rows. Components beyond +-131072 (after scaling 2^27) count as that bound; an inertia beyond a long is told as the largest long.
    Other columns are not read, whatever their names.
    """
    table = materialize(whole_vectors(vectors, dims, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = table.orderBy(order, "cells").limit(k).select("cells").collect()
    centroids = np.array([r["cells"] for r in first], dtype=np.int64).reshape(len(first), dims)
    if not len(centroids):
        release(table)
        return vectors.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        sums = _round_sums(table, centroids)
        centroids = np.array([[sums[c, d] // sums[c, COUNT] if (c, COUNT) in sums else int(centroids[c, d]) for d in range(dims)] for c in range(len(centroids))], dtype=np.int64)
    sums = _round_sums(table, centroids)
    spread = [min(sums.get((c, SPREAD), 0), (1 << 63) - 1) for c in range(len(centroids))]
    whole = min(sum(sums.get((c, SPREAD), 0) for c in range(len(centroids))), (1 << 63) - 1)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                away = distances(_cells(batch, dims), centroids)
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(nearest)), nearest])], ["vec_id", "cluster", "distance"])

    out = table.mapInArrow(assigned, f"vec_id {dict(table.dtypes)['vec_id']}, cluster int, distance long")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return out.select("*", of(spread).cast("long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all sound embeddings after ten rounds."""
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same in SQL: a pair of common tables for each round."""
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM k ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT k.rid, min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS m
            FROM k, c{r} c GROUP BY k.rid)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT a.m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{r} a JOIN k USING (rid)),
            n{r} AS (SELECT c, list(f ORDER BY dim) AS v FROM (SELECT c, dim, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM s{r} GROUP BY c, dim) GROUP BY c),
            c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT k.vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN k USING (rid) JOIN c{rounds} c ON c.c = a.m.c"""


OP12_SQL = _sql()
