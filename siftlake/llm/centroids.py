"""Centroid clustering in whole numbers, by equal-average equal-variance nearest-centroid search.

Centroids are sorted by the mean of their components. A vector's search starts where its own mean falls among them and
goes outward, always to the side whose mean is closer. With k components, means m and deviations s (the length of what
is left of a vector without its mean), the squared distance of x and c is at least k * (m_x - m_c)**2, and at least
that plus (s_x - s_c)**2. The first bound grows as the search goes outward and ends it; the second passes over single
centroids. Bounds are computed in doubles and lowered by more than their rounding error; only centroids above neither
are compared, in whole numbers.

The numbers are exact at any size: vectors whose components are small enough for 64-bit sums of squares use numpy's
integers. A batch with others uses Python's, and compares every centroid, as doubles can't hold its bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import NUMBER_BATCH_ROWS, text_batches
from siftlake.session import materialise

DIMENSION, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3"
#: With components of at most so much, 4 * 2**16 * SAFE**2 is below 2**63: no sum of 2**16 squared differences overflows.
SAFE = 1 << 22
#: Bounds are lowered by this share of the terms they come from.
ROUNDING = 1e-9

SUMS = "cluster int, n long, sums array<string>"
ASSIGNED = "vec_id long, cluster int, distance long"


def kept_vectors(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has that many components, none null, infinite or not a number."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(v) == dimension) & finite).select("vec_id", v.alias("vector"))


def _floor_exactly(x: float) -> int:
    top, bottom = x.as_integer_ratio()
    return top * SCALE // bottom


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each number: 64-bit integers where all are at most SAFE, else Python's."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < SAFE / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([_floor_exactly(x) for x in values.ravel().tolist()], object).reshape(values.shape)


@dataclass
class Search:
    """Centroids sorted by their mean. seen and compared count pairs of vector and centroid, all and those compared."""

    centroids: list[list[int]]
    seen: int = 0
    compared: int = 0
    numbers: np.ndarray = field(init=False)
    means: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        width = len(self.centroids[0]) if self.centroids else 1
        self.order = sorted(range(len(self.centroids)), key=lambda c: (sum(self.centroids[c]), c))
        self.numbers = np.array(self.order, np.int64)
        rows = [self.centroids[c] for c in self.order]
        self.small = all(abs(x) <= SAFE for row in rows for x in row)
        self.exact = np.array(rows, np.int64 if self.small else object).reshape(len(rows), width)
        self.means = np.array([sum(r) / width for r in rows], np.float64)
        self.spread = _spread(self.exact.astype(np.float64), self.means)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller one of equals, and squared distance, of each row of vectors."""
        n, width, k = len(vectors), vectors.shape[1], len(self.order)
        self.seen += n * k
        if vectors.dtype == object or not self.small:
            return self._nearest_of_all(vectors.astype(object))
        mean = vectors.sum(1) / width
        spread = _spread(vectors.astype(np.float64), mean)
        best, chosen, found = np.zeros(n, np.int64), np.full(n, k, np.int64), np.zeros(n, bool)
        high = np.searchsorted(self.means, mean)
        low, going = high - 1, np.arange(n)
        padded = np.concatenate([[-np.inf], self.means, [np.inf]])
        while len(going):
            m = mean[going]
            down, up = m - padded[low[going] + 1], padded[high[going] + 1] - m
            left = down <= up
            c = np.where(left, low[going], high[going])
            gap = np.minimum(down, up)
            inside = np.isfinite(gap)  # both ends passed: nothing is left
            going, left, c, gap = going[inside], left[inside], c[inside], gap[inside]
            low[going] -= left
            high[going] += ~left
            limit = np.where(found[going], best[going] * (1 + ROUNDING), np.inf)
            by_mean = width * np.maximum(gap - ROUNDING * (2 * np.abs(mean[going]) + gap), 0) ** 2
            alive = by_mean <= limit  # the other centroids on this side are no closer, nor are those on the other
            going, c, limit, by_mean = going[alive], c[alive], limit[alive], by_mean[alive]
            x, y = spread[going], self.spread[c]
            apart = np.maximum(np.abs(x - y) - ROUNDING * (x + y + np.abs(mean[going])), 0)
            close = by_mean + apart**2 <= limit
            rows, c = going[close], c[close]
            self.compared += len(rows)
            if len(rows):
                d = ((vectors[rows] - self.exact[c]) ** 2).sum(1)
                number = self.numbers[c]
                better = ~found[rows] | (d < best[rows]) | ((d == best[rows]) & (number < chosen[rows]))
                best[rows[better]], chosen[rows[better]] = d[better], number[better]
                found[rows] = True
        return chosen, best

    def _nearest_of_all(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.compared += len(vectors) * len(self.order)
        each = np.stack([((vectors - np.array(c, object)) ** 2).sum(1) for c in self.centroids], 1)
        chosen = each.argmin(1)
        return chosen, each[np.arange(len(vectors)), chosen]


def _spread(values: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.sqrt(((values - means[:, None]) ** 2).sum(1))


def _batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield batch.column(0), whole(flat.reshape(-1, dimension))


def _sums_of(vectors: DataFrame, centroids: list[list[int]], dimension: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, componentwise sum) of each cluster that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = Search(centroids), [0] * len(centroids), [[0] * dimension for _ in centroids]
        for _, rows in _batches(batches, dimension):
            chosen, _ = search.nearest(rows)
            for c in np.unique(chosen).tolist():
                own = rows[chosen == c]
                n[c] += len(own)
                sums[c] = [a + b for a, b in zip(sums[c], own.sum(0).tolist(), strict=True)]
        yield _sum_rows({c: (n[c], sums[c]) for c in range(len(centroids)) if n[c]})

    def add(table: pa.Table) -> pa.Table:
        total = [0] * dimension
        for own in table.column("sums").to_pylist():
            total = [a + int(b) for a, b in zip(total, own, strict=True)]
        c, n = table.column("cluster")[0].as_py(), sum(table.column("n").to_pylist())
        return pa.Table.from_batches([_sum_rows({c: (n, total)})])

    # a row per task and cluster; the collected table has a row per cluster
    added = vectors.mapInArrow(run, SUMS).groupBy("cluster").applyInArrow(add, SUMS).collect()
    return [(r["cluster"], r["n"], [int(x) for x in r["sums"]]) for r in added]


def _sum_rows(found: dict[int, tuple[int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(found), pa.int32()),
            pa.array([n for n, _ in found.values()], pa.int64()),
            pa.array([[str(x) for x in own] for _, own in found.values()], pa.list_(pa.string())),
        ],
        names=["cluster", "n", "sums"],
    )


def starts(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of salt and vec_id; of rows of one vec_id the smaller vector comes first."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("h", "vector").limit(clusters).select("vector").collect()
    return [whole(np.array(r["vector"], np.float64)).tolist() for r in first]


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> list[list[int]]:
    """Centroids after that many rounds of assigning every vector and taking floor(sum / count); empty ones stay.

    vectors: (vec_id, vector) of kept vectors. There are fewer centroids than asked for if there are fewer vectors.
    """
    text_batches(vectors.sparkSession, NUMBER_BATCH_ROWS)
    centroids = starts(vectors, clusters)
    for _ in range(rounds if centroids else 0):
        for c, n, sums in _sums_of(vectors, centroids, dimension):
            centroids[c] = [x // n for x in sums]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector; no rows where there are no centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for ids, rows in _batches(batches, dimension):
            if not centroids:
                continue
            chosen, distance = search.nearest(rows)
            numbers = distance if distance.dtype == np.int64 else map(_long, distance.tolist())
            columns = [ids, pa.array(chosen, pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return vectors.select(F.col("vec_id").cast("long"), "vector").mapInArrow(run, ASSIGNED)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, of another size, or hold a null or a number that is not finite take no part. Repeated rows
    count as often as they occur. A null vec_id is clustered as any other but starts no centroid; if all are null,
    or the table is empty, there are no rows. Equal distances go to the centroid of the smaller number. A distance or
    an inertia that does not fit a long is null; the clusters are right all the same. Other columns are ignored.
    """
    kept = materialise(kept_vectors(vectors, dimension), "vectors")
    centroids = fit(kept, clusters, rounds, dimension)
    found = materialise(assign(kept, centroids, dimension), "assigned")
    # a row per cluster
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("distance").alias("known"), F.count("*").alias("n")
    ).collect()
    inertia = {r["cluster"]: _long(r["total"] if r["known"] == r["n"] else None) for r in sums}
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    digests = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(centroids)}
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(_long(whole_sum)).cast("long").alias("inertia"),
        _by_cluster(digests, "string").alias("centroid_sha256"),
    )


def _long(x: int | None) -> int | None:
    return None if x is None or int(x) >= 1 << 63 else int(x)


def _by_cluster(values: dict, kind: str) -> Column:
    found = F.lit(None).cast(kind)
    for c, x in values.items():
        found = F.when(F.col("cluster") == int(c), F.lit(x).cast(kind)).otherwise(found)
    return found


def _oracle() -> str:
    """The rounds written out, with a common table for the centroids of each."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    near = lambda r: (
        f"a{r} AS MATERIALIZED (SELECT k, vec_id, v, arg_min(n, (d, n)) AS cluster, min(d) AS distance FROM "
        f"(SELECT x.k, x.vec_id, x.v, y.n, CAST({square} AS HUGEINT) AS d FROM x, c{r} y) GROUP BY k, vec_id, v)"
    )
    parts = [
        "x AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v "
        "FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('{SALT}:' || vec_id) AS h, v FROM x "
        f"WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS):
        parts += [
            near(r),
            f"m{r} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 65) t(i) "
            "GROUP BY cluster, i) GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON n = cluster)",
        ]
    return (
        "WITH " + ",\n".join([*parts, near(ROUNDS)]) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON n = cluster"""
    )


ORACLE_SQL = _oracle()
