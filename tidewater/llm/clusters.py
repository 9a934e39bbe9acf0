"""Centroid clustering in exact integers by Exponion search: a vector with bounds looks only at the centroids inside a ball
around its current one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import materialize, release, ship

#: Integer components up to this size have squared distances that fit a long (64 of them, differences of twice the size).
LARGEST = 2**27
#: Up to this size, the matrix product of doubles is exact: every partial sum stays below 2^53.
EXACT_IN_DOUBLES = 2**22
#: Bounds are held in doubles; this much is given away, so that rounding never prunes a centroid that ties.
SLACK = 1e-9

STATE = "vec_id long, v binary, cluster int, upper double, lower double, sums array<long>, n long"
_ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: len(x) by len(c), as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_IN_DOUBLES:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


class Balls:
    """Centroids with, for each, all centroids in order of their distance from it; how far each moved since the pass before."""

    def __init__(self, centres: np.ndarray, moved: np.ndarray | None = None):
        self.centres, k = centres, len(centres)
        between = squared(centres, centres)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.reach = np.sqrt(np.take_along_axis(between, self.order, axis=1).astype(float))
        self.gap = self.reach[:, 1] if k > 1 else np.full(k, np.inf)  # to the nearest other
        self.moved = np.zeros(k) if moved is None else moved
        others = np.where(np.eye(k, dtype=bool), 0.0, self.moved)
        self.others_moved = others.max(axis=1, initial=0.0)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number) and both bounds by looking at every centroid: the first pass."""
        return _nearest(squared(x, self.centres), np.arange(len(self.centres)))

    def search(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the pass before: its centroids ``at`` with bounds on the distance to them and to any other.

        Any centroid as near as ``at`` lies within twice the distance of ``at``, and the second nearest within that plus the gap
        from ``at`` to its nearest other, so the ball of that radius, edge included, holds both.
        """
        at, upper, lower = at.copy(), (upper + self.moved[at]) * (1 + SLACK), (lower - self.others_moved[at]) * (1 - SLACK)
        safe = np.maximum(lower, self.gap[at] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(upper >= safe)
        if len(open_):
            own = x[open_] - self.centres[at[open_]]
            upper[open_] = np.sqrt((own * own).sum(axis=1).astype(float)) * (1 + SLACK)
            open_ = open_[upper[open_] >= safe[open_]]
        k = len(self.centres)
        if len(open_) and k > 1:
            start = at[open_]
            radius = (2 * upper[open_] + self.gap[start]) * (1 + SLACK)
            inside = np.empty(len(open_), dtype=np.int64)
            for c in np.unique(start):
                mine = start == c
                inside[mine] = np.searchsorted(self.reach[c], radius[mine], side="right")
            rings = np.minimum(k, 2 ** np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64))  # few sizes: rows of one size share a product
            group = start.astype(np.int64) * (k + 1) + rings
            by = np.argsort(group, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                c, size = start[rows[0]], rings[rows[0]]
                near = np.sort(self.order[c, :size])
                to = open_[rows]
                at[to], upper[to], lower[to] = _nearest(squared(x[to], self.centres[near]), near)
        return at, upper, lower


def _nearest(d2: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = d2.argmin(axis=1)
    second = np.partition(d2, 1, axis=1)[:, 1] if d2.shape[1] > 1 else np.full(len(d2), np.inf)
    least = d2[np.arange(len(d2)), best].astype(float)
    return names[best].astype(np.int32), np.sqrt(least) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)


def _sums(into: dict[int, list], cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
    for c in np.unique(cluster):
        mine = cluster == c
        had = into.setdefault(int(c), [np.zeros(x.shape[1], dtype=np.int64), 0])
        had[0] += sign * x[mine].sum(axis=0)
        had[1] += sign * int(mine.sum())


def _state(vec_id: pa.Array, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    n, width = x.shape
    raw = pa.py_buffer(np.ascontiguousarray(x, dtype="<i4").tobytes())
    v = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width * 4).astype(np.int32).tobytes()), raw])
    return pa.RecordBatch.from_arrays([vec_id, v, pa.array(at, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], schema=_ARROW)


def _totals(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """What the task's rows change in the clusters' sums and counts: one row a cluster."""
    if sums:
        rows = [{"cluster": c, "sums": s.tolist(), "n": n} for c, (s, n) in sorted(sums.items())]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _ints(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").reshape(-1, width).astype(np.int64)


def _usable(vector: str, dim: int) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> DataFrame:
    """k-means of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly ``dim`` components, none null or non-finite, take part, each component x as floor(scale * x). The first
    centroids are the ``k`` vectors with the smallest sha256 of "seed:vec_id". A round assigns every vector to the nearest centroid
    (ties: the smaller number) and moves each non-empty one to the floor of its mean; after ``rounds`` of them vectors are assigned
    once more. All distances and sums are exact integers.

    A pass reads the vectors with their bounds and writes them anew, each task with what its movers change in the clusters' sums;
    nothing is shuffled but those (one row a cluster and task), and only k centroids reach the driver. No key deals rows out, so
    equal vectors or one huge cluster skew nothing. Each pass is a table in the shared folder; the one before it is deleted then.

    Rows of one vec_id are vectors of their own (among the first centroids, ties of the hash go to the smaller components); a null
    vec_id is kept and has the last hash. Fewer than ``k`` vectors: as many centroids. No usable vector: no rows. Other columns are
    ignored. A component beyond +-2^27 after scaling is an error that names the vector, as no long could hold its distances.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(_usable("embedding", dim)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = _scaled(np.array([r["embedding"] for r in first], dtype=float), [r["vec_id"] for r in first], scale)
    sums, counts = np.zeros((len(centres), dim), dtype=object), np.zeros(len(centres), dtype=object)
    balls, state = Balls(centres), None

    for _ in range(rounds):
        now = rows.mapInArrow(_first_pass(balls, dim, scale), STATE) if state is None else _kept(state).mapInArrow(_pass(balls, dim), STATE)
        now = materialize(now)
        if state is not None:
            release(state)
        state = now
        change = state.filter("sums is not null").select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n"))
        for r in change.collect():
            sums[r["cluster"], r["pos"]] += r["s"]
            counts[r["cluster"]] += r["n"] if r["pos"] == 0 else 0
        moved = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums.tolist(), counts.tolist(), centres.tolist(), strict=True)], dtype=np.int64)
        far = moved - centres
        balls, centres = Balls(moved, np.sqrt((far * far).sum(axis=1).astype(float)) * (1 + SLACK)), moved

    final = rows.mapInArrow(_first_pass(balls, dim, scale, True), "vec_id long, cluster int, distance long") if state is None else _kept(state).mapInArrow(_last_pass(balls, dim), "vec_id long, cluster int, distance long")
    final = materialize(final)
    if state is not None:
        release(state)
    inertia = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    about = [(c, s, whole, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    dims = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return final.join(F.broadcast(dims), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _kept(state: DataFrame) -> DataFrame:
    return state.filter("v is not null").select("vec_id", "v", "cluster", "upper", "lower")


def _scaled(x: np.ndarray, names: list, scale: int) -> np.ndarray:
    v = np.floor(scale * x)
    large = np.flatnonzero((np.abs(v) > LARGEST).any(axis=1))
    if len(large):
        raise ValueError(f"vector {names[large[0]]}: a component beyond 2^27 after scaling; its squared distances would not fit a long")
    return v.astype(np.int64)


def _first_pass(balls: Balls, dim: int, scale: int, last: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = _scaled(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), batch.column("vec_id").to_pylist(), scale)
                at, upper, lower = balls.all(x)
                _sums(sums, at, x, 1)
                yield _answer(batch, x, at, balls) if last else _state(batch.column("vec_id"), x, at, upper, lower)
        if not last:
            yield from _totals(sums)

    return run


def _pass(balls: Balls, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x, was = _ints(batch, dim), batch.column("cluster").to_numpy()
                at, upper, lower = balls.search(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                movers = at != was
                _sums(sums, was[movers], x[movers], -1)
                _sums(sums, at[movers], x[movers], 1)
                yield _state(batch.column("vec_id"), x, at, upper, lower)
        yield from _totals(sums)

    return run


def _last_pass(balls: Balls, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _ints(batch, dim)
                at = balls.search(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())[0]
                yield _answer(batch, x, at, balls)

    return run


def _answer(batch: pa.RecordBatch, x: np.ndarray, at: np.ndarray, balls: Balls) -> pa.RecordBatch:
    own = x - balls.centres[at]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array((own * own).sum(axis=1))], names=["vec_id", "cluster", "distance"])


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-component vector of ``embeddings`` with its cluster of 40."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out, one row a vector, centroid and component."""
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}))""",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"""m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{n} o LEFT JOIN m{n} m ON o.c = m.c AND o.i = m.i)""")
    return f"""WITH {", ".join(parts)}, named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"""


ORACLE = _oracle()
