"""Approximate nearest neighbours by largest inner product: score-aware four-bit quantisation, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.text import table
from tidewater.spark import materialize, ship

#: Bound on the vectors that the fit collects to the driver; they come first by a hash of their id.
SAMPLE = 12_000
#: Coarse cells, at most; rows of a block that one task scans, in one cell or several; queries that one task holds.
CELLS, BLOCK_ROWS, CHUNK_QUERIES = 64, 16_384, 8192
#: Distinct vectors of a block that the scan hands on to exact reranking, for each query: about 2 % of a full block. Recall is
#: measured in tests/llm/test_neighbours.py.
SHORTLIST = 320
#: Inner products below this share of the two lengths don't matter; it sets how much dearer a parallel error is.
SCORE_THRESHOLD = 0.2


@dataclass
class Index:
    """Cell centres, and for each pair of dimensions 16 centres of the scaled residuals."""

    centres: np.ndarray
    books: np.ndarray  # pairs x 16 x 2
    eta: float
    dim: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, scale and packed four-bit codes of each vector."""
        cell = self.cells(x)
        y, u, scale = _split(x, self.centres[cell], len(self.books))
        codes = _assign(y, u, self.books, self.eta)
        return cell, scale, (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the inner products of its 256 values: two four-bit tables added up."""
        qp = np.zeros((len(q), 2 * len(self.books)))
        qp[:, : self.dim] = q
        t = np.einsum("qmd,mkd->qmk", qp.reshape(len(q), -1, 2), self.books).astype(np.float32)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


def _pairs(dim: int) -> int:
    return -(-dim // 4) * 2


def _split(x: np.ndarray, centre: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of length one and directions of the vectors, both as pairs of dimensions; the residuals' lengths."""
    r = x - centre
    scale = np.linalg.norm(r, axis=1)
    y, u = np.zeros((2, len(x), 2 * pairs))
    y[:, : x.shape[1]] = r / np.maximum(scale, 1e-12)[:, None]
    u[:, : x.shape[1]] = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    return y.reshape(len(x), pairs, 2), u.reshape(len(x), pairs, 2), scale


def _assign(y: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes that make |e|^2 + (eta - 1) <e, u>^2 small: the error e across the vector counts once, along it ``eta`` times.
    One pair of dimensions changes at a time."""
    plain = np.stack([((books[m] ** 2).sum(axis=1) - 2 * y[:, m] @ books[m].T).argmin(axis=1) for m in range(len(books))], axis=1)
    along = np.einsum("nmd,nmd->nm", u, y - books[np.arange(len(books)), plain])
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for m, book in enumerate(books):
            rest = total - along[:, m]
            mine = (u[:, m] * y[:, m]).sum(axis=1)[:, None] - u[:, m] @ book.T
            cost = (book**2).sum(axis=1) - 2 * y[:, m] @ book.T + (eta - 1) * (rest[:, None] + mine) ** 2
            k = cost.argmin(axis=1)
            plain[:, m], along[:, m] = k, mine[np.arange(len(k)), k]
            total = rest + along[:, m]
    return plain


def fit(x: np.ndarray, seed: int = 5, rounds: int = 6) -> Index:
    """Cells by k-means; codebooks by rounds of score-aware assignment and the least squares that fits it."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    pairs = _pairs(dim)
    eta = max(1.0, (dim - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2))
    if not n:
        return Index(np.zeros((1, dim)), np.zeros((pairs, 16, 2)), eta, dim)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: max(1, min(CELLS, len(distinct) // 64))]].copy()
    for _ in range(8):
        cell = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums, count = np.zeros_like(centres), np.bincount(cell, minlength=len(centres))
        np.add.at(sums, cell, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    cell = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    y, u, _ = _split(x, centres[cell], pairs)
    books = np.stack([y[rng.integers(0, n, 16), m] + rng.normal(0, 1e-3, (16, 2)) for m in range(pairs)])
    for _ in range(rounds):
        codes = _assign(y, u, books, eta, 1)
        along = np.einsum("nmd,nmd->nm", u, y - books[np.arange(pairs), codes])
        total = along.sum(axis=1)
        for m in range(pairs):
            s = total - along[:, m] + (u[:, m] * y[:, m]).sum(axis=1)
            for k in range(16):
                mine = codes[:, m] == k
                if mine.any():
                    um = u[mine, m]
                    left = mine.sum() * np.eye(2) + (eta - 1) * um.T @ um
                    books[m, k] = np.linalg.solve(left, y[mine, m].sum(axis=0) + (eta - 1) * (um * s[mine, None]).sum(axis=0))
    return Index(centres, books, eta, dim)


def _usable(vector: str) -> F.Column:
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """For each query row of ``vectors`` (vec_id, embedding) its ``k`` nearest other rows by inner product, nearest first, ties
    to the smaller vec_id: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null vec_id, nor
    vectors of another length than the most frequent one (the longest of those that tie). Every other row is indexed; of
    identical vectors only the k + 1 smallest ids can be among any k nearest, so the others need no scan. Codes rank the
    candidates; scores are exact, in double precision. A block is skipped for a query only if even the farthest row of its cells
    can't reach the query's k-th best of the fitting sample. Rows that repeat a vec_id count as copies of one vector, each for itself.
    Fewer than k candidates: all. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(F.col("vec_id").isNotNull() & _usable("embedding")).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda e: e.cast("double")).alias("embedding"), is_query.alias("q"))
    by_size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = by_size["d"] if by_size else 1
    rows = rows.filter(F.size("embedding") == dim)
    sample = rows.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    x = np.array([r["embedding"] for r in sample], dtype=float).reshape(len(sample), dim)
    del sample
    index, probe = fit(x), x[:3000].astype(np.float32)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.select("vec_id", "embedding").withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf.embedding.tolist(), dtype=float)
                cell, scale, codes = index.encode(v)
                yield pd.DataFrame({"vec_id": pdf.vec_id, "first": pdf["_n"] == 1, "vector": [r.tobytes() for r in v], "cell": cell, "scale": scale, "codes": [c.tobytes() for c in codes]})

    made = materialize(few.mapInPandas(encode, "vec_id long, first boolean, vector binary, cell int, scale double, codes binary"))
    # small cells share a block, large ones are cut
    names, room, blocks = [], 0, []
    for cell, n in sorted((r["cell"], r["n"]) for r in made.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()):
        if not names or n > room:
            salts = max(1, -(-n // BLOCK_ROWS))
            start, room = len(names), BLOCK_ROWS * salts
            names += range(start, start + salts)
        room -= n
        blocks.append((cell, start, salts))
    dims = spark.createDataFrame(blocks, "_c int, start int, salts int")
    salt = F.pmod(F.xxhash64("vector"), F.col("salts"))  # copies of a vector stay in one block
    indexed = made.join(F.broadcast(dims), F.col("cell") == F.col("_c")).select("vec_id", "first", "vector", "scale", "codes", "cell", (F.col("start") + salt).cast("int").alias("block"))
    queries = rows.filter("q").select("vec_id", "embedding")
    n_chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    chunk = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(n_chunks)).cast("int")

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf.embedding.tolist(), dtype=float)
                s = v.astype(np.float32) @ probe.T
                floor = np.partition(s, -k - 1, axis=1)[:, -k - 1] - 1e-4 * np.linalg.norm(v, axis=1) * np.linalg.norm(probe, axis=1).max() if len(probe) > k else np.full(len(v), -np.inf)
                yield pd.DataFrame({"vec_id": pdf.vec_id, "vector": [r.tobytes() for r in v], "floor": floor.astype(float), "chunk": pdf.chunk})

    asked = queries.withColumn("chunk", chunk).mapInPandas(floors, "vec_id long, vector binary, floor double, chunk int")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1)))))
    spread = indexed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def scan(block: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(block) or not len(asked_):
            return pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})
        block = block.sort_values(["vector", "vec_id"], kind="stable")
        start = np.flatnonzero(block["first"].to_numpy() | (block.vector != block.vector.shift()).to_numpy())
        stop, ids = np.append(start[1:], len(block)), block.vec_id.to_numpy()
        top = block.iloc[start]
        v = np.frombuffer(b"".join(top.vector), dtype=float).reshape(len(top), dim)
        codes = np.ascontiguousarray(np.frombuffer(b"".join(top.codes), dtype=np.uint8).reshape(len(top), -1).T)
        scale, cell = top.scale.to_numpy(), top.cell.to_numpy()
        most = pd.Series(scale).groupby(cell).max()
        q_all = np.frombuffer(b"".join(asked_.vector), dtype=float).reshape(len(asked_), dim)
        base = q_all @ index.centres.T
        near = (base[:, most.index] + np.linalg.norm(q_all, axis=1)[:, None] * most.to_numpy()).max(axis=1) >= asked_.floor.to_numpy()
        take, out = min(shortlist, len(top)), []
        for at in np.array_split(np.flatnonzero(near), -(-int(near.sum()) // 64) or 1):
            if not len(at):
                continue
            tables = index.tables(q_all[at])
            approx = np.zeros((len(at), len(top)), dtype=np.float32)
            for m, code in enumerate(codes):
                approx += np.take(tables[:, m], code, axis=1)
            approx *= scale.astype(np.float32)
            approx += base[at][:, cell].astype(np.float32)
            best = np.argpartition(-approx, take - 1, axis=1)[:, :take]
            for i, j in zip(at, best, strict=True):
                score, me = (v[j] * q_all[i]).sum(axis=1), int(asked_.vec_id.iat[i])
                j = j[np.argsort(-score, kind="stable")[: k + 1]] if len(j) > k + 1 and len(np.unique(score)) == len(score) else j
                got = [(me, int(c), float(s)) for p in j for s in [(v[p] * q_all[i]).sum()] for c in ids[start[p] : stop[p]] if c != me]
                got.sort(key=lambda g: (-g[2], g[1]))
                out += got[:k]
        return pd.DataFrame(out, columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = spread.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th of ``embeddings``, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
