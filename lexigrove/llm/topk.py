"""Exact top-k inner products, every vector against all.

The vectors are rotated onto the principal axes of their Gram matrix (the right singular vectors), so the first coordinates of a product hold most of it,
and written to the shared folder in blocks of descending length. A task streams the blocks past its queries. A block whose longest vector
can't reach a query's k-th best ends that query's search; within a block, partial sums over the leading coordinates
plus the product of what is left of both lengths (Cauchy-Schwarz) rule pairs out before the rest is summed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_folder
from .common import binary_rows, col, fixed_matrix

K = 10
BLOCK, QUERIES = 4096, 1024
#: Digits to which products are compared; equal ones are ordered by id.
DIGITS = 9
_SLACK = 2 * 10.0**-DIGITS


def _gram(width: int):
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    return gram


def _add(table: pa.Table) -> pa.Table:
    total = np.asarray(table["sums"].combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"row": table["row"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})


def _rotate(axes: np.ndarray):
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, len(axes)) @ axes
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.sqrt((x * x).sum(axis=1))), binary_rows(x)], ["id", "length", "vector"])

    return rotate


def splits(width: int) -> list[int]:
    """Numbers of leading coordinates after which pairs are tested."""
    return sorted({max(1, width // 4), max(1, width // 2), width})


class Search:
    """The k best of a set of queries (rotated rows) so far, by their scores to DIGITS digits. Rows are offered block by block, of descending length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = np.sqrt((vectors**2).sum(axis=1))
        self.splits = splits(vectors.shape[1])
        self.rest = [np.sqrt((vectors[:, s:] ** 2).sum(axis=1)) for s in self.splits]
        self.score = np.full((len(ids), k), -np.inf)
        self.exact = self.score.copy()
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs = 0

    def done(self, longest: float) -> bool:
        """Whether no query can gain from vectors of at most this length."""
        return bool((self.lengths * longest < self.score[:, -1] - _SLACK).all())

    def offer(self, ids: np.ndarray, vectors: np.ndarray, rest: list[np.ndarray], longest: float) -> None:
        open_ = np.flatnonzero(self.lengths * longest >= self.score[:, -1] - _SLACK)
        for a in range(0, len(open_), QUERIES):
            rows = open_[a : a + QUERIES]
            self._offer(rows, ids, vectors, rest)

    def _offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rest: list[np.ndarray]) -> None:
        q, least = self.vectors[rows], self.score[rows, -1] - _SLACK
        total, before = None, 0
        r = c = None
        for n, s in enumerate(self.splits):
            if r is None:
                part = q[:, before:s] @ vectors[:, before:s].T
                total = part if total is None else total + part
                alive = total + self.rest[n][rows][:, None] * rest[n] >= least[:, None]
                if alive.sum() < alive.size / 16 or s == self.splits[-1]:
                    r, c = np.nonzero(alive)
                    total = total[r, c]
            else:
                total = total + np.einsum("ij,ij->i", q[r, before:s], vectors[c, before:s])
                alive = total + self.rest[n][rows[r]] * rest[n][c] >= least[r]
                r, c, total = r[alive], c[alive], total[alive]
            before = s
        other = self.ids[rows[r]] != ids[c]
        r, c, exact = r[other], c[other], total[other]
        total = np.round(exact, DIGITS)
        self.pairs += len(r)
        if not len(r):
            return
        hit = np.unique(r)
        k = self.k
        row = np.concatenate([np.repeat(hit, k), r])
        score = np.concatenate([self.score[rows[hit]].ravel(), total])
        exact = np.concatenate([self.exact[rows[hit]].ravel(), exact])
        found = np.concatenate([self.found[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((found, -score, row))
        row = row[order]
        first = np.searchsorted(row, hit)
        take = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[rows[hit]] = score[take].reshape(-1, k)
        self.exact[rows[hit]] = exact[take].reshape(-1, k)
        self.found[rows[hit]] = found[take].reshape(-1, k)


def _search(path: str, width: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        queries = pa.Table.from_batches(held)
        state = Search(queries["id"].to_numpy(), fixed_matrix(queries["vector"], np.float64, width), k)
        system, root = pyarrow.fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet"))
        for file in files:  # ranges of descending length
            ended = False
            for block in pyarrow.parquet.ParquetFile(file, filesystem=system).iter_batches(BLOCK, columns=["id", "length", "vector"]):
                length = block.column("length").to_numpy()
                if not len(length):
                    continue
                if state.done(length[0]):
                    ended = True
                    break
                x = fixed_matrix(block.column("vector"), np.float64, width)
                state.offer(block.column("id").to_numpy(), x, [np.sqrt((x[:, s:] ** 2).sum(axis=1)) for s in state.splits], length[0])
            if ended:
                break
        there = np.isfinite(state.score)
        rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), there.shape)
        ids = np.repeat(state.ids, k).reshape(there.shape)
        yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(rank[there]), pa.array(state.found[there]), pa.array(np.round(state.exact[there], 6) + 0.0)], ["vec_id", "rank", "neighbor_id", "score"])

    return search


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): for each query the k other vectors of the greatest inner product, exactly; ties by the lesser id.

    Queries are the vectors whose id query_step divides (1: all). Vectors of one length are searched among each other, each length apart. Left out, as queries and
    as neighbours: null ids, null or empty vectors, vectors with a null, NaN or infinite entry. Of several vectors with one id the longest counts, of these the
    greatest in array order. A vector isn't its own neighbour; with fewer than k others, all are returned. An empty table gives no rows. Products
    are compared after rounding to DIGITS digits. There is a search, of a few jobs, for each length that a query has.
    """
    spark = vectors.sparkSession
    if k < 1 or query_step < 1:
        raise ValueError("k and query_step must be positive")
    schema = "vec_id long, rank int, neighbor_id long, score double"
    plain = vectors.select(col(vectors, id_col).cast("long").alias("id"), col(vectors, vector_col).cast("array<double>").alias("vector"))
    sound = plain.where("id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    best = sound.groupBy("id").agg(F.max(F.struct(F.size("vector").alias("width"), "vector")).alias("x"))
    one = cut(best.select("id", "x.width", "x.vector"))
    widths = one.where(F.col("id") % query_step == 0).select("width").distinct().orderBy("width").collect()
    found = [_top_k(one.where(F.col("width") == r.width).select("id", "vector"), r.width, k, query_step, schema) for r in widths]
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _top_k(one: DataFrame, width: int, k: int, query_step: int, schema: str) -> DataFrame:
    spark = one.sparkSession
    sums = one.mapInArrow(_gram(width), "row long, sums array<double>").groupBy("row").applyInArrow(_add, "row long, sums array<double>")
    gram = np.array([r.sums for r in sums.orderBy("row").collect()])
    axes = np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1])
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rotated = one.mapInArrow(_rotate(axes), "id long, length double, vector binary")
    rotated.orderBy(F.desc("length"), "id").write.parquet(path)
    queries = spark.read.schema("id long, length double, vector binary").parquet(path).where(F.col("id") % query_step == 0)
    tasks = max(1, spark.sparkContext.defaultParallelism, queries.count() // (16 * QUERIES))
    return queries.select("id", "vector").repartition(tasks, "id").mapInArrow(_search(path, width, k), schema)
