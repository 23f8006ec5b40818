"""Approximate nearest neighbours by additive quantisation (op 4).

A vector is the sum of one codeword from each of several full-dimensional codebooks. Codebooks
are fitted on a bounded sample of rows by residual k-means; every row is encoded by beam search
and keeps its codes and its reconstruction's squared norm. A query scores a row by adding up
entries of its lookup tables, and the best rows of each block are reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import partitions, written
from lumenframe.llm.wordhash import column

SAMPLE_ROWS = 20_000  # rows that the codebooks are fitted on at most, by hash order
BOOKS, WORDS, BEAM, ROUNDS, SEED = 8, 256, 8, 12, 5
BLOCK_ROWS = 8192  # rows scored together
QUERY_ROWS = 512  # queries scored together
SHORTLIST = 200  # rows of a block that each query reranks exactly, and ties of the last


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimension

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the books, and squared norms of the reconstructions."""
        n = len(x)
        codes = np.zeros((n, 1, 0), np.uint8)
        rest = x[:, None, :]
        for book in self.words:
            norms = (book**2).sum(1)
            error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + norms  # n x beam x words
            flat = error.reshape(n, -1)
            keep = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[rows, parent] - book[word]
        error = (rest**2).sum(2)
        pick = error.argmin(1)
        rows = np.arange(n)
        return codes[rows, pick], ((x - rest[rows, pick]) ** 2).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: books x queries x words."""
        return np.einsum("qd,bwd->bqw", queries, self.words)


def fit(x: np.ndarray) -> Codebooks:
    """Residual k-means; with fewer rows than words the words repeat rows."""
    rng, books, rest = np.random.default_rng(SEED), [], x.astype(np.float32)
    for _ in range(BOOKS):
        if not len(rest):
            books.append(np.zeros((WORDS, x.shape[1]), np.float32))
            continue
        book = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)].copy()
        for _ in range(ROUNDS):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            count = np.bincount(near, minlength=WORDS)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
        books.append(book)
    return Codebooks(np.stack(books))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that can take part: no null, NaN or infinite component, and not all zero."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good & F.exists("embedding", lambda v: v != 0)
    )


def matrix(array: pa.ListArray) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``rows``, the last of a task shorter, however they came."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _blobs(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regrouped(batches, BLOCK_ROWS):
            ids, x = column(part, "vec_id").to_numpy(), matrix(column(part, "embedding"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            codes, norms = [], []
            for a in range(0, len(ids), 1024):
                c, n = books.encode(x[a : a + 1024].astype(np.float32))
                codes.append(c)
                norms.append(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "codes": pa.array([np.concatenate(codes).tobytes()], pa.binary()),
                    "norms": pa.array([np.concatenate(norms).astype("<f4").tobytes()], pa.binary()),
                    "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()),
                }
            )

    return run


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in regrouped(batches, QUERY_ROWS):
        yield pa.RecordBatch.from_pydict(
            {"q_ids": pa.array([column(part, "vec_id").to_numpy().tobytes()], pa.binary()), "q_vectors": pa.array([matrix(column(part, "embedding")).astype("<f8").tobytes()], pa.binary())}
        )


def scored(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, books: Codebooks, k: int, measure: str) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the best ``k`` rows of a block for each query."""
    table = books.tables(q.astype(np.float32))
    approx = np.zeros((len(q_ids), len(ids)), np.float32)
    for b in range(codes.shape[1]):
        approx += table[b][:, codes[:, b]]
    if measure == DISTANCE:  # |q - x|^2 = |q|^2 - 2 qx + |x|^2, and |q| is the same for all rows
        approx = 2 * approx - norms
    out: list[list[np.ndarray]] = [[], [], []]
    want = SHORTLIST + k
    for i, query in enumerate(q_ids):
        row = approx[i]
        if len(row) > want:
            limit = np.partition(row, len(row) - want)[len(row) - want]
            near = np.flatnonzero(row >= limit)
        else:
            near = np.arange(len(row))
        near = near[ids[near] != query]
        exact = x[near] @ q[i] if measure == PRODUCT else -((x[near] - q[i]) ** 2).sum(1)
        best = np.lexsort((ids[near], -exact))[:k]
        out[0].append(np.full(len(best), query))
        out[1].append(ids[near][best])
        out[2].append(exact[best])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def _search(books: Codebooks, k: int, measure: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(column(batch, c)[i].as_buffer(), kind)  # noqa: B023, E731
                q_ids, ids = get("q_ids", "<i8"), get("ids", "<i8")
                q = get("q_vectors", "<f8").reshape(len(q_ids), -1)
                query, vec, score = scored(q_ids, q, ids, get("codes", np.uint8).reshape(len(ids), -1), get("norms", "<f4"), get("vectors", "<f8").reshape(len(ids), -1), books, k, measure)
                yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(vec.astype(np.int64)), pa.array(score.astype(float))], names=["query_id", "vec_id", "score"])

    return run


PRODUCT, DISTANCE = "product", "distance"


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, measure: str = PRODUCT) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``: by largest inner product, or by least Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score: exact double-precision products, or squared
    distances with a minus, ties to the smaller vec_id. Null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part; other columns are ignored; rows that repeat an id count once, by
    the smallest vector; vectors of another length than most have (ties: the longer) take no
    part. An empty table, or one without queries, gives an empty result.
    """
    if measure not in (PRODUCT, DISTANCE):
        raise ValueError(f"measure is {PRODUCT} or {DISTANCE}")
    fit_in = usable(vectors)
    length = fit_in.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is not None:
        fit_in = fit_in.where(F.size("embedding") == length["length"])
    good = written(fit_in.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    books = fit(matrix(sample.column("embedding").combine_chunks()) if sample.num_rows else np.zeros((0, 1)))
    blocks = written(good.mapInArrow(_blobs(books), "ids binary, codes binary, norms binary, vectors binary"), "blocks")
    queries = written(good.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_queries, "q_ids binary, q_vectors binary"), "queries")
    blocks = blocks.repartition(partitions(vectors.sparkSession))
    # blocks of a stated query set against blocks of rows: rows of both are few, large and bounded
    pairs = blocks.crossJoin(queries)
    found = pairs.mapInArrow(_search(books, k, measure), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
