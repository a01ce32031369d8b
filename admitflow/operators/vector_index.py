"""A stored vector index: a table partitioned by list, with product-quantised codes beside the vectors.

Centres and codebooks are fitted on a bounded, documented sample; every vector is indexed.
A search reads the codes of the lists that its queries look into (partition pruning), ranks them by
their approximate similarity, and reads only the best of them as vectors, for the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admitflow.operators.retrieve import AT_ONCE, QUERY_BLOCK, Best, matrix_of, query_blocks, unit

#: Lists of the index, parts of a code, values of a part, and vectors that both are fitted on at most.
LISTS, PARTS, VALUES, SAMPLE, SEED = 64, 16, 256, 20_000, 11
#: Lists that a query looks into, and vectors that are read for it, as a multiple of the results asked for.
PROBES, RERANK = 48, 10
#: Candidates that are broadcast to the vectors at most; more are joined by shuffling.
MAX_BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Quantiser:
    """Unit centres of the lists, and the values of each part of what a vector has beyond its centre."""

    centres: np.ndarray
    books: np.ndarray  # parts x values x width of a part

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.centres.T).argmax(axis=1)

    def split(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        padded = np.zeros((len(vectors), parts * width))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), parts, width)

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.split(vectors - self.centres[lists])
        return np.stack([nearest(rest[:, p], self.books[p]) for p in range(len(self.books))], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """What each value of each part adds to a query's similarity: queries x parts x values."""
        return np.einsum("qpw,pvw->qpv", self.split(queries), self.books)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, sphere: bool = False) -> np.ndarray:
    """At most ``k`` centres of ``rows``."""
    different = np.unique(rows, axis=0)
    if len(different) <= k:
        return different
    centres = different[rng.choice(len(different), k, replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)[:, None]
        np.add.at(sums, own, rows)
        centres = np.where(n > 0, unit(sums) if sphere else sums / np.maximum(n, 1), centres)
    return centres


def fit_quantiser(vectors: DataFrame, lists: int = LISTS, parts: int = PARTS, sample: int = SAMPLE, seed: int = SEED) -> Quantiser:
    """Fitted on about ``sample`` unit vectors spread over the table, at most twice as many."""
    rows = vectors.where("embedding is not null").select("embedding")
    share = min(1.0, sample / max(1, rows.count()))
    taken = rows.sample(share, seed) if share < 1 else rows
    data = unit(matrix_of(taken.limit(2 * sample).toArrow().column(0).combine_chunks()))
    rng = np.random.default_rng(seed)
    if not len(data):
        return Quantiser(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    centres = k_means(data, lists, rng, sphere=True)
    width = -(-data.shape[1] // parts)
    blank = Quantiser(centres, np.zeros((-(-data.shape[1] // width), 1, width)))
    rest = blank.split(data - centres[blank.lists(data)])
    books = [k_means(rest[:, p], VALUES, rng) for p in range(rest.shape[1])]
    full = max(map(len, books))
    return Quantiser(centres, np.stack([np.concatenate([b, np.repeat(b[:1], full - len(b), axis=0)]) for b in books]))


def write_index(vectors: DataFrame, path: str, quantiser: Quantiser) -> None:
    """(vec_id, embedding, code) of every vector, partitioned by list. Rows of a list are spread over tasks, so that a large list is several files."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if batch.num_rows:
                data = unit(matrix_of(batch.column(1)))
                lists = q.lists(data)
                codes = q.encode(data, lists)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists.astype(np.int32))], ["vec_id", "embedding", "code", "list"])

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.mapInArrow(encode, "vec_id long, embedding array<float>, code binary, list int").write.partitionBy("list").parquet(path)


def candidates(index: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, probes: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, list): the ``k`` best of each query by their codes, in the lists nearest to it. Only codes are read, and only of lists that a query looks into."""
    schema = "query_id long, list int, vec_id long, similarity double"
    out = None
    for ids, matrix in query_blocks(queries.where("embedding is not null"), block):
        asked = np.argsort(-(matrix @ quantiser.centres.T), axis=1, kind="stable")[:, :probes]
        shared = index.sparkSession.sparkContext.broadcast((ids, matrix @ quantiser.centres.T, quantiser.tables(matrix), asked))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, centres, tables, asked = shared.value
            best, where = Best(len(ids), k), {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in np.unique(lists).tolist():
                    some, rows = np.flatnonzero((asked == c).any(axis=1)), np.flatnonzero(lists == c)
                    where |= dict.fromkeys(own[rows].tolist(), c) if len(some) else {}
                    for at in range(0, len(some), AT_ONCE):
                        q = some[at : at + AT_ONCE]
                        sims = centres[q, c][:, None] + sum(tables[q, p][:, codes[rows, p]] for p in range(codes.shape[1]))
                        sims[ids[q][:, None] == own[rows][None, :]] = -np.inf
                        best.add(q, sims, own[rows])
                if len(where) > 4 * len(ids) * k:
                    where = {i: where[i] for found in best.ids for i in found.tolist()}
            made = best.batch(ids)
            yield pa.RecordBatch.from_arrays([made.column(0), pa.array([where[i] for i in made.column(1).to_pylist()], pa.int32()), made.column(1), made.column(2)], ["query_id", "list", "vec_id", "similarity"])

        wanted = np.unique(asked).tolist()
        part = index.where(F.col("list").isin(wanted)).select("vec_id", "code", "list").mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = index.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "list", "vec_id")


def search_index(spark: SparkSession, path: str, queries: DataFrame, quantiser: Quantiser, k: int = 10, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id, similarity, rank, vectors_read): the ``k`` nearest others of each query among ``k * rerank`` candidates, by exact similarity.

    queries: query_id, embedding. The vectors are read by list and id, so only lists that hold a candidate are opened.
    """
    index = spark.read.parquet(path)
    found = candidates(index, queries, quantiser, k * rerank, probes)
    few = F.broadcast if queries.count() * k * rerank <= MAX_BROADCAST_ROWS else lambda x: x
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    pairs = index.select("list", "vec_id", F.col("embedding").cast("array<double>").alias("v")).join(few(found), ["list", "vec_id"]).join(few(asked), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    near = F.coalesce(dot(F.col("q"), F.col("v")) / F.nullif(F.sqrt(dot(F.col("q"), F.col("q"))) * F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(0.0)), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    read = F.count("*").over(Window.partitionBy("query_id"))
    scored = pairs.select("query_id", "vec_id", F.round(near, 6).alias("similarity")).withColumns({"vectors_read": read, "rank": rank})
    return scored.where(F.col("rank") <= k).select("query_id", "vec_id", "similarity", "rank", "vectors_read")


def measured(found: DataFrame, exact: DataFrame, n_vectors: int) -> DataFrame:
    """(query_id, recall, share_read): how much of the exact result was found, and the share of all vectors that was read for it."""
    right = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    recall = right.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    read = found.groupBy("query_id").agg((F.max("vectors_read") / F.lit(max(1, n_vectors))).alias("share_read"))
    return recall.join(read, "query_id", "left").select("query_id", "recall", F.coalesce("share_read", F.lit(0.0)).alias("share_read"))
