"""Dense vectors: shards, flat inner-product search, and search in cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import PASSAGE_PREFIX, repaired
from lexloom.operators.lexical import DIGITS, ranked
from lexloom.sources.articles import require, with_index

MULTIPLIER, LEAST_CANDIDATES = 5, 50
#: Cells of an inverted file, and how many of them a query looks into.
CELLS, PROBES = 256, 32
#: Bytes of query vectors that go to all tasks at a time, rows of vectors compared at a time, and products made at a time.
QUERY_BYTES, ROWS, BLOCK = 16 << 20, 1 << 12, 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, none of them null and all of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(owner: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest scores of each owner, smaller keys first among equals."""
    order = np.lexsort((key, -score, owner))
    owner, key, score = owner[order], key[order], score[order]
    first = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - first < k
    return owner[keep], key[keep], score[keep]


def _cells_of(vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell of each vector's largest product."""
    return (vectors @ cells.T).argmax(axis=1)


def _products(shared, key: str, k: int, by_cell: bool):
    """Vectors to each query's best ones among those of the task: (query_id, key, score).

    Products are made in blocks of ``BLOCK`` at most, however many queries there are.  A product is kept if it is among the best of its
    block and not under what its query's ``k``-th best was when the kept ones were last cut, which is as soon as they are ``k`` a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, probed, cells = shared.value
        width = max(1, BLOCK // ROWS)
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        least = np.full(len(names), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, most = 0, max(len(names) * k, BLOCK)

        def cut() -> None:
            nonlocal size, best
            best = list(_best(*(np.concatenate(x) for x in zip(best, *kept, strict=True)), k))
            kept.clear()
            size = 0
            owner, n = np.unique(best[0], return_counts=True)
            full = owner[n == k]
            least[full] = best[2][np.cumsum(n)[n == k] - 1]

        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                real = batch.column("embedding").is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(real)) if not real.all() else batch
                if not len(batch):
                    continue
                held, ids = matrix(batch.column("embedding")), batch.column(key).to_numpy()
                if by_cell:
                    cell = batch.column("cell_id").to_numpy() if "cell_id" in batch.schema.names else _cells_of(held, cells)
                for q in range(0, len(names), width):
                    score = held @ queries[q : q + width].T
                    np.round(score, DIGITS, out=score)
                    if by_cell:
                        score[~probed[q : q + width, cell].T] = -np.inf
                    floor = least[q : q + width]
                    if len(score) > k:
                        floor = np.maximum(floor, np.partition(score, -k, axis=0)[-k])
                    row, owner = np.nonzero((score >= floor) & (score > -np.inf))
                    kept.append((owner + q, ids[row], score[row, owner]))
                    size += len(row)
                    if size >= most:
                        cut()
        cut()
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["query_id", key, "score"])

    return run


def best_products(vectors: DataFrame, queries: DataFrame, key: str, k: int, cells: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """``queries(query_id, vector)`` against all vectors: (query_id, key, score, rank), the ``k`` best of each.

    Queries go to the tasks in blocks of bounded bytes, one pass over the vectors each; a task returns no more than each query's
    best, so no row is made of a pair.  With ``cells``, a query meets the vectors of its ``probes`` nearest cells only; a vector
    without ``cell_id`` is in the cell of its largest product.
    """
    spark, none = vectors.sparkSession, None
    size, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not size or k < 1:
        return ranked(spark.createDataFrame([], T.StructType([queries.schema["query_id"], vectors.schema[key], T.StructField("score", T.DoubleType())])), k, key)
    blocks = -(-size * dim * 8 // QUERY_BYTES)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` bigint, score double"
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vector").toArrow()  # QUERY_BYTES or so
        if not len(part):
            continue
        names, held = part["query_id"].to_numpy(), matrix(part["vector"])
        probed = None
        if cells is not None:
            near = np.argsort(-(held @ cells.T), axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(names), len(cells)), bool)
            probed[np.arange(len(names))[:, None], near] = True
        shared = spark.sparkContext.broadcast((names, held, probed, cells))
        found = vectors.select(F.col(key).cast("bigint").alias(key), "embedding", *(["cell_id"] if cells is not None and "cell_id" in vectors.columns else [])).mapInArrow(_products(shared, key, k, cells is not None), kind)
        none = found if none is None else none.unionAll(found)
    return ranked(none, k, key)


def embed_passages(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list]], *, text_col: str = "text", prefix: str = PASSAGE_PREFIX) -> DataFrame:
    """Adds ``embedding``; the encoder is made once in each task and gets an Arrow batch at a time.  Texts are repaired and trimmed; blank ones are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            yield batch.assign(embedding=[[float(x) for x in v] for v in encode([prefix + t for t in batch[text_col]])])

    wanted = texts.withColumn(text_col, F.trim(repaired(text_col))).where(F.col(text_col) != "")
    return wanted.mapInPandas(run, T.StructType([*wanted.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def assign_shards(vectors: DataFrame, order: str, shard_rows: int = 10_000, batch: int = 16) -> DataFrame:
    """Adds ``embedding_index`` and ``shard``; a shard is full after whole batches only."""
    rows = -(-shard_rows // batch) * batch
    return with_index(vectors, order, name="embedding_index").withColumn("shard", F.floor(F.col("embedding_index") / rows).cast("long"))


def candidates(top_k: int, multiplier: int = MULTIPLIER, least: int = LEAST_CANDIDATES) -> int:
    return max(multiplier * top_k, least)


def write_shards(vectors: DataFrame, path: str, order: str, shard_rows: int = 10_000, batch: int = 16) -> None:
    """Vectors and their metadata, in the same rows, a folder a shard."""
    assign_shards(vectors, order, shard_rows, batch).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards of a folder; as numbers and vectors share rows, they can't come apart."""
    require(spark, path)
    return spark.read.parquet(path)


def shard_totals(shards: DataFrame) -> DataFrame:
    """How many vectors each shard has, and between which numbers."""
    return shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("embedding_index").alias("first"), F.max("embedding_index").alias("last"))


@dataclass
class Flat:
    """Exact search: ``vectors(embedding_index, embedding, ...)`` against a table of query vectors."""

    vectors: DataFrame
    key: str = "embedding_index"

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries(query_id, vector)``; a query vector that is in the table finds itself too."""
        found = best_products(self.vectors, queries, self.key, k)
        return found.join(self.vectors.drop("embedding"), self.key)

    def search(self, queries: DataFrame, top_k: int = 10, *, min_score: float | None = None, label: int | None = None, dedupe: str | None = None) -> DataFrame:
        """Filters act on the candidates, not on the table, and what they take away isn't made up for."""
        found = self.candidates(queries, candidates(top_k))
        if min_score is not None:
            found = found.where(F.col("score") >= min_score)
        if label is not None:
            found = found.where(F.col("label") == label)
        if dedupe:
            found = found.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", dedupe).orderBy("rank"))).where("copy = 1").drop("copy")
        return ranked(found.drop("rank"), top_k, self.key)


def _nearest(shared):
    """Vectors with the cell of their largest product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            real = np.flatnonzero(batch.column("embedding").is_valid().to_numpy(zero_copy_only=False))
            cell = np.zeros(len(batch), np.int32)
            if len(real):
                cell[real] = _cells_of(matrix(batch.column("embedding").take(pa.array(real))), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell_id"])

    return run


@dataclass
class Ivf:
    """Approximate search: vectors live in cells around centroids, a query reads the ``probes`` nearest ones.

    Vectors without ``cell_id`` get their cell where they are read."""

    vectors: DataFrame
    centroids: np.ndarray
    key: str = "embedding_index"

    @classmethod
    def train(cls, vectors: DataFrame, cells: int = CELLS, sample: int | None = None, seed: int = 7, key: str = "embedding_index") -> Ivf:
        """Centroids of a bounded sample (39 rows a cell, 10,000 at least); every vector is in the cell of its largest product."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        sample = max(39 * cells, 10_000) if sample is None else sample
        rows = vectors.orderBy(key).limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters())
        centers = centers / np.maximum(np.sqrt((centers * centers).sum(axis=1)), 1e-300)[:, None]  # of length one, as products decide
        return cls(vectors.drop("cell_id"), centers, key)

    def placed(self) -> DataFrame:
        """The vectors with ``cell_id``."""
        if "cell_id" in self.vectors.columns:
            return self.vectors
        shared = self.vectors.sparkSession.sparkContext.broadcast(self.centroids)
        return self.vectors.mapInArrow(_nearest(shared), T.StructType([*self.vectors.schema.fields, T.StructField("cell_id", T.IntegerType())]))

    def save(self, path: str) -> None:
        """Vectors a folder a cell, so that a search reads the cells that are probed."""
        self.placed().write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")
        centroids = [(k, [float(x) for x in c]) for k, c in enumerate(self.centroids)]
        self.vectors.sparkSession.createDataFrame(centroids, "cell_id int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "embedding_index") -> Ivf:
        require(spark, f"{path}/vectors", f"{path}/centroids")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell_id").collect()  # as many as there are cells
        return cls(spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows]), key)

    def search(self, queries: DataFrame, top_k: int = 10, probes: int = PROBES) -> DataFrame:
        found = best_products(self.vectors, queries, self.key, top_k, self.centroids, probes)
        return found.join(self.vectors.drop("embedding", "cell_id"), self.key)
