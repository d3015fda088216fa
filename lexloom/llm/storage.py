"""Tables between the steps of one operator.

They are written as Parquet to the folder that the cluster names in ``spark.checkpoint.dir`` and read again:
that cuts the lineage, and a lost executor costs its running tasks only.  A table that no later step reads is deleted
by ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: Arrow batches hold whole texts, so their bytes are bounded besides their rows, where the session has Spark's own default.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"
SLICE_BYTES = 2 << 20
SIEVE_BITS = 1 << 23
_own: dict[str, str] = {}  # of local runs, by application


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.  Where it names none, a local run gets one of its own and a cluster an error."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{KEY} names no folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        found = _own[app]
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; the session's settings are the same afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_KEY)
    try:
        if before == BATCH_DEFAULT:
            spark.conf.set(BATCH_KEY, BATCH_BYTES)
        df.write.parquet(path)
    finally:
        if before == BATCH_DEFAULT:
            spark.conf.set(BATCH_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _release() -> None:
    """Give freed memory back, as Python workers live on from stage to stage."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def in_slices(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], column: str = "text", rows: int = 1 << 14, most: int = SLICE_BYTES, gather: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches that hold ``most`` bytes of ``column`` at most, or a single row, whatever the session's batches are.

    With ``gather``, smaller batches are put together to about that size."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if held and size + batch.nbytes > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches) if gather else batches:
            if len(batch) <= rows and batch.nbytes <= most:
                yield batch
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            begin = held = 0
            for k, n in enumerate(sizes):
                if k > begin and (held + n > most or k - begin == rows):
                    yield batch.slice(begin, k - begin)
                    begin, held = k, 0
                held += n
            if begin < len(batch):
                yield batch.slice(begin)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        _release()

    return whole


def sieve(df: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with ``__maybe``: false only where ``key`` isn't among the longs of the one column of ``ids``.

    So rows that a join would drop needn't be shuffled for it.  It is a bitmap of ``SIEVE_BITS`` at most, whatever the
    number of ids; the fuller it is, the more rows pass.
    """
    spot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SIEVE_BITS)).alias("h")
    bits = ids.select(spot).groupBy(F.shiftright("h", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("__bits"))
    bits = stage(bits, name)  # SIEVE_BITS / 64 rows at most
    held = df.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))).withColumn("__w", F.shiftright("__h", 6)).join(F.broadcast(bits), "__w", "left")
    return held.withColumn("__maybe", F.coalesce(F.expr("(shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1L) = 1"), F.lit(False))).drop("__h", "__w", "__bits")
