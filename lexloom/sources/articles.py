"""Articles and chunks: JSON arrays, JSON lines, Parquet and the star tables, as one document table.

Columns of a document: doc_index, id, title, content, url, source, topic, author, crawled_at (number), crawled_text,
title_processed, content_processed, combined_processed, combined_unaccented, doc_id, chunk_id, metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import as_text, chunk_title, repaired

# The keys of a record that have a place of their own.
FIELDS = (
    "id", "doc_id", "chunk_id", "title", "content", "raw_text", "url", "source", "topic", "author", "crawled_at",
    "title_processed", "content_processed", "combined_processed", "combined_unaccented", "chunk_processed", "chunk_unaccented",
)

#: Bytes of an Arrow batch where the session has Spark's own default.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


class MissingArtifact(FileNotFoundError):
    """A table or file that a search needs isn't there."""


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def require(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise MissingArtifact(f"missing: {', '.join(missing)}")


def read_raw_json(spark: SparkSession, path: str, array: bool | None = None) -> DataFrame:
    """``(raw, place)``: one JSON object a row, with its place in the input.  ``array`` says whether the file is one JSON array; None looks at its beginning.

    Lines are split and read in parallel, with closing commas dropped and blank ones skipped; bytes that aren't UTF-8 are
    replaced.  An array whose objects have lines of their own is read as such lines.  Any other array is one value for
    Spark's reader; convert a large one once.
    """
    source = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = source.select(F.make_valid_utf8("value").alias("value"), place.alias("place"))
    if array is None:
        head = lines.where(F.trim("value") != "").limit(1).collect()
        array = bool(head) and head[0]["value"].lstrip("\ufeff \t").startswith("[")
    objects = lines.select(F.regexp_replace(F.trim("value"), r"[,\s]+$", "").alias("raw"), "place").where("raw <> ''")
    if not array:
        return objects
    inner = objects.where(~F.col("raw").isin("[", "]", "\ufeff["))
    if not inner.isEmpty() and inner.where(F.coalesce(F.left("raw", F.lit(1)) != "{", F.lit(True)) | F.json_object_keys("raw").isNull()).isEmpty():
        return inner
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("row", "raw")).select("raw", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")).alias("place"))


def records_to_documents(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of ``raw`` JSON to repaired documents, numbered by ``order``; the shape is told by whether the key ``chunk_id`` is there, null or not."""
    keys = F.json_object_keys("raw")
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    parsed = raw.select("*", keys.alias("__keys"), F.from_json("raw", "map<string,string>").alias("__map"), *(get(k).alias(f"__{k}") for k in FIELDS))
    chunk = F.array_contains("__keys", "chunk_id")
    pick = lambda a, b: F.when(chunk, as_text(a)).otherwise(as_text(b))
    mended = lambda a, b: repaired(pick(a, b))
    nothing = F.lit("")
    number = F.when(F.col("__map")["crawled_at"].rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$") & ~F.col("raw").rlike(r'"crawled_at"\s*:\s*"'), F.col("__crawled_at").cast("double"))
    extra = F.map_filter("__map", lambda k, v: ~k.isin(*FIELDS))
    ids = F.when(chunk, F.create_map(F.lit("doc_id"), as_text("__doc_id"), F.lit("chunk_id"), as_text("__chunk_id"))).otherwise(F.create_map().cast("map<string,string>"))
    out = parsed.select(
        pick("__chunk_id", "__id").alias("id"), repaired(F.when(chunk, chunk_title("__raw_text")).otherwise(as_text("__title"))).alias("title"), mended("__raw_text", "__content").alias("content"),
        as_text("__url").alias("url"), *(repaired(as_text(f"__{k}")).alias(k) for k in ("source", "topic", "author")),
        number.alias("crawled_at"), F.when(number.isNull(), F.col("__crawled_at")).alias("crawled_text"),
        F.when(chunk, nothing).otherwise(repaired(as_text("__title_processed"))).alias("title_processed"), mended("__chunk_processed", "__content_processed").alias("content_processed"),
        mended("__chunk_processed", "__combined_processed").alias("combined_processed"), mended("__chunk_unaccented", "__combined_unaccented").alias("combined_unaccented"),
        F.when(chunk, as_text("__doc_id")).otherwise(as_text("__id")).alias("doc_id"), F.when(chunk, as_text("__chunk_id")).otherwise(nothing).alias("chunk_id"),
        F.map_concat(F.map_filter(extra, lambda k, v: ~F.array_contains(F.map_keys(ids), k)), ids).alias("metadata"), *([order] if order else []),
    )
    return with_index(out, order) if order else out


def fixed(df: DataFrame) -> DataFrame:
    """The same rows for every reader, in the shared folder, so that a lost executor takes none of them along."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and named:
        context.setCheckpointDir(named)
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lexloom-')}")
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``fixed`` for large tables: Parquet in the shared folder, a fraction of the bytes; deleted when the session's JVM ends."""
    import uuid

    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}")
    before = spark.conf.get(BATCH_KEY)
    try:
        if before == BATCH_DEFAULT:  # batches of whole texts are bounded by their bytes
            spark.conf.set(BATCH_KEY, BATCH_BYTES)
        df.write.parquet(path.toString())
    finally:
        spark.conf.set(BATCH_KEY, before)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def with_index(df: DataFrame, *order: str, name: str = "doc_index") -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, whose values should differ: counts of ranges first, then places within each range.

    Rows are range-partitioned, so no task sorts them all.  The ranges are drawn from a sample, so their rows are written
    once for both readers.  The running sum is over one row a range.
    """
    ranged = fixed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    before = counts.select("__part", "first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(before, "__part").withColumn(name, (F.col("before") + F.col("__row") - F.col("first")).cast("long")).drop("__part", "__row", "first", "before")


def load_documents(spark: SparkSession, path: str, limit: int | None = None, array: bool | None = None) -> DataFrame:
    """Documents of a JSON file in its order; ``limit`` takes the first ones, one at least, as the scan stops after a record."""
    raw = read_raw_json(spark, path, array)
    raw = raw.orderBy("place").limit(max(limit, 1)) if limit is not None else raw
    return records_to_documents(raw, "place").drop("place")


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` as documents: titles from the text, languages as topics."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return adapt_documents(docs)


def adapt_documents(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    docs = docs.withColumn("content", repaired("text"))
    return docs.select(
        F.col("doc_id").alias("doc_index"), F.col("doc_id").cast("string").alias("id"), chunk_title("content").alias("title"), "content",
        empty.alias("url"), as_text("source").alias("source"), as_text("lang").alias("topic"), empty.alias("author"),
        *(empty.alias(k) for k in ("title_processed", "content_processed", "combined_processed", "combined_unaccented")),
        F.lit(None).cast("double").alias("crawled_at"), F.lit(None).cast("string").alias("crawled_text"), F.col("doc_id").cast("string").alias("doc_id"), empty.alias("chunk_id"),
    )


def write_table(df: DataFrame, path: str, *, cluster: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """Parquet, range-partitioned and sorted by ``cluster``, so that scans for one value read few row groups."""
    out = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else df
    writer = out.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """One JSON row with the settings of an index."""
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()["value"])


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``word``: one a line, inner spaces as underscores."""
    return spark.read.text(path).select(F.replace(F.lower(F.trim("value")), F.lit(" "), F.lit("_")).alias("word")).where("word <> ''").distinct()


RESULT = T.StructType([T.StructField(n, t) for n, t in (
    ("query_id", T.LongType()), ("rank", T.IntegerType()), ("doc_index", T.LongType()), ("score", T.DoubleType()), ("doc_id", T.StringType()), ("chunk_id", T.StringType()), ("title", T.StringType()),
    ("snippet", T.StringType()), ("url", T.StringType()), ("source", T.StringType()), ("topic", T.StringType()), ("author", T.StringType()), ("crawled_at", T.DoubleType()), ("crawled_text", T.StringType()))])
