"""What several operators of this subpackage share: the shared folder, hashes, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that the engine sends to Python; its own default is 64 MB, doubled while it grows and held outside the heap.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of the tables written between steps.
ROW_GROUP = 16 << 20
#: A key is hot if it has more than so manieth a part of all rows.
PARTS = 1_000
#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cadence-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Sets the session's bound on a batch's bytes; results don't depend on it. A longer text makes a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, codec))


def write_table(df: DataFrame, name: str, codec: str = "snappy") -> str:
    """Row groups are small, as a writer holds one in memory for each file that it writes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.block.size": str(ROW_GROUP), "compression": codec}
    if codec == "zstd":  # large pages of values that hardly repeat
        options |= {"parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20), "parquet.enable.dictionary": "false"}
    df.write.options(**options).parquet(path)
    return path


def join_uneven(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (a row for each key, ``_n``: how many of ``rows`` have it, of ``total`` in all).

    Keys with more than 1/PARTS of all rows, which are fewer than PARTS, are broadcast, so that no task
    gets all rows of one; the rest are shuffled. So ``table`` must have each key that many rows have,
    with nulls if need be; it is read twice. Rows without a key meet nothing. ``_n`` doesn't go on.
    """
    often = F.col("_n") > max(total // PARTS, 1)
    hot = table.where(often).drop("_n")
    a = rows.join(F.broadcast(hot), key)
    b = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~often).drop("_n"), key, how)
    out = a.unionByName(b)
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that write_table() made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_text(doc_id: str = "doc_id") -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus``."""
    return F.crc32(id_text(doc_id).cast("binary")) % modulus


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task of mapInArrow, giving freed memory back to the system after each batch and at its end.

    Workers are kept for later tasks, and would hold what the largest batches took.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return task


def give_back() -> None:
    """Freed memory of Arrow's pool and of the C library (where it is glibc's) back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but ``used`` under a name that no operator takes, and {name: new name} of all columns."""
    names = {c: c if c in used else f"_aside{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def brought_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that set_aside() was given, under their own names and in their order."""
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


def clean_name(*taken: str, stem: str = "_c") -> str:
    """A column name that is not among ``taken``, for frames with columns of any name."""
    name = stem
    while name in taken:
        name += "_"
    return name
