"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import re
import string
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgauge.session import scratch_folder, table

#: ASCII capitals to small letters, everything else as it is; for bytes and for Spark's translate.
LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Rows of one Arrow batch: whole texts pass, so the usual 10,000 rows can be a gigabyte.
BATCH_ROWS = 1000

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where the kept tables lie


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds a bounded part of a partition."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


@contextlib.contextmanager
def byte_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Bound the bytes of an Arrow batch while a table is written, so that long texts never add up in a worker."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(size))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextlib.contextmanager
def read_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the rows that a reader decodes at once: 4,096 rows of packed values can be a whole file."""
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def kept_table(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder and go on from the written table."""
    folder = scratch_folder(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(folder)
    kept = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[kept] = folder
    return kept


def remove_tables(*tables: DataFrame) -> None:
    """Delete results of ``kept_table`` that no later step reads; any other table is an error."""
    for kept in tables:
        context = kept.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(kept))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in small letters and nothing else; texts of ASCII alone take the built-in, much faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo a number; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def word_blocks(data: bytes, block_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII blanks, block after block, so that a very long text never becomes one list of words."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + block_bytes) if len(data) - at > block_bytes else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def release_memory() -> None:
    """Give back what Arrow and the C library keep for later: the workers of an executor share its memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
