"""Shared pieces of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words, as a character class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
SPACES = b" \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z only.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests on one machine) a temporary folder is chosen.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_fold(doc_id, modulus: int):
    """crc32(doc_id as text) mod ``modulus`` as a column; null ids hash as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def crc_fold_value(doc_id, modulus: int) -> int:
    """The same fold for one Python value."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; nulls are empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [value or b"" for value in binary.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [value or "" for value in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of a batch, so that per-slice work needs little memory."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


#: What a Python worker keeps between tasks, for one operator at a time.
_WORKER_STATE: dict = {}


def worker_state(key, make: Callable):
    """State of this Python worker under ``key``, made once; other states are dropped."""
    if key not in _WORKER_STATE:
        _WORKER_STATE.clear()
        _WORKER_STATE[key] = make()
    return _WORKER_STATE[key]


def stateless(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """``run`` in a worker that lets go of what other operators kept there, and of its own in the end."""

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        _WORKER_STATE.clear()
        with uncollected():
            yield from run(batches)
        release_memory()

    return fresh


@contextlib.contextmanager
def uncollected():
    """Python's cycle collector off: the operators make no cycles, and it would walk their tables again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def release_memory() -> None:
    """Hands memory that a finished task freed back to the system; idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows in an Arrow batch: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches sized for rows that carry whole texts.

    The setting stays with the session: frames are lazy, and it counts when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def popcount64(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)
