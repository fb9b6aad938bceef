"""What the corpus operators share: written intermediate tables, key hashing, batch sizes."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts vary from nothing to megabytes, so batches are kept short.
BATCH_ROWS = 512

_own_folder: list[str] = []
_sent_to: set[str] = set()


def prepare_python(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on executors: send them this package, once, and bound the Arrow batches that carry whole texts."""
    context = spark.sparkContext
    if context.applicationId not in _sent_to:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tessera-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _sent_to.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_remembered: dict[tuple, object] = {}


def remembered(operator: str, key: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker from task to task. Workers outlive operators, so what others kept goes."""
    for other in [k for k in _remembered if k != (operator, key)]:
        del _remembered[other]
    if (operator, key) not in _remembered:
        _remembered[operator, key] = make()
    return _remembered[operator, key]


def thrifty(run: Callable) -> Callable:
    """A function over batches that gives the memory of its Python worker back when a task ends: workers outlive stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tessera-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that saved() wrote and that nothing reads any more: what came of it is written itself."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(column: str, modulus: int):
    """crc32 of the value as text, modulo; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def raw(column: str = "text"):
    """A text as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def sent_if_small(table: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for a broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


_SEPARATORS = [c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90)]
_TABLE = bytes.maketrans(bytes(_SEPARATORS) + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(_TABLE).split()
