"""Files as tables: directory scans, ignore files, whole, line and chunk readers, source dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

#: Larger files are left out of scans; whole files up to the second size are read at once; chunks have the third.
SCAN_BYTES, WHOLE_BYTES, CHUNK_BYTES = 1 << 20, 10 << 20, 64 << 10


def scan_directory(spark: SparkSession, folder: str, excluded_dirs: list[str] | None = None, rules: list[str] | None = None, extensions: list[str] | None = None, max_bytes: int = SCAN_BYTES) -> DataFrame:
    """(file_path under the folder, bytes, language, content) of the text files of a folder and its subfolders.

    Spark lists and reads the files; size and name filters come before any content is read. Files over `max_bytes` or
    that aren't UTF-8 are left out; empty files, which Spark's reader skips, and empty folders give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= max_bytes)
    files = files.withColumn("file_path", F.substring_index(F.col("path"), folder.rstrip("/").split("://")[-1].rstrip("/") + "/", -1))
    files = files.where(text.included(F.col("file_path"), excluded_dirs or [], rules or [], extensions or list(text.EXTENSIONS)))
    decoded = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return decoded.select("file_path", F.col("length").alias("bytes"), text.language_of(F.col("file_path")).alias("language"), F.col("content").cast("string").alias("content"))


def ignore_rules(spark: SparkSession, path: str) -> list[str]:
    """The rules of an ignore file in order, without blank lines and comments. Such a file is small: whole on the driver."""
    content = spark.read.text(path, wholetext=True).collect()
    lines = [x.strip() for r in content for x in r.value.splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line) of text files; large files are split among tasks."""
    return spark.read.text(path).select(F.input_file_name().alias("file_path"), F.col("value").alias("line"))


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file_path, chunk from 0, content) in pieces of `chunk_bytes` bytes; an empty file gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    return files.select(F.col("path").alias("file_path"), F.posexplode(starts).alias("chunk", "start"), "content").select("file_path", "chunk", F.expr(f"substring(content, int(start) + 1, {chunk_bytes})").alias("content"))


def read_smart(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file_path, chunk, content): files up to `whole_bytes` whole, larger ones in chunks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole_bytes).select(F.col("path").alias("file_path"), F.lit(0).alias("chunk"), "content")
    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("p"))
    return small.unionByName(read_chunks(spark, path).join(large, F.col("file_path") == F.col("p"), "left_semi"))


def open_source(spark: SparkSession, target: str, fetch: dict[str, Callable[[str], str]] | None = None, **options) -> DataFrame:
    """A project's files from a path that exists, or else from the address of a hosting service.

    `fetch` maps a host to a function that stages an address in a folder that all machines see and returns that
    folder. Hosts without one, and other targets, are errors.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    web = target.startswith(("http://", "https://"))
    if not web and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return scan_directory(spark, target, **options)
    host = target.split("://", 1)[-1].split("/")[0].lower() if web else ""
    for known, stage in (fetch or {}).items():
        if host == known or host.endswith("." + known):
            return scan_directory(spark, stage(target), **options)
    raise ValueError(f"neither a path nor an address of a known host: {target}")
