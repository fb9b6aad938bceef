"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare_python, saved

#: Leading characters that take part in the range key, so that sampled splitters stay small.
PREFIX = 32
RUNS = "part int, run long, doc_id long, run_keep long, text_sha256 string, nth long, run_size long, edge boolean"


def normalised(text):
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the runs of neighbours whose whole texts are equal. Only ids of the open run and one text are held."""
    from pyspark import TaskContext

    part, run, last, ids, sha = TaskContext.get().partitionId(), 0, None, [], None

    def close(edge: bool) -> pd.DataFrame:
        return pd.DataFrame({
            "part": part, "run": run, "doc_id": pd.array(ids, dtype="Int64"),
            "run_keep": pd.array(ids[:1] * len(ids), dtype="Int64"), "text_sha256": sha,
            "nth": range(len(ids)), "run_size": len(ids), "edge": edge,
        })

    for frame in batches:
        done = []
        for doc_id, text, digest in zip(frame["doc_id"], frame["norm"], frame["sha"], strict=True):
            if last is not None and text != last:
                done.append(close(run == 0))
                run, ids = run + 1, []
            last, sha = text, digest
            ids.append(None if pd.isna(doc_id) else int(doc_id))
        if done:
            yield pd.concat(done, ignore_index=True)
    if last is not None:
        yield close(True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Group texts that are equal after white-space normalisation; the row with the smallest id of each group stays.

    Normalised texts are range-partitioned by sampled splitters over (prefix, 64-bit hash, id) and sorted
    by (prefix, hash, text, id) with Spark's external sort, so equal texts stand side by side, a large group is
    dealt over many tasks, and neighbours are compared in full. Runs that cross a task's edge are merged by
    their digest; that table has at most two rows a task.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.
    Null texts count as empty. Rows that repeat an id and a text: the first stays, the others are dropped.
    A null id sorts first and can be the one that stays (keep_id null). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = norm.select("doc_id", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"))
    ordered = keyed.repartitionByRange(n, "prefix", "hash", "doc_id").sortWithinPartitions("prefix", "hash", "norm", "doc_id")
    ranged = ordered.select("doc_id", F.col("norm").cast("binary").alias("norm"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    runs = saved(ranged.mapInPandas(_runs, RUNS), "exact-runs")

    # at most two runs a task: bounded by the number of partitions, not by the data
    edges = runs.where("edge and nth = 0").select("part", "run", "doc_id", "text_sha256", "run_size").orderBy("part", "run").collect()
    merged, group = [], []
    for row in [*edges, None]:
        if group and (row is None or row.text_sha256 != group[0].text_sha256):
            size, first = sum(r.run_size for r in group), group[0]
            merged += [(r.part, r.run, first.doc_id, size, r is first) for r in group]
            group = []
        if row is not None:
            group.append(row)
    across = spark.createDataFrame(merged, "part int, run long, all_keep long, all_size long, leads boolean")
    inside = F.col("all_size").isNull()
    return runs.join(F.broadcast(across), ["part", "run"], "left").select(
        "doc_id",
        F.when(inside, F.col("run_keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.when(inside, F.col("run_size")).otherwise(F.col("all_size")).alias("group_size"),
        ((F.col("nth") == 0) & (inside | F.col("leads"))).alias("kept"),
        "text_sha256",
    )
