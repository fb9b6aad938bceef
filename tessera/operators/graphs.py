"""Lineage: nodes, clone edges with one parent each, walks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of a traced path. The search for a root has no such bound.
MAX_HOPS = 10

_own_folder: list[str] = []


def parents(edges: DataFrame) -> DataFrame:
    """One parent for each node: of edges (node, parent, similarity, seq) the last by seq."""
    return edges.groupBy("node").agg(F.max_by(F.struct("parent", "similarity"), F.struct("seq", "parent")).alias("e")).select("node", "e.parent", "e.similarity")


def ancestors(spark, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, ancestor, hops, path, strongest): up to `max_hops` steps towards the root, none twice.

    Chains of parents are doubled until they are long enough: a chain goes on with the chain of its last node. Each node has a row
    for each of its chains, so nothing bounds how many steps all walks have together, as it does in a recursive query.
    """
    steps = edges.select(F.col("node").alias("start"), F.array(F.struct("parent", "similarity")).alias("chain"))
    reach = 1
    while reach < max_hops:
        left = steps.withColumn("last", F.element_at("chain", -1)["parent"])
        further = steps.select(F.col("start").alias("last"), F.col("chain").alias("further"))
        # a shorter chain has ended at its root, which has no further one
        joined = left.join(further, "last", "left")
        reach = min(2 * reach, max_hops)
        steps = joined.select("start", F.when(F.col("further").isNull(), F.col("chain")).otherwise(F.slice(F.concat("chain", "further"), 1, reach)).alias("chain"))
    chains = steps.groupBy("start").agg(F.collect_set("chain").alias("chains"))
    known = nodes.select("node").join(chains.withColumnRenamed("start", "node"), "node", "left")
    # of several chains, the steps they begin with are walked once
    begun = F.flatten(F.transform("chains", lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.slice(c, 1, i))))
    none = F.array(F.array().cast(chains.schema["chains"].dataType.elementType))
    each = known.select("node", F.explode(F.concat(none, F.coalesce(F.array_distinct(begun), F.array().cast(chains.schema["chains"].dataType)))).alias("chain"))
    path = F.concat(F.array("node"), F.transform("chain", lambda s: s["parent"]))
    walks = each.select("node", "chain", path.alias("path")).where((F.size(F.array_distinct("path")) == F.size("path")) & (F.size("chain") <= max_hops))
    strongest = F.aggregate("chain", F.lit(0.0), lambda s, x: F.greatest(s, x["similarity"].cast("double")))
    return walks.select("node", F.element_at("path", -1).alias("ancestor"), F.size("chain").alias("hops"), "path", strongest.alias("strongest"))


def roots(walks: DataFrame) -> DataFrame:
    """(node, root, hops): the farthest ancestor of each node."""
    return walks.groupBy("node").agg(F.max_by("ancestor", "hops").alias("root"), F.max("hops").alias("hops"))


def _rounds_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver's JVM ends; a temporary one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tessera-"))
        shared = _own_folder[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/sources-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def sources(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, hops): the node without a parent that each node's parents lead to, however far it is.

    Edges have one parent for each node. A node of a cycle, or below one, has no source: root and hops are null.
    Each round, an open node (one whose `to` has a parent) takes over where its `to` points, so steps double. While any open node
    leads to a root, some node is as far from it as this round reaches, and a round that closes none has cycles only left.
    Rounds are written tables of one row a node, so neither the rows nor the plan grow with the length of the chains.
    """
    folder, jvm = _rounds_folder(spark), spark.sparkContext._jvm

    def written(table: DataFrame, number: int) -> DataFrame:
        table.write.parquet(f"{folder}/{number}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{number}")

    linked = edges.select(F.col("node").alias("parent"), F.lit(True).alias("has_parent"))
    first = edges.join(linked, "parent", "left").select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("hops"), F.coalesce("has_parent", F.lit(False)).alias("open"))
    number, now = 0, written(first, 0)
    before, left = None, now.where("open").count()
    while left and left != before:
        further = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"), F.col("open").alias("still"))
        moved = now.where("open").join(further, "to").select("node", F.col("further").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("still").alias("open"))
        now = written(now.where("not open").unionByName(moved), number + 1)
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
        number, before, left = number + 1, left, now.where("open").count()
    found = nodes.select("node").distinct().join(now, "node", "left")
    root = F.when(F.col("open").isNull(), F.col("node")).when(~F.col("open"), F.col("to"))
    hops = F.when(F.col("open").isNull(), F.lit(0).cast("long")).when(~F.col("open"), F.col("hops"))
    return found.select("node", root.alias("root"), hops.alias("hops"))


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("children"))


def descendants(walks: DataFrame) -> DataFrame:
    """(node, descendant, hops): what was cloned from a node, level by level, from the walks of `ancestors`."""
    return walks.where("hops > 0").select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "hops")


def recorded(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detection results (source, target, similarity, seq) as lineage: nodes (node, is_source) and edges with one parent each.

    A target is a clone of its source, the last by seq if it has several; a node that is no target is a source.
    """
    links = parents(matches.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("parent"), "similarity", "seq"))
    ends = matches.select(F.col("source").alias("node")).unionByName(matches.select(F.col("target").alias("node"))).distinct()
    marked = ends.join(links.select("node", F.lit(False).alias("is_source")), "node", "left")
    return marked.select("node", F.coalesce("is_source", F.lit(True)).alias("is_source")), links
