"""The library's exchange format: projects with their modules, modules with their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Modules of a row, about.
MODULES_A_ROW = 200


def nested(projects: DataFrame, modules: DataFrame, fingerprints: DataFrame, modules_a_row: int = MODULES_A_ROW) -> DataFrame:
    """Projects (id, ...) with modules (id, ..., fingerprints (value, type)), all sorted; `write.json` exports it.

    `modules` has id and project_id, `fingerprints` value, type and module_id. Projects without modules and modules
    without fingerprints have empty lists. A project of many modules has several rows, which repeat its own columns and
    share its modules by a hash of their id, about `modules_a_row` each: no row, and no task, holds a large project whole.
    """
    prints = fingerprints.groupBy(F.col("module_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("value", "type"))).alias("fingerprints"))
    empty = F.array().cast("array<struct<value:bigint,type:string>>")
    full = modules.join(prints, "id", "left").withColumn("fingerprints", F.coalesce("fingerprints", empty))
    shown = [c for c in full.columns if c != "project_id"]
    rows = modules.groupBy("project_id").agg(F.ceil(F.count("*") / modules_a_row).alias("__rows"))
    dealt = full.join(rows, "project_id").withColumn("__row", F.pmod(F.xxhash64("id"), F.col("__rows")))
    owned = dealt.groupBy(F.col("project_id").alias("id"), "__row").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in shown if c != "id"]))).alias("modules")).drop("__row")
    none = F.array().cast(owned.schema["modules"].dataType)
    return projects.join(owned, "id", "left").withColumn("modules", F.coalesce("modules", none))


def new_projects(exported: DataFrame, existing: DataFrame) -> DataFrame:
    """The exported projects whose id the library doesn't have: what an import adds."""
    return exported.join(existing.select("id"), "id", "left_anti")


def flattened(exported: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, one row each, modules with their project_id, fingerprints with their module_id."""
    modules = exported.select(F.col("id").alias("project_id"), F.explode("modules").alias("m")).select("project_id", "m.*")
    prints = modules.select(F.col("id").alias("module_id"), F.explode("fingerprints").alias("f")).select("module_id", "f.*")
    return exported.drop("modules").dropDuplicates(["id"]), modules.drop("fingerprints"), prints
