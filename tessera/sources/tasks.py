"""Lists of detection tasks, and changes as a version-control tool prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TASK = "target string, candidates array<string>"


def from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(target, candidates): one target a line; blank lines and comments don't count."""
    bare = F.trim(F.col(column))
    return lines.where((bare != "") & ~bare.startswith("#")).select(bare.alias("target"), F.array().cast("array<string>").alias("candidates"))


def from_csv(lines: DataFrame, column: str = "value") -> DataFrame:
    """(target, candidates) of lines `target,candidate,...`; empty candidates don't count, fields may be quoted."""
    fields = F.regexp_extract_all(F.col(column), F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), 1)
    unquoted = lambda x: F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"'))
    plain = F.transform(fields, lambda x: F.trim(F.when(x.startswith('"'), unquoted(x)).otherwise(x)))
    rows = lines.where((F.trim(F.col(column)) != "") & ~F.col(column).startswith("#")).select(plain.alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("target"), F.filter(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x != "").alias("candidates"))


def from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """(target, candidates) of JSON texts: a task, or a list of tasks and targets. Tasks without a target don't count."""
    whole = F.trim(F.col(column))
    items = F.from_json(F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]"))), "array<string>")
    item = documents.select(F.explode(items).alias("x"))
    task = F.when(F.col("x").startswith("{"), F.from_json("x", _TASK)).otherwise(F.struct(F.col("x").alias("target"), F.array().cast("array<string>").alias("candidates")))
    found = item.select(task.alias("t")).select("t.target", F.coalesce("t.candidates", F.array().cast("array<string>")).alias("candidates"))
    return found.where(F.coalesce(F.col("target"), F.lit("")) != "")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(target, candidates) of a .txt, .csv or .json file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return from_json(spark.read.text(path, wholetext=True))
    if kind not in ("txt", "csv"):
        raise ValueError(f"not a task file: {path}")
    return (from_lines if kind == "txt" else from_csv)(spark.read.text(path))


def name_status(line: Column) -> Column:
    """(change, path) of a line `status<TAB>path`; null where it isn't one. Renames and copies add, and their path is `old<TAB>new`."""
    status, path = F.regexp_extract(line, r"^([AMDRC])[0-9]*\t", 1), F.regexp_extract(line, r"^[^\t]*\t(.*)$", 1)
    kind = F.when(status.isin("A", "R", "C"), "added").when(status == "M", "modified").when(status == "D", "deleted")
    return F.when(kind.isNotNull() & (path != ""), F.struct(kind.alias("change"), path.alias("path")))


def blame(lines: DataFrame) -> DataFrame:
    """(path, number, commit, author, time, line) of porcelain blame lines (path, pos, line): one row for each line of the file.

    A commit, an author and a time hold until the next one of the path; a commit is its first 8 characters, `unknown` before the first.
    """
    after = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("line")
    code = x.startswith("\t")
    known = lambda head: F.when(x.startswith(head), F.substring(x, len(head) + 1, 1 << 30))
    commit = F.when(~code & ~x.startswith("author ") & ~x.startswith("author-time "), F.substring(F.nullif(F.regexp_extract(x, "^[0-9a-f]{40}", 0), F.lit("")), 1, 8))
    held = lambda c, other: F.coalesce(F.last(c, ignorenulls=True).over(after), F.lit(other))
    rows = lines.select("path", "line", held(commit, "unknown").alias("commit"), held(known("author "), "").alias("author"), held(known("author-time "), "").alias("time"), F.sum(code.cast("int")).over(after).alias("number"))
    return rows.where(code).select("path", "number", "commit", "author", "time", F.substring(x, 2, 1 << 30).alias("line"))


def commit_log(line: Column) -> Column:
    """(sha, author, date, message) of a line `sha|author|date|message`, whose message may have bars; null where it isn't one."""
    parts = F.split(line, r"\|", 4)
    return F.when((F.trim(line) != "") & (F.size(parts) == 4), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(["sha", "author", "date", "message"])]))
