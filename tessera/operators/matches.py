"""Statistics, attribution, rules and comparisons over scored matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity

#: Lower bounds of the report's histogram. Fixed values.
BUCKETS = (90, 80, 70, 60, 50, 0)


def statistics(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = F.col("similarity")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return matches.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.round(zero(F.avg(s)), 6).alias("avg_similarity"), F.round(zero(F.max(s)), 6).alias("max_similarity"), F.round(zero(F.min(s)), 6).alias("min_similarity"),
        F.count_if(s >= 90).alias("high"), F.count_if((s >= 80) & (s < 90)).alias("medium"), F.count_if((s >= 70) & (s < 80)).alias("low"),
    )


def distribution(matches: DataFrame) -> DataFrame:
    """(lower, n) of six buckets, empty ones too."""
    upper = dict(zip(BUCKETS, (None, *BUCKETS[:-1]), strict=True))
    counts = [F.count_if((F.col("similarity") >= lo) & (F.lit(True) if hi is None else F.col("similarity") < hi)).alias(str(lo)) for lo, hi in upper.items()]
    stacked = ", ".join(f"{lo}L, `{lo}`" for lo in BUCKETS)
    return matches.agg(*counts).selectExpr(f"stack({len(BUCKETS)}, {stacked}) as (lower, n)")


def histogram(values: DataFrame, column: str, bins: int = 20, top: float = 100.0) -> DataFrame:
    """(bin, n) of values in [0, top]; the last bin is closed, values outside are left out."""
    c = F.col(column)
    inside = values.where((c >= 0) & (c <= top))
    return inside.groupBy(F.least(F.floor(c * bins / top), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def pivot_matrix(matches: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    return matches.groupBy(row).pivot(column, columns).agg(F.round(F.avg("similarity"), 6))


def symmetric_matrix(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, y, similarity): the larger of both directions, 100 on the diagonal."""
    both = matches.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(matches.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    own = nodes.select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit(100.0).alias("similarity"))
    return both.unionByName(own).groupBy("x", "y").agg(F.max("similarity").alias("similarity"))


def unordered_first(rows: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """One row for each unordered pair: the first in order."""
    first = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return rows.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")


def top_pairs(matches: DataFrame, by: list[str], k: int) -> DataFrame:
    return matches.groupBy(*by).agg(F.round(F.avg("similarity"), 6).alias("mean")).orderBy(F.desc("mean"), *by).limit(k)


def attribution(best: DataFrame, sources: DataFrame, total_modules: int | Column) -> DataFrame:
    """Of matches (module, source_module, similarity): each source project's share and confidence; unknown sources together."""
    known = best.join(sources, "source_module", "left").withColumn("project", F.coalesce("project", F.lit("unknown")))
    total = total_modules if isinstance(total_modules, Column) else F.lit(total_modules)
    counted = known.groupBy("project").agg(F.countDistinct("module").alias("n"), F.avg("similarity").alias("mean"))
    ratio = F.col("n") / total
    return counted.select("project", "n", F.round(ratio, 6).alias("ratio"), F.round("mean", 6).alias("mean"), F.round(similarity.confidence(F.col("n"), ratio, F.col("mean")), 6).alias("confidence"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], value: str, significant: float = 5.0) -> DataFrame:
    """Full outer diff: added, removed, changed (by 0.01 or more) or unchanged, and whether the change is significant."""
    a = old.select(*keys, F.col(value).alias("before"))
    b = new.select(*keys, F.col(value).alias("after"))
    delta = F.col("after") - F.col("before")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.abs(delta) >= 0.01, "changed").otherwise("unchanged")
    return a.join(b, keys, "full").withColumn("status", status).withColumn("delta", F.round(delta, 6)).withColumn("significant", F.coalesce(F.abs(delta) >= significant, F.lit(False)))


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, hash)."""
    joined = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full")
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def merge_channels(first: DataFrame, second: DataFrame, keys: list[str], weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Full outer merge of two scored channels (keys, score): weighted where both score, else the one there is."""
    joined = first.select(*keys, F.col("score").alias("s1")).join(second.select(*keys, F.col("score").alias("s2")), keys, "full")
    score = F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), weights[0] * F.col("s1") + weights[1] * F.col("s2")).otherwise(F.coalesce("s1", "s2"))
    channels = F.array_compact(F.array(F.when(F.col("s1").isNotNull(), F.lit("ir")), F.when(F.col("s2").isNotNull(), F.lit("embedding"))))
    return joined.select(*keys, F.round(score, 6).alias("score"), F.array_join(channels, "+").alias("channels"))


def rule_condition(rule: dict) -> Column:
    """A rule as a column: all of its conditions hold."""
    out = F.lit(True)
    tests = {"ge": lambda c, v: c >= v, "gt": lambda c, v: c > v, "le": lambda c, v: c <= v, "lt": lambda c, v: c < v, "eq": lambda c, v: F.abs(c - v) <= 0.01, "ne": lambda c, v: F.abs(c - v) > 0.01}
    for column, (op, value) in rule.get("where", {}).items():
        c = F.col(column)
        if op in tests:
            out = out & tests[op](c, value)
        elif op == "matches":
            out = out & c.rlike(value)
        elif op == "contains":
            out = out & c.rlike(f"(?i){value}")
        elif op == "in":
            out = out & c.isin(value)
        else:
            raise ValueError(f"unknown operator {op}")
    return F.coalesce(out, F.lit(False))


def apply_rules(matches: DataFrame, rules: list[dict], name: str = "name", condition: Callable[[dict], Column] = rule_condition) -> DataFrame:
    """Rows that no exclude rule fits, with the names and tags of the rules that do."""
    fits = F.array_compact(F.array(*[F.when(condition(r), F.struct(F.lit(r[name]).alias("name"), F.lit(r.get("action", "flag")).alias("action"), F.array(*[F.lit(t) for t in r.get("tags", [])]).cast("array<string>").alias("tags"))) for r in rules]))
    marked = matches.withColumn("__fits", fits).where(~F.exists("__fits", lambda f: f["action"] == "exclude"))
    return marked.withColumn("rules", F.transform("__fits", lambda f: f["name"])).withColumn("tags", F.array_sort(F.array_distinct(F.flatten(F.transform("__fits", lambda f: f["tags"]))))).drop("__fits")


def quality_gate(metrics: DataFrame, conditions: DataFrame) -> DataFrame:
    """(gate, metric, value, status) of conditions (gate, metric, op, threshold, severity) on metrics (metric, value); a missing metric is a warning."""
    joined = conditions.join(F.broadcast(metrics), "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("op") == "GT", v > t).when(F.col("op") == "GE", v >= t).when(F.col("op") == "LT", v < t).when(F.col("op") == "LE", v <= t).otherwise(F.abs(v - t) <= 0.001)
    status = F.when(v.isNull(), "WARNING").when(holds, "PASSED").when(F.col("severity") == "warning", "WARNING").otherwise("FAILED")
    return joined.select("gate", "metric", F.round(v, 6).alias("value"), status.alias("status"))


def gate_status(results: DataFrame) -> DataFrame:
    return results.groupBy("gate").agg(F.when(F.bool_or(F.col("status") == "FAILED"), "FAILED").when(F.bool_or(F.col("status") == "WARNING"), "WARNING").otherwise("PASSED").alias("status"))


#: From this similarity on, trees are compared; how far below it they may be; what is left of one that isn't verified. Fixed values.
VERIFY_FROM, VERIFY_TOLERANCE, UNVERIFIED = 80.0, 10.0, 0.85


def deep_verify(pairs: DataFrame, threshold: float = VERIFY_FROM) -> DataFrame:
    """Adds verified, and lowers similarity where it is false, to pairs (similarity, node_similarity, structure_similarity).

    A pair under the threshold is verified as it is; one whose trees couldn't be read (a null) isn't, nor one whose lesser measure
    is more than the tolerance below the threshold. Apply the threshold of matches again afterwards.
    """
    least = F.when(F.col("node_similarity").isNotNull() & F.col("structure_similarity").isNotNull(), F.least("node_similarity", "structure_similarity"))
    verified = (F.col("similarity") < threshold) | F.coalesce(least >= threshold - VERIFY_TOLERANCE, F.lit(False))
    marked = pairs.withColumn("verified", verified)
    return marked.withColumn("similarity", F.when(F.col("verified"), F.col("similarity")).otherwise(F.col("similarity") * UNVERIFIED))


#: Commit messages that speak of a security fix, and code that shows one, whatever the case. Fixed values.
FIX_MESSAGES = [
    r"\bcve[-_]\d{4}[-_]\d+",
    r"\bfix\s+(security|vuln|vulnerability)",
    r"\b(security|vulnerability)\s+fix",
    r"\bpatch\s+(security|vuln)",
    r"\b(address|resolve|close)\s+(cve|vuln|security)",
    r"\b(xss|injection|csrf|ssrf|rce)\b",
    r"\bfix\s+(xss|injection|csrf|ssrf|rce)",
    r"\bbuffer\s+overflow",
    r"\bprivilege\s+escalation",
]
FIX_CODE = {
    "input_sanitization": r"\binput_sanitiz\w+",
    "parameter_check": r"\bparam\w*_check\w*",
    "boundary_check": r"\bbound\w*_check\w*",
    "length_validation": r"\b(length|size|count)\s*[<>=!]+\s*\w+",
    "output_encoding": r"\b(escape|encode|sanitize)\s*\(",
    "access_control": r"\b(auth|permission|access)_check\w*",
    "sql_injection_prevention": r"\b(prepared|parameterized)\s*statement",
    "timing_safe_compare": r"\bcrypt\w*_compare\w*",
    "csrf_protection": r"\b(csrf|token)_verify",
    "rate_limiting": r"\brate\s*limit",
}
#: A pair under this similarity isn't analysed; a share of new fingerprints and a confidence that count. Fixed values.
PATCH_SIMILARITY, NEW_SHARE, SAFE = 60.0, 0.15, 0.6


def speaks_of_fix(message: Column) -> Column:
    return message.rlike("(?i)(" + "|".join(FIX_MESSAGES) + ")")


def fix_patterns(code: Column) -> Column:
    """The names of the patterns that occur in code; none in null."""
    return F.array_compact(F.array(*[F.when(F.coalesce(code.rlike(f"(?i){p}"), F.lit(False)), F.lit(name)) for name, p in FIX_CODE.items()]))


def patch_analysis(pairs: DataFrame) -> DataFrame:
    """Adds new_share, confidence, patch_status and safe to pairs (similarity, n_a, n_b, overlap, n_messages, n_patterns).

    `n_messages` counts the target's messages that speak of a fix, `n_patterns` the fix patterns of its code. Each gives its
    part in thirds, a share of new fingerprints the rest; a pair under PATCH_SIMILARITY is unknown.
    """
    thirds = lambda n: F.least(F.col(n), F.lit(3)) / 3
    fresh = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), (F.col("n_b") - F.col("overlap")) / F.col("n_b")).otherwise(0.0)
    known = F.col("similarity") >= PATCH_SIMILARITY
    out = pairs.withColumn("new_share", F.when(known, fresh).otherwise(0.0))
    score = 0.4 * thirds("n_messages") + 0.3 * thirds("n_patterns") + F.when(F.col("new_share") >= NEW_SHARE, 0.3).otherwise(0.0)
    out = out.withColumn("confidence", F.when(known, score).otherwise(0.0))
    status = F.when(~known, "unknown").when(F.col("confidence") >= 0.7 - 1e-9, "patched").when(F.col("confidence") > 0, "partially_patched").otherwise("unpatched")
    out = out.withColumn("patch_status", status)
    return out.withColumn("safe", F.col("patch_status").isin("patched", "partially_patched") & (F.col("confidence") >= SAFE))


def entity_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(module, name, type, change, new_name, added, removed): how entities (module, name, type, params, body, line) of two versions differ.

    Of entities with one name the one on the last line counts. Same name: modified if the body differs, with the parameters that came
    and went, else moved if the line does. A name that is gone is renamed to the first new name (by line) of its type with its
    body or with over 0.7 of the parameters in common, else removed; new names that none was renamed to are added.
    New entities are aggregated by body and by parameters before they meet the gone ones, so no two lists are paired.
    """

    def last(d: DataFrame, mark: str) -> DataFrame:
        fields = ["line", "type", "body", F.array_sort(F.array_distinct("params")).alias("params")]
        return d.groupBy("module", "name").agg(F.max(F.struct(*fields)).alias(mark))

    both = last(old, "o").join(last(new, "n"), ["module", "name"], "full")
    gone = both.where("n is null").select("module", "name", "o.*")
    fresh = both.where("o is null").select("module", "name", "n.*")
    first = F.min(F.struct("line", "name")).alias("to")
    by_body = gone.join(fresh.groupBy("module", "type", "body").agg(first), ["module", "type", "body"]).select("module", "name", "to")
    lists = fresh.groupBy("module", "type", F.col("params").alias("p2")).agg(first)
    each = lists.select("*", F.explode("p2").alias("param"))
    shared = gone.select("module", "name", "type", "params", F.explode("params").alias("param")).join(each, ["module", "type", "param"])
    shared = shared.groupBy("module", "name", "params", "p2", "to").agg(F.count("*").alias("c")).where("c > 0.7 * (size(params) + size(p2) - c)").select("module", "name", "to")
    bare = gone.where("size(params) = 0").join(lists.where("size(p2) = 0").select("module", "type", "to"), ["module", "type"]).select("module", "name", "to")
    renamed = by_body.unionByName(shared).unionByName(bare).groupBy("module", "name").agg(F.min("to").alias("to"))
    none = F.array().cast("array<string>")
    row = lambda d, change, to=F.lit(None).cast("string"), a=none, r=none: d.select("module", "name", "type", change.alias("change"), to.alias("new_name"), a.alias("added"), r.alias("removed"))
    left = row(gone.join(renamed, ["module", "name"], "left"), F.when(F.col("to").isNull(), "removed").otherwise("renamed"), F.col("to.name"))
    came = row(fresh.join(renamed.select("module", F.col("to.name").alias("name")).distinct(), ["module", "name"], "left_anti"), F.lit("added"))
    stayed = both.where("o is not null and n is not null and (o.body <> n.body or o.line <> n.line)")
    stayed = stayed.select("module", "name", "o.type", (F.col("o.body") != F.col("n.body")).alias("m"), F.col("o.params").alias("p"), F.col("n.params").alias("q"))
    part = lambda x, y: F.when(F.col("m"), F.array_except(x, y)).otherwise(none)
    return left.unionByName(came).unionByName(row(stayed, F.when(F.col("m"), "modified").otherwise("moved"), a=part("q", "p"), r=part("p", "q")))
