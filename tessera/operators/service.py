"""Service levels, alerts, histories, budgets over event tables."""

from __future__ import annotations

import operator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sli_statistics(samples: DataFrame, key: str, last: int = 1000) -> DataFrame:
    """Of (key, ts, seq, value, good): the share of good, and of the last 1000 the order statistics by index int(n * p / 100)."""
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    recent = samples.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= last)
    ordered = recent.groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("v"), F.round(F.avg("value"), 6).alias("mean"))
    at = lambda p: F.get("v", F.least(F.floor(F.size("v") * p / 100), F.size("v") - 1).cast("int"))
    whole = samples.groupBy(key).agg(F.count("*").alias("n"), F.round(F.count_if("good") * 100.0 / F.count("*"), 6).alias("sli"))
    return whole.join(ordered, key).select(key, "n", "sli", "mean", at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))


def slo_status(slis: DataFrame, target: float, warning: float) -> DataFrame:
    """Status against a target, and what is left of the error budget in percent."""
    budget = (100.0 - target) - (100.0 - F.col("sli"))
    status = F.when(F.col("sli") < target, "breach").when(F.col("sli") < warning, "warning").otherwise("ok")
    return slis.withColumn("status", status).withColumn("budget_left", F.round(F.greatest(F.lit(0.0), budget * 100 / (100.0 - target)), 6))


def bounded_history(events: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key."""
    place = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("e")).select(key, *[f"e.{c}" for c in columns])


#: When a value breaks its rule.
COMPARISONS = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "eq": operator.eq}


def alert_states(samples: DataFrame, key: str, threshold: float, cooldown_s: float, comparison: str = "gt") -> DataFrame:
    """(key, ts, seq, value, state): FIRING when the comparison with the threshold holds and the cooldown since the last firing is over, else PENDING; OK where it doesn't hold.

    A cooldown depends on the firings before it, so each key is folded in the order of time, in bounded state.
    """

    broken = COMPARISONS[comparison]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        last, out = None, []
        for ts, value in zip(frame["ts"], frame["value"], strict=True):
            if not broken(value, threshold):
                out.append("OK")
            elif last is None or (ts - last).total_seconds() >= cooldown_s:
                last = ts
                out.append("FIRING")
            else:
                out.append("PENDING")
        return frame.assign(state=out)

    return samples.select(key, "ts", "seq", "value").groupBy(key).applyInPandas(fold, f"{key} string, ts timestamp_ntz, seq long, value double, state string")


def token_bucket(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """(key, ts, seq, allowed): a bucket of `burst` tokens that fills at `rate` a second; a request takes one."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        level, last, out = burst, None, []
        for ts in frame["ts"]:
            if last is not None:
                level = min(burst, level + (ts - last).total_seconds() * rate)
            last = ts
            out.append(level >= 1)
            level -= level >= 1
        return frame.assign(allowed=out)

    return requests.select(key, "ts", "seq").groupBy(key).applyInPandas(fold, f"{key} long, ts timestamp_ntz, seq long, allowed boolean")


def flag_on(user, flag: str, percent: int):
    """Percentage targeting: the first 32 bits of an MD5 of flag and user, modulo 100."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{flag}:"), user.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def chained(entries: DataFrame, order: list[str], stated: str = "previous", own: str = "hash", by: str = "chain") -> DataFrame:
    """Verify a hash chain: each entry states the hash of the one before."""
    before = F.lag(own).over(Window.partitionBy(by).orderBy(*order))
    return entries.withColumn("valid", F.coalesce(F.col(stated), F.lit("")) == F.coalesce(before, F.lit("")))
