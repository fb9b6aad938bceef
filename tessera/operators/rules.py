"""Detection rules from YAML, as columns over pairs of modules."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS, SEVERITIES = ["flag", "exclude", "warn", "tag"], ["critical", "high", "medium", "low", "info"]
#: The rules of an engine that is given none. Ids, conditions, actions, severities and tags are fixed values.
DEFAULTS = r"""
rules:
  - id: high-similarity-critical
    name: Nearly equal
    condition: {similarity: ">=95"}
    action: flag
    severity: critical
    tags: [clone, direct-copy]
  - id: exclude-test-files
    name: No test files
    condition: {file_pattern: 'test_|_test\.|tests/|spec_|_spec\.'}
    action: exclude
    severity: info
  - id: sql-injection-risk
    name: Like code with SQL in it
    condition: {similarity: ">=80", contains_pattern: 'SELECT.*FROM|INSERT.*INTO|DELETE.*FROM|UPDATE.*SET'}
    action: flag
    severity: high
    tags: [security, sql-injection]
  - id: cross-language-clone
    name: Clone in another language
    condition: {cross_language: true, similarity: ">=70"}
    action: tag
    severity: medium
    tags: [cross-language, clone]
  - id: large-clone-block
    name: Clone of many lines
    condition: {similarity: ">=80", min_lines: 50}
    action: flag
    severity: high
    tags: [large-clone, refactor]
"""


def load(text: str) -> list[dict]:
    """The rules of a YAML text, the last of one id in its first place. Rules without id or name go; an unknown action is a flag, an unknown severity medium."""
    given = (yaml.safe_load(text) or {}).get("rules") or []
    out = {}
    for r in given:
        if "id" in r and "name" in r:
            known = {"action": r.get("action") if r.get("action") in ACTIONS else "flag", "severity": r.get("severity") if r.get("severity") in SEVERITIES else "medium"}
            out[str(r["id"])] = {"description": "", "condition": {}, "tags": [], "enabled": True} | r | known | {"id": str(r["id"])}
    return list(out.values())


def load_file(path: str) -> list[dict]:
    """The rules of a YAML file; none if there is no such file."""
    try:
        with open(path, encoding="utf-8") as f:
            return load(f.read())
    except FileNotFoundError:
        return []


def switched(rules: list[dict], rule_id: str, on: bool) -> list[dict]:
    return [r | {"enabled": on} if r["id"] == rule_id else r for r in rules]


def _compared(value: Column, stated) -> Column:
    sign, number = re.match(r"(>=|<=|>|<|==|!=)?(.*)", str(stated), re.DOTALL).groups()
    try:
        x = float(number)
    except ValueError:
        if sign:
            raise
        return F.lit(False)
    tests = {">=": value >= x, "<=": value <= x, ">": value > x, "<": value < x, "!=": F.abs(value - x) >= 0.01}
    return tests.get(sign, F.abs(value - x) < 0.01)


def _lines(code: Column) -> Column:
    return F.when(code == "", 0).otherwise(F.size(F.split(code, "\n")))


def condition(rule: dict) -> Column:
    """A rule as a column over similarity, source_file, target_file, source_code, target_code, source_language, target_language and
    metadata (a map), of which the pairs need those that the rule names. All of its conditions hold; a null is an empty text, a rule that is off never holds.
    """
    own = lambda name: F.coalesce(F.col(name), F.lit(""))
    found = lambda name, pattern: own(name).rlike(pattern) & (own(name) != "")
    tests = {
        "similarity": lambda v: _compared(F.coalesce(F.col("similarity"), F.lit(0.0)), v),
        "source_file": lambda v: found("source_file", v) | found("target_file", v),
        "file_pattern": lambda v: found("source_file", v) | found("target_file", v),
        "target_file": lambda v: (own("target_file") == "") | own("target_file").rlike(v),
        "contains_pattern": lambda v: F.concat_ws("\n", own("source_code"), own("target_code")).rlike(f"(?i){v}"),
        "source_language": lambda v: own("source_language") == v,
        "target_language": lambda v: own("target_language") == v,
        "cross_language": lambda v: ((own("source_language") != own("target_language")) & (own("source_language") != "") & (own("target_language") != "")) == bool(v),
        "min_lines": lambda v: (_lines(own("source_code")) >= v) | (_lines(own("target_code")) >= v),
        "metadata": lambda v: _all(F.size("metadata") > 0, *[F.col("metadata")[k].eqNullSafe(F.lit(x)) for k, x in v.items()]),
    }
    holds = _all(F.lit(rule.get("enabled", True)), *[tests[k](v) for k, v in rule["condition"].items() if k in tests])
    return F.coalesce(holds, F.lit(False))


def _all(first: Column, *rest: Column) -> Column:
    for c in rest:
        first = first & c
    return first
