"""Reports of matches: rows of the SARIF format, Markdown and HTML, and files of them."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

SARIF_SCHEMA, SARIF_VERSION = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json", "2.1.0"


def level(similarity: Column) -> Column:
    """Severity by what the match suggests: direct reuse, adaption, else a note."""
    return F.when(similarity >= 90, "error").when(similarity >= 80, "warning").otherwise("note")


def sarif_results(matches: DataFrame) -> DataFrame:
    """(level, result) of matches (source, target, similarity): a SARIF result object as JSON for each. Secrets are masked."""
    place = lambda c: F.array(F.struct(F.struct(F.struct(text.redacted(F.col(c).cast("string")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    message = text.redacted(F.format_string("%s and %s are %.1f%% alike", F.col("source").cast("string"), F.col("target").cast("string"), F.col("similarity").cast("double")))
    severity = level(F.col("similarity"))
    result = F.struct(F.lit(RULE).alias("ruleId"), F.lit(0).alias("ruleIndex"), severity.alias("level"), F.struct(message.alias("text")).alias("message"), place("source").alias("locations"), place("target").alias("relatedLocations"))
    return matches.select("source", "target", severity.alias("level"), F.to_json(result).alias("result"))


#: The rule that a result names. Fixed value.
RULE = "MM001"


def sarif(matches: DataFrame, tool: str, limit: int = 5000) -> str:
    """A SARIF document of the `limit` most similar matches; the rows themselves are written by sarif_results().write."""
    rows = sarif_results(matches.orderBy(F.desc("similarity"), "source", "target").limit(limit)).collect()
    driver = {"name": tool, "rules": [{"id": RULE, "name": "SimilarCode"}]}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}, "results": [json.loads(r.result) for r in rows]}]})


def _top(matches: DataFrame, limit: int) -> list[tuple[str, str, str]]:
    chosen = matches.orderBy(F.desc("similarity"), "source", "target").limit(limit)
    shown = [text.redacted(F.col(c).cast("string")).alias(c) for c in ("source", "target")]
    return [(r.source, r.target, f"{r.similarity:.1f}") for r in chosen.select(*shown, "similarity").collect()]


def markdown(matches: DataFrame, title: str, limit: int = 100) -> str:
    """A table of the `limit` most similar matches."""
    rows = [[x.replace("|", "\\|") for x in r] for r in _top(matches, limit)]
    return "\n".join([f"# {title}", "", "| source | target | similarity |", "|---|---|---|", *(f"| {' | '.join(r)} |" for r in rows), ""])


def html_page(matches: DataFrame, title: str, limit: int = 100) -> str:
    """The same table as a page."""
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in r) + "</tr>" for r in _top(matches, limit))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>source</th><th>target</th><th>similarity</th></tr>{rows}</table></body></html>"


def write_all(rows: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Give the rows to each sink; one that fails doesn't keep the others from theirs. Returns the failures by name."""
    failed = {}
    for name, sink in sinks.items():
        try:
            sink(rows)
        except Exception as e:  # a sink is foreign code; its failure is reported
            failed[name] = f"{type(e).__name__}: {e}"
    return failed
