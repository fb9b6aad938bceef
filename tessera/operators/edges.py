"""Operators that SQL has no function for: compression distance, sequence ratios, line diffs, parsing, adaptive weights."""

from __future__ import annotations

import ast
import difflib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import FUSION as VIEWS



def _ncd():
    # made here so that it travels to executors by value
    def ncd(a: str, b: str) -> float:
        """100 for texts that compress together as well as the lesser alone; empty texts are alike, an empty and another are not."""
        x, y = (a or "").encode(), (b or "").encode()
        if not x or not y:
            return 100.0 if not x and not y else 0.0
        cx, cy, cxy = (len(zlib.compress(t, 6)) for t in (x, y, x + y))
        return max(0.0, 1 - max(0.0, (cxy - min(cx, cy)) / max(cx, cy))) * 100

    return ncd


ncd = _ncd()


def ncd_similarity(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    return pairs.withColumn("similarity", _series_udf(ncd)(F.col(a), F.col(b)))


def _series_udf(f):
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")


def line_diff(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Add lines added, removed and unchanged, and the ratio of a sequence matcher over lines."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            left, right = (p or "").split("\n"), (q or "").split("\n")
            m = difflib.SequenceMatcher(None, left, right, autojunk=False)
            same = sum(t.size for t in m.get_matching_blocks())
            rows.append((len(right) - same, len(left) - same, same, round(m.ratio(), 6)))
        return pd.DataFrame(rows, columns=["added", "removed", "unchanged", "ratio"])

    return pairs.withColumn("diff", F.pandas_udf(run, "added long, removed long, unchanged long, ratio double")(F.col(a), F.col(b)))


def unified_diff(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((p or "").split("\n"), (q or "").split("\n"), "a", "b", lineterm="")) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("unified", F.pandas_udf(run, "string")(F.col(a), F.col(b)))


def structure_ratio(pairs: DataFrame, a: str = "nodes_a", b: str = "nodes_b") -> DataFrame:
    """Sequence matcher's ratio of two arrays of `type:children`."""
    return pairs.withColumn("ratio", _series_udf(lambda p, q: round(difflib.SequenceMatcher(None, list(p), list(q), autojunk=False).ratio(), 6))(F.col(a), F.col(b)))


MODULES = "path string, name string, module_type string, start_line int, end_line int, source_code string, token_count int, node_types array<string>"


def python_modules(files: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Modules of Python files (path, content): the file, its classes and functions, with node types in pre-order.

    A file that can't be parsed is one module without nodes. Modules with fewer tokens than `min_tokens` are left out.
    """

    def walk(node: ast.AST) -> Iterator[str]:
        yield type(node).__name__
        for child in ast.iter_child_nodes(node):
            yield from walk(child)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                content = content or ""
                lines = content.split("\n")
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError):
                    tree = None
                rows.append((path, path, "FILE", 1, len(lines), content, len(content.split()), list(walk(tree)) if tree else []))
                for node in ast.walk(tree) if tree else ():
                    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                        kind = "CLASS" if isinstance(node, ast.ClassDef) else "FUNCTION"
                        rows.append((path, node.name, kind, node.lineno, node.end_lineno, code, len(code.split()), list(walk(node))))
            yield pd.DataFrame([r for r in rows if r[6] >= min_tokens], columns=[c.split()[0] for c in MODULES.split(", ")])

    return files.select("path", "content").mapInPandas(parse, MODULES)


def adaptive_weights(scores: DataFrame, key: str, order: str, threshold: float = 70.0, rate: float = 0.3, least: int = 5) -> DataFrame:
    """Fold scored pairs, in order, into weights of the views: a view that tells high from low pairs better gains weight.

    Each key (a project pair, a run) is one ordered fold with state of fixed size.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        weights = dict(VIEWS)
        high = {v: [0.0, 0] for v in VIEWS}
        low = {v: [0.0, 0] for v in VIEWS}
        for row in frame.itertuples():
            side = high if row.final >= threshold else low
            for v in VIEWS:
                value = getattr(row, v)
                if value == value and value is not None:
                    side[v][0] += value
                    side[v][1] += 1
            target = {}
            for v in VIEWS:
                n = high[v][1] + low[v][1]
                means = [s[v][0] / s[v][1] if s[v][1] else 0.0 for s in (high, low)]
                target[v] = max(0.0, means[0] - means[1]) if n >= least else weights[v] * 10
            total = sum(target.values())
            if total > 0:
                weights = {v: w + rate * (target[v] / total - w) for v, w in weights.items()}
                weights = {v: w / sum(weights.values()) for v, w in weights.items()}
        return pd.DataFrame({key: [frame[key].iloc[0]], **{v: [round(w, 6)] for v, w in weights.items()}})

    return scores.groupBy(key).applyInPandas(fold, f"{key} string, " + ", ".join(f"{v} double" for v in VIEWS))
