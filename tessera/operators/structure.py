"""Structure of code read line by line: trees of line kinds, three views and their similarity, entities, node vectors.

All but the entities are row-local columns over an array of lines; a null text is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing, similarity

#: Words before a function in languages of this kind, and what starts one after them. Fixed values.
MODIFIERS = ["public ", "private ", "protected ", "static "]
STARTERS = ["fun ", "def "]
MODIFIED, ARROWED, FUNCED = ["java", "kotlin", "scala"], ["javascript", "typescript"], ["go", "rust", "c", "cpp"]


def step(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns by an explode of an array of one, which keeps the optimizer from inlining them into later lambdas."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__s")).select("*", *[F.col(f"__s.{n}").alias(n) for n in columns]).drop("__s")


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _starts(x: Column, *heads: str) -> Column:
    return x.rlike("^(?:" + "|".join(re.escape(h) for h in heads) + ")")


def line_trees(code: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """Add types, depth, n: the tree module > functions > lines of each code.

    A line after the first function's start is a node of a kind, a function's start a node over the lines up to the next one;
    lines before are no nodes, and code without functions is a block in a block. `fn ` starts a function in every language whose
    own rule didn't apply to the line, as the rules say.
    """
    lang = F.coalesce(F.col(language), F.lit(""))
    rows = step(code, __lines=F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), stripped), lambda x: x != ""))

    def bare(x: Column) -> Column:
        for m in MODIFIERS:
            x = F.replace(x, F.lit(m), F.lit(""))
        return x

    def line(x: Column) -> Column:
        modified = lang.isin(MODIFIED) & _starts(x, *MODIFIERS, *STARTERS)
        return F.struct(F.when(modified, bare(x)).otherwise(x).alias("x"), modified.alias("modified"))

    def marked(s: Column) -> Column:
        x = s["x"]
        python = (lang == "python") & _starts(x, "def ")
        arrow = lang.isin(ARROWED) & (x.contains("function ") | x.contains("=>"))
        other = (lang.isin(FUNCED) & x.contains("func ")) | x.contains("fn ")
        start = F.when(s["modified"], _starts(x, *STARTERS)).otherwise(python | arrow | other)
        kind = (
            F.when(_starts(x, "if ", "if("), "conditional").when(_starts(x, "for ", "while ", "for("), "loop").when(_starts(x, "return "), "return")
            .when(x.contains("=") & ~x.startswith("="), "assignment").when(x.contains("(") & x.contains(")"), "call").otherwise("identifier")
        )
        return F.when(start, F.lit("function")).otherwise(kind)

    rows = step(rows, __own=F.transform("__lines", line))
    rows = step(rows, __kinds=F.transform("__own", marked))
    first = F.array_position("__kinds", F.lit("function")).cast("int")
    rows = step(rows, __body=F.when(first > 0, F.slice("__kinds", F.greatest(first, F.lit(1)), F.greatest(F.size("__kinds"), F.lit(1)))).otherwise(F.array().cast("array<string>")))
    some, leaves = F.size("__body") > 0, F.exists("__body", lambda k: k != "function")
    return rows.select(
        *code.columns,
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit("block")), F.col("__body")))).alias("types"),
        F.when(leaves, 3).otherwise(2).cast("long").alias("depth"),
        F.when(some, 1 + F.size("__body")).otherwise(2).cast("long").alias("n"),
    )


def cross_language_counts(trees: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(lang_a, lang_b, pairs, best) of trees (lang, types, depth, n) of two languages with a similarity of the threshold or more.

    Trees of one shape are counted, not paired. Which sets of types can reach the threshold at all is found among the distinct
    (types, depth), of which there are at most 2 * 2**8, and the shapes meet by an equi-join over those.
    Trees with equal hashes have equal types, depth and count, for which the measure is 1 anyway.
    """
    shapes = trees.groupBy("lang", "types", "depth", "n").agg(F.count("*").alias("trees"))
    kinds = shapes.select("types", "depth").distinct()
    side = lambda d, s: d.select([F.col(c).alias(f"{c}_{s}") for c in d.columns])
    most = similarity.ir_similarity(F.col("types_a"), F.col("depth_a"), F.lit(1), F.col("types_b"), F.col("depth_b"), F.lit(1))
    least = threshold - 1e-9
    near = side(kinds, "a").join(F.broadcast(side(kinds, "b")), most >= least)
    score = similarity.ir_similarity(F.col("types_a"), F.col("depth_a"), F.col("n_a"), F.col("types_b"), F.col("depth_b"), F.col("n_b"))
    pairs = side(shapes, "a").join(near, ["types_a", "depth_a"]).join(side(shapes, "b"), ["types_b", "depth_b"]).where("lang_a < lang_b")
    pairs = pairs.withColumn("score", score).where(F.col("score") >= least)
    return pairs.groupBy("lang_a", "lang_b").agg(F.sum(F.col("trees_a") * F.col("trees_b")).alias("pairs"), F.max("score").alias("best"))


#: Weights of the views. Fixed values.
VIEW_WEIGHTS = {"ast": 0.4, "dfg": 0.3, "cfg": 0.3}


def views(code: DataFrame, text: str = "text") -> DataFrame:
    """Add ast, dfg, cfg, each (types, depth, n, hash), and fused_hash.

    ast: kinds of lines and the indentation in fours. dfg: names that are assigned, and those of them that are used; an assigned
    identifier stands in its own line, so it is used whatever the order of lines, and what is no identifier never is. cfg: blocks and jumps.
    """
    rows = step(code, __lines=F.split(stripped(F.coalesce(F.col(text), F.lit(""))), "\n"))
    rows = step(rows, __pairs=F.filter(F.transform("__lines", lambda x: F.struct(x.alias("x"), stripped(x).alias("s"))), lambda p: p["s"] != ""))

    def kind(p: Column) -> Column:
        s = p["s"]
        return (
            F.when(_starts(s, "def ", "function "), "function_def").when(_starts(s, "class "), "class_def").when(_starts(s, "if ", "elif "), "conditional")
            .when(_starts(s, "for ", "while "), "loop").when(_starts(s, "return "), "return").when(_starts(s, "import ", "from "), "import")
            .when(s.contains("="), "assignment").when(s.contains("("), "call").otherwise("statement")
        )

    def flow(p: Column) -> Column:
        s = p["s"]
        made = lambda node, edge: F.struct(F.lit(node).alias("node"), F.lit(edge).alias("edge"))
        return (
            F.when(_starts(s, "if ", "elif ", "else"), made("branch_block", "branch")).when(_starts(s, "for ", "while "), made("loop_block", "loop_back"))
            .when(_starts(s, "return "), made("exit", "return")).when(_starts(s, "break"), made("exit", "break"))
            .when(_starts(s, "continue"), made("loop_entry", "continue")).when(_starts(s, "try:", "except"), made("exception_block", "exception"))
        )

    assigned = lambda p: F.when(p["s"].contains("=") & ~p["s"].startswith("="), F.regexp_extract(F.substring_index(p["s"], "=", 1), r"(\S+)\s*$", 1))
    rows = step(
        rows,
        __kinds=F.transform("__pairs", kind),
        __deep=F.array_max(F.transform("__pairs", lambda p: F.floor((F.length(p["x"]) - F.length(p["s"])) / 4) + 1)),
        __defs=F.filter(F.array_distinct(F.array_compact(F.transform("__pairs", assigned))), lambda d: ~d.isin("", "if", "for", "while", "return")),
        __flow=F.array_compact(F.transform("__pairs", flow)),
    )
    strings = lambda c: F.transform("__flow", lambda f: f[c])
    rows = step(
        rows,
        __uses=F.filter("__defs", lambda d: d.rlike(r"(?U)^[A-Za-z_]\w*$") & ~d.isin("def", "class")),
        __nodes=F.concat(F.array(F.lit("entry")), strings("node")),
        __returns=F.exists("__flow", lambda f: f["edge"] == "return"),
        __loops=F.exists("__flow", lambda f: f["edge"] == "loop_back"),
    )
    ending = lambda x: F.when(F.col("__returns"), F.array().cast("array<string>")).otherwise(F.array(F.lit(x)))
    rows = step(
        rows,
        __ast=F.array_sort(F.array_distinct("__kinds")),
        __cfg=F.array_sort(F.array_distinct(F.concat("__nodes", ending("exit")))),
        __jumps=F.array_distinct(F.concat(strings("edge"), ending("fall_through"))),
    )
    n_defs, n_uses = F.size("__defs"), F.size("__uses")
    view = lambda types, depth, n, raw: F.struct(types.alias("types"), depth.cast("long").alias("depth"), n.cast("long").alias("n"), hashing.structural_hash(raw).alias("hash"))
    rows = step(
        rows,
        ast=view(F.col("__ast"), F.coalesce("__deep", F.lit(0)), F.size("__kinds"), F.array_join("__ast", ":")),
        dfg=view(F.array_compact(F.array(F.when(n_defs > 0, "def_node"), F.when(n_uses > 0, "use_node"))), F.lit(1), n_defs + n_uses, F.concat_ws(":", F.lit("defs"), n_defs, F.lit("uses"), n_uses)),
        cfg=view(F.col("__cfg"), F.when(F.col("__loops"), 2).otherwise(1), F.size("__cfg"), F.array_join(F.array_sort(F.array_union("__cfg", "__jumps")), ":")),
    )
    return rows.select(*code.columns, "ast", "dfg", "cfg", hashing.structural_hash(F.concat_ws(":", "ast.hash", "dfg.hash", "cfg.hash")).alias("fused_hash"))


def fused_similarity(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float] = VIEW_WEIGHTS) -> Column:
    """0 to 1: the weighted sum of the views' similarities; views by name."""
    parts = [w * similarity.view_similarity(a[v]["types"], a[v]["depth"], a[v]["n"], b[v]["types"], b[v]["depth"], b[v]["n"]) for v, w in weights.items()]
    return sum(parts[1:], parts[0])


ENTITIES = "name string, type string, start_line int, end_line int, params array<string>, source string"
#: What starts a function or a class in a line of any language but Python, the first that fits. Fixed values.
FUNCTION_LINES = [
    r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+(\w+)\s*\(([^)]*)\)\s*\{?",
    r"^\s*func\s+(\w+)\s*\(([^)]*)\)",
    r"^\s*fn\s+(\w+)\s*\(([^)]*)\)",
    r"^\s*function\s+(\w+)\s*\(([^)]*)\)",
]
CLASS_LINES = [r"^\s*(?:public\s+)?class\s+(\w+)", r"^\s*struct\s+(\w+)", r"^\s*interface\s+(\w+)", r"^\s*type\s+(\w+)\s+struct"]


def _scanner():
    # made here so that it travels to executors by value
    functions, classes = [re.compile(p) for p in FUNCTION_LINES], [re.compile(p) for p in CLASS_LINES]

    def indented(lines: list[str]) -> Iterator[tuple]:
        """Outermost blocks: one is open at a time, to the last line with text before one that is indented no deeper."""
        head, depth, last = None, 0, 0

        def close() -> tuple:
            x, word = lines[head].strip(), "def" if lines[head].strip().startswith("def ") else "class"
            name = re.search(rf"{word}\s+(\w+)", x)
            given = re.search(r"\(([^)]*)\)", x) if word == "def" else None
            bare = [re.split("[:=]", p, maxsplit=1)[0].strip() for p in given.group(1).split(",")] if given else []
            kind = "function" if word == "def" else "class"
            named = name.group(1) if name else f"{'func' if word == 'def' else 'class'}_{head}"
            return named, kind, head + 1, last + 1, [p for p in bare if p and p != "self"], "\n".join(lines[head : last + 1])

        for i, x in enumerate(lines):
            text = x.strip()
            if not text:
                continue
            indent = len(x) - len(x.lstrip())
            if head is not None and indent <= depth:
                yield close()
                head = None
            if head is None and text.startswith(("def ", "class ")):
                head, depth = i, indent
            last = i
        if head is not None:
            yield close()

    def by_line(lines: list[str]) -> Iterator[tuple]:
        for i, x in enumerate(map(str.strip, lines), 1):
            for kind, patterns in (("function", functions), ("class", classes)) if x else ():
                found = next((m for m in (p.match(x) for p in patterns) if m), None)
                if found:
                    params = [p.strip() for p in found.group(2).split(",") if p.strip()] if kind == "function" else []
                    yield found.group(1), kind, i, i, params, x

    return lambda text, lang: list((indented if lang == "python" else by_line)((text or "").split("\n")))


scan = _scanner()


def code_entities(code: DataFrame, key: str = "id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, name, type, start_line, end_line, params, source) of functions and classes; one row each, none for null or empty code.

    Python's by indented blocks, the outermost only; of other languages by lines. One pass over a text's lines: a block's end is the
    next line indented no deeper, for which SQL needs a join of each head with all later lines.
    """
    names = [c.split()[0] for c in ENTITIES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(k, *e) for k, t, g in zip(frame[key], frame[text], frame[language], strict=True) for e in scan(t, g)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return code.select(key, text, language).mapInPandas(run, f"{key} {dict(code.dtypes)[key]}, {ENTITIES}")


#: The slot of each node type in a vector; types without one share the last. Fixed values.
SLOTS = [
    "function_definition", "class_definition", "decorator", "if_statement", "for_statement", "while_statement", "try_statement", "with_statement",
    "return_statement", "assignment", "augmented_assignment", "call", "binary_operator", "unary_operator", "comparison_operator", "boolean_operator",
    "lambda", "list_comprehension", "set_comprehension", "dict_comprehension", "generator_expression", "subscript", "attribute", "import_statement",
    "import_from_statement", "argument", "parameter", "string", "number", "identifier", "comment",
]
#: Node types of tokens. Fixed values.
TOKEN_TYPES = {
    "if_statement": ["if", "elif", "else"],
    "loop_statement": ["for", "while"],
    "def_definition": ["def"],
    "class_definition": ["class"],
    "try_statement": ["try", "except", "finally"],
    "boolean_operator": ["and", "or", "not"],
    "binary_operator": ["+", "-", "*", "/"],
    "call": ["("],
}
TOKEN_PREFIXES = {"identifier": "ID", "number": "NUM", "string": "STR"}


def token_types(tokens: Column) -> Column:
    def one(t: Column) -> Column:
        out = F.lit("other")
        for name, head in reversed(TOKEN_PREFIXES.items()):
            out = F.when(t.startswith(head), F.lit(name)).otherwise(out)
        for name, words in TOKEN_TYPES.items():
            out = F.when(t.isin(words), F.lit(name)).otherwise(out)
        return out

    return F.transform(tokens, one)


def node_vector(types: Column) -> Column:
    """32 shares of node types; the last is the sum of all types without a slot of their own. No types: zeros."""
    slots = F.array(*[F.lit(s) for s in SLOTS])
    share = lambda f: F.size(F.filter(types, f)) / F.greatest(F.size(types), F.lit(1)).cast("double")
    return F.concat(F.transform(slots, lambda s: share(lambda t: t == s)), F.array(share(lambda t: ~t.isin(SLOTS))))
