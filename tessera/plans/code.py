"""Queries over code: each order is a module in one of four languages, a line of code for each of its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import edges, fingerprints, graphs, matches, rules, structure
from tessera.plans.queries import _MATCHES, document_matches, modules, query, table
from tessera.sources import tasks

_N = "CAST(l_suppkey % 5 AS STRING)"
#: A line by part number, for Spark and SQL alike.
_LINE = f"""CASE l_partkey % 14
    WHEN 0 THEN CASE l_orderkey % 4 WHEN 0 THEN 'def f' || {_N} || '(self, a, b: int = 2):' WHEN 1 THEN 'public def f' || {_N} || '(int a, int b) {{' WHEN 2 THEN 'function f' || {_N} || '(a, b) {{' ELSE 'func f' || {_N} || '(a int) {{' END
    WHEN 1 THEN CASE l_orderkey % 4 WHEN 0 THEN 'class C' || {_N} || ':' WHEN 1 THEN 'public class C' || {_N} || ' {{' WHEN 2 THEN 'const g = (a) => a + ' || {_N} ELSE 'type C' || {_N} || ' struct {{' END
    WHEN 2 THEN '    if a > ' || {_N} || ':'
    WHEN 3 THEN '        for i in a' || {_N} || ':'
    WHEN 4 THEN '    return a' || {_N}
    WHEN 5 THEN '    a' || {_N} || ' = b + 1'
    WHEN 6 THEN '        call' || {_N} || '(a, "s")'
    WHEN 7 THEN ''
    WHEN 8 THEN 'import m' || {_N}
    WHEN 9 THEN '    else:'
    WHEN 10 THEN '    try:'
    WHEN 11 THEN '        break'
    WHEN 12 THEN '    x.y = "SELECT a FROM t' || {_N} || '"'
    ELSE '    def inner' || {_N} || '(a, c=3):' END"""
_LANG = "CASE l_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'scala' WHEN 2 THEN 'javascript' ELSE 'go' END"
_CODE = f"code AS (SELECT l_orderkey AS id, any_value({_LANG}) AS lang, string_agg({_LINE}, chr(10) ORDER BY l_linenumber, {_LINE}) AS text FROM lineitem GROUP BY l_orderkey)"
_ROWS = f"{_CODE}, raw AS (SELECT id, lang, unnest(string_split(trim(text, ' ' || chr(10)), chr(10))) AS x, generate_subscripts(string_split(trim(text, ' ' || chr(10)), chr(10)), 1) AS pos FROM code), ln AS (SELECT id, lang, pos, x, trim(x) AS s FROM raw WHERE trim(x) <> '')"


def code(spark, sf_dir) -> DataFrame:
    """(id, lang, text)"""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr(_LANG).alias("lang"), F.struct("l_linenumber", F.expr(_LINE).alias("x")).alias("line"))
    grouped = lines.groupBy("id").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("id", "lang", F.array_join(F.transform("lines", lambda x: x["x"]), "\n").alias("text"))


# --- trees of lines


_HEAD = "lang = 'scala' AND regexp_matches(s, '^(public |private |protected |static |fun |def )')"
_IR = f"""{_ROWS}, own AS (SELECT *, {_HEAD} AS modified, CASE WHEN {_HEAD} THEN replace(replace(replace(replace(s, 'public ', ''), 'private ', ''), 'protected ', ''), 'static ', '') ELSE s END AS y FROM ln),
    st AS (SELECT *, CASE WHEN modified THEN regexp_matches(y, '^(fun |def )') ELSE (lang = 'python' AND starts_with(y, 'def ')) OR (lang = 'javascript' AND (contains(y, 'function ') OR contains(y, '=>'))) OR (lang = 'go' AND contains(y, 'func ')) OR contains(y, 'fn ') END AS is_start FROM own),
    fn AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY id ORDER BY pos) AS f FROM st),
    kinds AS (SELECT id, CASE WHEN is_start THEN 'function' WHEN regexp_matches(y, '^(if |if\\()') THEN 'conditional' WHEN regexp_matches(y, '^(for |while |for\\()') THEN 'loop' WHEN starts_with(y, 'return ') THEN 'return'
        WHEN contains(y, '=') AND NOT starts_with(y, '=') THEN 'assignment' WHEN contains(y, '(') AND contains(y, ')') THEN 'call' ELSE 'identifier' END AS kind FROM fn WHERE f > 0),
    ir AS (SELECT code.id, any_value(lang) AS lang, list_sort(list_distinct(list_concat(['block'], list(kind)))) AS types, CASE WHEN bool_or(kind <> 'function') THEN 3 ELSE 2 END AS depth, CASE WHEN count(kind) = 0 THEN 2 ELSE 1 + count(kind) END AS n FROM code LEFT JOIN kinds USING (id) GROUP BY code.id)"""


@query(f"WITH {_IR} SELECT lang, array_to_string(list_filter(types, lambda t: t IS NOT NULL), '+') AS types, depth::BIGINT AS depth, count(*) AS trees, sum(n)::BIGINT AS nodes FROM ir GROUP BY ALL")
def ir_lines(spark, sf_dir):
    trees = structure.line_trees(code(spark, sf_dir))
    return trees.groupBy("lang", F.array_join("types", "+").alias("types"), "depth").agg(F.count("*").alias("trees"), F.sum("n").alias("nodes"))


@query(f"""WITH {_IR}, xl AS (SELECT a.lang AS lang_a, b.lang AS lang_b, a.trees * b.trees AS pairs, 0.5 * len(list_intersect(a.types, b.types)) / len(list_distinct(list_concat(a.types, b.types))) + 0.25 / (1 + 0.2 * abs(a.depth - b.depth)) + 0.25 * (1 - 0.3 * abs(a.n - b.n) / greatest(a.n, b.n, 1)) AS score
    FROM (SELECT lang, types, depth, n, count(*) AS trees FROM ir GROUP BY ALL) a JOIN (SELECT lang, types, depth, n, count(*) AS trees FROM ir GROUP BY ALL) b ON a.lang < b.lang)
    SELECT lang_a, lang_b, sum(pairs)::BIGINT AS pairs, round(max(score), 6)::DOUBLE AS best FROM xl WHERE score >= 0.9 - 1e-9 GROUP BY 1, 2""")
def cross_language_pairs(spark, sf_dir):
    found = structure.cross_language_counts(structure.line_trees(code(spark, sf_dir)), 0.9)
    return found.withColumn("best", F.round("best", 6))


# --- views


_VIEWS = f"""{_ROWS}, a0 AS (SELECT id, CASE WHEN regexp_matches(s, '^(def |function )') THEN 'function_def' WHEN starts_with(s, 'class ') THEN 'class_def' WHEN regexp_matches(s, '^(if |elif )') THEN 'conditional' WHEN regexp_matches(s, '^(for |while )') THEN 'loop'
        WHEN starts_with(s, 'return ') THEN 'return' WHEN regexp_matches(s, '^(import |from )') THEN 'import' WHEN contains(s, '=') THEN 'assignment' WHEN contains(s, '(') THEN 'call' ELSE 'statement' END AS k, (len(x) - len(s)) // 4 + 1 AS d FROM ln),
    av AS (SELECT id, list_sort(list(DISTINCT k)) AS t, max(d) AS d, count(*) AS n FROM a0 GROUP BY id),
    defs AS (SELECT id, pos, list_last(regexp_split_to_array(trim(string_split(s, '=')[1]), '\\s+')) AS v FROM ln WHERE contains(s, '=') AND NOT starts_with(s, '=')),
    known AS (SELECT id, v, min(pos) AS pos FROM defs WHERE v NOT IN ('', 'if', 'for', 'while', 'return') GROUP BY ALL),
    words AS (SELECT id, pos, unnest(regexp_extract_all(s, '\\b[a-zA-Z_]\\w*\\b')) AS v FROM ln),
    used AS (SELECT DISTINCT w.id, w.v FROM words w JOIN known k ON k.id = w.id AND k.v = w.v AND k.pos <= w.pos WHERE w.v NOT IN ('if', 'for', 'while', 'return', 'def', 'class')),
    c0 AS (SELECT id, CASE WHEN regexp_matches(s, '^(if |elif |else)') THEN ['branch_block', 'branch'] WHEN regexp_matches(s, '^(for |while )') THEN ['loop_block', 'loop_back'] WHEN starts_with(s, 'return ') THEN ['exit', 'return']
        WHEN starts_with(s, 'break') THEN ['exit', 'break'] WHEN starts_with(s, 'continue') THEN ['loop_entry', 'continue'] WHEN regexp_matches(s, '^(try:|except)') THEN ['exception_block', 'exception'] END AS e FROM ln),
    c1 AS (SELECT id, e[1] AS node, e[2] AS edge FROM c0 WHERE e IS NOT NULL UNION ALL SELECT id, 'entry', NULL FROM code UNION ALL SELECT id, 'exit', 'fall_through' FROM code WHERE id NOT IN (SELECT id FROM c0 WHERE e[2] = 'return')),
    cv AS (SELECT id, list_sort(list(DISTINCT node)) AS t, list_sort(list_distinct(list_concat(list(node), list(edge) FILTER (edge IS NOT NULL)))) AS every, CASE WHEN coalesce(bool_or(edge = 'loop_back'), false) THEN 2 ELSE 1 END AS d FROM c1 GROUP BY id),
    vw AS (SELECT code.id, coalesce(av.t, []) AS tt, coalesce(av.d, 0) AS ad, coalesce(av.n, 0) AS an, (SELECT count(*) FROM known WHERE known.id = code.id) AS nd, (SELECT count(*) FROM used WHERE used.id = code.id) AS nu, cv.t AS ct, cv.d AS cd, cv.every AS ce FROM code LEFT JOIN av USING (id) JOIN cv USING (id)),
    views AS (SELECT *, list_filter([CASE WHEN nd > 0 THEN 'def_node' END, CASE WHEN nu > 0 THEN 'use_node' END], lambda z: z IS NOT NULL) AS dt, substr(sha256(substr(sha256(array_to_string(tt, ':')), 1, 16) || ':' || substr(sha256('defs:' || nd || ':uses:' || nu), 1, 16) || ':' || substr(sha256(array_to_string(ce, ':')), 1, 16)), 1, 16) AS fused_hash FROM vw)"""


@query(f"WITH {_VIEWS} SELECT id, array_to_string(tt, '+') AS ast, ad::BIGINT AS ast_depth, an::BIGINT AS ast_nodes, (nd + nu)::BIGINT AS dfg_nodes, array_to_string(ct, '+') AS cfg, cd::BIGINT AS cfg_depth, fused_hash FROM views")
def code_views(spark, sf_dir):
    v = structure.views(code(spark, sf_dir))
    joined = lambda c: F.array_join(f"{c}.types", "+").alias(c)
    return v.select("id", joined("ast"), F.col("ast.depth").alias("ast_depth"), F.col("ast.n").alias("ast_nodes"), F.col("dfg.n").alias("dfg_nodes"), joined("cfg"), F.col("cfg.depth").alias("cfg_depth"), "fused_hash")


def _view_sql(t: str, d: str, n: str) -> str:
    return f"CASE WHEN len(x.{t}) = 0 AND len(y.{t}) = 0 THEN 1 WHEN len(x.{t}) = 0 OR len(y.{t}) = 0 THEN 0 ELSE 0.5 * len(list_intersect(x.{t}, y.{t})) / len(list_distinct(list_concat(x.{t}, y.{t}))) + 0.25 / (1 + 0.2 * abs(x.{d} - y.{d})) + 0.25 * (1 - 0.3 * abs(x.{n} - y.{n}) / greatest(x.{n}, y.{n}, 1)) END"


_VERSIONS = "ver AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
_FUSED = f"{_VIEWS}, {_VERSIONS}, flat AS (SELECT *, len(ct) AS cn, 1 AS dd, nd + nu AS dn FROM views), fused AS (SELECT a, b, 0.4 * {_view_sql('tt', 'ad', 'an')} + 0.3 * {_view_sql('dt', 'dd', 'dn')} + 0.3 * {_view_sql('ct', 'cd', 'cn')} AS similarity, x.fused_hash = y.fused_hash AS same FROM ver JOIN flat x ON x.id = a JOIN flat y ON y.id = b)"


def versions(spark, sf_dir, of: DataFrame) -> DataFrame:
    """(a, b, x, y): rows `of` code beside those of the same customer's order before; a customer's orders are versions of one module."""
    rows = of.select("id", F.struct(*of.columns).alias("y"))
    dated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate").join(rows, "id")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "id")
    return dated.select(F.col("id").alias("b"), "y", F.lag("y").over(before).alias("x")).where("x is not null").select(F.col("x.id").alias("a"), "b", "x", "y")


@query(f"WITH {_FUSED} SELECT a, b, round(similarity, 6)::DOUBLE AS similarity, same FROM fused")
def multiview_similarity(spark, sf_dir):
    """Of each version and the one before."""
    pairs = versions(spark, sf_dir, structure.views(code(spark, sf_dir)))
    side = lambda s: {v: F.col(s)[v] for v in structure.VIEW_WEIGHTS}
    return pairs.select("a", "b", F.round(structure.fused_similarity(side("x"), side("y")), 6).alias("similarity"), (F.col("x.fused_hash") == F.col("y.fused_hash")).alias("same"))


# --- entities


_PY = "regexp_matches(ltrim(x), '^(def|class) ')"
_BLOCKS = f"""{_CODE}, every AS (SELECT id, lang, string_split(text, chr(10)) AS lines, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM code),
    py AS (SELECT id, lines, x, pos, len(x) - len(ltrim(x)) AS ind FROM every WHERE lang = 'python' AND trim(x) <> ''),
    heads AS (SELECT h.*, coalesce((SELECT min(l.pos) FROM py l WHERE l.id = h.id AND l.pos > h.pos AND l.ind <= h.ind), len(h.lines) + 1) AS stop FROM py h WHERE {_PY}),
    outer_heads AS (SELECT h.*, (SELECT max(l.pos) FROM py l WHERE l.id = h.id AND l.pos < h.stop) AS last FROM heads h WHERE NOT EXISTS (SELECT 1 FROM heads o WHERE o.id = h.id AND o.pos < h.pos AND o.stop > h.pos)),
    pye AS (SELECT id, regexp_extract(x, '(def|class)\\s+(\\w+)', 2) AS name, CASE WHEN starts_with(ltrim(x), 'def') THEN 'function' ELSE 'class' END AS type, pos AS start_line, last AS end_line,
        CASE WHEN starts_with(ltrim(x), 'def') THEN list_filter(list_transform(string_split(regexp_extract(x, '\\(([^)]*)\\)', 1), ','), lambda p: trim(regexp_extract(p, '^[^:=]*'))), lambda p: p <> '' AND p <> 'self') ELSE [] END AS params, array_to_string(lines[pos:last], chr(10)) AS source FROM outer_heads),
    gen AS (SELECT id, pos, trim(x) AS s FROM every WHERE lang <> 'python' AND trim(x) <> ''),
    gf AS (SELECT id, pos, s, list_filter([{", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN [regexp_extract(s, '{p}', 1), regexp_extract(s, '{p}', 2)] END" for p in structure.FUNCTION_LINES)}], lambda z: z IS NOT NULL)[1] AS m,
        list_filter([{", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}', 1) END" for p in structure.CLASS_LINES)}], lambda z: z IS NOT NULL)[1] AS c FROM gen),
    ent AS (SELECT * FROM pye UNION ALL SELECT id, m[1], 'function', pos, pos, list_filter(list_transform(string_split(m[2], ','), lambda p: trim(p)), lambda p: p <> ''), s FROM gf WHERE m IS NOT NULL UNION ALL SELECT id, c, 'class', pos, pos, [], s FROM gf WHERE c IS NOT NULL)"""


@query(f"WITH {_BLOCKS} SELECT id, name, type, start_line::INT AS start_line, end_line::INT AS end_line, array_to_string(params, ',') AS params, substr(sha256(source), 1, 16) AS body FROM ent")
def code_entities(spark, sf_dir):
    found = structure.code_entities(code(spark, sf_dir))
    return found.select("id", "name", "type", "start_line", "end_line", F.array_join("params", ",").alias("params"), F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 16).alias("body"))


# --- node vectors


@query()
def ast_vectors(spark, sf_dir):
    """Of the code tokens of each module; the test compares these with a plain count."""
    v = node_vectors(spark, sf_dir)
    return v.select("id", F.array_join(F.transform("v", lambda x: F.format_number(x, 4)), ",").alias("vector"), F.col("n").cast("long").alias("n"))


def node_vectors(spark, sf_dir) -> DataFrame:
    types = structure.step(code(spark, sf_dir), types=structure.token_types(text.code_tokens(F.col("text"))))
    return types.select("id", structure.node_vector(F.col("types")).alias("v"), F.size("types").alias("n"))


@query()
def vector_lsh_candidates(spark, sf_dir):
    """The five nearest of the modules that agree in two bands, for the ids divisible by 20 against all modules."""
    v = node_vectors(spark, sf_dir).select("id", "v")
    return fingerprints.vector_lookup(v.where("id % 20 = 0"), v, 5)


@query()
def deep_verify(spark, sf_dir):
    """Of each version and the one before: fused similarity, lowered where the node types of their tokens differ too much."""
    tokens = structure.step(code(spark, sf_dir), nodes=structure.token_types(text.code_tokens(F.col("text"))))
    pairs = versions(spark, sf_dir, structure.views(tokens).select("id", "nodes", "ast", "dfg", "cfg"))
    side = lambda s: {v: F.col(s)[v] for v in structure.VIEW_WEIGHTS}
    scored = pairs.select("a", "b", (structure.fused_similarity(side("x"), side("y")) * 100).alias("similarity"), F.col("x.nodes").alias("nodes_a"), F.col("y.nodes").alias("nodes_b"))
    measured = edges.structure_ratio(scored).select("a", "b", "similarity", similarity.node_multiset(F.col("nodes_a"), F.col("nodes_b")).alias("node_similarity"), (F.col("ratio") * 100).alias("structure_similarity"))
    six = lambda c: F.round(c, 6).alias(c)
    return matches.deep_verify(measured).select("a", "b", six("similarity"), six("node_similarity"), six("structure_similarity"), "verified")


# --- version control


_BLAME = "h AS (SELECT *, md5(event_id::VARCHAR) AS sha, event_id % 3 = 0 OR lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS head FROM events)"


@query(f"""WITH {_BLAME}, g AS (SELECT *, row_number() OVER w AS number, sum(head::INT) OVER w AS k FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT 'src/' || g.user_id || '.py' AS path, g.number, substr(g.sha, 1, 8) AS commit, first.event_type AS author, floor(epoch(first.ts))::BIGINT::VARCHAR AS time, 'x = ' || g.event_id AS line FROM g JOIN g first ON first.user_id = g.user_id AND first.k = g.k AND first.head""")
def blame_lines(spark, sf_dir):
    """Each user's events as the blame of a file: a commit each, whose author is stated for the first and every third."""
    events = table(spark, sf_dir, "events")
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sha = F.concat(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit("00000000"))
    named = (F.col("event_id") % 3 == 0) | F.lag("event_id").over(along).isNull()
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    each = F.array_compact(F.array(F.concat(sha, F.lit(" 1 1 1")), F.when(named, F.concat(F.lit("author "), "event_type")), F.when(named, F.concat(F.lit("author-time "), seconds)), F.concat(F.lit("\tx = "), F.col("event_id").cast("string"))))
    rows = events.select(F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.row_number().over(along).alias("place"), each.alias("each"))
    lines = rows.select("path", "place", F.posexplode("each").alias("p", "line")).select("path", (F.col("place") * 4 + F.col("p")).alias("pos"), "line")
    return tasks.blame(lines)


@query("SELECT event_id, md5(event_id::VARCHAR) AS sha, event_type AS author, user_id::VARCHAR AS date, 'a|b' || event_id AS message FROM events WHERE event_id % 4 <> 0")
def commit_log(spark, sf_dir):
    """Events as lines of a log; every fourth lacks its message."""
    own = [F.md5(F.col("event_id").cast("string").cast("binary")), F.col("event_type"), F.col("user_id").cast("string")]
    line = F.when(F.col("event_id") % 4 == 0, F.concat_ws("|", *own)).otherwise(F.concat_ws("|", *own, F.concat(F.lit("a|b"), F.col("event_id").cast("string"))))
    return table(spark, sf_dir, "events").select("event_id", tasks.commit_log(line).alias("c")).where("c is not null").select("event_id", "c.*")


# --- rules


_EXTRA_RULES = """
rules:
  - {id: short-clone, name: Clone of few lines, condition: {similarity: "<90", min_lines: 5, metadata: {priority: "1-URGENT"}}, action: warn, tags: [urgent, clone]}
  - {id: python-only, name: Python on both sides, condition: {source_language: python, target_language: python}, tags: [python]}
  - {id: never, name: Switched off, condition: {similarity: ">=0"}, action: exclude, enabled: false}
"""


@query(f"""WITH {_FUSED}, d AS (SELECT a, b, round(similarity * 100, 4)::DOUBLE AS s, CASE WHEN a % 10 = 0 THEN 'tests/' ELSE 'src/' END || a AS f, CASE WHEN b % 10 = 0 THEN 'tests/' ELSE 'src/' END || b AS g, p.text || chr(10) || q.text AS both_text,
        len(string_split(p.text, chr(10))) AS la, len(string_split(q.text, chr(10))) AS lb, p.text = '' AS ea, q.text = '' AS eb, p.lang AS pl, q.lang AS ql, o_orderpriority AS priority FROM fused JOIN code p ON p.id = a JOIN code q ON q.id = b JOIN orders ON o_orderkey = b),
    r AS (SELECT a, b, list_filter([CASE WHEN s >= 95 THEN 'high-similarity-critical' END, CASE WHEN s >= 80 AND regexp_matches(both_text, '(?i)SELECT.*FROM|INSERT.*INTO|DELETE.*FROM|UPDATE.*SET') THEN 'sql-injection-risk' END, CASE WHEN s >= 70 AND pl <> ql THEN 'cross-language-clone' END,
        CASE WHEN s < 90 AND ((NOT ea AND la >= 5) OR (NOT eb AND lb >= 5)) AND priority = '1-URGENT' THEN 'short-clone' END, CASE WHEN pl = 'python' AND ql = 'python' THEN 'python-only' END], lambda z: z IS NOT NULL) AS rules FROM d WHERE NOT (starts_with(f, 'tests/') OR starts_with(g, 'tests/')))
    SELECT a, b, array_to_string(rules, ',') AS rules FROM r""")
def detection_rules(spark, sf_dir):
    """The default rules and three of a rule file, on each version and the one before."""
    pairs = versions(spark, sf_dir, structure.views(code(spark, sf_dir)).select("id", "lang", "text", "ast", "dfg", "cfg"))
    side = lambda s: {v: F.col(s)[v] for v in structure.VIEW_WEIGHTS}
    path = lambda c: F.concat(F.when(F.col(c) % 10 == 0, "tests/").otherwise("src/"), F.col(c).cast("string"))
    urgency = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("b"), F.create_map(F.lit("priority"), "o_orderpriority").alias("metadata"))
    found = pairs.select(
        "a", "b", F.round(structure.fused_similarity(side("x"), side("y")) * 100, 4).alias("similarity"), path("a").alias("source_file"), path("b").alias("target_file"),
        F.col("x.text").alias("source_code"), F.col("y.text").alias("target_code"), F.col("x.lang").alias("source_language"), F.col("y.lang").alias("target_language"),
    ).join(urgency, "b")
    ruled = matches.apply_rules(found, rules.load(rules.DEFAULTS) + rules.load(_EXTRA_RULES), name="id", condition=rules.condition)
    return ruled.select("a", "b", F.array_join("rules", ",").alias("rules"))


# --- lineage of matches, languages of projects


@query(f"""WITH {_MATCHES}, e AS (SELECT b AS node, arg_max(a, a) AS parent, arg_max(similarity, a) AS similarity FROM m GROUP BY b)
    SELECT node, parent, round(similarity, 6)::DOUBLE AS similarity, parent IS NULL AS is_source FROM (SELECT a AS node FROM m UNION SELECT b FROM m) LEFT JOIN e USING (node)""")
def recorded_lineage(spark, sf_dir):
    """Documents that match an earlier one as its clones."""
    found = document_matches(spark, sf_dir).select(F.col("a").alias("source"), F.col("b").alias("target"), "similarity", F.col("a").alias("seq"))
    nodes, links = graphs.recorded(found)
    return nodes.join(links, "node", "left").select("node", "parent", F.round("similarity", 6).alias("similarity"), "is_source")


@query("""WITH l AS (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL), base AS (SELECT lang FROM documents WHERE source = 'src0' AND lang IS NOT NULL)
    SELECT source, EXISTS (SELECT lang FROM base EXCEPT SELECT lang FROM l x WHERE x.source = s.source) OR EXISTS (SELECT lang FROM l x WHERE x.source = s.source EXCEPT SELECT lang FROM base) AS differs FROM (SELECT DISTINCT source FROM documents) s""")
def language_difference(spark, sf_dir):
    """Whether a project's languages are others than those of src0; a project's languages are few."""
    each = modules(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("langs"))
    base = each.where("source = 'src0'").select(F.col("langs").alias("base"))
    none = F.array().cast("array<string>")
    both = each.withColumn("base", F.coalesce(base.scalar(), none))
    return both.select("source", similarity.sets_differ(F.col("langs"), F.col("base")).alias("differs"))
