import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import fingerprints, graphs, matches, rules, service, structure, vector_lists, vector_scan
from tessera.plans import queries
from tessera.sources import tasks

PYTHON = "import x\n\nclass A:\n    def f(self, a: int, b=2):\n        return a\n\n\n  \ndef g(a,\n      b):\n    x = 1\n\n    def h():\n        pass\n\nx = 2\n    def odd(self):\n"


def test_entities_of_hand_examples(spark):
    java = "public class B {\n  private static int m(int a, String b) {\n  }\ninterface C\nreturn\n"
    rows = spark.createDataFrame([(1, PYTHON, "python"), (2, java, "java"), (3, None, "python"), (4, "", "go"), (5, "fn r(x) {\ntype S struct {", "rust")], "id long, text string, lang string")
    found = {(r.id, r.name, r.type, r.start_line, r.end_line, tuple(r.params)) for r in structure.code_entities(rows).collect()}
    assert found == {
        (1, "A", "class", 3, 5, ()),
        (1, "g", "function", 9, 14, ()),
        (1, "odd", "function", 17, 17, ()),
        (2, "B", "class", 1, 1, ()),
        (2, "m", "function", 2, 2, ("int a", "String b")),
        (2, "C", "class", 4, 4, ()),
        (5, "r", "function", 1, 1, ("x",)),
        (5, "S", "class", 2, 2, ()),
    }


def test_entities_of_a_long_text(spark):
    text = "\n".join(f"def f{i}(a):\n    return {'a + ' * 20}a\n" for i in range(20000))
    rows = spark.createDataFrame([(1, text, "python"), (2, "word " * 200000 + "(", "java")], "id long, text string, lang string")
    assert structure.code_entities(rows).groupBy("id").count().collect()[0]["count"] == 20000


def test_trees_of_lines(spark):
    code = [
        (1, "python", "x = 1\ndef f(a):\n    if a:\n        for i in a:\n            return i\n    y = 2\n    g(a)\n    else:\ndef h():"),
        (2, "java", "public int a(int b) {\nstatic def f() {\nprivate int c = 2"),
        (3, "javascript", "const f = (a) => a\nwhile (true)"),
        (4, "python", "fn x"),
        (5, "python", ""),
        (6, "go", None),
    ]
    got = {r.id: (r.types, r.depth, r.n) for r in structure.line_trees(spark.createDataFrame(code, "id long, lang string, text string")).collect()}
    assert got[1] == (["assignment", "block", "call", "conditional", "function", "identifier", "loop", "return"], 3, 9)
    assert got[2] == (["assignment", "block", "function"], 3, 3)
    assert got[3] == (["block", "function", "loop"], 3, 3)
    assert got[4] == (["block", "function"], 2, 2)
    assert got[5] == got[6] == (["block"], 2, 2)


def test_cross_language_counts_equal_all_pairs(spark):
    trees = [("a", ["block"], 2, 2), ("a", ["block", "function"], 2, 3), ("b", ["block", "function"], 2, 9), ("b", ["block"], 2, 2), ("c", ["block", "call", "function"], 3, 40), ("b", ["block"], 2, 2)]

    def score(x, y):
        return 0.5 * len({*x[1]} & {*y[1]}) / len({*x[1]} | {*y[1]}) + 0.25 / (1 + 0.2 * abs(x[2] - y[2])) + 0.25 * (1 - 0.3 * abs(x[3] - y[3]) / max(x[3], y[3]))

    for threshold in (0.5, 0.75, 0.95):
        want = Counter((x[0], y[0]) for x in trees for y in trees if x[0] < y[0] and score(x, y) >= threshold - 1e-9)
        rows = structure.cross_language_counts(spark.createDataFrame(trees, "lang string, types array<string>, depth long, n long"), threshold).collect()
        assert {(r.lang_a, r.lang_b): r.pairs for r in rows} == want


def test_views(spark):
    code = [(1, "def f(a):\n    x = a\n    for i in x:\n        y.z = i\n    return x"), (2, ""), (3, None), (4, "== 2\ntry:\n    continue")]
    got = {r.id: r for r in structure.views(spark.createDataFrame(code, "id long, text string")).collect()}
    assert (got[1].ast.types, got[1].ast.depth, got[1].ast.n) == (["assignment", "function_def", "loop", "return"], 3, 5)
    assert (got[1].dfg.types, got[1].dfg.n) == (["def_node", "use_node"], 3)
    assert (got[1].cfg.types, got[1].cfg.depth, got[1].cfg.n) == (["entry", "exit", "loop_block"], 2, 3)
    assert got[2].fused_hash == got[3].fused_hash
    assert (got[2].ast.types, got[2].dfg.types, got[2].cfg.types) == ([], [], ["entry", "exit"])
    assert got[4].cfg.types == ["entry", "exception_block", "exit", "loop_entry"] and got[4].dfg.n == 0


def test_view_similarity_of_empty_views(spark):
    rows = spark.createDataFrame([([], 0, 0, [], 0, 0), (["a"], 1, 1, [], 0, 0), (["a"], 1, 4, ["a"], 3, 2)], "t array<string>, d long, n long, u array<string>, e long, m long")
    got = [r[0] for r in rows.select(similarity.view_similarity(*[F.col(c) for c in "tdnuem"])).collect()]
    assert got[:2] == [1.0, 0.0] and got[2] == pytest.approx(0.5 + 0.25 / 1.4 + 0.25 * (1 - 0.3 * 0.5))


def test_node_vectors(spark):
    tokens = ["if", "for", "ID", "ID", "NUM", "STR", "(", "+", "or", "class", "try", ")"]
    rows = spark.createDataFrame([(1, tokens), (2, [])], "id long, t array<string>").select("id", structure.token_types(F.col("t")).alias("k"))
    got = {r.id: r for r in rows.select("id", "k", structure.node_vector(F.col("k")).alias("v")).collect()}
    kinds = ["if_statement", "loop_statement", "identifier", "identifier", "number", "string", "call", "binary_operator", "boolean_operator", "class_definition", "try_statement", "other"]
    assert got[1].k == kinds
    counts = Counter(kinds)
    want = [counts[s] / 12 for s in structure.SLOTS] + [2 / 12]
    assert got[1].v == pytest.approx(want) and got[2].v == [0.0] * 32


def test_vector_lookup(spark):
    base = [0.5, 0.25, 0.0, 0.25] + [0.0] * 4 + [0.1, 0.2, 0.3, 0.4] + [0.0] * 20
    near = base[:]
    near[16] = 0.01
    other = [0.0] * 28 + [1.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(1, base), (2, near), (3, other), (4, [0.0] * 32)], "id long, v array<double>")
    assert [(r.a, r.b, r.bands) for r in fingerprints.vector_lookup(rows.where("id in (1, 4)"), rows, 5).collect()] == [(1, 2, 2)]


def test_vector_lookup_among_copies_in_time(spark):
    base = [0.5, 0.25, 0.0, 0.25] + [0.0] * 4 + [0.1, 0.2, 0.3, 0.4] + [0.0] * 20
    near = base[:16] + [0.01] + base[17:]
    v = F.when(F.col("id") % 3 == 1, F.array(*map(F.lit, near))).otherwise(F.array(*map(F.lit, base)))
    rows = spark.range(60_000).select("id", v.alias("v"))
    began = time.monotonic()
    found = fingerprints.vector_lookup(rows.where("id % 20 = 0"), rows, 5)
    some = sorted((r["rank"], r.b, r.cosine == 1, r.bands) for r in found.where("a = 60").collect())
    assert some == [(i + 1, b, True, 2) for i, b in enumerate((0, 2, 3, 5, 6))] and found.where("a = 0").agg(F.max("b")).first()[0] == 8
    assert found.count() == 15_000 and time.monotonic() - began < 40


def test_vector_lists_find_nine_of_ten(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, []), (9001, None)], "id long, v array<double>")
    asked = rows.where("id % 20 = 0")
    found = vector_lists.nearest(asked, rows, vector_lists.centroids(rows, 16), 8, 5).collect()
    hits = total = 0
    for i in range(0, 1500, 20):
        s = x @ x[i]
        s[i] = -2
        best = set(np.argsort(-s)[:5])
        got = {r.b for r in found if r.a == i}
        assert len(got) == 5
        hits, total = hits + len(best & got), total + 5
    assert hits / total >= 0.9
    exact = vector_lists.nearest(asked.where("id = 40"), rows, vector_lists.centroids(rows, 16), 16, 5).collect()
    s = x @ x[40]
    s[40] = -2
    assert [r.b for r in sorted(exact, key=lambda r: r.rank)] == list(np.argsort(-s)[:5])
    none = rows.limit(0)
    assert vector_lists.nearest(asked, none, vector_lists.centroids(none, 16), 8, 5).count() == 0


def test_vector_scan_of_ties_and_missing_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    x[100:400] = x[0]
    x[500] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (801, [1.0])], "id long, v array<double>").repartition(3)
    pairs = rows.where("id in (0, 20, 500, 800)").selectExpr("id as a", "v as va").join(rows.selectExpr("id as b", "v as vb"), F.expr("a <> b"))
    rank = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    top = lambda t: {tuple(r) for r in t.withColumn("cosine", F.round("cosine", 6)).withColumn("r", F.row_number().over(rank)).where("r <= 7").select("a", "b", "cosine").collect()}
    scored = pairs.where("size(va) = 8 and size(vb) = 8").withColumn("cosine", similarity.cosine(F.col("va"), F.col("vb")))
    want = {r for r in top(scored) if r[0] != 800} | {(800, b, None) for b in range(7)}
    assert top(vector_scan.best(rows.where("id in (0, 20, 500, 800)"), rows, 7, digits=6)) == want


def test_cosines_of_many_vectors_in_time(spark, tmp_path):
    spark.range(12_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.hash(i, "id").cast("double"))).alias("embedding"), (F.col("id") % 7).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in (queries.cross_label_topk, queries.vector_index):
        began = time.monotonic()
        assert query(spark, str(tmp_path)).count() == 3000 and time.monotonic() - began < 12


def test_rule_files(spark, tmp_path):
    assert [r["id"] for r in rules.load(rules.DEFAULTS)] == ["high-similarity-critical", "exclude-test-files", "sql-injection-risk", "cross-language-clone", "large-clone-block"]
    odd = rules.load("rules: [{id: a}, {id: b, name: B, action: what, severity: ever}, {name: c}]")
    assert [(r["id"], r["action"], r["severity"], r["enabled"]) for r in odd] == [("b", "flag", "medium", True)]
    assert rules.load("") == [] and rules.load("x: 1") == [] and rules.load_file(str(tmp_path / "none")) == []
    (tmp_path / "r.yml").write_text(rules.DEFAULTS)
    assert rules.load_file(str(tmp_path / "r.yml")) == rules.load(rules.DEFAULTS)
    assert [r["enabled"] for r in rules.switched(odd, "b", False)] == [False]

    schema = "similarity double, source_file string, target_file string, source_code string, target_code string, source_language string, target_language string, metadata map<string,string>"
    pairs = spark.createDataFrame([(95.0, "src/a", "b", "select 1 from t", "x", "go", "java", {"k": "v"}), (69.995, "tests/a", None, "", None, "go", "", {}), (None,) * 8], schema)

    def holds(**condition):
        return [r[0] for r in pairs.select(rules.condition({"condition": condition})).collect()]

    assert holds(similarity=">=95") == [True, False, False]
    assert holds(similarity="70") == [False, True, False] and holds(similarity="!=70") == [True, False, True] and holds(similarity="x") == [False] * 3
    assert holds(file_pattern="tests/") == [False, True, False] and holds(target_file="^b$") == [True, True, True]
    assert holds(contains_pattern="SELECT.*FROM") == [True, False, False]
    assert holds(source_language="go", target_language="java") == [True, False, False]
    assert holds(cross_language=True) == [True, False, False] and holds(cross_language=False) == [False, True, True]
    assert holds(min_lines=1) == [True, False, False] and holds(metadata={"k": "v"}) == [True, False, False]
    assert holds(unknown=1) == [True] * 3
    assert pairs.select(rules.condition({"condition": {}, "enabled": False})).first()[0] is False
    kept = matches.apply_rules(pairs, rules.load(rules.DEFAULTS), name="id", condition=rules.condition).collect()
    assert [r.rules for r in kept] == [["high-similarity-critical", "sql-injection-risk", "cross-language-clone"], []]


def test_recorded_lineage_and_descent(spark):
    found = spark.createDataFrame([("a", "b", 90.0, 1), ("a", "c", 80.0, 2), ("b", "c", 85.0, 3), ("c", "c", 100.0, 4), ("c", "d", 70.0, 5)], "source string, target string, similarity double, seq long")
    nodes, links = graphs.recorded(found)
    assert {(r.node, r.is_source) for r in nodes.collect()} == {("a", True), ("b", False), ("c", False), ("d", False)}
    assert {(r.node, r.parent) for r in links.collect()} == {("b", "a"), ("c", "b"), ("d", "c")}
    down = graphs.descendants(graphs.ancestors(spark, nodes, links))
    assert {(r.descendant, r.hops) for r in down.where("node = 'a'").collect()} == {("b", 1), ("c", 2), ("d", 3)}


@pytest.mark.parametrize(("comparison", "want"), [("gt", "OK OK FIRING"), ("ge", "OK FIRING PENDING"), ("lt", "FIRING OK OK"), ("le", "FIRING PENDING OK"), ("eq", "OK FIRING OK")])
def test_alert_comparisons(spark, comparison, want):
    rows = spark.createDataFrame([("k", i, float(i)) for i in (1, 2, 3)], "k string, seq long, value double").select("k", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)").alias("ts"), "seq", "value")
    got = service.alert_states(rows, "k", 2.0, 60.0, comparison).orderBy("seq").collect()
    assert " ".join(r.state for r in got) == want


def test_sets_differ(spark):
    rows = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "b"], ["b", "a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(similarity.sets_differ(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_node_measures(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in rows.select(similarity.node_multiset(F.col("a"), F.col("b")), similarity.node_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (pytest.approx(100 * 2 / 5), pytest.approx(100 * 2 / 3)) and got[1] == (0.0, 0.0) and got[2] == (100.0, 0.0)


def test_deep_verification(spark):
    rows = spark.createDataFrame([(79.0, 0.0, 0.0), (80.0, 70.0, 71.0), (100.0, 69.9, 100.0), (90.0, None, 90.0)], "similarity double, node_similarity double, structure_similarity double")
    got = [(r.verified, round(r.similarity, 6)) for r in matches.deep_verify(rows).collect()]
    assert got == [(True, 79.0), (True, 80.0), (False, 85.0), (False, 76.5)]


def test_blame_and_log(spark):
    text = ["\tearly", "0" * 40 + " 1 1 1", "author A", "author-time 5", "summary x", "\tone", "f" * 40 + " 2 2", "\ttwo\t", "abc", "author B", "\t"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(text)] + [("q", 0, "\tx"), ("r", 0, None)], "path string, pos int, line string")
    got = [tuple(r) for r in tasks.blame(lines).orderBy("path", "number").collect()]
    assert got == [("p", 1, "unknown", "", "", "early"), ("p", 2, "00000000", "A", "5", "one"), ("p", 3, "ffffffff", "A", "5", "two\t"), ("p", 4, "ffffffff", "B", "5", ""), ("q", 1, "unknown", "", "", "x")]
    log = spark.createDataFrame([("s|a|d|m|n",), ("s|a|d",), ("",), (None,), ("s|a|d|",)], "x string").select(tasks.commit_log(F.col("x")).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in log] == [("s", "a", "d", "m|n"), None, None, None, ("s", "a", "d", "")]
