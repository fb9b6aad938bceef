import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hashing, similarity, text
from tessera.operators import edges, fingerprints, graphs, matches, service
from tessera.plans import queries


def stable(x: str) -> int:
    return int.from_bytes(hashlib.sha256(b"\x2a\0\0\0" + x.encode()).digest()[:4], "big")


def brute_fingerprints(tokens, k, w):
    h = [stable(t) for t in tokens]
    roll = lambda xs: __import__("functools").reduce(lambda s, x: (s * 257 + x) % (2**31 - 1), xs, 0)
    if not h:
        return set()
    g = [roll(h[i : i + k]) for i in range(max(1, len(h) - k + 1))]
    return set(g) if len(g) <= w else {min(g[i : i + w]) for i in range(len(g) - w + 1)}


def test_fingerprints_equal_brute_force(spark):
    cases = ["", "a", "a b c d e", "a b c d e f g", "x " * 9, " ".join(f"w{i % 5}" for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    found = fingerprints.fingerprints(rows, text.words(F.col("t")), ["id"], 5, 3).collect()
    for i, c in enumerate(cases):
        assert {r.fp for r in found if r.id == i} == brute_fingerprints(c.split(), 5, 3)


def test_fingerprints_of_long_texts_in_time(spark):
    rows = spark.range(100).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), F.pmod(F.hash(i, "id"), F.lit(50_000)))), " ").alias("t"))
    began = time.monotonic()
    found = fingerprints.fingerprint_positions(rows, text.words(F.col("t")), ["id"])
    assert found.agg(F.count("*"), F.max("pos")).first()[1] > 19_000 and time.monotonic() - began < 15


def test_continuity_of_copies(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [words, words, words[:200], ["a", "b"], ["a", "b"], ["a", "c"], [], []]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t array<string>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (0, 3), (6, 7)], "a long, b long")
    found = {(r.a, r.b): r.continuity for r in fingerprints.token_continuity(rows, pairs).collect()}
    assert found == {(0, 1): 100.0, (0, 2): 196 * 100 / 296, (1, 2): 196 * 100 / 296, (3, 4): 100.0, (3, 5): 0.0, (0, 3): 0.0, (6, 7): 0.0}
    runs = {(r.a, r.b): (r.common, r.longest) for r in fingerprints.continuity(fingerprints.fingerprint_positions(rows, F.col("t"), ["id"]), pairs).collect()}
    assert set(runs) == {(0, 1), (0, 2), (1, 2), (3, 4)} and runs[0, 2] == runs[1, 2] and runs[0, 1] > runs[0, 2] and runs[3, 4] == (1, 0)


def test_modules_are_read_once_for_their_continuity(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{j + (i % 5 == 0)}" for j in range(i % 5 * 7, 60 + i % 3)) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, queries.fingerprint_continuity(spark, str(tmp_path)).collect()))
    read = spark.sparkContext.accumulator(0)

    def words(t):
        read.add(1)
        return t.split()

    monkeypatch.setattr(text, "words", F.udf(words, "array<string>"))
    assert want and sorted(map(tuple, queries.fingerprint_continuity(spark, str(tmp_path)).collect())) == want
    assert read.value == len(texts)


def test_fingerprint_sets_of_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, ""), (4, "a b c d e f g h"), (4, "x y z x y z x y z")], "id long, t string")
    words = text.words(F.col("t"))
    sets = {r.id: r for r in fingerprints.fingerprint_sets(rows, words, "id", 3, 2).collect()}
    long = fingerprints.fingerprint_positions(rows, words, ["id"], 3, 2).collect()
    assert {i: list(zip(r.fps, r.at, strict=True)) for i, r in sets.items()} == {i: sorted((r.fp, r.pos) for r in long if r.id == i) for i in (1, 2, 4)}
    assert sets[1]["class"] == sets[2]["class"] != sets[4]["class"] and sets[1].place == sets[2].place


def test_index_lookup_of_hand_example(spark):
    rows = spark.createDataFrame([("m1", x) for x in (1, 2, 3)] + [("m2", x) for x in (2, 3, 4)], "id string, fp long")
    query = spark.createDataFrame([("q", x) for x in (1, 2, 3)], "id string, fp long")
    assert [(r.b, r.overlap) for r in fingerprints.lookup(query, rows, 5).orderBy("rank").collect()] == [("m1", 3), ("m2", 2)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20), max_size=12), min_size=2, max_size=8), st.sampled_from([30.0, 50.0, 70.0, 100.0]))
def test_similar_pairs_lose_none(spark, sets, threshold):
    rows = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s] or [(0, 0)], "id long, fp long")
    sets = sets if any(sets) else [{0}]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a & b and len(a & b) * 100 >= threshold * len(a | b)}
    assert {(r.a, r.b) for r in fingerprints.similar_pairs(rows, threshold).collect()} == want


def test_code_tokens(spark):
    code = 'def f(x):  # note\n    """doc"""\n    return x + 1.5 ** "s"\n'
    got = spark.createDataFrame([(code,)], "c string").select(text.code_tokens(F.col("c")).alias("t")).first().t
    assert got == ["def", "ID", "(", "ID", ")", ":", "return", "ID", "+", "NUM", "**", "STR"]
    java = spark.createDataFrame([("int a = 1; // x\n/* y */ b();",)], "c string").select(text.code_tokens(F.col("c"), "java").alias("t")).first().t
    assert java == ["int", "ID", "=", "NUM", ";", "ID", "(", ")", ";"]


def scanned(code: str) -> list[str]:
    """Tokens of Python code, one character after the other."""
    out, i = [], 0
    while i < len(code):
        c, two, three = code[i], code[i : i + 2], code[i : i + 3]
        j = i + 1
        if c in " \t\n\v\f\r":
            pass
        elif c == "#":
            while j < len(code) and code[j] != "\n":
                j += 1
        elif three in ('"""', "'''"):
            j = code.index(three, i + 3) + 3
        elif c in "\"'":
            while j < len(code) and code[j] != c:
                j += 2 if code[j] == "\\" else 1
            j += 1
            out.append("STR")
        elif c.isascii() and (c.isalpha() or c == "_"):
            while j < len(code) and code[j].isascii() and (code[j].isalnum() or code[j] == "_"):
                j += 1
            out.append(code[i:j] if code[i:j] in text.KEYWORDS["python"] else "ID")
        elif c in "0123456789":
            while j < len(code) and code[j] in "0123456789.":
                j += 1
            out.append("NUM")
        else:
            j += two in "== != <= >= += -= *= /= // ** -> => << >> && || ++ -- ?? ?.".split()
            out.append(code[i:j])
        i = j
    return out


def test_code_tokens_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    bits = ["x", " in ", "and", " not ", "7.5", "== ", "!=", "**", "<", "=", "# é \"\n", "\"a 'b\\\" # c\"", "'\\''", '\n"""d\n\'"""\n', "\n", "\t", ".", "é", "(", "😀", " for ", "_y1 "]
    codes = ["", "x" * 199 + " and 5", "it's " * 30_001, 'f("a b") # c\ng(1)\n', *["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(n)) + "\n" for n in (5, 60, 400, 3_000) for _ in range(5)]]
    spark.createDataFrame([(i, c, "en", "s") for i, c in enumerate(codes)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.numbers, r.names, r.keywords, r.n) for r in queries.code_tokens(spark, str(tmp_path)).collect()}
    for i, c in enumerate(codes):
        k = scanned(c)
        assert got[i] == (k.count("NUM"), k.count("ID"), sum(t in ("and", "in", "is", "for", "or", "not", "with") for t in k), len(k)), c[:300]


def test_minhash_finds_what_64_bands_promise(spark, tmp_path):
    """Pairs with about a sixth of their fingerprints in common, against exact sets."""
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [word(60) for _ in range(150)]
    rows = [(2 * i + j, " ".join(x + word(110)), "en", "s") for i, x in enumerate(shared) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: brute_fingerprints(t.split(), 15, 5) for i, t, _, _ in rows}
    share = {(2 * i, 2 * i + 1): len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(150)}
    found = {(r.a, r.b): r.estimate for r in queries.lsh_candidates(spark, str(tmp_path)).collect()}
    assert len(found.keys() & share.keys()) >= 0.9 * sum(1 - (1 - s * s) ** 64 for s in share.values())
    assert all((e * 128).is_integer() for e in found.values()) and not all((e * 32).is_integer() for e in found.values())
    assert {len(r.signature.split("-")) for r in queries.minhash_signatures(spark, str(tmp_path)).collect()} == {128}


def test_tuning_counts_pairs_of_many_copies(spark, tmp_path):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, texts[0]).otherwise(texts[1]).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    n = 10_000 * 9_999 // 2 + 20_000 * 19_999 // 2
    assert sorted(map(tuple, queries.minhash_tuning(spark, str(tmp_path)).collect())) == [(t, n, n, 1.0, 1.0) for t in (0.1, 0.3, 0.5, 0.7, 0.9)]


def test_signatures_by_hand(spark):
    rng = random.Random(4)
    sets = [[rng.randrange(2**31 - 1) for _ in range(n)] for n in (1, 2, 40_000, 7)] + [[0, 2**31 - 2]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id int, fps array<int>")
    perms = [*hashing.permutations(6), (2**31 - 2, 2**31 - 2), (1, 0)]
    assert {r.id: r.sig for r in fingerprints.set_signatures(rows, perms).collect()} == {i: [min((a * x + b) % (2**31 - 1) for x in s) for a, b in perms] for i, s in enumerate(sets)}


def test_measures(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        similarity.cosine(F.col("a"), F.col("a")).alias("same"), similarity.cosine(F.col("a"), F.col("z")).alias("zero"), similarity.euclidean(F.col("a"), F.col("b")).alias("d"),
        similarity.jaccard(F.lit(0), F.lit(0), F.lit(0)).alias("empty"), similarity.fused({"winnowing": F.lit(80.0), "ast": F.lit(None).cast("double"), "token": F.lit(50.0)}).alias("f"),
    ).first()
    assert (row.same, row.zero, row.empty) == (1.0, 0.0, 100.0)
    assert row.d == pytest.approx(5**0.5) and row.f == pytest.approx((0.4 * 80 + 0.2 * 50) / 0.6)


def test_rules_gate_and_delta(spark):
    rows = spark.createDataFrame([(95.0, "a/b.py"), (60.0, "vendor/x.js")], "similarity double, path string")
    rules = [{"name": "high", "where": {"similarity": ("ge", 90.0)}, "tags": ["t"]}, {"name": "vendor", "where": {"path": ("matches", "^vendor/")}, "action": "exclude"}]
    assert [(r.path, r.rules, r.tags) for r in matches.apply_rules(rows, rules).collect()] == [("a/b.py", ["high"], ["t"])]
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string"), spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in matches.file_delta(old, new).collect()} == {"a": "deleted", "b": "modified", "c": "unchanged", "d": "added"}


def test_lineage_with_a_cycle(spark):
    links = spark.createDataFrame([("b", "a", 0.9, 1), ("c", "b", 0.5, 2), ("a", "c", 0.1, 3)], "node string, parent string, similarity double, seq long")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    walks = graphs.ancestors(spark, nodes, graphs.parents(links))
    assert {r.node: r.hops for r in graphs.roots(walks).collect()} == {"a": 2, "b": 2, "c": 2}


def test_walks_of_more_rows_than_a_recursive_query_may_have(spark):
    nodes = spark.range(240_000).select(F.col("id").alias("node"))
    chains = nodes.where("node % 12 > 0").select("node", (F.col("node") - 1).alias("parent"), (F.col("node") % 12 / 10.0).alias("similarity"))
    walks = graphs.ancestors(spark, nodes, chains)
    assert walks.groupBy("hops").count().orderBy("hops").collect() == [(h, 20_000 * (12 - h)) for h in range(11)]
    last = {r.hops: r for r in walks.where("node = 23").collect()}
    assert {h: (r.ancestor, r.path, r.strongest) for h, r in last.items()} == {h: (23 - h, list(range(23, 22 - h, -1)), 1.1 if h else 0.0) for h in range(11)}


def test_walks_with_several_parents(spark):
    links = spark.createDataFrame([("d", "b", 0.1), ("d", "c", 0.2), ("b", "a", 0.3), ("c", "a", 0.4), ("a", "d", 0.5)], "node string, parent string, similarity double")
    walks = graphs.ancestors(spark, links.select("node").distinct(), links)
    assert sorted((r.path, r.strongest) for r in walks.where("node = 'd'").collect()) == [(["d"], 0.0), (["d", "b"], 0.1), (["d", "b", "a"], 0.3), (["d", "c"], 0.2), (["d", "c", "a"], 0.4)]


def test_lineage_trace_of_many_turns(spark, tmp_path):
    turns = spark.range(240_000).select(F.floor(F.col("id") / 12).alias("conv_id"), (F.col("id") % 12).cast("int").alias("turn"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.lineage_trace(spark, str(tmp_path)).count() == 20_000 * sum(12 - h for h in range(1, 11))


def test_source_farther_than_a_traced_path(spark, tmp_path):
    # conversation 1 lacks turn 300, so its turns have two sources; null turns have no parent
    turns = spark.range(1_403).where("id <> 300").select(F.when(F.col("id") < 1_000, 1).otherwise(2).alias("conv_id"), F.when(F.col("id") < 1_400, F.col("id") % 1_000).alias("turn"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.node: (r.root, r.hops) for r in queries.find_source(spark, str(tmp_path)).collect()}
    want = {f"1:{t}": ("1:0", t) if t < 300 else ("1:301", t - 301) for t in range(1_000) if t != 300} | {f"2:{t}": ("2:0", t) for t in range(400)}
    assert got == want | {None: (None, 0)}


def test_sources_of_a_tree_and_of_cycles(spark):
    # node n > 1 is a clone of n // 2, and a chain of 40 hangs below node 5; 900 and 901 are each other's clones, 902 to 940 lead to them
    parent = {n: n // 2 for n in range(2, 64)} | {n: n - 1 if n > 100 else 5 for n in range(100, 140)} | {900: 901, 901: 900} | {n: n - 1 for n in range(902, 941)} | {950: 950}
    links = spark.createDataFrame([(n, p, 0.5) for n, p in parent.items()], "node long, parent long, similarity double")
    nodes = spark.createDataFrame([(n,) for n in [1, 7000, *parent]], "node long")
    depth = {1: 0} | {n: n.bit_length() - 1 for n in range(2, 64)} | {n: n - 97 for n in range(100, 140)}
    want = {n: (1, d) for n, d in depth.items()} | {7000: (7000, 0)} | {n: (None, None) for n in parent if n >= 900}
    assert {r.node: (r.root, r.hops) for r in graphs.sources(spark, nodes, links).collect()} == want
    assert graphs.sources(spark, nodes, links.limit(0)).where("root = node and hops = 0").count() == len(want)


def test_edges(spark):
    assert edges.ncd("abc" * 50, "abc" * 50) > 80 and edges.ncd("", "") == 100 and edges.ncd("", "x") == 0
    files = spark.createDataFrame([("m.py", "class A:\n    def f(self):\n        return 1\n"), ("bad.py", "def (")], "path string, content string")
    got = {(r.name, r.module_type, r.start_line, r.end_line) for r in edges.python_modules(files, 0).collect()}
    assert got == {("m.py", "FILE", 1, 4), ("A", "CLASS", 1, 3), ("f", "FUNCTION", 2, 3), ("bad.py", "FILE", 1, 1)}
    pair = spark.createDataFrame([("a\nb", "a\nc")], "text_a string, text_b string")
    assert tuple(edges.line_diff(pair).first()["diff"]) == (1, 1, 1, 0.5)


def test_token_bucket(spark):
    rows = spark.sql("select 1L as k, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, id as seq from range(4)")
    assert [r.allowed for r in service.token_bucket(rows, "k", 0.5, 1.0).orderBy("seq").collect()] == [True, False, True, False]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_redaction_and_behaviour(spark):
    code = "import json\ntry:\n    api_key = 'abc'\n    open('f').read(); xs = sorted( map(f, xs))\nexcept ValueError:\n    raise X\n"
    row = spark.createDataFrame([(code, "x = 1")], "a string, b string").select(text.redacted(F.col("a")).alias("r"), similarity.behaviour(F.col("a")).alias("x"), similarity.behaviour(F.col("b")).alias("y"))
    got = row.withColumn("same", similarity.behaviour_similarity(F.col("x"), F.col("x"))).withColumn("none", similarity.behaviour_similarity(F.col("x"), F.col("y"))).first()
    assert "api_key = '***REDACTED***'" in got.r and "abc" not in got.r
    assert got.x == ["algorithm:sorting", "api_call:file_io", "data_transform:map(", "data_transform:sorted(", "exception_handling:try_catch", "io_operation:file_io"]
    assert got.y == [] and (got.same, got.none) == (1.0, 0.0)


def test_patch_analysis(spark):
    rows = [(90.0, 10, 10, 8, 3, 3), (90.0, 10, 10, 10, 3, 0), (90.0, 10, 10, 10, 0, 0), (50.0, 10, 10, 1, 3, 3), (60.0, 10, 10, 8, 3, 0)]
    pairs = spark.createDataFrame(rows, "similarity double, n_a int, n_b int, overlap int, n_messages int, n_patterns int")
    got = [(round(r.confidence, 6), r.patch_status, r.safe) for r in matches.patch_analysis(pairs).collect()]
    assert got == [(1.0, "patched", True), (0.4, "partially_patched", False), (0.0, "unpatched", False), (0.0, "unknown", False), (0.7, "patched", True)]
    found = spark.createDataFrame([("Fix security hole, CVE-2020-1234",), ("tidy",)], "m string").select(matches.speaks_of_fix(F.col("m")).alias("x")).collect()
    assert [r.x for r in found] == [True, False]


def test_entity_diff(spark):
    schema = "module int, name string, type string, params array<string>, body string, line int"
    old = spark.createDataFrame([(1, "kept", "f", ["a"], "x", 1), (1, "changed", "f", ["a", "b"], "y", 5), (1, "gone", "f", ["z"], "g", 9), (1, "was", "f", ["p", "q"], "w", 12), (1, "shifted", "c", [], "s", 20), (1, "bare", "c", [], "t", 30)], schema)
    new = spark.createDataFrame([(1, "kept", "f", ["a"], "x", 1), (1, "changed", "f", ["b", "c"], "y2", 5), (1, "now", "f", ["p", "q"], "w2", 14), (1, "shifted", "c", [], "s", 25), (1, "plain", "c", [], "u", 31), (1, "extra", "f", ["e"], "v", 40)], schema)
    got = {(r.name, r.change, r.new_name, tuple(r.added), tuple(r.removed)) for r in matches.entity_diff(old, new).collect()}
    assert got == {("changed", "modified", None, ("c",), ("a",)), ("gone", "removed", None, (), ()), ("was", "renamed", "now", (), ()), ("shifted", "moved", None, (), ()), ("bare", "renamed", "plain", (), ()), ("extra", "added", None, (), ())}
    assert matches.entity_diff(old.limit(0), new.limit(0)).count() == 0
