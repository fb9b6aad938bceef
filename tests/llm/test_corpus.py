"""Each corpus operator against a brute-force version, a round trip or held-out accuracy, with odd rows among the usual."""

import base64
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, exact_dedup, language, line_dedup, lm, near_dup, packing, toxicity, url_filter, warc
from tessera.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, key string, block string"


def documents(spark, texts, lang=None):
    rows = [(i, t, lang[i] if lang else None, "k", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [prose(rng, n) for n in (120, 60, 300)]
    out = [None, "", "  \n\t ", "one two", "one  two", "ONE two", *base, *base]
    for b in base:
        for share in (1, 3, 8):
            w = b.split()
            for _ in range(share):
                w[rng.randrange(len(w))] = "x" + str(rng.random())
            out.append(" ".join(w))
    return [*out, prose(rng, 6_000), *[prose(rng, rng.randrange(1, 80)) for _ in range(30)]]


def test_exact_dedup(spark, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, texts), partitions=5).collect()}
    for i, t in enumerate(norm):
        group = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (group[0], len(group), i == group[0], hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(documents(spark, texts).limit(0)).count() == 0


def test_exact_dedup_of_a_group_over_many_tasks(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(rows, partitions=13).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 167)} and sum(r.kept for r in got) == 1


def test_near_duplicates(spark, texts):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root(i), root(i) == i), i
    left = near_dup.one_of_each(documents(spark, texts))
    assert left.columns == ["doc_id", "text", "lang", "key", "block"] and left.count() == sum(root(i) == i for i in range(len(sets)))


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, c), (7, c + " z"), (7, c + " z"), (9, c + " q"), (9, ""), (9, None), (8, "one"), (8, "two")]
    docs = spark.createDataFrame([(i, t, "s", "h", 5) for i, t in rows], "doc_id long, text string, same string, hash string, rep int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(docs).collect())
    want = [("1", 56, "1", True)] * 2 + [("2", 57, "1", False), ("3", 57, "1", False), ("None", 56, "None", True)] + [("7", 57, "7", True)] * 2
    want += [("9", 57, "7", False), ("9", 0, "9", True), ("9", 0, "9", True), ("8", 1, "8", True), ("8", 1, "8", True)]
    assert got == sorted(want)
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "7", "7", "8", "8", "None"]


def test_samples_find_pairs_of_large_sets():
    """The estimate for sets of over SAMPLE shingles alone: no planted pair at 75 to 80 % is lost."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = []
        for _ in range(100):
            n = int(rng.integers(300, 3_000))
            share = rng.uniform(0.75, 0.80)
            both = int(np.ceil(2 * n * share / (1 + share)))
            x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            sets += [np.sort(x[:n]), np.sort(x[n - both :])]
        samples = {"n": [len(x) for x in sets], "sample": [near_dup.sample_of(x) for x in sets]}
        cell = pd.DataFrame({"rep": range(200), "component": range(200), "block": 0, "shingle": 0, "rare": [np.zeros(0, dtype=np.int64)] * 200, **samples})
        found = near_dup._similar_in(cell, near_dup.PERCENT)
        assert {(2 * i, 2 * i + 1) for i in range(100)} <= set(zip(found["a"], found["b"], strict=True))


def test_a_pair_within_the_distance_shares_a_bucket():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, near_dup.SYMBOLS).astype("<u2")
    for _ in range(200):
        b = a.copy()
        places = rng.permutation(near_dup.SYMBOLS)[: near_dup.MOST_ERRORS]
        b[places] ^= 1
        x, y = near_dup.chunk_keys(np.stack([a, b]))
        assert set(x) & set(y)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in linked}


def brute_decontamination(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, names = words(text), set(), set()
    for name, item in items:
        t = words(item)
        size = min(10, len(t))
        for j in range(len(t) - size + 1 if t else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == t[j : j + size]:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_decontamination(spark, limit):
    rng = random.Random(3)
    few = [f"v{i}" for i in range(4)]
    items = [(1, prose(rng, 25, few)), (2, prose(rng, 14)), (3, "Solo Word here"), (4, None), (5, "..."), (10, prose(rng, 14))]
    texts = [None, "", items[1][1].upper(), f"{prose(rng, 20)}, {items[5][1]}! {prose(rng, 30)}", "a solo, word-here b", *[prose(rng, 200, few) for _ in range(6)], items[0][1] + " " + items[0][1], prose(rng, 2_000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.scan(documents(spark, texts), benchmark, limit=limit)).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute_decontamination(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest()), i
    left = {r.doc_id: r.text for r in decontaminate.clean(documents(spark, texts), benchmark, limit=limit).collect()}
    assert 2 not in left and left[0] is None and left[12] == texts[12] and brute_decontamination(left[3], items)[1] == 0
    assert decontaminate.report(decontaminate.scan(documents(spark, texts), benchmark.limit(0))).where("contaminated").count() == 0


def test_packing(spark, texts):
    import numpy as np
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*texts, "a\x1cb\u2003c <|endoftext|> e\u0301 'S don't 12 \u03a3\u03a3 \u0130x", "\u0301start"]
    plain = Tokenizer.from_file(path)
    got = {}
    for r in packing.best_fit_packing(documents(spark, texts), path, 64).collect():
        got.setdefault(r.doc_id, {})[r.piece] = r
    places = {}
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 64] for k in range(0, len(ids), 64)]
        assert sorted(got[i]) == list(range(len(cut)))
        for k, own in enumerate(cut):
            r = got[i][k]
            assert (r.start, r.length, r.ids_crc32) == (64 * k, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())), i
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 64
    lengths = [r.length for d in got.values() for r in d.values()]
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit if fit is not None else 64) - n)
    assert len(places) == len(gaps)


def test_warc(spark):
    rng = random.Random(4)
    same = "copy \u00e9 " + prose(rng, 20)
    html = [None, "", same, same, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "WARC/1.1\r\n", "0\r\n\r\n", prose(rng, 30_000), "\u20ac" * 30_000, same, "x"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    payload = [(h or "").encode() for h in html]
    for i, p in enumerate(payload):
        first = payload.index(p)
        r = got[i]
        assert r.problem is None and r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert first != i or bytes(r.payload) == p
    assert len(got) == len(html) and warc.archive_round_trip(pages.limit(0)).count() == 0
    parts = [warc.parse_record(r) for r in warc.page_records(7, None, b"z" * 100_000, None)]
    assert [p["segment"] for p in parts] == [1, 2, 3, 4]
    broken = spark.createDataFrame([tuple(p[c.split()[0]] for c in warc.RECORD.split(", ")) for p in parts if p["segment"] != 2], warc.RECORD)
    assert warc.payloads(warc.reassemble(broken)).first().problem == "segments are missing"
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_warc_with_repeated_page_ids(spark):
    long = "y" * 90_000
    rows = [(1, "a"), (2, "b"), (2, "a"), (0, "c"), (3, "a"), (3, "c"), (4, long), (4, long), (4, long + "z"), (None, "a"), (5, "b"), (5, "b")]
    pages = spark.createDataFrame([(i, "http://h/", x) for i, x in rows], "page_id long, url string, html string").repartition(3)
    least = {x: min(i for i, y in rows if y == x and i is not None) for _, x in rows}
    want = sorted((i, len(x), warc.digest_of(x.encode()), "response" if i == least[x] else "revisit", -1 if i == least[x] else least[x]) for i, x in rows if i is not None)
    got = warc.archive_round_trip(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want
    assert all(r.problem is None for r in got)


def test_decontamination_of_rows_that_share_ids(spark):
    item = " ".join(f"b{i}" for i in range(12))
    rows = [(1, f"x {item} y"), (1, "clean words"), (None, item), (None, "other"), (None, None), (2, f"z {item} {'w ' * 30}"), (2, f"z {item} {'w ' * 30}")]
    docs = spark.createDataFrame([(i, t, "own", "too") for i, t in rows], "doc_id long, text string, spans string, raw string")
    benchmark = spark.createDataFrame([(1, item), (2, "solo"), (3, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    results = []
    for limit in (3, 1_000_000):
        found = decontaminate.report(decontaminate.scan(docs, benchmark, limit=limit)).collect()
        results.append(sorted(map(str, found)))
        assert sorted(r.n_hit for r in found) == [0, 0, 0, 12, 12, 12, 12]
        left = decontaminate.clean(docs, benchmark, limit=limit)
        assert left.columns == docs.columns and {(r.spans, r.raw) for r in left.collect()} == {("own", "too")}
        assert sorted(str(r.text).strip()[:3] for r in left.collect()) == ["Non", "cle", "oth", "z  ", "z  "]
    assert results[0] == results[1]


def test_automaton_stays_under_its_bound():
    import pickle

    rng = random.Random(8)
    for few in (3, 50, 100_000):
        items = [(str(i), [b"w%d" % rng.randrange(few) for _ in range(200)]) for i in range(50)]
        made = decontaminate.SuffixAutomaton(items)
        distinct = {w for _, x in items for w in x}
        assert len(pickle.dumps(made)) < decontaminate.automaton_bytes(10_000, len(distinct), sum(map(len, distinct)))


def test_language_blocks_have_the_same_subwords():
    import numpy as np

    text = "Th\u00e9 quick 123 brown fox ".encode() * 20
    for block in (1, 7, 64, 10_000):
        assert sorted(np.concatenate(list(language._blocks(text, 16, block))).tolist()) == sorted(language.subwords(text, 16).tolist())


def test_line_dedup(spark):
    a, b, c, d = ("first short line", "second short line", "third short line", "fourth one")
    long = " ".join(f"word{i}" for i in range(55))
    texts = [f"{a}\n{b}\n{c}\n{d}", f"x1\n{a}\n\n{b}\n {c}\ny1", f"{a}\nz1\n{b}", f"p\n{long}\nq", f"r\n{long}", None, "", f"{a}\n{b}", "s\n" * 8, long]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    want = [*texts]
    want[1], want[4], want[8], want[9] = "x1\n\ny1", "r", "s\n", ""
    assert got == dict(enumerate(want))
    assert set(dict(enumerate(want))) - {r.doc_id for r in line_dedup.dedup_lines(documents(spark, texts), drop_emptied=True).collect()} == {9}


def test_line_dedup_long_runs(spark):
    """Runs that go on far beyond the lines that travel with a fingerprint, while their other lines have earlier first places."""
    line = [f"line {i}" for i in range(200)]
    mixed = [f"own {i // 9}" if i % 9 == 0 else line[i] for i in range(200)]
    docs = [line[i : i + 40] for i in range(0, 200, 50)]
    docs += [mixed, ["start"] + mixed[:90] + ["middle"] + mixed[110:], mixed[30:180], ["same"] * 60, ["x"] + ["same"] * 75]
    assert gone_lines(spark, docs) == every_repeated_run(docs)


def every_repeated_run(docs: list[list[str]], min_lines: int = 3, min_words: int = 50) -> list[set[int]]:
    """Places of removed lines, by comparing every two places line by line."""
    places = [(d, p) for d, x in enumerate(docs) for p in range(len(x))]
    at = lambda d, p: docs[d][p] if 0 <= p < len(docs[d]) else None
    gone = [set() for _ in docs]
    for d, p in places:
        for e, q in places:
            if (e, q) >= (d, p) or docs[d][p] != docs[e][q] or (p and q and at(d, p - 1) == at(e, q - 1)):
                continue
            k = 0
            while at(d, p + k) is not None and at(d, p + k) == at(e, q + k):
                k += 1
            if k >= min_lines or sum(len(x.split()) for x in docs[d][p : p + k]) >= min_words:
                gone[d] |= set(range(p, p + k))
    return gone


def gone_lines(spark, docs: list[list[str]]) -> list[set[int]]:
    found = line_dedup.removed_by_document(documents(spark, ["\n".join(x) for x in docs])).collect()
    gone = {r.doc_id: set(r.places) for r in found}
    return [gone.get(d, set()) for d in range(len(docs))]


def test_line_dedup_earlier_places_elsewhere(spark):
    """Lines of a repeated run that stand alone in earlier documents, whichever of them has the least hash."""
    run = ["run one", "run two", "run three"]
    docs = [[f"o{i}", x, f"e{i}"] for i, x in enumerate(run)] + [["b", *run, "c"], ["d", *run, "e"]]
    assert every_repeated_run(docs)[4] == {1, 2, 3}
    assert gone_lines(spark, docs) == every_repeated_run(docs)
    rng = random.Random(5)
    docs = [[f"line {rng.randrange(5)}" for _ in range(rng.randrange(9))] or [""] for _ in range(25)]
    assert gone_lines(spark, docs) == [{p for p in x if docs[d][p]} for d, x in enumerate(every_repeated_run(docs))]


def test_line_dedup_wordy_pairs(spark):
    """Repeated passages of two lines and 50 words, with any neighbours; 49 words stay."""
    rng = random.Random(6)
    for first, second in ((4, 47), (43, 49), (25, 25), (24, 25), (1, 49)):
        pair = [prose(rng, first), prose(rng, second)]
        docs = [[*[f"a{i} {rng.random()}" for i in range(2)], *pair, f"b {rng.random()}"] for _ in range(6)]
        assert every_repeated_run(docs)[1:] == [{2, 3} if first + second >= 50 else set()] * 5
        assert gone_lines(spark, docs) == every_repeated_run(docs)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://Blog.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://a.org", "https://x.com/de/a", "https://x.com/fr/a", "http://bad.net/1", "http://bad.net://2", "http://org/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(8, 1), (6, 0)], "page_id long, bad int")
    more = spark.createDataFrame([(100 + i, "http://bad.net/n") for i in range(60)] + [(200 + i, "http://good.net/n") for i in range(60)], "page_id long, url string")
    outcomes = outcomes.unionByName(spark.createDataFrame([(200 + i, 0) for i in range(60)], "page_id long, bad int"))
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.unionByName(more), rules, outcomes).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("blog.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5] == ("a.org", "", None, "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8] == ("bad.net", "/1", None, "block") and got[9][0] == "bad.net:" and got[200][3] == "allow" and got[10][2] == "org/"
    many = rules + [(f"h{i}.example/", "block") for i in range(300)]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.unionByName(more), many, outcomes).collect()} == got


def test_toxicity(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(600):
        t = prose(rng, rng.randrange(5, 120)).split()
        bad = i % 6 == 0
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "scum", "idiot"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    docs, labels = documents(spark, [*texts, None, ""]), spark.createDataFrame([*enumerate(toxic), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == toxic[i] for i in held) >= 0.95 * len(held) and got[600] == got[601] < 0.5 and len(model.index) < 2_000
    assert toxicity.clean(docs, model).columns == docs.columns
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_is_not_fitted_by_the_driver(spark, monkeypatch):
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    docs = documents(spark, ["vile scum " * (i % 2) + f"kind words {i % 7}" for i in range(200)])
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == i % 2 for i in range(200))


def test_language(spark):
    rng = random.Random(6)
    syllables = {"aa": ["the", "ing", "sh", "er"], "bb": ["ung", "sch", "ie", "\u00fc"]}
    lang = [rng.choice(["aa", "bb"]) for _ in range(300)]
    texts = [" ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(30)) for k in lang]
    docs = documents(spark, [*texts, None, "123 ...", "", "theing" * 400_000], [*lang, "aa", "aa", None, None])
    model = language.train(docs, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, k in enumerate(lang)) and [got[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_lm_score(spark):
    import math
    from collections import Counter

    rng = random.Random(7)
    words = ["the", "of", "and", *[f"w{i}" for i in range(80)]]
    texts = [None, "", "\u00c9t\u00e9 \u3042", *[prose(rng, rng.randrange(1, 90), words) for _ in range(80)], "Unseen zebra"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in lm.score(docs, crc_mod("doc_id", 10) == 0).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    counts = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert lm.score(docs.limit(0), crc_mod("doc_id", 10) == 0).count() == 0


def test_running_classes():
    import numpy as np

    rng = random.Random(11)
    for n in (1, 2, 30):
        for _ in range(20):
            votes = [rng.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(n)]
            want = []
            for i in range(n):
                before = [votes[:i].count(k) if k else 0 for k in range(lm.CLASSES + 1)]
                want.append(before.index(max(before)))
            assert lm.running_classes(np.asarray(votes, dtype=np.int8)).tolist() == want


def test_spelling_probabilities_add_up_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    code = lm.spelling(np.zeros(256))
    n = rng.random((2, lm.SLOTS)).astype("f4")
    sample = lm.bits_of([b"ab", b"c"], np.array([0, 1]), code)
    model = lm.learn_mixer(n[0], n[1], sample, code)
    one = [bytes([b]) for b in range(256) if b != lm.END]
    # the first byte of a token: every byte, or the end at once
    first = []
    for w in [*one, b""]:
        own = lm.bits_of([w], np.zeros(1, dtype=np.int64), code)
        k = int(code.length[w[0] if w else lm.END])
        gate = model.met[own.slots[lm.GATE]].astype(np.int64) * 3 + own.place
        _, p = lm._combined(model.logit[own.slots], gate, own.nodes, model.weights, model.refine)
        first.append(np.prod(np.where(own.values == 1, p, 1 - p)[:k]))
    assert sum(first) == pytest.approx(1)


def test_pipeline(spark, tmp_path, texts):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = documents(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[-1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 8 in kept and 11 not in kept and len(texts) - 1 not in kept


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Texts around a common passage fill large buckets; cells of few rows find the links that all pairs of sets have."""
    monkeypatch.setattr(near_dup, "CELL", 8)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"w{i}x{j}" for j in range(rng.randrange(4, 40))]) for i in range(90)]
    texts += [" ".join(texts[i].split()[: rng.randrange(58, 66)] + [f"v{i}"]) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    component = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((component[a], component[b]))
                component = {i: lo if c == hi else c for i, c in component.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1, 2):
        found = near_dup.near_duplicates(docs, star_rounds=rounds).collect()
        assert {r.doc_id: r.component_id for r in found} == component
