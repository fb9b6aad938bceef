import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, library, reports, tasks
from tessera.streaming import events as streams


def test_scan_and_readers(spark, tmp_path):
    (tmp_path / "p/vendor").mkdir(parents=True)
    (tmp_path / "p/sub").mkdir()
    for name, content in {"a.py": b"x = 1\n", "sub/b.java": "é".encode(), "vendor/c.py": b"no", "d.bin": b"no", "bad.py": b"\xff\xfe", "big.py": b"y" * 5000, "empty.py": b"", "test_a.py": b"no"}.items():
        (tmp_path / "p" / name).write_bytes(content)
    (tmp_path / "ignore").write_text("# comment\n\n test_*.py \n!keep.py\n")
    rules = files.ignore_rules(spark, str(tmp_path / "ignore"))
    assert rules == ["test_*.py", "!keep.py"]
    found = files.open_source(spark, str(tmp_path / "p"), excluded_dirs=["vendor"], rules=rules, max_bytes=4000).collect()
    assert {(r.file_path, r.bytes, r.language, r.content) for r in found} == {("a.py", 6, "python", "x = 1\n"), ("sub/b.java", 2, "java", "é")}
    staged = files.open_source(spark, "https://www.host.test/x/y", {"host.test": lambda url: str(tmp_path / "p")}, extensions=["java"])
    assert [r.file_path for r in staged.collect()] == ["sub/b.java"]
    for target in ("/no/such/folder", "https://other.test/x"):
        with pytest.raises(ValueError):
            files.open_source(spark, target)
    big = str(tmp_path / "p/big.py")
    assert [len(r.content) for r in files.read_chunks(spark, big, 2048).orderBy("chunk").collect()] == [2048, 2048, 904]
    assert [len(r.content) for r in files.read_smart(spark, big, 5000).collect()] == [5000]
    assert files.read_smart(spark, big, 10).count() == 1
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "p/a.py")).collect()] == ["x = 1"]


def test_tasks(spark, tmp_path):
    for name, content in {"t.txt": "# c\n a \n\nb\n", "t.csv": 'a,b, c,,"d,""e"\n#x\n\nf\n', "t.json": '["a", {"target": "b", "candidates": ["c"]}, {"candidates": []}]', "one.json": '{"target": "z"}', "t.yml": ""}.items():
        (tmp_path / name).write_text(content)
    load = lambda name: [(r.target, r.candidates) for r in tasks.load_tasks(spark, str(tmp_path / name)).collect()]
    assert load("t.txt") == [("a", []), ("b", [])]
    assert load("t.csv") == [("a", ["b", "c", 'd,"e']), ("f", [])]
    assert load("t.json") == [("a", []), ("b", ["c"])]
    assert load("one.json") == [("z", [])]
    with pytest.raises(ValueError):
        load("t.yml")
    lines = spark.createDataFrame([("A\ta b.py",), ("R090\told\tnew",), ("M\tm",), ("D\td",), ("nothing",), ("X\tx",)], "l string")
    got = [r.c and tuple(r.c) for r in lines.select(tasks.name_status(F.col("l")).alias("c")).collect()]
    assert got == [("added", "a b.py"), ("added", "old\tnew"), ("modified", "m"), ("deleted", "d"), None, None]


def test_library_round_trip(spark, tmp_path):
    projects = spark.createDataFrame([("p", "one"), ("q", "two"), ("r", "none")], "id string, name string")
    modules = spark.createDataFrame([(1, "f", "p"), (2, "g", "p"), (3, "h", "q")], "id long, name string, project_id string")
    prints = spark.createDataFrame([(10, "winnowing", 1), (11, "ast", 1), (12, "winnowing", 3)], "value long, type string, module_id long")
    nested = library.nested(projects, modules, prints)
    nested.write.json(str(tmp_path / "out"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "out"))
    for a, b in zip(library.flattened(back), (projects, modules, prints), strict=True):
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert {r.id for r in library.new_projects(back, projects.where("id = 'p'")).collect()} == {"q", "r"}


def test_library_of_a_large_project(spark, tmp_path):
    projects = spark.createDataFrame([("p", "one"), ("q", "two")], "id string, name string")
    modules = spark.range(3000).select("id", F.when(F.col("id") == 7, "q").otherwise("p").alias("project_id"))
    prints = modules.select((F.col("id") * 3).alias("value"), F.lit("ast").alias("type"), F.col("id").alias("module_id"))
    nested = library.nested(projects, modules, prints)
    assert nested.agg(F.max(F.size("modules"))).first()[0] < 400
    nested.write.json(str(tmp_path / "out"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "out"))
    for a, b in zip(library.flattened(back), (projects, modules, prints), strict=True):
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_reports(spark):
    rows = spark.createDataFrame([("a|1", "<b>", 95.0), ("c", "token = 'x'", 85.0), ("e", "f", 70.0)], "source string, target string, similarity double")
    run = json.loads(reports.sarif(rows, "t"))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note"]
    assert run["results"][1]["relatedLocations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "token = '***REDACTED***'"
    assert "| a\\|1 | <b> | 95.0 |" in reports.markdown(rows, "R")
    assert "&lt;b&gt;" in reports.html_page(rows, "R")
    seen = []
    failed = reports.write_all(rows, {"bad": lambda d: 1 / 0, "good": lambda d: seen.append(d.count())})
    assert seen == [3] and list(failed) == ["bad"]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "running", "2024-01-01 00:00:00"), (2, "a", "completed", "2024-01-01 01:00:00"), (3, "b", "running", "2024-01-02 00:30:00"), (3, "b", "running", "2024-01-02 00:30:00")]
    table = spark.createDataFrame(rows, "id long, task string, status string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for r in range(2):
        table.where(f"id % 2 = {r}").coalesce(1).write.parquet(str(tmp_path / f"in/{r}"))
    stream = lambda: streams.stream_table(spark, str(tmp_path / "in/*"), 1)
    assert [tuple(r) for r in streams.run_to_end(streams.open_tasks(stream(), "task", ["ts"], "status"), "complete").collect()] == [("b", "running")]
    daily = streams.run_to_end(streams.windowed(stream(), "ts", "1 day", [], {"n": F.count("*")}), "complete")
    assert sorted((str(r.window_start)[:10], r.n) for r in daily.collect()) == [("2024-01-01", 2), ("2024-01-02", 2)]
    assert sorted(r.id for r in streams.run_to_end(streams.once(stream(), "ts", "id", "7 days").select("id")).collect()) == [1, 2, 3]
    bus, seen = streams.Bus("status"), []
    bus.subscribe("running", lambda d: 1 / 0)
    bus.subscribe("completed", lambda d: seen.append(d.count()))
    bus.subscribe("*", lambda d: seen.append(d.count()))
    bus.publish(table, 7)
    assert seen == [1, 4] and bus.failures[0][:2] == (7, "running")
