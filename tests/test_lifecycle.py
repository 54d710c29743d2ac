"""Extraction, indexing, rescans, deletion, edits and streams on a small source tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.functions.extract import entities
from weftline.operators import graph
from weftline.plans import lifecycle
from weftline.sources.config import load
from weftline.sources.scan import file_info, scan
from weftline.streaming.rescan import progress, run_levels, run_queue

BEFORE = 'import helper\n\nclass Model:\n    """Doc."""\n    def compute_loss(self, x):\n        return helper.square(x)\n'
AFTER = BEFORE.replace("compute_loss", "calculate_gradient")


def tree(folder):
    (folder / "pkg").mkdir()
    (folder / "node_modules").mkdir()
    (folder / "model.py").write_text(BEFORE)
    (folder / "helper.py").write_text("def square(x):\n    return x * x\n")
    (folder / "pkg" / "main.js").write_text("import x from './y'\nfunction go(a) {\n  run(a);\n}\nclass Car {\n  drive() { go(1); }\n}\n")
    (folder / "node_modules" / "z.js").write_text("function no() {}\n")
    (folder / "broken.py").write_text("def (:\n")


def names(df, kind):
    return {r["qualified_name"] for r in df.where(F.col("symbol_type") == kind).collect()}


def test_entities():
    found = entities(BEFORE, "python")
    got = {(r["kind"], r["qualified_name"]) for r in found}
    assert {("class", "Model"), ("function", "Model.compute_loss"), ("import", "helper"), ("call", "square")} <= got
    assert next(r for r in found if r["kind"] == "class")["docstring"] == "Doc."
    js = {(r["kind"], r["name"]) for r in entities("const f = (a) => g(a);\nimport q from 'm';\n", "javascript")}
    assert {("function", "f"), ("call", "g"), ("import", "m")} <= js
    for lang, text, want in [
        ("rust", "use a::b;\npub fn f() {\n g();\n}\nstruct S;\n", {("function", "f"), ("class", "S"), ("import", "a::b"), ("call", "g")}),
        ("go", "func (s *S) F() {\n g()\n}\ntype S struct {\n}\n", {("function", "F"), ("class", "S"), ("call", "g")}),
        ("java", "import a.b;\npublic class C {\n public int f(int x) {\n  return g(x);\n }\n}\n", {("class", "C"), ("function", "f"), ("import", "a.b")}),
        ("c", '#include "x.h"\nint f(int a) {\n return g(a);\n}\n', {("function", "f"), ("import", "x.h"), ("call", "g")}),
    ]:
        assert want <= {(r["kind"], r["name"]) for r in entities(text, lang)}, lang
    assert entities("def (:", "python")[0]["kind"] == "error" and entities("x", "cobol") == []


def test_index_rescan_delete(spark, tmp_path):
    tree(tmp_path)
    g = lifecycle.index(spark, str(tmp_path))
    assert {r["path"] for r in g.files.collect()} == {"model.py", "helper.py", "pkg/main.js", "broken.py"}
    assert {"Model.compute_loss", "square"} <= names(g.symbols, "function")
    edges = g.edges.groupBy("edge_type").count().collect()
    count = {r["edge_type"]: r["count"] for r in edges}
    assert count["IMPORTS"] == 1 and count["CALLS"] >= 2 and g.equations.count() == 1
    square = g.symbols.where("name = 'square'").first()["id"]
    hit = graph.impact(g.edges, lifecycle.nodes_of(g), "symbol", square).collect()
    assert [(r["name"], r["depth"]) for r in hit] == [("Model.compute_loss", 1)]
    assert "square" in lifecycle.report(g)

    (tmp_path / "model.py").write_text(AFTER)
    g2, changes = lifecycle.rescan(g, scan(spark, str(tmp_path)))
    assert {r["path"]: r["change"] for r in changes.collect()}["model.py"] == "changed"
    assert "Model.calculate_gradient" in names(g2.symbols, "function") and "Model.compute_loss" not in names(g2.symbols, "function")
    assert g2.records.where("status = 'stale'").count() > 0
    square_calls = g2.edges.where((F.col("target_id") == square) & (F.col("edge_type") == "CALLS"))
    assert square_calls.count() == 1

    g3 = lifecycle.deleted(g2, ["helper.py"])
    assert g3.symbols.where("name = 'square'").count() == 0 and g3.edges.where(F.col("target_id") == square).count() == 0
    after, _ = lifecycle.rescan(g2, lifecycle.edited(g2, "helper.py", [{"type": "replace", "start_line": 1, "end_line": 1, "new_content": "def cube(x):"}]))
    assert "cube" in names(after.symbols, "function")


OK = {
    "file": '{"summary": "s", "confidence": 0.5}',
    "symbol": '{"responsibility": "r", "confidence": 1}',
    "equation": '{"mathematical_meaning": "m", "algorithmic_role": "a", "confidence": 0.5, "evidence": "e"}',
}


def test_queue(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.py"), (2, "x/_archive/b.py"), (3, "c.py"), (4, "d.py")], "id long, path string")
    symbols = spark.createDataFrame([(10, 1), (11, 2)], "id long, file_id long")
    equations = spark.createDataFrame([(20, 1), (21, 3)], "id long, file_id long")
    rows = [("file", 1, "pending"), ("file", 2, "pending"), ("file", 3, "completed"), ("file", 4, "pending"), ("file", 9, "pending"), ("symbol", 10, "pending"), ("symbol", 11, "pending"), ("equation", 20, "pending"), ("equation", 21, "pending"), ("equation", 22, "pending")]
    tasks = spark.createDataFrame(rows, "target_type string, target_id long, status string")
    log = str(tmp_path / "log")

    def analyze(frames):
        for f in frames:
            for r in f.itertuples():
                with open(log, "a") as out:
                    out.write(f"{r.target_type} {r.target_id}\n")
            said = [None if i == 4 else "{" if i == 21 else OK[k] for k, i in zip(f["target_type"], f["target_id"], strict=True)]
            yield f.assign(output_json=said, error=["call failed" if i == 4 else None for i in f["target_id"]])[["target_type", "target_id", "output_json", "error"]]

    done = run_queue(tasks, files, symbols, equations, analyze)
    got = {(r["target_type"], r["target_id"]): (r["status"], r["error"]) for r in done.collect()}
    skipped = ("failed", "skipped: the file is archived")
    assert got == {
        ("file", 1): ("completed", None), ("file", 2): skipped, ("file", 3): ("completed", None), ("file", 4): ("failed", "call failed"), ("file", 9): ("failed", "file record missing"),
        ("symbol", 10): ("completed", None), ("symbol", 11): skipped, ("equation", 20): ("completed", None), ("equation", 21): ("failed", "invalid JSON"), ("equation", 22): ("failed", "equation record missing"),
    }
    with open(log) as f:
        calls = [line.split()[0] for line in f]
    assert calls == ["file"] * 2 + ["symbol"] + ["equation"] * 2  # layer after layer, each task once
    assert tuple(progress(done).first()) == (4, 4, 2, 0)


def test_levels_in_order(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    placed = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("gone", 0)], "node string, level int")
    log = str(tmp_path / "log")

    def analyze(frames):
        for f in frames:
            for r in f.itertuples():
                with open(log, "a") as out:
                    out.write(r.path)
            yield f.assign(size=len(f), error=None)[["path", "size", "error"]]

    got = {r["path"]: r["error"] for r in run_levels(placed, files, analyze, "path string, size int, error string").collect()}
    assert got == {"a": None, "b": None, "c": None, "gone": "File not found"}
    with open(log) as f:
        calls = f.read()
    assert calls[0] == "a" and sorted(calls) == ["a", "b", "c"]


def test_hidden_names(spark, tmp_path):
    for name in ("__init__.py", "__main__.py", "_util.py", "ok.py", ".eslintrc.json", "sub/_x/deep.py", "sub/y.py", "node_modules/_z.py", ".git/config.json", "_archive/old.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    got = {r["path"]: r for r in scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"__init__.py", "__main__.py", "_util.py", "ok.py", ".eslintrc.json", "sub/_x/deep.py", "sub/y.py"}
    assert got["sub/_x/deep.py"]["text"] == "# sub/_x/deep.py\n" and got["__main__.py"]["is_entrypoint"]
    assert got["_util.py"]["size_bytes"] == 11 and got["_util.py"]["hash"] == hashlib.sha256(b"# _util.py\n").hexdigest()
    assert {r["path"] for r in scan(spark, str(tmp_path), ["sub", "_*", ".*"]).collect()} == {"ok.py"}
    for name, there in (("ok.py", 1), ("_util.py", 1), ("none.py", 0), ("_none.py", 0)):
        assert file_info(spark, str(tmp_path / name)).count() == there


def test_confirmed_delete(spark, tmp_path):
    (tmp_path / "t").mkdir()
    tree(tmp_path / "t")
    g = lifecycle.index(spark, str(tmp_path / "t"))
    same, said = lifecycle.confirm_delete(g, "file", "helper.py", "helper.py")
    assert same is g and not said.first()["success"]
    assert lifecycle.confirm_delete(g, "symbol", "nothing", None, True)[1].first()["message"] == "Target not found"
    less, said = lifecycle.confirm_delete(g, "symbol", "square", None, True)
    square = g.symbols.where("name = 'square'").first()["id"]
    assert said.first()["operation"]["impact_summary"] == "Deleted symbol: square"
    assert less.symbols.where("name = 'square'").count() == 0 and less.edges.where((F.col("target_id") == square) | (F.col("source_id") == square)).count() == 0
    gone, done = lifecycle.confirm_delete(g, "file", "model.py", "model.py", True)
    assert gone.symbols.where("path = 'model.py'").count() == 0 and gone.files.count() == g.files.count() - 1
    assert gone.edges.where("edge_type = 'CALLS'").count() == g.edges.where("edge_type = 'CALLS'").count()  # only the file's own edges go
    for outcome in (said, done):
        lifecycle.append_operation(outcome, str(tmp_path / "ops"))
    assert spark.read.parquet(str(tmp_path / "ops")).count() == 2
    twice = g.symbols.unionByName(g.symbols.where("name = 'square'").withColumn("id", F.lit(5).cast("long")))
    with pytest.raises(ValueError, match="2 nodes"):
        graph.find_target("symbol", "square", None, g.files, twice, g.equations)
    for _ in range(2):
        manual = lifecycle.store_manual(g, str(tmp_path / "manual"))
    assert [r["order"] for r in manual.orderBy("order").collect()] == list(range(1, 8)) and "files" in manual.orderBy("order").first()["content"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("MODEL_NAME", "m")
    (tmp_path / "c.json").write_text('{"llm": {"model": "${MODEL_NAME}", "mode": "local"}, "parallel": {"batch_size": 7}}')
    s = load(str(tmp_path / "c.json"))
    assert (s.llm_model, s.llm_mode, s.batch_size, s.max_analysis_depth) == ("m", "local", 7, 3)


def edge_rows(g):
    return {tuple(r) for r in g.edges.select("source_type", "source_id", "target_type", "target_id", "edge_type", "evidence", "confidence").collect()}


def test_edges_after_changes(spark, tmp_path):
    """After every step the edges are those of a full rebuild, and files that nothing affects keep theirs unresolved anew."""
    write = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    write("a.py", "import b\nimport pkg.c\ndef f():\n    g()\n    h()\n")
    write("b.py", "import a\ndef g():\n    return k()\n")
    write("pkg/c.py", "from b import g\ndef h():\n    g()\n\ndef k():\n    h()\n")
    write("alone.py", "import nothing\ndef own():\n    own()\n")
    write("late.py", "import fresh\nimport x.fresh\ndef late():\n    newcomer()\n    f()\n")
    g = lifecycle.index(spark, str(tmp_path))

    def step():
        after, changes = lifecycle.rescan(g, scan(spark, str(tmp_path)))
        assert edge_rows(after) == edge_rows(lifecycle.index(spark, str(tmp_path)))
        affected = {r["path"] for r in lifecycle.affected_files(g, after.entities, after.symbols, changes).collect()}
        return after, affected

    write("b.py", "import a\n\ndef g2():\n    return k()\n")  # a definition goes, another comes
    g, affected = step()
    assert affected == {"b.py", "a.py", "pkg/c.py"}
    write("fresh.py", "def newcomer():\n    late()\n")  # what was not resolved is
    g, affected = step()
    assert affected == {"fresh.py", "late.py"}
    (tmp_path / "pkg/c.py").unlink()
    write("alone.py", "import nothing\n\n\ndef own():\n    own()\n")
    g, affected = step()
    assert "late.py" not in affected and {"a.py", "b.py", "alone.py", "pkg/c.py"} <= affected
    g, affected = step()
    assert affected == set()
