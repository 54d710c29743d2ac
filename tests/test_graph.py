"""Loops against naive ones on random graphs; diffs and edits against plain Python."""

import random
from collections import defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.operators import aggregates, dml, graph, joins, results
from weftline.sources.shared import shared_folder

KINDS = ["CALLS", "USES", "DEFINES"]
QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
EDGES = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.sampled_from(KINDS)), max_size=20, unique=True)


def naive_impact(edges, root, depth):
    incoming = defaultdict(list)
    for s, t, k in edges:
        if k in ("CALLS", "USES"):
            incoming[t].append((s, k))
    seen, queue, out = {root}, deque([(root, 0)]), []
    while queue:
        node, d = queue.popleft()
        if d > depth:
            continue
        for s, k in incoming[node]:
            out.append((s, k, d + 1))
            if s not in seen:
                seen.add(s)
                queue.append((s, d + 1))
    return sorted(out)


@QUICK
@given(EDGES, st.integers(0, 3))
def test_impact(spark, edges, depth):
    e = spark.createDataFrame([("n", s, "n", t, k) for s, t, k in edges], "source_type string, source_id long, target_type string, target_id long, edge_type string")
    nodes = spark.createDataFrame([("n", i, str(i)) for i in range(8)], "node_type string, node_id long, name string")
    got = sorted((r["id"], r["edge_type"], r["depth"]) for r in graph.impact(e, nodes, "n", 0, depth).collect())
    assert got == naive_impact(edges, 0, depth)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12))
def test_levels(spark, deps):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in deps], "source string, target string")
    got = {r["node"]: r["level"] for r in graph.levels(df).collect()}
    need = defaultdict(set)
    nodes = set()
    for a, b in deps:
        if a != b:
            need[str(a)].add(str(b))
            nodes |= {str(a), str(b)}
    want, left = {}, set(nodes)
    while ready := {n for n in left if need[n] <= set(want)}:
        want |= {n: 1 + max((want[m] for m in need[n]), default=-1) for n in ready}
        left -= ready
    assert got == want


def test_levels_of_a_long_chain(spark):
    deps = spark.createDataFrame([(str(i + 1), str(i)) for i in range(104)] + [("a", "b"), ("b", "a")], "source string, target string").coalesce(1)
    placed = graph.levels(deps)
    assert {r["node"]: r["level"] for r in placed.collect()} == {str(i): i for i in range(105)}
    assert {r["level"]: r["dependencies"] for r in graph.level_dependencies(placed, deps).collect()} == dict.fromkeys(range(1, 105), 1)


@QUICK
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xy")), st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xy")))
def test_diff_partitions_the_union(spark, old, new):
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    got = {r["path"]: r["change"] for r in joins.snapshot_diff(frame(old), frame(new)).collect()}
    want = {p: "added" if p not in old else "deleted" if p not in new else "same" if old[p] == new[p] else "changed" for p in {*old, *new}}
    assert got == want
    merged = {r["path"]: r["hash"] for r in dml.upsert(frame(old), frame(new), ["path"], ["hash"]).collect()}
    assert merged == old | new


def test_line_edits(spark):
    text = "a\nb\nc\nd"
    rows = [("replace", 2, 3, "x"), ("delete", 1, None, None), ("insert", 3, None, "y\nz"), ("delete", 2, 9, None), ("replace", 4, 4, "")]
    df = spark.createDataFrame([(text, *r) for r in rows], "t string, k string, s int, e int, n string")
    got = [r[0] for r in df.select(fn.edited(F.col("t"), F.col("k"), F.col("s"), F.col("e"), F.coalesce("n", F.lit("")))).collect()]
    assert got == ["a\nx\nd", "b\nc\nd", "a\nb\ny\nz\nc\nd", "a", "a\nb\nc\n"]


def test_consistency(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.4), (3, None)], "k int, confidence double")
    got = {r["k"]: r["confidence"] for r in aggregates.consistency(df, ["k"]).collect()}
    assert abs(got[1] - 0.54) < 1e-12 and got[2] == 0.4 and got[3] == 0.0


def test_paths(spark):
    paths = ["src/app.py", "x/Makefile", "a/b/test_x.py", "a/.hidden", "node_modules/x.js", "deep/tests/y.go", "pyproject.toml", "lib.so", "UP.PY"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in df.select(p, fn.language(p), fn.is_test(p), fn.is_config(p), fn.is_entrypoint(p), fn.excluded(p), fn.included(p), fn.suffix(fn.filename(p))).collect()}
    assert got["src/app.py"] == ("python", False, False, True, False, True, ".py")
    assert got["x/Makefile"][0] == "make" and got["x/Makefile"][2]
    assert got["a/b/test_x.py"][1] and got["deep/tests/y.go"][1]
    assert got["a/.hidden"][6] == "" and not got["a/.hidden"][5]
    assert got["node_modules/x.js"][4] and got["lib.so"][4]
    assert got["pyproject.toml"][2] and got["UP.PY"][0] == "python"


def test_snapshot_documents_stay_small(spark):
    files = spark.range(25_000).select(F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    documents = dml.snapshot_json(files)
    sizes = [len(r["files"]) for r in documents.select(F.from_json("snapshot", "files map<string,string>")["files"].alias("files")).collect()]
    assert sum(sizes) == 25_000 and len(sizes) == 3 and max(sizes) < 10_000
    back = dml.read_snapshot(documents)
    assert back.count() == 25_000 and back.exceptAll(files).count() == 0
    assert [r["snapshot"] for r in dml.snapshot_json(files.limit(0)).collect()] == ['{"files":{}}']


def test_audit_without_gathering(spark):
    rows = spark.range(1000).repartition(3)
    one = dml.audit("delete", rows, ["id"])
    assert "collect_" not in one._jdf.queryExecution().optimizedPlan().toString()
    got = one.first()
    assert got["affected"] == 1000 and len(got["digest"]) == 64
    assert dml.audit("delete", rows.unionAll(rows), ["id"]).first()[1:] == (2000, got["digest"])
    assert dml.audit("delete", rows.where("id <> 5"), ["id"]).first()["digest"] != got["digest"]
    assert dml.audit("delete", rows.limit(0), ["id"]).first()["affected"] == 0


def test_lines_against_intervals(spark, monkeypatch):
    """Stretches of lines give what all pairs of a file give."""
    rng = random.Random(6)
    spans = [(i % 3, i, rng.choice(["function", "class"]), a := rng.randint(0, 300), a + rng.choice([0, 3, 40, 250])) for i in range(120)]
    calls = [(i % 3, i, rng.randint(0, 500), "n") for i in range(150)]
    s = spark.createDataFrame(spans, "file_id long, id long, symbol_type string, start_line long, end_line long")
    c = spark.createDataFrame(calls, "file_id long, id long, line long, name string")
    want_calls, want_parents = {}, {}
    for f, i, line, _ in calls:
        inside = [(k != "function", a, j) for g, j, k, a, b in spans if f == g and a <= line <= b]
        if inside:
            want_calls[i] = min(inside)[2]
    for f, i, _, a, b in spans:
        around = [(x, j) for g, j, _, x, y in spans if f == g and i != j and x <= a and y >= b]
        if around:
            want_parents[i] = max(around)[1]
    for lines in (128, 7):
        monkeypatch.setattr(joins, "LINES", lines)
        assert {r["call_id"]: r["symbol_id"] for r in joins.enclosing_symbols(c, s).collect()} == want_calls
        assert {r["id"]: r["parent_id"] for r in joins.parents(s).collect()} == want_parents


def test_results(spark):
    good = {
        "file": '{"summary": "s", "confidence": "0.5", "key_concepts": ["é"], "more": 1}',
        "variable": '{"inferred_meaning": "m", "confidence": 0, "unit": null, "role": "state"}',
        "dependency": '{"confidence": 1, "data_flow_edges": [{"a": "b"}]}',
        "impact": '{"risk_summary": "r", "confidence": 0.25, "risk_level": "high"}',
        "delete": '{"can_delete": true, "recommendation": "r", "confidence": 1.0}',
    }
    bad = {
        "file": [('{"confidence": 0.5}', "summary: missing"), ('{"summary": "s", "confidence": 0.5, "purpose": "x"}', "purpose: not allowed"), ("5", "no object"), ("", "invalid JSON"), (None, "invalid JSON"), ("{'summary': 's'}", "invalid JSON"), ('{"summary": "s", "confidence": true}', "confidence: no number"), ('{"summary": "s", "confidence": 1.2}', "confidence: out of range"), ('{"summary": "s", "confidence": 1, "risk_notes": [null]}', "risk_notes: no list of texts")],
        "variable": [('{"inferred_meaning": 4, "confidence": 0}', "inferred_meaning: no text"), ('{"inferred_meaning": "m", "confidence": 0, "unit": []}', "unit: no text")],
        "dependency": [('{"confidence": 1, "data_flow_edges": ["a"]}', "data_flow_edges: no list of edges")],
        "impact": [('{"risk_summary": "r", "confidence": 0.25, "risk_level": null}', "risk_level: no text")],
        "delete": [('{"recommendation": "r", "confidence": 1.0}', "can_delete: missing"), ('{"can_delete": "no", "recommendation": "r", "confidence": 1.0}', "can_delete: no flag")],
    }
    for kind, text in good.items():
        rows = [(0, text, None), *((i + 1, t, e) for i, (t, e) in enumerate(bad[kind]))]
        got = results.validated(spark.createDataFrame(rows, "id int, output_json string, want string"), kind).orderBy("id").collect()
        assert [r["error"] for r in got] == [e for *_, e in rows]
        assert got[0]["new_status"] == "completed" and got[1]["new_status"] == "failed" and got[1]["result"] is None
        assert 0 <= got[0]["result"]["confidence"] <= 1
        if kind == "file":
            r = got[0]["result"]
            assert (r["purpose"], r["is_core"], r["key_concepts"], r["risk_notes"], r["confidence"]) == ("unknown", False, ["é"], [], 0.5)


def test_results_come_once(spark):
    """Several results for one target, and results for targets with a record, leave one record."""
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, path string")
    rows = [(1, "file_1", '{"summary": "one", "confidence": 0.1}'), (2, "file_1", '{"summary": "two", "confidence": 0.2}'), (3, "file_1", "{"), (4, "f_2", '{"summary": "x", "confidence": 0.3}'), (5, "file_7", '{"summary": "x", "confidence": 0.3}')]
    judged = results.judged(spark.createDataFrame(rows, "id long, task_id string, output_json string"), files, "file")
    assert {r["id"]: r["error"] for r in judged.collect()} == {1: None, 2: None, 3: "invalid JSON", 4: None, 5: "file record not found for task_id file_7"}
    done = results.latest(judged)
    assert {r["id"]: r["llm_summary"] for r in results.submitted(files, done, "file").collect()} == {1: "two", 2: "x", 3: None}
    records = spark.createDataFrame([("file", 1, None, None, "pending"), ("file", 3, None, None, "pending"), ("symbol", 2, None, None, "failed")], "target_type string, target_id long, output_json string, confidence double, status string")
    got = sorted((r["target_type"], r["target_id"], r["status"]) for r in results.with_results(records, done, "file").collect())
    assert got == [("file", 1, "completed"), ("file", 2, "completed"), ("file", 3, "pending"), ("symbol", 2, "failed")]


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        @staticmethod
        def get(_, default):
            return default

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("S", (), {"conf": Conf, "sparkContext": Context})
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(session)


def test_paths_read_near_edges_alone(spark, monkeypatch):
    """Few ends: their ids reach what edges is made of, below distinct. Many: all edges are written once. Same paths."""
    rows = [("a", i, "a", j) for i, j in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6), (6, 7), (2, 1), (7, 2)]] + [("b", 1, "a", 1)]
    edges = spark.createDataFrame(rows * 2, "source_type string, source_id long, target_type string, target_id long").distinct()
    asked, made, whole = [], [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what: (made.append(what), asked.append(df._jdf.queryExecution().optimizedPlan().toString())) and whole(df, what))

    def paths(backward):
        return sorted(tuple(r) for r in graph.reach_with_paths(edges, "a", 1, 5, backward).collect())

    few = {b: paths(b) for b in (False, True)}
    assert set(made) == {"paths"}
    first = asked[0]
    assert first.index("Aggregate") < first.index("source_id#") and "Filter" in first[first.index("Aggregate") :]
    made.clear()
    monkeypatch.setattr(graph, "NEAR", 1)
    assert {b: paths(b) for b in (False, True)} == few and made.count("known") == 2
    walk, want = [(("a", 1), ["a:1"])], []
    for depth in range(1, 6):
        walk = [((t, i), [*seen, f"{t}:{i}"]) for (a, n), seen in walk for s, k, t, i in rows if (s, k) == (a, n) and f"{t}:{i}" not in seen]
        want += [(t, i, depth, " > ".join(seen)) for (t, i), seen in walk]
    assert few[False] == sorted(want)


def test_many_pairs(spark, monkeypatch):
    """A key with many rows on both sides is dealt over many tasks; nothing is lost, null keys join nothing."""
    monkeypatch.setattr(joins, "CELL", 16)
    monkeypatch.setattr(joins, "TASK_PAIRS", 256)
    left = spark.range(700).select(F.col("id").alias("l"), F.when(F.col("id") % 7 > 0, F.least(F.col("id") % 7, F.lit(2))).alias("k"))
    right = spark.range(90).select(F.col("id").alias("r"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"))
    out = joins.many_pairs(left, right, "k")
    want = sorted((a["k"], a["l"], b["r"]) for a in left.collect() for b in right.collect() if a["k"] is not None and a["k"] == b["k"])
    assert sorted((r["k"], r["l"], r["r"]) for r in out.select("k", "l", "r").collect()) == want
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 20 and max(sizes) < len(want) / 8
    monkeypatch.undo()
    assert sorted((r["k"], r["l"], r["r"]) for r in joins.many_pairs(left, right, "k").select("k", "l", "r").collect()) == want
