"""Tables changed in place, hierarchies by doubling, and the queue that is taken up again."""

import math
import os

import pytest

from weftline.operators import hierarchy
from weftline.operators.keyed import KeyedTable
from weftline.streaming.queue import enqueue, results, run_stored

SCHEMA = "id long, name string, n long"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "name", "n").collect())


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], SCHEMA, buckets=32)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert table.version() == 0 and table.read().count() == 0
    want = {i: (i, f"n{i}", 1) for i in range(1000)}
    table.insert_ignore(make(list(want.values())))
    old, homes = table.read(), table.homes()
    fresh = [(i, f"m{i}", 2) for i in (1, 2, 3, 500, 2000, 2001, 2002, 2003, 2004, 2005)]
    assert table.upsert(make(fresh), ["n"]) == 2
    moved = [b for b, h in table.homes().items() if h == 2]
    assert 0 < len(moved) <= 10 and all(h == homes[b] for b, h in table.homes().items() if b not in moved)
    written = [n for _, _, names in os.walk(tmp_path / "t/data/v=2") for n in names if n.endswith(".parquet")]
    assert len(written) == len(moved)
    assert rows_of(old) == sorted(want.values())  # a reader of version 1
    for i, name, n in fresh:
        want[i] = (i, want[i][1] if i in want else name, n)
    assert rows_of(table.read()) == sorted(want.values())
    table.insert_ignore(make([(1, "other", 9), (3000, "x", 3), (3000, "x", 3)]))
    want[3000] = (3000, "x", 3)
    assert rows_of(table.read()) == sorted(want.values())
    table.delete(make([(i, None, None) for i in range(0, 1000, 7)] + [(77777, None, None)]))
    want = {i: r for i, r in want.items() if i >= 1000 or i % 7}
    assert rows_of(table.read()) == sorted(want.values()) and table.version() == 4
    make([(5, "broken", 0)]).write.parquet(str(tmp_path / "t/data/v=99/bucket=1"))  # a change that did not end
    assert rows_of(table.read()) == sorted(want.values())
    table.vacuum()
    assert rows_of(table.read()) == sorted(want.values()) and sorted(os.listdir(tmp_path / "t/versions")) == ["4"]
    assert table.upsert(make([]), ["n"]) == 4


def test_keyed_table_emptied(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], SCHEMA, buckets=4)
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), ["n"])
    table.delete(spark.createDataFrame([(1, None, None), (2, None, None)], SCHEMA))
    assert table.read().count() == 0 and table.version() == 2
    table.upsert(spark.createDataFrame([(1, "c", 5)], SCHEMA), ["n"])
    assert rows_of(table.read()) == [(1, "c", 5)]


def test_chain(spark, monkeypatch):
    """5,000 nodes in one chain: 13 rounds."""
    count = []
    whole = hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, what: count.append(what) or whole(df, what))
    chain = [(i, i - 1 if i else None, f"{i % 10}") for i in range(5000)]
    got = {r["node"]: (r["root"], r["depth"], r["qualified_name"]) for r in hierarchy.ancestry(spark.createDataFrame(chain, "node long, parent long, name string")).collect()}
    assert len(count) - 1 == math.ceil(math.log2(5000)) == 13
    assert got[4999] == (0, 4999, ".".join(f"{i % 10}" for i in range(5000))) and got[0] == (0, 0, "0") and len(got) == 5000


def test_odd_parents(spark):
    rows = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "gone", "D"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "x", "Z"), ("s", "s", "S")]
    got = {r["node"]: tuple(r)[1:] for r in hierarchy.ancestry(spark.createDataFrame(rows, "node string, parent string, name string")).collect()}
    none = (None, None, None)
    assert got == {"a": ("a", 0, "A"), "b": ("a", 1, "A.B"), "c": ("a", 2, "A.B.C"), "d": ("d", 0, "D"), "x": none, "y": none, "z": none, "s": none}


def test_layers(spark, monkeypatch):
    """Bushy trees: leaves are laid aside before any round, dangling parents, cycles and null names among them; a parent
    of most nodes is joined by few of them in the rounds."""
    doubled, sizes = hierarchy._doubled, []
    monkeypatch.setattr(hierarchy, "_doubled", lambda nodes, count: sizes.append(count) or doubled(nodes, count))
    rows = [(0, None, "r")] + [(i, 0, f"a{i}") for i in range(1, 5)] + [(10 + i, 1 + i % 4, f"b{i}") for i in range(40)] + [(100 + i, 10 + i % 40, f"c{i}") for i in range(900)]
    rows += [(2000 + i, 1999, f"d{i}") for i in range(20)] + [(3000, 3001, "x"), (3001, 3000, "y")] + [(3100 + i, 3000, "z") for i in range(9)] + [(4000, None, None), (4001, 4000, None), (4002, 4001, "n")]
    known = {n: (p, m) for n, p, m in rows}

    def above(node):
        names, at, depth = [known[node][1]], node, 0
        while known[at][0] in known:
            at, depth = known[at][0], depth + 1
            names.insert(0, known[at][1])
            if depth > len(known):
                return None, None, None
        return at, depth, ".".join(n for n in names if n is not None) or None

    got = {r["node"]: tuple(r)[1:] for r in hierarchy.ancestry(spark.createDataFrame(rows, "node long, parent long, name string")).collect()}
    assert got == {n: above(n) for n in known}
    assert sizes[0] < 30  # of 983


OK = {
    "file": '{"summary": "s", "confidence": 0.5}',
    "symbol": '{"responsibility": "r", "confidence": 1}',
    "equation": '{"mathematical_meaning": "m", "algorithmic_role": "a", "confidence": 0.5, "evidence": "e"}',
}


def test_queue_taken_up_again(spark, tmp_path):
    """The third batch is killed; the next run repeats that batch alone, and every other task is called once."""
    files = spark.createDataFrame([(i, "x/_archive/b.py" if i == 5 else f"f{i}.py") for i in range(25)], "id long, path string")
    symbols = spark.createDataFrame([(100 + i, i) for i in range(8)], "id long, file_id long")
    equations = spark.createDataFrame([(200, 1), (201, 2)], "id long, file_id long")
    wanted = [("file", i) for i in range(25)] + [("file", 77)] + [("symbol", 100 + i) for i in range(8)] + [("equation", 200), ("equation", 201)]
    tasks = spark.createDataFrame([(k, i, "pending") for k, i in wanted] + [("file", 900, "completed")], "target_type string, target_id long, status string")
    store, log, kill = str(tmp_path / "store"), str(tmp_path / "log"), str(tmp_path / "kill")
    with open(kill, "w"):
        pass

    def call(kind, target, path):
        with open(log, "a") as f:
            f.write(f"{kind} {target}\n")
        if target == 24 and os.path.exists(kill):
            os._exit(1)  # the worker dies: no row, no answer
        if target == 7:
            raise TimeoutError("no answer")
        return "{" if target == 101 else OK[kind]

    batches = enqueue(tasks, files, symbols, equations, store, 10)
    assert batches == 4
    with pytest.raises(Exception, match=".*"):
        run_stored(spark, batches, call, store)
    assert results(spark, batches, store).count() == 20
    os.remove(kill)
    before = open(log).read().split("\n")[:-1]
    assert enqueue(tasks.limit(0), files, symbols, equations, store, 10) == 4  # the stored order counts
    got = {(r["target_type"], r["target_id"]): (r["status"], r["error"]) for r in run_stored(spark, batches, call, store).collect()}
    want = {(k, i): ("completed", None) for k, i in wanted}
    want[("file", 5)], want[("file", 7)] = ("failed", "skipped: the file is archived"), ("failed", "TimeoutError: no answer")
    want[("symbol", 105)] = want[("file", 5)]
    want[("file", 77)], want[("symbol", 101)] = ("failed", "file record missing"), ("failed", "invalid JSON")
    assert got == want
    after = open(log).read().split("\n")[len(before) : -1]
    third = {f"{k} {i}" for k, i in wanted[20:30]}
    assert set(after) & set(before) <= third and not set(after[0:1]) - third
    assert all(after.count(c) == 1 for c in after) and all(before.count(c) == 1 for c in before if c not in third)
