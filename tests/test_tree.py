"""Scans of trees with odd names, bytes and files, and the watcher."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources.scan import file_info, read_tree, scan, skipped, with_sources
from weftline.sources.tree import listed, register
from weftline.streaming.watch import watch_tree

OLD = (1, 2)  # times of access and change


@pytest.fixture
def odd_tree(tmp_path):
    for name in ("ok.py", "_util.py", ".eslintrc.json", "sub/_x/deep.py", "sub/.hidden/y.js", "sub/notes.unknown", "_archive/old.py", ".git/config.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "latin.py").write_bytes("# café\nx = 1\n".encode("latin-1"))
    (tmp_path / "mixed.py").write_bytes(b"a\xff\xfeb \xe2\x82 \xe2\x82\xac")
    os.symlink("/proc/self/mem", tmp_path / "broken.py")  # opens, but cannot be read
    os.symlink("nowhere", tmp_path / "gone.py")
    os.symlink(".", tmp_path / "sub/loop")
    for i in range(200):
        (tmp_path / f"node_modules/p{i}/lib").mkdir(parents=True)
        (tmp_path / f"node_modules/p{i}/lib/z.js").write_text("function no() {}\n")
    with open(tmp_path / "node_modules/huge.js", "wb") as f:
        f.truncate(3 << 30)
    for folder, _, names in os.walk(tmp_path):
        for name in names:
            if not os.path.islink(os.path.join(folder, name)):
                os.utime(os.path.join(folder, name), OLD)
    return tmp_path


def test_odd_tree(spark, odd_tree):
    got = {r["path"]: r for r in scan(spark, str(odd_tree)).collect()}
    assert set(got) == {"ok.py", "_util.py", ".eslintrc.json", "sub/_x/deep.py", "sub/.hidden/y.js", "latin.py", "mixed.py"}
    for path, row in got.items():
        raw = (odd_tree / path).read_bytes()
        assert row["text"] == raw.decode("utf-8", errors="replace") and row["hash"] == hashlib.sha256(raw).hexdigest() and row["size_bytes"] == len(raw)
    errors = {r["path"]: r["error"] for r in skipped(spark, str(odd_tree)).collect()}
    assert set(errors) == {"broken.py"} and "OSError" in errors["broken.py"]
    assert {r["path"] for r in scan(spark, str(odd_tree), ["sub", "node_*", "_*", ".*"]).collect()} == {"ok.py", "latin.py", "mixed.py"}


def test_what_is_opened(spark, odd_tree):
    """Reading moves a file's time of access on, where the file system keeps it: excluded files and unknown kinds keep theirs."""
    scan(spark, str(odd_tree)).write.format("noop").mode("overwrite").save()
    opened = {os.path.relpath(os.path.join(d, n), odd_tree) for d, _, names in os.walk(odd_tree) for n in names if not os.path.islink(os.path.join(d, n)) and os.stat(os.path.join(d, n)).st_atime > 1}
    if not opened:
        pytest.skip("times of access are not kept here")
    assert opened == {"ok.py", "_util.py", ".eslintrc.json", "sub/_x/deep.py", "sub/.hidden/y.js", "latin.py", "mixed.py"}


def test_rounds(spark, odd_tree):
    """Tasks that see few entries hand folders back; the listing is the same."""
    whole = sorted(tuple(r) for r in listed(spark, str(odd_tree), []).select("path", "length").collect())
    assert sorted(tuple(r) for r in listed(spark, str(odd_tree), [], step=20).select("path", "length").collect()) == whole
    assert len(whole) == 200 + 1 + 11 and not any(p.startswith("sub/loop") for p, _ in whole)


def test_data_source(spark, odd_tree):
    register(spark)
    want = sorted((r["path"], r["length"]) for r in listed(spark, str(odd_tree)).collect())
    for folders in ("1", "3", "1000"):
        df = spark.read.format("tree").option("folders", folders).option("content", "false").load(str(odd_tree))
        assert sorted((r["path"], r["length"]) for r in df.collect()) == want
    one = spark.read.format("tree").option("exclude", json.dumps(["node_modules", "sub", "*.py"])).load(str(odd_tree))
    assert {r["path"]: bytes(r["content"]).decode() for r in one.collect()} == {p: f"# {p}\n" for p in (".eslintrc.json", ".git/config.json")}


def test_one_file_and_sources(spark, odd_tree):
    for name, there in (("ok.py", 1), ("_util.py", 1), ("none.py", 0), ("_none.py", 0), ("broken.py", 0), ("mixed.py", 1)):
        assert file_info(spark, str(odd_tree / name)).count() == there
    rows = spark.createDataFrame([("ok.py", 1), ("none.py", 2), ("_archive/old.py", 3), ("broken.py", 4)], "path string, id int")
    assert {r["id"]: r["text"] for r in with_sources(spark, rows, str(odd_tree)).collect()} == {1: "# ok.py\n", 2: "", 3: "# _archive/old.py\n", 4: ""}
    nothing = odd_tree / "sub/none"
    nothing.mkdir()
    assert scan(spark, str(nothing)).count() == 0
    assert [r["path"] for r in read_tree(spark, str(odd_tree / "missing")).where(F.col("error").isNotNull()).collect()] == ["."]


def test_watcher(spark, tmp_path):
    root, state, seen = tmp_path / "t", str(tmp_path / "state"), []
    (root / "_pkg").mkdir(parents=True)

    def write(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def handle(changes, files, number):
        seen.append((number, {r["path"]: r["change"] for r in changes.collect()}, {r["path"]: r["text"] for r in files.collect()}))

    def sweep():  # each a query of its own that knows only the checkpoint
        watch_tree(spark, str(root), state, handle).awaitTermination()
        return seen[-1][1:]

    write("a.py", "1", 10)
    write("_pkg/.b.py", "2", 10)
    write("same.py", "3", 10)
    assert sweep() == ({"a.py": "added", "_pkg/.b.py": "added", "same.py": "added"}, {"a.py": "1", "_pkg/.b.py": "2", "same.py": "3"})
    write("a.py", "9", 20)  # same length, other content
    write("same.py", "3", 20)  # other time, same content
    write("new.py", "4", 20)
    os.remove(root / "_pkg/.b.py")
    assert sweep() == ({"a.py": "changed", "new.py": "added", "_pkg/.b.py": "deleted"}, {"a.py": "9", "new.py": "4"})
    write("_pkg/.b.py", "5", 30)
    os.remove(root / "a.py")
    assert sweep() == ({"_pkg/.b.py": "added", "a.py": "deleted"}, {"_pkg/.b.py": "5"})
    assert sweep() == ({}, {})
