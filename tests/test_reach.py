"""Reachability, cycles and their levels against small brute force."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.operators import reach, search


def naive_cycles(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    nodes = {x for p in pairs for x in p}

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reached(a) for a in nodes}
    rings = {a: frozenset(b for b in nodes if b in far[a] and a in far[b]) | {a} for a in nodes}
    level, rows = {}, {}

    def height(ring):
        if ring not in level:
            level[ring] = 1 + max((height(rings[b]) for a in ring for b in out[a] if b not in ring), default=-1)
        return level[ring]

    for a in nodes:
        ring = rings[a]
        rows[a] = (height(ring), min(ring), len(ring)) if len(ring) > 1 else (height(ring), None, None)
    return rows


def check(spark, pairs):
    df = spark.createDataFrame(pairs, "source string, target string")
    got = {r["node"]: (r["level"], r["cycle"], r["size"]) for r in reach.levels_with_cycles(df).collect()}
    assert got == naive_cycles([(a, b) for a, b in pairs if a != b])


NESTED = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "b"), ("c", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("h", "a"), ("i", "h"), ("x", "y"), ("y", "x"), ("p", "q"), ("q", "q"), ("g", "k"), ("e", "m"), ("m", "x")]


def test_nested_cycles(spark):
    check(spark, NESTED)
    ring = [(f"{i:03}", f"{(i + 1) % 60:03}") for i in range(60)]
    check(spark, [*ring, ("030", "x"), ("x", "y"), ("z", "000"), ("y", "w"), ("w", "x")])
    assert reach.cycles(spark.createDataFrame([("a", "a"), ("a", "b")], "source string, target string")).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefghijklmno"), st.sampled_from("abcdefghijklmno")).filter(lambda p: p[0] != p[1]), min_size=1, max_size=30))
def test_any_graph(spark, pairs):
    check(spark, pairs)


def edges(spark, pairs):
    return spark.createDataFrame([("n", a, "n", b, "CALLS") for a, b in pairs], "source_type string, source_id long, target_type string, target_id long, edge_type string")


@pytest.mark.parametrize("backward", [False, True])
def test_tree_and_paths(spark, backward):
    """A ladder has two paths more with every rung; the tree has one row a node."""
    rng = random.Random(2)
    pairs = [(2 * i + a, 2 * i + 2 + b) for i in range(12) for a in (0, 1) for b in (0, 1)] + [(5, 0), (24, 1), (3, 3)]
    rng.shuffle(pairs)
    way = [(b, a) for a, b in pairs] if backward else pairs
    start = [24, 99] if backward else [0, 99]
    depth, parent, now = dict.fromkeys(start, 0), {}, set(start)
    for d in range(1, 11):
        after = defaultdict(set)
        for a, b in way:
            if a in now and b not in depth:
                after[b].add(a)
        parent |= {b: min(s) for b, s in after.items()}
        depth |= dict.fromkeys(after, d)
        now = set(after)
    tree = reach.reach_tree(edges(spark, pairs), spark.createDataFrame([("n", s) for s in start], "type string, id long"), 10, backward)
    got = {r["id"]: (r["depth"], r["from_id"]) for r in tree.collect()}
    assert got == {n: (d, parent.get(n)) for n, d in depth.items()} and tree.count() == len(depth)

    def path(n):
        return [*(path(parent[n]) if n in parent else []), f"n:{n}"]

    wanted = spark.createDataFrame([("n", n) for n in range(0, 30, 3)], "type string, id long")
    assert {r["id"]: r["path"] for r in reach.paths_in(tree, wanted).collect()} == {n: " > ".join(path(n)) for n in range(0, 30, 3) if n in depth}
    assert reach.paths_in(tree, wanted.limit(0)).count() == 0


def test_tiers_stop_when_full(spark):
    nodes = spark.createDataFrame([("n", i, name) for i, name in enumerate(["load", "load file", "file", "save", "parse", "x"])], "node_type string, node_id long, name string")
    e = edges(spark, [(2, 3), (3, 4), (5, 0), (4, 9)])
    found = lambda q, cap: [(r["node_id"], r["tier"], r["depth"]) for r in search.tiered_text(nodes, e, q, cap).collect()]
    assert found("load", 10) == [(0, 1, 0), (1, 2, 0), (5, 3, 1)]
    assert found("file", 10) == [(2, 1, 0), (1, 2, 0), (3, 3, 1), (4, 3, 2)]
    assert found("file", 3) == [(2, 1, 0), (1, 2, 0), (3, 3, 1)] and found("load", 1) == [(0, 1, 0)]
    assert found("#", 5) == [] and found("nothing", 5) == []
