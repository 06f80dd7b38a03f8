import itertools
import random

import pytest

from treeloom.operators.components import components
from treeloom.operators.hierarchy import cyclic_nodes, forest_summary, node_depths, peel_edges, peel_nested, peeled_descendants
from treeloom.session import NotConverged

SCHEMA = "key int, nodes array<struct<id: string, up: array<string>>>, extra int, node string"


def forest(spark, rows):
    return spark.createDataFrame([(k, nodes, 1, "clash") for k, nodes in rows], SCHEMA)


def told(spark, nodes, **kw):
    return {r["node"]: r for r in peel_nested(forest(spark, [(1, nodes)]), "key", "nodes", "id", "up", **kw).collect()}


def test_tree_with_two_parents(spark):
    t = told(spark, [("1", []), ("2", ["1"]), ("3", ["1"]), ("4", ["2", "3"])])
    assert t["4"]["depth"] == 2 and t["4"]["roots"] == ["1"] and t["4"]["n_paths"] == 2
    assert sorted(t["4"]["paths"]) == [["1", "2", "4"], ["1", "3", "4"]]
    assert t["1"]["descendants"] == ["2", "3", "4"] and t["1"]["subtree_size"] == 4 and t["1"]["height"] == 2


def test_blanks_repeats_unknown_and_null(spark):
    t = told(spark, [(" a ", None), ("b", ["a", " a", "zz", None]), ("b", ["a"]), (None, ["a"]), ("c", ["b "])])
    assert set(t) == {"a", "b", "c"} and t["b"]["parents"] == ["a"] and t["c"]["depth"] == 2


def test_cycles(spark):
    t = told(spark, [("r", []), ("a", ["b", "r"]), ("b", ["a"]), ("c", ["b"]), ("s", ["s"]), ("x", ["s"])])
    status = {k: r["status"] for k, r in t.items()}
    assert status == {"r": "above_cycle", "a": "on_cycle", "b": "on_cycle", "c": "below_cycle", "s": "on_cycle", "x": "below_cycle"}
    assert t["c"]["depth"] is None and t["r"]["descendants"] == ["a", "b", "c"] and t["a"]["descendants"] == ["a", "b", "c"]


def test_node_between_two_cycles_is_not_on_one(spark):
    nodes = [("a", ["b"]), ("b", ["a"]), ("m", ["a"]), ("c", ["m", "d"]), ("d", ["c"])]
    got = {r["node"] for r in cyclic_nodes(forest(spark, [(1, nodes)]), "key", "nodes", "id", "up").collect()}
    assert got == {"a", "b", "c", "d"}


def test_many_paths_are_counted_not_listed(spark):
    nodes = [("0", [])] + [(f"{k}{s}", ["0"] if k == 1 else [f"{k - 1}a", f"{k - 1}b"]) for k in range(1, 21) for s in "ab"]
    t = told(spark, nodes, listed_paths=100)
    assert t["20a"]["n_paths"] == 2**19 and t["20a"]["paths"] is None and t["20a"]["depth"] == 20 and len(t["3a"]["paths"]) == 4


def test_empty_and_null_rows(spark):
    df = forest(spark, [(1, []), (2, None)])
    assert peel_nested(df, "key", "nodes", "id", "up").count() == 0
    assert cyclic_nodes(df.limit(0), "key", "nodes", "id", "up").count() == 0


def brute_cycles(nodes):
    ids = {n for n, _ in nodes}
    up = {n: set() for n in ids}
    for n, ps in nodes:
        up[n] |= {p for p in ps if p in ids}
    out = set()
    for n in ids:
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        if n in seen:
            out.add(n)
    return out


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        n = rng.randint(1, 12)
        rows.append((k, [(str(i), [str(rng.randint(0, n)) for _ in range(rng.randint(0, 2))]) for i in range(n)]))
    got = {(r["key"], r["node"]) for r in cyclic_nodes(forest(spark, rows), "key", "nodes", "id", "up").collect()}
    assert got == {(k, x) for k, nodes in rows for x in brute_cycles(nodes)}


@pytest.mark.parametrize("tail", [2, 1000])
def test_peel_edges_agrees(spark, tail):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("a", None), ("x", "y"), ("y", "x"), ("z", "y"), ("r", "x"), ("q", None), ("b", "a"), ("d", "q")]
    table = spark.createDataFrame(links, "child string, parent string")
    out = {r["node"]: r for r in peel_edges(table, tail_links=tail).collect()}
    assert out["d"]["path"] == ["a", "b", "d"] and out["a"]["n_descendants"] == 3 and out["q"]["depth"] == 0 and out["q"]["height"] == 1
    assert out["x"]["in_cycle_part"] and out["y"]["in_cycle_part"] and out["z"]["depth"] is None and out["z"]["height"] == 0
    below = {tuple(r) for r in peeled_descendants(table, tail_links=tail).collect()}
    assert below == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("q", "d")}
    assert peel_edges(table.limit(0)).count() == 0


@pytest.mark.parametrize("tail", [0])
def test_chain_deeper_than_the_kept_parts(spark, tail):
    """A caterpillar: every node of a chain has a leaf besides, so that all wait long; messages are merged on the way."""
    links = [(f"{k:03}", f"{k - 1:03}") for k in range(1, 15)] + [(f"leaf{k}", f"{k:03}") for k in range(15)]
    out = {r["node"]: r for r in peel_edges(spark.createDataFrame(links, "child string, parent string"), tail_links=tail).collect()}
    assert out["000"]["height"] == 15 and out["014"]["depth"] == 14 and out["000"]["n_descendants"] == 29 and not any(r["in_cycle_part"] for r in out.values())
    assert out["leaf14"]["path"] == [f"{k:03}" for k in range(15)] + ["leaf14"] and out["leaf14"]["root"] == "000"


@pytest.mark.parametrize("tail", [0, 6, 1000])
def test_peel_edges_of_random_graphs(spark, tail):
    """Many small graphs with cycles and several parents, as one table: the distributed form agrees with the nested one."""
    rng = random.Random(11)
    rows = [(k, [(str(i), [str(rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(9)]) for k in range(12)]
    links = [(f"{k}:{i}", f"{k}:{p}" if p != "9" else None) for k, nodes in rows for i, ps in nodes for p in (ps or ["9"])]
    want = {f"{r['key']}:{r['node']}": r for r in peel_nested(forest(spark, rows), "key", "nodes", "id", "up").collect()}
    table = spark.createDataFrame(links, "child string, parent string")
    listed = peel_edges(table, tail_links=tail).collect()
    got = {r["node"]: r for r in listed}
    assert set(got) == set(want) and len(listed) == len(want)
    for name, r in got.items():
        w = want[name]
        assert (r["height"], r["depth"], r["in_cycle_part"]) == (w["height"], w["depth"], w["height"] is None)
        assert r["n_descendants"] == (None if w["height"] is None else len(w["descendants"]))
        if w["depth"] is not None:
            k = name.split(":")[0]
            assert [x.split(":")[1] for x in r["path"]] in [p for p in w["paths"] if len(p) == w["depth"] + 1] and r["root"] == r["path"][0] == f"{k}:{r['path'][0].split(':')[1]}"
    pairs = {tuple(r) for r in peeled_descendants(table, tail_links=tail).collect()}
    assert pairs == {(n, f"{n.split(':')[0]}:{d}") for n, w in want.items() if w["height"] is not None for d in w["descendants"]}


def test_summary_and_depths_of_random_graphs(spark):
    rng = random.Random(5)
    rows = [(k, [(str(i), [str(rng.randint(0, n)) for _ in range(rng.randint(0, 2))]) for i in range(n)]) for k, n in enumerate([0, 1, *(rng.randint(1, 12) for _ in range(40))])]
    df = forest(spark, rows)
    whole = [r for r in peel_nested(df, "key", "nodes", "id", "up").collect()]
    assert {(r["key"], r["node"]): r["depth"] for r in node_depths(df, "key", "nodes", "id", "up").collect()} == {(r["key"], r["node"]): r["depth"] for r in whole}
    for r in forest_summary(df, "nodes", "id", "up").collect():
        mine = [x for x in whole if x["key"] == r["key"]]
        want = (len(mine), sum(len(x["parents"]) for x in mine), sum(not x["parents"] for x in mine), max([-1, *(x["depth"] for x in mine if x["depth"] is not None)]), any(x["status"] == "on_cycle" for x in mine))
        assert (r["n_nodes"], r["n_links"], r["n_roots"], r["max_depth"], r["has_cycle"]) == want and r["node"] == "clash"


def test_components_raises_where_it_is_stopped(spark):
    with pytest.raises(NotConverged):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint"), max_rounds=2)


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3)], list(itertools.pairwise(range(40)))])
def test_components(spark, pairs):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent}
