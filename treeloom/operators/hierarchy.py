"""Parent-child links to full hierarchies.

Two forms of one algorithm, bottom-up leaf peeling:

* :func:`peel_nested` - every row holds all the nodes of its own forest (an array of
  node id and parent ids).  No shuffle: each Arrow batch is peeled level by level for
  all of its rows at once with numpy.
* :func:`peel_edges` - one (child, parent) row per link, forests of any size across the
  table.  Each round peels all leaves with DataFrame joins.

In both, leaves send descendant lists and subtree sizes to their parents; the reverse of
the peel order gives depths and paths; nodes that are never peeled lie on a cycle or
above one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.session import write_table

#: Nodes with more root-to-node paths than this list none of them: ``ancestor_links`` then holds them exactly.
LISTED_PATHS = 1000

STATUS = ("ok", "on_cycle", "above_cycle", "below_cycle")


class Forests:
    """The forests of one batch: nodes sorted by (row, id), links as index pairs (child, parent)."""

    def __init__(self, lists: pa.Array, ids: pa.Array, parents: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row_of_item = np.repeat(np.arange(len(lists)), lengths)
        ids = pc.utf8_trim_whitespace(ids.cast(pa.string()))
        link_lengths = pc.fill_null(pc.list_value_length(parents), 0).to_numpy(zero_copy_only=False)
        item_of_link = np.repeat(np.arange(len(ids)), link_lengths)
        parent_ids = pc.utf8_trim_whitespace(pc.list_flatten(parents).cast(pa.string()))
        coded = pa.concat_arrays([ids, parent_ids]).dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        size = len(self.names) + 1
        named = code[: len(ids)] >= 0
        item_key = row_of_item * size + code[: len(ids)]
        self.keys, first = np.unique(item_key[named], return_index=True)
        self.position = (np.flatnonzero(named)[first] - (np.cumsum(lengths) - lengths)[self.keys // size]).astype(np.int64) if len(first) else np.empty(0, np.int64)
        self.row, self.code = self.keys // size, self.keys % size
        self.n = len(self.keys)
        usable = (code[len(ids) :] >= 0) & named[item_of_link]
        child = np.searchsorted(self.keys, item_key[item_of_link[usable]])
        parent_key = row_of_item[item_of_link[usable]] * size + code[len(ids) :][usable]
        parent = np.searchsorted(self.keys, parent_key)
        known = parent < self.n
        known[known] = self.keys[parent[known]] == parent_key[known]
        pairs = np.unique(child[known] * max(self.n, 1) + parent[known])
        self.child, self.parent = pairs // max(self.n, 1), pairs % max(self.n, 1)
        self._peel()

    def _peel(self) -> None:
        """Height of each node: the round in which it is peeled, -1 for residual nodes."""
        self.height = np.full(self.n, -1, np.int64)
        waiting = np.bincount(self.parent, minlength=self.n)
        begin = np.searchsorted(self.child, np.arange(self.n + 1))
        leaves, level = np.flatnonzero(waiting == 0), 0
        while len(leaves):
            self.height[leaves] = level
            sent = self.parent[ragged(begin[leaves], begin[leaves + 1])]
            np.subtract.at(waiting, sent, 1)
            touched = np.unique(sent)
            leaves, level = touched[waiting[touched] == 0], level + 1
        self.begin = begin  # links of a child: parent[begin[x]:begin[x + 1]]

    def depths(self) -> np.ndarray:
        """Longest path from a root to each node, -1 for nodes on or below a cycle: the reverse sweep, a level at a time."""
        depth, waiting = np.full(self.n, -1, np.int64), np.bincount(self.child, minlength=self.n)
        order = np.argsort(self.parent, kind="stable")
        down, begin = self.child[order], np.searchsorted(self.parent[order], np.arange(self.n + 1))
        ready, level = np.flatnonzero(waiting == 0), 0
        while len(ready):
            depth[ready] = level
            reached = down[ragged(begin[ready], begin[ready + 1])]
            np.subtract.at(waiting, reached, 1)
            touched = np.unique(reached)
            ready, level = touched[waiting[touched] == 0], level + 1
        return depth

    def on_cycle(self) -> np.ndarray:
        """Which nodes reach themselves.  Residual nodes with no residual parent are trimmed first; then strong components."""
        found = np.zeros(self.n, bool)
        left = self.height < 0
        inner = left[self.child] & left[self.parent]
        child, parent = self.child[inner], self.parent[inner]
        while len(child):
            keep = np.isin(parent, child)  # a parent that is nobody's child in the rest lies above the cycles only
            if keep.all():
                break
            child, parent = child[keep], parent[keep]
        if not len(child):
            return found
        up: dict[int, list[int]] = {}
        for c, p in zip(child.tolist(), parent.tolist()):
            up.setdefault(c, []).append(p)
            up.setdefault(p, [])
        for part in strong_components(up):
            if len(part) > 1 or part[0] in up[part[0]]:
                found[part] = True
        return found


def ragged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The indices of all ranges begin[i]:end[i], one after another."""
    lengths = end - begin
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)


def strong_components(links: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components by two depth-first sweeps, without recursion."""
    order: list[int] = []
    seen: set[int] = set()
    back: dict[int, list[int]] = {x: [] for x in links}
    for x, targets in links.items():
        for y in targets:
            back[y].append(x)
    for root in links:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(links[root]))]
        while stack:
            x, rest = stack[-1]
            y = next((y for y in rest if y not in seen), None)
            if y is None:
                order.append(x)
                stack.pop()
            else:
                seen.add(y)
                stack.append((y, iter(links[y])))
    parts, seen = [], set()
    for root in reversed(order):
        if root in seen:
            continue
        seen.add(root)
        part, todo = [], [root]
        while todo:
            x = todo.pop()
            part.append(x)
            for y in back[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        parts.append(part)
    return parts


def _describe(f: Forests, listed_paths: int) -> dict[str, list]:
    """Everything about each node of a batch, by the two sweeps over the peel order."""
    cyclic = f.on_cycle()
    up = [f.parent[f.begin[x] : f.begin[x + 1]].tolist() for x in range(f.n)]
    down: list[list[int]] = [[] for _ in range(f.n)]
    for c, p in zip(f.child.tolist(), f.parent.tolist()):
        down[p].append(c)
    height = f.height
    below: list[set[int]] = [set() for _ in range(f.n)]
    for x in np.lexsort((np.arange(f.n), height)).tolist():  # leaves first: children have sent their lists before
        if height[x] >= 0:
            for c in down[x]:
                below[x].add(c)
                below[x] |= below[c]
    for x in np.flatnonzero(height < 0).tolist():
        todo = list(down[x])
        while todo:
            y = todo.pop()
            if y not in below[x]:
                below[x].add(y)
                if height[y] >= 0:
                    below[x] |= below[y]
                else:
                    todo += down[y]
    # top-down, in an order in which parents come first; nodes on or below a cycle are never released
    waiting = np.array([len(u) for u in up], np.int64)
    todo, depth = [x for x in range(f.n) if not waiting[x]], [None] * f.n
    for x in todo:
        depth[x] = 0
    at = 0
    while at < len(todo):
        x = todo[at]
        at += 1
        for c in down[x]:
            depth[c] = max(depth[c] or 0, depth[x] + 1)
            waiting[c] -= 1
            if not waiting[c]:
                todo.append(c)
    released = np.zeros(f.n, bool)
    released[todo] = True
    names = f.names.to_pylist()
    name = [names[c] for c in f.code.tolist()]
    count, paths = [0] * f.n, [[] for _ in range(f.n)]
    roots: list[set[int]] = [set() for _ in range(f.n)]
    for x in todo:
        if not up[x]:
            count[x], paths[x], roots[x] = 1, [[name[x]]], {x}
            continue
        count[x] = sum(count[p] for p in up[x])
        paths[x] = None if count[x] > listed_paths or any(paths[p] is None for p in up[x]) else [path + [name[x]] for p in up[x] for path in paths[p]]
        for p in up[x]:
            roots[x] |= roots[p]
    status = [STATUS[1] if cyclic[x] else STATUS[3] if not released[x] else STATUS[2] if height[x] < 0 else STATUS[0] for x in range(f.n)]
    return {
        "node": name,
        "position": f.position.tolist(),
        "status": status,
        "depth": [depth[x] if released[x] else None for x in range(f.n)],
        "height": [h if h >= 0 else None for h in height.tolist()],
        "roots": [sorted(name[r] for r in roots[x]) if released[x] else None for x in range(f.n)],
        "n_paths": [Decimal(count[x]) if released[x] and count[x] < 10**38 else None for x in range(f.n)],
        "paths": [paths[x] if released[x] else None for x in range(f.n)],
        "parents": [sorted(name[p] for p in up[x]) for x in range(f.n)],
        "descendants": [sorted(name[d] for d in below[x]) for x in range(f.n)],
        "subtree_size": [len(below[x] | {x}) for x in range(f.n)],
    }


_NODE_FIELDS = [
    T.StructField("node", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("depth", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("roots", T.ArrayType(T.StringType())),
    T.StructField("n_paths", T.DecimalType(38, 0)),
    T.StructField("paths", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("descendants", T.ArrayType(T.StringType())),
    T.StructField("subtree_size", T.LongType()),
]
_ARROW = {
    "node": pa.string(), "position": pa.int64(), "status": pa.string(), "depth": pa.int64(), "height": pa.int64(), "roots": pa.list_(pa.string()),
    "n_paths": pa.decimal128(38, 0), "paths": pa.list_(pa.list_(pa.string())), "parents": pa.list_(pa.string()), "descendants": pa.list_(pa.string()), "subtree_size": pa.int64(),
}
_ROWS_AT_ONCE = 2048


def _nested_columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Key, list column, flat ids, flat parent lists (aligned: both lists come from one array of structs)."""
    ids, parents = batch.column(1), batch.column(2)
    return batch.column(0), ids, pc.list_flatten(ids), pc.list_flatten(parents)


def peel_nested(df: DataFrame, key: str, nodes: str, node_id: str, parent_ids: str, listed_paths: int = LISTED_PATHS) -> DataFrame:
    """One row per node of each row's forest: key, node, position, status, depth, height, roots, n_paths, paths, parents, descendants, subtree_size.

    * ids are compared as text without surrounding blanks; items with a null id are no nodes; an id
      listed twice is one node with the parents of both; parents that name no node are ignored.
    * ``depth`` is the longest path from a root; ``height`` the peel round; ``roots`` and ``descendants`` are sorted.
    * ``paths`` holds every root-to-node path; null above ``listed_paths`` of them, where ``n_paths`` and the
      ``parents`` of the node and its ancestors still give them exactly (:func:`ancestor_links`).  ``n_paths`` is exact up to 38 digits, null beyond.
    * ``status``: ``on_cycle`` reaches itself; ``above_cycle`` has a cycle among its descendants; ``below_cycle`` hangs
      below one (depth, roots and paths are null there and on cycles); else ``ok``.
    * null or empty ``nodes``: no rows.  Other columns of ``df`` are left out, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                keys, lists, ids, parents = _nested_columns(whole.slice(at, _ROWS_AT_ONCE))
                f = Forests(lists, ids, parents)
                out = _describe(f, listed_paths)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(f.row)), *(pa.array(out[c], t) for c, t in _ARROW.items())], [key, *_ARROW])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *_NODE_FIELDS])
    return _narrow(df, key, nodes, node_id, parent_ids).mapInArrow(run, schema)


def node_depths(df: DataFrame, key: str, nodes: str, node_id: str, parent_ids: str) -> DataFrame:
    """(key, node, depth) of :func:`peel_nested` without paths and descendants; null depth on and below cycles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, ids, parents = _nested_columns(batch)
            f = Forests(lists, ids, parents)
            depth = f.depths()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(f.row)), f.names.take(pa.array(f.code)), pa.array(depth, mask=depth < 0)], [key, "node", "depth"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("node", T.StringType()), T.StructField("depth", T.LongType())])
    return _narrow(df, key, nodes, node_id, parent_ids).mapInArrow(run, schema)


def forest_summary(df: DataFrame, nodes: str, node_id: str, parent_ids: str) -> DataFrame:
    """Every row of ``df`` but for ``nodes``, with n_nodes, n_links, n_roots, max_depth (-1 without nodes that have one) and has_cycle of its forest; no shuffle."""
    kept = [c for c in df.columns if c != nodes]
    added = ("n_nodes", "n_links", "n_roots", "max_depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, len(kept)
            ids, parents = batch.column(at), batch.column(at + 1)
            f = Forests(ids, pc.list_flatten(ids), pc.list_flatten(parents))
            depth, cyclic, most = f.depths(), np.zeros(n, bool), np.full(n, -1, np.int64)
            np.maximum.at(most, f.row, depth)
            cyclic[f.row[f.on_cycle()]] = True
            root = np.bincount(f.child, minlength=f.n) == 0
            numbers = (np.bincount(f.row, minlength=n), np.bincount(f.row[f.child], minlength=n), np.bincount(f.row[root], minlength=n), most)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(cyclic)], [*kept, *added, "has_cycle"])

    source = df.select(*kept, df[nodes].getField(node_id).alias("_ids"), df[nodes].getField(parent_ids).alias("_parents"))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in added), T.StructField("has_cycle", T.BooleanType())])
    return source.mapInArrow(run, schema)


def cyclic_nodes(df: DataFrame, key: str, nodes: str, node_id: str, parent_ids: str) -> DataFrame:
    """(key, node) of every node that reaches itself: the residual part of :func:`peel_nested` only, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, ids, parents = _nested_columns(batch)
            f = Forests(lists, ids, parents)
            hit = np.flatnonzero(f.on_cycle())
            if len(hit):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(f.row[hit])), f.names.take(pa.array(f.code[hit]))], [key, "node"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("node", T.StringType())])
    return _narrow(df, key, nodes, node_id, parent_ids).mapInArrow(run, schema).distinct()


def _narrow(df: DataFrame, key: str, nodes: str, node_id: str, parent_ids: str) -> DataFrame:
    """Only the key, the ids and the parents reach Python and the scan: fields taken straight from the array are pruned in Parquet."""
    return df.select(df[key], df[nodes].getField(node_id).alias("_ids"), df[nodes].getField(parent_ids).alias("_parents"))


def ancestor_links(described: DataFrame, key: str) -> DataFrame:
    """(key, node, parent) rows: the links that spell out every path of the nodes whose ``paths`` is null."""
    return described.select(key, "node", F.explode("parents").alias("parent"))


#: Tables of messages that a loop keeps before it merges them.
_MOST_PARTS = 12
#: Links that one task takes on: the rest of a table is peeled there once no more are left.
TAIL_LINKS = 200_000


def _all(parts: list[DataFrame]) -> DataFrame:
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    return told


def peel_edges(links: DataFrame, child: str = "child", parent: str = "parent", tail_links: int = TAIL_LINKS) -> DataFrame:
    """Distributed leaf peeling of a table of links: node, height, depth, root, path, n_descendants, in_cycle_part.

    For forests that don't fit into one row.  A null parent marks a root; parents need no row of their own; repeated
    links count once.  A node with several parents has the depth of the longest path and, of those, the path through the smallest parent.
    Nodes that are never peeled lie on a cycle or above one (``in_cycle_part``; height and n_descendants are null), nodes on or below one have no
    depth, root and path.  Columns are cast to string.  An empty table gives an empty result.  :func:`peeled_descendants` gives the
    descendants themselves, a row each, so that no node gathers a list.

    One round per level of height, and one per level of depth.  A round writes the messages of its leaves and the nodes that
    become leaves by them, and nothing of those that go on waiting; messages to nodes still waiting are merged now and then.
    Once at most ``tail_links`` links between waiting nodes are left, one task peels those to the end, so that a few deep chains take no
    rounds of their own.  Rounds end by themselves: each takes at least one node, so there is no limit to the depth.
    """
    down, below, top = _peel(links, child, parent, tail_links)
    told = down.join(below.groupBy("v").agg(F.count("*").alias("n")), "v", "left").join(top, "v", "left")
    peeled = F.col("height").isNotNull()
    return told.select(F.col("v").alias("node"), "height", "depth", "root", "path", F.when(peeled, F.coalesce("n", F.lit(0))).alias("n_descendants"), (~peeled).alias("in_cycle_part"))


def peeled_descendants(links: DataFrame, child: str = "child", parent: str = "parent", tail_links: int = TAIL_LINKS) -> DataFrame:
    """(node, descendant) of every node that leaf peeling takes, distinct."""
    return _peel(links, child, parent, tail_links, upward=False)[1].select(F.col("v").alias("node"), F.col("d").alias("descendant"))


def _peel(links: DataFrame, child: str, parent: str, tail_links: int, upward: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """((v, height) of every node, (v, d) descendants of peeled ones, (v, depth, root, path))."""
    edges = links.select(links[child].cast("string").alias("c"), links[parent].cast("string").alias("p")).filter("c is not null").distinct()
    nodes, _ = write_table(edges.select(F.col("c").alias("v")).union(edges.filter("p is not null").select(F.col("p").alias("v"))).distinct(), "nodes")
    edges, _ = write_table(edges.filter("p is not null"), "edges")
    height, below = _bottom_up(nodes, edges, tail_links)
    return nodes.join(height, "v", "left"), below, _top_down(nodes, edges, tail_links) if upward else None


def _bottom_up(nodes: DataFrame, edges: DataFrame, tail_links: int) -> tuple[DataFrame, DataFrame]:
    """((v, height), (v, d)) of all nodes that are peeled.

    A message (v, d, told) says that d is a descendant of v; told is the sender's height where d is the sender, a child, else null.
    """
    children = edges.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("n"))
    peeled = [write_table(nodes.join(children, "v", "left_anti").select("v", F.lit(0).alias("height")), "leaves")[0]]
    descendants = [nodes.sparkSession.createDataFrame([], "v string, d string")]
    leaves, below, sent = peeled[0], descendants[0], []
    while True:
        up = edges.join(leaves, edges.c == leaves.v).select("p", "c", "height")
        message = up.select(F.col("p").alias("v"), F.col("c").alias("d"), F.col("height").alias("told")).union(up.join(below, up.c == below.v).select(F.col("p").alias("v"), "d", F.lit(None).cast("int").alias("told")))
        message, _ = write_table(message, "message")
        sent.append(message)
        if message.isEmpty():
            break
        waiting = edges.join(_all(peeled).select(F.col("v").alias("c")), "c", "left_anti")
        if waiting.count() <= tail_links:
            heights, pairs = _tail_bottom_up(waiting, children, _all(sent).join(_all(peeled).select("v"), "v", "left_anti"))
            return _all([*peeled, heights]), _all([*descendants, pairs])
        heard = _all(sent).join(message.select("v").distinct(), "v", "left_semi")
        ready = heard.groupBy("v").agg(F.count("told").alias("k"), (F.max("told") + 1).alias("height")).join(children, "v").filter("k = n").select("v", "height")
        leaves, _ = write_table(ready, "leaves")
        below, _ = write_table(heard.join(leaves.select("v"), "v", "left_semi").select("v", "d").distinct(), "below")
        peeled.append(leaves)
        descendants.append(below)
        if len(sent) > _MOST_PARTS:
            sent = [write_table(_all(sent).join(_all(peeled).select("v"), "v", "left_anti").distinct(), "message")[0]]
            peeled, descendants = [write_table(_all(peeled), "peeled")[0]], [write_table(_all(descendants), "below")[0]]
    return _all(peeled), _all(descendants)


def _tail_bottom_up(waiting: DataFrame, children: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rest of the peeling, of a bounded number of links between nodes that wait and the messages to those: one task walks their graph."""
    heard = sent.groupBy("v").agg(F.count("told").alias("k"), (F.max("told") + 1).alias("base")).join(children, "v")
    inner = waiting.select(F.col("c").alias("v")).union(waiting.select("p")).union(heard.filter("k = n").select("v")).distinct()
    base = inner.join(heard.select("v", "base"), "v", "left")
    rows = waiting.select("c", "p", F.lit(None).cast("int").alias("base")).union(base.select(F.col("v").alias("c"), F.lit(None).cast("string").alias("p"), F.coalesce("base", F.lit(0)).alias("base")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, up, down, height = {}, [], [], []

        def at(name: str) -> int:
            if name not in names:
                names[name] = len(names)
                up.append([])
                down.append([])
                height.append(0)
            return names[name]

        for batch in batches:
            for c, p, h in zip(*(x.to_pylist() for x in batch.columns)):
                if p is None:
                    i = at(c)
                    height[i] = max(height[i], h)
                else:
                    i, j = at(c), at(p)
                    up[i].append(j)
                    down[j].append(i)
        left = [len(d) for d in down]
        order = [i for i, n in enumerate(left) if not n]
        for i in order:
            for j in up[i]:
                height[j] = max(height[j], height[i] + 1)
                left[j] -= 1
                if not left[j]:
                    order.append(j)
        listed, out = list(names), []
        for i in order:
            out.append((listed[i], height[i], None))
            seen, todo = set(), list(down[i])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    out.append((listed[i], None, listed[x]))
                    todo += down[x]
            if len(out) > 100_000:
                yield _rows(out, ("v", pa.string()), ("height", pa.int32()), ("d", pa.string()))
                out = []
        if out:
            yield _rows(out, ("v", pa.string()), ("height", pa.int32()), ("d", pa.string()))

    told, _ = write_table(rows.coalesce(1).mapInArrow(walk, "v string, height int, d string"), "tail")
    heights = told.filter("height is not null").select("v", "height")
    inner = told.filter("d is not null").select("v", "d")
    reached = inner.select("v", F.col("d").alias("u")).union(heights.select("v", F.col("v").alias("u")))
    outer = reached.join(sent.select(F.col("v").alias("u"), "d"), "u").select("v", "d")
    return heights, inner.union(outer).distinct()


def _rows(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])


def _top_down(nodes: DataFrame, edges: DataFrame, tail_links: int) -> DataFrame:
    """(v, depth, root, path): each level reads the paths of its parents; a node waits until all its parents have one."""
    parents = edges.groupBy(F.col("c").alias("v")).agg(F.count("*").alias("n"))
    known = nodes.join(parents, "v", "left_anti").select("v", F.lit(0).alias("depth"), F.col("v").alias("root"), F.array("v").alias("path"))
    known, _ = write_table(known, "known")
    parts, sent = [known], []
    while True:
        step = known.join(edges, known.v == edges.p).select(F.col("c").alias("v"), F.struct((-F.col("depth") - 1).alias("depth"), "p", "root", "path").alias("x"))
        step, _ = write_table(step.groupBy("v").agg(F.count("*").alias("k"), F.min("x").alias("x")), "step")
        sent.append(step)
        if step.isEmpty():
            return _all(parts)
        waiting = edges.join(_all(parts).select(F.col("v").alias("p")), "p", "left_anti")
        if waiting.count() <= tail_links:
            return _all([*parts, _tail_top_down(waiting, _all(sent).join(_all(parts).select("v"), "v", "left_anti"), parents)])
        heard = _all(sent).join(step.select("v"), "v", "left_semi").groupBy("v").agg(F.sum("k").alias("k"), F.min("x").alias("x"))
        ready = heard.join(parents, "v").filter("k = n").select("v", (-F.col("x.depth")).alias("depth"), "x.root", F.array_append("x.path", F.col("v")).alias("path"))
        known, _ = write_table(ready, "known")
        parts.append(known)
        if len(sent) > _MOST_PARTS:
            sent = [write_table(_all(sent).join(_all(parts).select("v"), "v", "left_anti").groupBy("v").agg(F.sum("k").alias("k"), F.min("x").alias("x")), "step")[0]]
            parts = [write_table(_all(parts), "known")[0]]


def _tail_top_down(waiting: DataFrame, sent: DataFrame, parents: DataFrame) -> DataFrame:
    """Depths, roots and paths of the nodes still without, of a bounded number of links from nodes that wait: one task walks their graph.

    It tells each node's top, the node of its path that known parents reach, and the nodes from there; the path above the top is joined.
    """
    best = sent.groupBy("v").agg(F.sum("k").alias("k"), F.min("x").alias("x")).join(parents, "v")
    inner = waiting.select(F.col("c").alias("v")).union(waiting.select(F.col("p").alias("v"))).distinct()
    simple = best.join(inner, "v", "left_anti").filter("k = n")
    direct = simple.select("v", (-F.col("x.depth")).alias("depth"), "x.root", F.array_append("x.path", F.col("v")).alias("path"))
    held = best.join(inner, "v", "left_semi")
    rows = waiting.select("c", "p", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("via")).union(held.select(F.col("v").alias("c"), F.lit(None).cast("string").alias("p"), (-F.col("x.depth")).alias("depth"), F.col("x.p").alias("via")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down, first = {}, {}, {}
        for batch in batches:
            for c, p, depth, via in zip(*(x.to_pylist() for x in batch.columns)):
                if p is None:
                    first[c] = (depth, via)
                    up.setdefault(c, [])
                else:
                    up.setdefault(c, []).append(p)
                    up.setdefault(p, [])
                    down.setdefault(p, []).append(c)
        left = {v: len(ps) for v, ps in up.items()}
        order = [v for v, n in left.items() if not n]
        depth, chosen, out = {}, {}, []
        for v in order:
            found = [(-depth[p] - 1, p, True) for p in up[v]] + ([(-first[v][0], first[v][1], False)] if v in first else [])
            far, p, inside = min(found)
            depth[v], chosen[v] = -far, p if inside else None
            for c in down.get(v, ()):
                left[c] -= 1
                if not left[c]:
                    order.append(c)
            part, x = [v], v
            while chosen[x] is not None:
                x = chosen[x]
                part.append(x)
            out.append((v, depth[v], x, part[::-1]))
            if len(out) > 2000:
                yield _rows(out, ("v", pa.string()), ("depth", pa.int32()), ("top", pa.string()), ("part", pa.list_(pa.string())))
                out = []
        if out:
            yield _rows(out, ("v", pa.string()), ("depth", pa.int32()), ("top", pa.string()), ("part", pa.list_(pa.string())))

    told, _ = write_table(rows.coalesce(1).mapInArrow(walk, "v string, depth int, top string, part array<string>"), "tail")
    above = held.select(F.col("v").alias("top"), "x.root", F.col("x.path").alias("head"))
    return direct.union(told.join(above, "top").select("v", "depth", "root", F.concat("head", "part").alias("path")))
