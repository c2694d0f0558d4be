"""Structure-changing operators, one tree a group: rerooting, pruning, ladderised layout.

Rerooting splits an edge, turns the path to the old root around and removes the unary node that is left; distances
between leaves stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..groups import map_groups
from ..sources.newick import NODES, Node, linked, map_tree_lists, map_trees, map_trees_and_sets, node_rows
from . import nodes as N
from .intervals import ordinals

OUT = NODES + ", was_rerooted boolean, reason string"

NO_OUTGROUP = "outgroup not in the tree"


def suppress_unary(root: Node) -> Node:
    """Contract nodes of one child; lengths add up."""
    for n in root.postorder():
        for i, c in enumerate(n.children):
            while len(c.children) == 1:
                g = c.children[0]
                g.length = (g.length or 0.0) + (c.length or 0.0) if g.length is not None or c.length is not None else None
                g.parent, n.children[i], c = n, g, g
    while len(root.children) == 1 and root.children[0].children:
        root = root.children[0]
        root.parent = root.length = None
    return root


def on_edge(root: Node, below: Node, at: float) -> Node:
    """A new root on the edge above ``below``, ``at`` from it."""
    if below.parent is None:
        return root
    total = below.length
    up, new = below.parent, Node()
    up.children.remove(below)
    below.parent, below.length = new, (None if total is None else at)
    new.children.append(below)
    carry, prev, now = (None if total is None else total - at), new, up
    while now is not None:
        nxt, length = now.parent, now.length
        if nxt is not None:
            nxt.children.remove(now)
        now.parent, now.length = prev, carry
        prev.children.append(now)
        prev, carry, now = now, length, nxt
    while not prev.children and prev is not new:  # an old root, and nodes under it, with no child but the one on the way
        prev.parent.children.remove(prev)
        prev = prev.parent
    return suppress_unary(new)


def mrca_of(root: Node, names: set[str]) -> Node | None:
    want = len(names)
    count: dict[int, set[str]] = {}
    for n in root.postorder():
        kids = [count.pop(id(c)) for c in n.children]
        s = max(kids, key=len) if kids else {n.label} & names
        for k in kids:
            if k is not s:
                s |= k
        if len(s) == want:
            return n
        count[id(n)] = s
    return None


def distances(root: Node, start: Node) -> dict[int, float]:
    """Distances from one node to all, by node identity."""
    out, stack = {id(start): 0.0}, [start]
    while stack:
        n = stack.pop()
        for m, w in [*((c, c.length or 0.0) for c in n.children), *([(n.parent, n.length or 0.0)] if n.parent is not None else [])]:
            if id(m) not in out:
                out[id(m)] = out[id(n)] + w
                stack.append(m)
    return out


def outgroup(root: Node, names: set[str]) -> tuple[Node, bool, str]:
    tips = {t.label for t in root.tips()}
    if not names or not names <= tips:
        return root, False, NO_OUTGROUP
    if names == tips:
        return root, False, "outgroup is the whole tree"
    m = mrca_of(root, names)
    if m.parent is None:  # the outgroup surrounds the root: its complement's edge is the same split
        m = mrca_of(root, tips - names)
        if m.parent is None:
            return root, False, "outgroup is not a clade"
    return on_edge(root, m, m.length or 0.0), True, ""


def midpoint(root: Node) -> tuple[Node, bool, str]:
    """On the middle of the longest path between leaves; the first such path."""
    tips = root.tips()
    if len(tips) < 2:
        return root, False, "fewer than two leaves"
    far = lambda s: max(tips, key=lambda t, d=distances(root, s): d[id(t)])
    a = far(tips[0])
    b = far(a)
    da, db = distances(root, a), distances(root, b)
    total = da[id(b)]
    if total <= 0:
        return root, False, "no positive distance"
    half = total / 2
    for n in root.preorder():
        if n.parent is None:
            continue
        p, tol = n.parent, 1e-9 * total
        on_path = abs(da[id(n)] + db[id(n)] - total) <= tol and abs(da[id(p)] + db[id(p)] - total) <= tol
        d = da if da[id(n)] < da[id(p)] else db
        if on_path and d[id(n)] <= half + tol and d[id(p)] >= half - tol and d[id(p)] > d[id(n)]:
            return on_edge(root, n, min(max(half - d[id(n)], 0.0), n.length or 0.0)), True, ""
    return root, False, "no middle found"


def leaf_variances(root: Node) -> list[tuple[Node, float]]:
    """Each node, in preorder, with the population variance of its distances to all leaves.

    Count, sum and sum of squares of distances are gathered upwards and then moved across each edge: two passes."""
    order = list(root.preorder())
    below: dict[int, tuple[float, float, float]] = {}

    def moved(x: tuple[float, float, float], w: float) -> tuple[float, float, float]:
        n, s, q = x
        return n, s + n * w, q + 2 * w * s + n * w * w

    for v in reversed(order):
        parts = [moved(below[id(c)], c.length or 0.0) for c in v.children]
        below[id(v)] = (sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)) if parts else (1.0, 0.0, 0.0)
    total = {id(root): below[id(root)]}
    out = []
    for v in order:
        if v.parent is not None:
            w = v.length or 0.0
            own, all_of_parent = below[id(v)], total[id(v.parent)]
            there = moved(own, w)
            rest = moved(tuple(a - b for a, b in zip(all_of_parent, there, strict=True)), w)
            total[id(v)] = tuple(a + b for a, b in zip(own, rest, strict=True))
        n, s, q = total[id(v)]
        out.append((v, max(0.0, q / n - (s / n) ** 2)))
    return out


def least_variance(root: Node) -> tuple[Node, bool, str]:
    """At the node whose distances to all leaves have the least population variance; the first in preorder on ties."""
    rows = leaf_variances(root)
    slack = 1e-12 * max(1.0, max(v for _, v in rows))  # sums are moved along paths: equal variances differ by rounding
    least = min(v for _, v in rows)
    where = next(n for n, v in rows if v <= least + slack)
    if where.parent is None:
        return root, False, "the root is the best place"
    return on_edge(root, where, 0.0), True, ""


def ancestor_deviations(root: Node) -> list[tuple[Node, float, float]]:
    """(node, at, deviation) of each edge, in preorder: where on the edge above ``node`` (from it) a root has the least
    ancestor deviation, and that deviation: the root mean square, over all pairs of leaves, of 2 d / D - 1, D being the
    pair's distance and d that of one of them from their ancestor.

    A pair on one side of the edge has its ancestor where its path is nearest to the edge.  So a node counts the pairs
    between its directions other than the edge's: those sums are made once a node, and summed along the way down.  Pairs of
    distance 0 don't count.  All pairs of a tree's leaves are looked at: for trees of some thousands of leaves.
    """
    order, tips = list(root.preorder()), root.tips()
    n = len(tips)
    place = {id(t): i for i, t in enumerate(tips)}
    dist, lo, hi = distances(root, root), {}, {}
    for v in reversed(order):
        lo[id(v)], hi[id(v)] = (lo[id(v.children[0])], hi[id(v.children[-1])]) if v.children else (place[id(v)], place[id(v)] + 1)
    height = np.array([dist[id(t)] for t in tips])
    far = np.zeros((n, n))
    for v in order:
        for i, c in enumerate(v.children):
            a = slice(lo[id(c)], hi[id(c)])
            b = slice(hi[id(c)], hi[id(v)])
            if i < len(v.children) - 1:
                far[a, b] = height[a, None] + height[None, b] - 2 * dist[id(v)]
                far[b, a] = far[a, b].T
    with np.errstate(divide="ignore"):
        near = np.where(far > 0, 1 / far, 0.0)
    pairs = (far > 0).sum() / 2

    def outside(v: Node) -> np.ndarray:
        return np.r_[0 : lo[id(v)], hi[id(v)] : n].astype(int)

    def squares(rows: slice, columns, at: float) -> float:
        """Of pairs of ``rows`` and ``columns`` whose ancestor is at root distance ``at`` above the rows."""
        inverse = near[rows][:, columns]
        return float(((2 * (height[rows] - at)[:, None] * inverse - 1) ** 2 * (inverse > 0)).sum())

    between, above, full = {}, {}, 0.0  # by child: its pairs with the other children, and with what isn't under the parent
    for v in order:
        spans = [slice(lo[id(c)], hi[id(c)]) for c in v.children]
        for i, c in enumerate(v.children):
            others = np.r_[lo[id(v)] : spans[i].start, spans[i].stop : hi[id(v)]].astype(int)
            between[id(c)] = squares(spans[i], others, dist[id(v)])
            above[id(c)] = squares(spans[i], outside(v), dist[id(v)])
        full += sum(between[id(c)] for c in v.children) / 2
    same = {id(root): full}
    out = []
    for v in order:
        if v.parent is None:
            continue
        p = v.parent
        same[id(v)] = same[id(p)] - between[id(v)] + sum(above[id(c)] for c in p.children) - above[id(v)]
        rows, rest, w = slice(lo[id(v)], hi[id(v)]), outside(v), v.length or 0.0
        inverse = near[rows][:, rest]
        weight = inverse * inverse
        down = (height[rows] - dist[id(v)])[:, None]
        total = float(weight.sum())
        at = min(max(float(((far[rows][:, rest] - 2 * down) * weight).sum()) / (2 * total), 0.0), w) if total > 0 else 0.0
        across = float(((2 * (down + at) * inverse - 1) ** 2 * (inverse > 0)).sum())
        out.append((v, at, float(np.sqrt(max(0.0, same[id(v)] + across) / max(pairs, 1)))))
    return out


#: Cells (ordered pairs of leaves times levels) of trees that are summed at once; a larger tree is taken alone.
CELLS = 400_000


def many_deviations(roots: list[Node]) -> Iterator[tuple[list[Node], np.ndarray, np.ndarray]]:
    """(nodes, at, deviation) of each tree's edges: see ancestor_deviations(); small trees share their arrays."""
    some, pairs, levels = [], 0, 0
    for root in roots:
        depth, leaves = {}, 0
        for v in (order := list(root.preorder())):
            depth[id(v)] = depth[id(v.parent)] + 1 if v is not root else 0
            leaves += not v.children
        height = max(depth.values()) + 1
        if some and (pairs + leaves**2) * max(levels, height) > CELLS:
            yield from shared_deviations(some)
            some, pairs, levels = [], 0, 0
        if leaves**2 * height > CELLS:
            rows = ancestor_deviations(root)
            yield [v for v, _, _ in rows], np.array([a for _, a, _ in rows]), np.array([d for _, _, d in rows])
        else:
            some.append(order)
            pairs, levels = pairs + leaves**2, max(levels, height)
    if some:
        yield from shared_deviations(some)


def shared_deviations(orders: list[list[Node]]) -> Iterator[tuple[list[Node], np.ndarray, np.ndarray]]:
    """many_deviations() of trees given by their nodes in preorder: a cell is a pair of leaves and an edge between them."""
    up, length, depth, dist, tree, tips, ends = [], [], [], [], [], [], [0]
    for t, order in enumerate(orders):
        number = {}
        for v in order:
            k = number[id(v)] = len(up)
            p = k if v is order[0] else number[id(v.parent)]
            up.append(p)
            length.append(v.length or 0.0)
            depth.append(depth[p] + 1 if p != k else 0)
            dist.append(dist[p] + length[k] if p != k else 0.0)
            tree.append(t)
            if not v.children:
                tips.append(k)
        ends.append(len(up))
    up, length, depth, dist, tree, tips = map(np.array, (up, length, depth, dist, tree, tips))
    size, top = len(up), int(depth.max())
    chain, now = np.full((len(tips), top + 1), -1), tips.copy()  # by leaf: its ancestors by level, itself the last
    for level in range(top, -1, -1):
        at = depth[now] == level
        chain[at, level] = now[at]
        now = np.where(at, up[now], now)
    per = np.bincount(tree[tips], minlength=len(orders))
    others, first = per[tree[tips]], (np.cumsum(per) - per)[tree[tips]]
    i = np.repeat(np.arange(len(tips)), others)
    j = np.repeat(first - (np.cumsum(others) - others), others) + np.arange(len(i))
    i, j = i[i != j], j[i != j]
    meet = ((chain[i] == chain[j]) & (chain[i] >= 0)).sum(axis=1) - 1
    far = dist[tips[i]] + dist[tips[j]] - 2 * dist[chain[i, meet]]
    i, meet, far = i[far > 0], meet[far > 0], far[far > 0]
    way, inverse, own_tree = chain[i], 1 / far, tree[tips[i]]
    ratio = 2 * (dist[tips[i]][:, None] - dist[way]) * inverse[:, None] - 1  # 2 d / D - 1 at each level
    total = lambda where, what, n=size: np.bincount(where, what, n)
    pair, level = np.nonzero((np.arange(top + 1) > meet[:, None]) & (way >= 0))
    edge, r, x = way[pair, level], ratio[pair, level], inverse[pair]
    here = ratio[np.arange(len(i)), meet] ** 2
    between = total(way[np.arange(len(i)), np.minimum(meet + 1, top)], here)
    deep = level > meet[pair] + 1
    above = total(edge[deep], ratio[pair[deep], level[deep] - 1] ** 2)
    across, slope, weight = total(edge, r * r), total(edge, r * x), total(edge, x * x)
    same = (total(own_tree, here, len(orders)) / 2)[tree]
    for level in range(1, top + 1):
        v = np.flatnonzero(depth == level)
        same[v] = same[up[v]] - between[v] + across[up[v]] - above[v]
    at = np.minimum(np.maximum(np.divide(-slope, 2 * weight, out=np.zeros(size), where=weight > 0), 0.0), np.where(weight > 0, length, 0.0))
    squares = same + total(edge, (r + 2 * at[edge] * x) ** 2)
    count = np.bincount(own_tree, minlength=len(orders)) / 2
    deviation = np.sqrt(np.maximum(squares, 0.0) / np.maximum(count, 1)[tree])
    for order, a, b in zip(orders, ends, ends[1:], strict=False):
        yield order[1:], at[a + 1 : b], deviation[a + 1 : b]


def rooted_by(root: Node, edges: list[Node], at: np.ndarray, deviation: np.ndarray) -> tuple[Node, bool, str]:
    """On the first edge of the least deviation."""
    if not any(v.length for v in edges):
        return root, False, "no positive distance"
    k = int(np.argmax(deviation <= deviation.min() + 1e-12))
    return on_edge(root, edges[k], float(at[k])), True, ""


def least_deviation(root: Node) -> tuple[Node, bool, str]:
    """On the edge, and at the place on it, of the least ancestor deviation; the first edge in preorder on ties."""
    if len(root.tips()) < 2:
        return root, False, "fewer than two leaves"
    return rooted_by(root, *next(many_deviations([root])))


def edge_deviations(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, at, deviation): see ancestor_deviations(); the edge is the one above the node."""

    def run(roots: list[Node], firsts: list[tuple]) -> Iterator[tuple]:
        for first, (_, at, deviation) in zip(firsts, many_deviations(roots), strict=True):
            yield from ((first[0], k, a, d) for k, (a, d) in enumerate(zip(at.tolist(), deviation.tolist(), strict=True), 1))

    return map_tree_lists(nodes, run, "tree_id string, node_id int, at double, deviation double")


def rooted_deviations(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, branch_length, n_leaves, n_tips, before, deviation): trees of two leaves or more are rooted at the
    least ancestor deviation, ``before``, and each edge then has ``deviation``.  The two edges at a root of two children are
    one here, whose root is taken off: the first, as long as both.

    A tree is read once, where reroot() and edge_deviations() of its outcome would read it three times."""

    def run(roots: list[Node], firsts: list[tuple]) -> Iterator[tuple]:
        kept = [(root, first, sorted(tips)) for root, first in zip(roots, firsts, strict=True) if len(tips := [t.label or "" for t in root.tips()]) > 1]
        least, new = [], []
        for (root, _, tips), found in zip(kept, many_deviations([x[0] for x in kept]), strict=True):
            least.append(float(found[2].min()))
            new.append(rooted_by(root, *found)[0])
            if sorted(t.label or "" for t in new[-1].tips()) != tips:
                raise ValueError("rerooting changed the leaves")
        for (_, first, tips), before, root, (edges, _, deviation) in zip(kept, least, new, many_deviations(new), strict=True):
            below: dict[int, int] = {}
            for v in reversed(edges):
                below[id(v)] = sum(below[id(c)] for c in v.children) or 1
            twin = root.children[1] if len(root.children) == 2 else None
            for k, (v, d) in enumerate(zip(edges, deviation.tolist(), strict=True), 1):
                if v is not twin:
                    length = (v.length or 0.0) + (twin.length or 0.0 if twin and v.parent is root else 0.0)
                    yield first[0], k, length, below[id(v)], len(tips), before, d

    return map_tree_lists(nodes, run, "tree_id string, node_id int, branch_length double, n_leaves int, n_tips int, before double, deviation double")


def node_variances(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, variance): see leaf_variances()."""
    run = lambda root, first: [(first[0], i, v) for i, (_, v) in enumerate(leaf_variances(root))]
    return map_trees(nodes, run, "tree_id string, node_id int, variance double")


def reroot(nodes: DataFrame, method: str, outgroups: DataFrame | None = None) -> DataFrame:
    """``nodes`` of the rerooted trees with was_rerooted and reason; ``method``: outgroup, midpoint, minvar or mad.

    outgroups: (tree_id, names array).  A tree whose leaves would change raises.
    """
    ways = {"midpoint": midpoint, "minvar": least_variance, "mad": least_deviation}
    if method != "outgroup" and method not in ways:
        raise ValueError(f"unknown rooting {method}")

    def rows_of(before: list[str], first: tuple, root: Node, done: bool, why: str) -> list[tuple]:
        if sorted(t.label or "" for t in root.tips()) != before:
            raise ValueError("rerooting changed the leaves")
        return [(*row, done, why) for row in node_rows(first[0], first[1], root)]

    def run(root: Node, first: tuple) -> list[tuple]:
        before = sorted(t.label or "" for t in root.tips())
        return rows_of(before, first, *(outgroup(root, set()) if method == "outgroup" else ways[method](root)))

    def run_outgroup(tree: list[tuple], sets: dict[str, set[str]]) -> list[tuple]:
        root = linked(tree)
        before = sorted(t.label or "" for t in root.tips())
        return rows_of(before, tree[0], *outgroup(root, sets.get("", set())))

    if method != "outgroup" or outgroups is None:
        return map_trees(nodes, run, OUT)
    return map_trees_and_sets(nodes, outgroups.select("tree_id", F.lit("").alias("name"), F.explode("names").alias("label")), run_outgroup, OUT)


def outgroup_clades(nodes: DataFrame, outgroups: DataFrame) -> DataFrame:
    """(tree_id, outgroup, n_members, n_leaves, was_rerooted): each tree rooted at each of its outgroups (tree_id, outgroup,
    label); n_leaves are those of the clade that then holds its members.  An outgroup that the tree lacks leaves of has no
    row.  A tree is read once for all of them."""

    def run(tree: list[tuple], sets: dict[str, set[str]]) -> list[tuple]:
        out, inner = [], {row[3] for row in tree}
        before = sorted(row[4] or "" for row in tree if row[2] not in inner)
        for name, members in sets.items():
            root, done, why = outgroup(linked(tree), members)
            if why == NO_OUTGROUP:
                continue
            if sorted(t.label or "" for t in root.tips()) != before:
                raise ValueError("rerooting changed the leaves")
            out.append((tree[0][0], name, len(members), len(mrca_of(root, members).tips()), done))
        return out

    return map_trees_and_sets(nodes, outgroups.select("tree_id", F.col("outgroup").alias("name"), "label"), run, "tree_id string, outgroup string, n_members int, n_leaves int, was_rerooted boolean")


def prune(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """``nodes`` of the trees restricted to the leaves named in ``keep`` (tree_id, label); unary nodes are contracted.
    Trees with no such leaf go."""

    def run(tree: list[tuple], sets: dict[str, set[str]]) -> list[tuple]:
        root, want = linked(tree), sets.get("", set())
        for n in root.postorder():
            n.children = [c for c in n.children if c.children or (c.label in want and not c.comments.get("_gone"))]
            if not n.children and n.parent is not None and n.label not in want:
                n.comments["_gone"] = "1"
        root = suppress_unary(root)
        return node_rows(tree[0][0], tree[0][1], root) if any(t.label in want for t in root.tips()) else []

    return map_trees_and_sets(nodes, keep.select("tree_id", F.lit("").alias("name"), "label").where("label IS NOT NULL"), run, NODES)


def layout(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, x, y): ladderised coordinates; y counts leaves, an inner node lies amid its children; x is the age
    (largest tip distance minus the node's)."""

    def run(root: Node, first: tuple) -> list[tuple]:
        ids = {id(n): i for i, n in enumerate(root.preorder())}
        size: dict[int, int] = {}
        for n in root.postorder():
            size[id(n)] = sum(size[id(c)] for c in n.children) or 1
            n.children.sort(key=lambda c: size[id(c)])
        y, leaf = {}, 0
        for n in root.preorder():
            if not n.children:
                y[id(n)], leaf = float(leaf), leaf + 1
        for n in root.postorder():
            if n.children:
                y[id(n)] = sum(y[id(c)] for c in n.children) / len(n.children)
        d = distances(root, root)
        top = max(d[id(t)] for t in root.tips())
        return [(first[0], ids[k], top - d[k], v) for k, v in y.items()]

    return map_trees(nodes, run, "tree_id string, node_id int, x double, y double")


def segments(coords: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, kind, x0, y0, x1, y1): a horizontal segment to the parent and a vertical one over the children."""
    c = coords.join(nodes.select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"])
    p = coords.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"))
    flat = c.join(p, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.lit("horizontal").alias("kind"), F.col("px").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    v = c.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    up = v.join(coords.select("tree_id", "node_id", "x"), ["tree_id", "node_id"]).select("tree_id", "node_id", F.lit("vertical").alias("kind"), F.col("x").alias("x0"), "y0", F.col("x").alias("x1"), "y1")
    return flat.unionByName(up)


def digest(root: Node) -> str:
    """A fingerprint of the rooted tree that doesn't depend on the order of children; lengths to 1e-9."""
    import hashlib

    made: dict[int, str] = {}
    for n in root.postorder():
        length = "" if n.length is None else f"{round(n.length, 9):.9f}"
        made[id(n)] = hashlib.sha1(("(" + ",".join(sorted(made.pop(id(c)) for c in n.children)) + ")" + (n.label or "" if not n.children else "") + ":" + length).encode()).hexdigest()
    return made[id(root)]


def tree_digests(nodes: DataFrame) -> DataFrame:
    """(tree_id, digest)"""
    return map_trees(nodes, lambda root, first: [(first[0], digest(root))], "tree_id string, digest string")


def name_internal(nodes: DataFrame, prefix: str = "internal_node_") -> DataFrame:
    """(tree_id, node_id, name): inner nodes without a label, numbered in postorder from 1."""

    def run(root: Node, first: tuple) -> list[tuple]:
        ids = {id(n): i for i, n in enumerate(root.preorder())}
        bare = [n for n in root.postorder() if n.children and not n.label]
        return [(first[0], ids[id(n)], f"{prefix}{i}") for i, n in enumerate(bare, 1)]

    return map_trees(nodes, run, "tree_id string, node_id int, name string")


def collapse(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``nodes`` with the subtrees under ``targets`` (tree_id, node_id) taken out; the target becomes a leaf.

    Numbers are in preorder, so a subtree is the run of numbers from its node's to that of its last leaf."""
    t = targets.select("tree_id", "node_id").distinct().join(nodes.select("tree_id", "node_id", "leaf_hi"), ["tree_id", "node_id"])
    ends = nodes.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("leaf_hi"), F.col("node_id").alias("_end"))
    t = t.join(ends, ["tree_id", "leaf_hi"]).where("_end > node_id").select("tree_id", (F.col("node_id") + 1).alias("_begin"), "_end")
    under = ordinals(t, "_begin", "_end", "node_id").select("tree_id", F.col("node_id").cast("int").alias("node_id")).distinct()
    keep = nodes.join(under, ["tree_id", "node_id"], "left_anti")

    return map_trees(keep, lambda root, first: node_rows(first[0], first[1], root), NODES)


def diameter(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, distance): the farthest pair of leaves of each tree in one pass over it, the first in leaf order on
    ties.  Trees of one leaf have no row.

    A node keeps the farthest leaf beneath it; leaves of different children meet there and nowhere else."""

    def run(root: Node, first: tuple) -> list[tuple]:
        place = {id(t): i for i, t in enumerate(root.tips())}
        best, far = None, {}
        for n in root.postorder():
            here = None if n.children else (0.0, -place[id(n)], n.label)
            for c in n.children:
                d, at, label = far.pop(id(c))
                d += c.length or 0.0
                if here is not None:
                    pair = (here[0] + d, here[1], at, here[2], label)
                    best = pair if best is None or pair[:3] > best[:3] else best
                here = (d, at, label) if here is None or (d, at) > here[:2] else here
            far[id(n)] = here
        return [] if best is None else [(first[0], best[3], best[4], best[0])]

    return map_trees(nodes, run, "tree_id string, a string, b string, distance double")


def farthest_members(members: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, distance, n): of each set of labels (tree_id, by, label) the two farthest apart, the first in leaf order on
    ties; sets of one leaf have no row.

    No pairs are made.  The leaves in order and the nodes where neighbours meet are the set's own small tree: two leaves
    meet at the shallowest of the nodes between them, so a stack of open ancestors finds the best partner of each in turn.
    """
    keys = list(dict.fromkeys(["tree_id", *by]))
    at = members.select(*keys, "label").distinct().join(N.leaves(nodes).select("tree_id", "label", "ord", "root_dist"), ["tree_id", "label"])
    line = at.withColumn("hi", F.lead("ord").over(W.partitionBy(*keys).orderBy("ord")))
    spans = line.where("hi IS NOT NULL").select("tree_id", F.col("ord").alias("lo"), "hi").distinct()
    met = N.smallest_container(spans, nodes, ["tree_id", "lo", "hi"]).select("tree_id", F.col("lo").alias("ord"), "hi", F.col("depth").alias("_meet"), F.col("root_dist").alias("_meet_dist"))
    rows = line.join(met, ["tree_id", "ord", "hi"], "left")
    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def run(group: list[tuple]) -> list[tuple]:
        # of open nodes, deepest last: depth, farthest leaf that meets later ones there, and of this and the nodes above the
        # largest height of such a leaf less twice the node's own
        best, stack = None, []
        for i, row in enumerate(group):
            if i:
                _, before, depth, meet, _ = group[i - 1][width:]
                now = (before, 1 - i)
                while stack and stack[-1][0] >= depth:
                    now = max(now, stack.pop()[1])
                here = (now[0] - 2 * meet, now[1])
                top = max(here, stack[-1][2]) if stack else here
                stack.append((depth, now, top))
                pair = (round(top[0] + row[width + 1], 9), top[1], -i)
                best = pair if best is None or pair > best else best
        if best is None:
            return []
        return [(*group[0][:width], group[-best[1]][width], group[-best[2]][width], best[0], len(group))]

    line = rows.select(*keys, "label", "root_dist", "_meet", "_meet_dist", "ord")
    return map_groups(line, keys, ["ord"], run, f"{kinds}, a string, b string, distance double, n long")
