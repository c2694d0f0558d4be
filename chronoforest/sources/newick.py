"""Trees: one iterative parser and writer for Newick, NHX and NEXUS text, as DataFrame sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..groups import batch_of, map_group_lists, map_groups, values_of

NODES = (
    "tree_id string, tree_ordinal int, node_id int, parent_id int, child_index int, label string, branch_length double, is_leaf boolean, is_root boolean, "
    "depth int, root_dist double, leaf_lo int, leaf_hi int, n_leaves int, comments map<string,string>"
)
_TOKEN = re.compile(r"'(?:[^']|'')*'|\[[^\[\]]*\]|[(),:;]|[^\s(),:;\[\]']+|\[")
_PLAIN = re.compile(r"[(),:;]|[^\s(),:;]+")
_PAIR = re.compile(r"&{0,2}([^=,{}\s]+)=(\{[^}]*\}|[^,\]]+)")


class Node:
    __slots__ = ("label", "length", "children", "parent", "comments")

    def __init__(self, parent: Node | None = None):
        self.label, self.length, self.children, self.parent, self.comments = None, None, [], parent, {}

    def preorder(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def postorder(self) -> list[Node]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n)
            stack.extend(n.children)
        return out[::-1]

    def tips(self) -> list[Node]:
        return [n for n in self.preorder() if not n.children]


class NewickError(ValueError):
    pass


def decode(raw: bytes) -> str:
    """UTF-8 (a byte order mark goes), else GBK, else GB18030."""
    for name in ("utf-8-sig", "gbk", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise NewickError("text in no known encoding")


def comment_pairs(text: str) -> dict[str, str]:
    body = text.strip("[]").lstrip("&")
    body = body.removeprefix("NHX").lstrip(":").replace(":", ",") if body.startswith("NHX") else body
    return {k: v.strip() for k, v in _PAIR.findall(body)}


def tokens(text: str) -> Iterator[str]:
    if not any(c in text for c in "[]'"):
        yield from _PLAIN.findall(text)
        return
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == "[":  # comments nest
            depth, end = 0, at
            while end < len(text):
                depth += {"[": 1, "]": -1}.get(text[end], 0)
                end += 1
                if not depth:
                    break
            if depth:
                raise NewickError("open comment")
            yield text[at:end]
            at = end
            continue
        m = _TOKEN.match(text, at)
        if not m or m[0] == "'":
            raise NewickError(f"bad character at {at}")
        yield m[0]
        at = m.end()


def parse(text: str) -> Node:
    """The first tree of ``text``.  Non-finite or unreadable lengths are missing; a PHYLIP-like count line is skipped."""
    lines = text.strip().split("\n", 1)
    if len(lines) == 2 and re.fullmatch(r"\s*\d+(\s+\d+)?\s*", lines[0]):
        text = lines[1]
    root = now = Node()
    state, opened, closed, after_child = "start", 0, False, False
    for t in tokens(text):
        if t[0] == "[":
            now.comments |= comment_pairs(t)
        elif t == "(":
            if after_child or now.label is not None or now.children:
                raise NewickError("unexpected (")
            child = Node(now)
            now.children.append(child)
            now, opened, state, after_child = child, opened + 1, "label", False
        elif t == ",":
            if now.parent is None:
                raise NewickError("comma outside brackets")
            child = Node(now.parent)
            now.parent.children.append(child)
            now, state, after_child = child, "label", False
        elif t == ")":
            if now.parent is None:
                raise NewickError("unbalanced )")
            now, opened, state, after_child = now.parent, opened - 1, "label", True
        elif t == ":":
            state = "length"
        elif t == ";":
            closed = True
            break
        elif state == "length":
            try:
                v = float(t)
                now.length = v if v == v and abs(v) != float("inf") else None
            except ValueError:
                now.length = None
            state = "done"
        else:
            if now.label is not None:
                raise NewickError("two labels")
            now.label = t[1:-1].replace("''", "'") if t[0] == "'" else t
    if opened or now is not root:
        raise NewickError("unbalanced (")
    if not root.children and root.label is None:
        raise NewickError("empty tree")
    del closed
    return root


_NEEDS_QUOTES = re.compile(r"[\s(),:;\[\]']")


def quoted(label: str | None) -> str:
    if not label:
        return ""
    return "'" + label.replace("'", "''") + "'" if _NEEDS_QUOTES.search(label) else label


def fixed(x: float) -> str:
    """A number without an exponent."""
    s = f"{x:.12f}".rstrip("0")
    return s + "0" if s.endswith(".") else s


def note_of(pairs: dict[str, str], style: str) -> str:
    """A node's comments: ``[&k=v,...]``, or ``[&&NHX:k=v:...]`` with style nhx."""
    body = [f"{k}={v}" for k, v in sorted(pairs.items())]
    return "" if not body else "[&&NHX:" + ":".join(body) + "]" if style == "nhx" else "[&" + ",".join(body) + "]"


def write(root: Node, lengths: bool = True, labels: bool = True, comments: bool = False, style: str = "plain") -> str:
    """Newick text; with ``comments`` and style nhx the comment follows the length, as NHX has it."""
    text: dict[int, str] = {}
    for n in root.postorder():
        kids = "(" + ",".join(text.pop(id(c)) for c in n.children) + ")" if n.children else ""
        name = quoted(n.label) if labels or not n.children else ""
        note = note_of(n.comments, style) if comments else ""
        length = f":{fixed(n.length)}" if lengths and n.length is not None else ""
        text[id(n)] = kids + name + (length + note if style == "nhx" else note + length)
    return text[id(root)] + ";"


def pieces(text: str, at: str) -> list[str]:
    """``text`` cut at each ``at`` outside quotes and bracket comments; the rest after the last one included."""
    out, start, quote, depth = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and not depth:
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth = max(depth - 1, 0)
        elif c == at and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def unquoted(name: str) -> str:
    q = name[:1]
    return name[1:-1].replace(q * 2, q) if len(name) > 1 and q in "'\"" and name.endswith(q) else name


def statements(text: str) -> list[str]:
    """Newick texts of a file: the TREE statements of a NEXUS file with its TRANSLATE table applied, else one a ``;``."""
    parts = pieces(text, ";")
    if not text.lstrip().upper().startswith("#NEXUS"):
        return [p.strip() + ";" * (i < len(parts) - 1) for i, p in enumerate(parts) if p.strip()]
    table, named = {}, []
    for p in parts:
        words = p.strip()
        if m := re.match(r"translate\b", words, re.I):
            pairs = (x.strip().split(None, 1) for x in pieces(words[m.end() :], ","))
            table = {unquoted(x[0]): unquoted(x[1].strip()) for x in pairs if len(x) == 2}
        elif m := re.match(r"u?tree\b\s*[^=]+=\s*(?:\[&[RU]\]\s*)?", words, re.I):
            named.append(words[m.end() :].strip() + ";")
    if not table:
        return named
    out = []
    for t in named:
        root = parse(t)
        for tip in root.tips():
            tip.label = table.get(tip.label, tip.label)
        out.append(write(root, comments=True))
    return out


def node_rows(tree_id: str, ordinal: int, root: Node) -> list[tuple]:
    order = list(root.preorder())
    ids = {id(n): i for i, n in enumerate(order)}
    depth, dist, lo, hi, leaf = {}, {}, {}, {}, 0
    place = {id(root): 0}
    for n in order:
        p = n.parent
        place.update((id(c), k) for k, c in enumerate(n.children))
        depth[id(n)] = depth[id(p)] + 1 if p is not None else 0
        dist[id(n)] = dist[id(p)] + (n.length or 0.0) if p is not None else 0.0
        if not n.children:
            leaf += 1
            lo[id(n)] = hi[id(n)] = leaf
    for n in reversed(order):
        if n.children:
            lo[id(n)], hi[id(n)] = lo[id(n.children[0])], hi[id(n.children[-1])]
    return [
        (tree_id, ordinal, i, ids[id(n.parent)] if n.parent is not None else None, place[id(n)], n.label, n.length, not n.children, n.parent is None, depth[id(n)], dist[id(n)], lo[id(n)], hi[id(n)], hi[id(n)] - lo[id(n)] + 1, n.comments or None)
        for i, n in enumerate(order)
    ]


_COLUMNS = [c.split()[0] for c in NODES.replace("map<string,string>", "map").split(", ")]


#: Node rows that a task returns at once.
NODES_AT_ONCE = 20_000


def parse_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, findings) of trees (tree_id, tree_ordinal, newick).  A text that is no tree is a finding, not a failure.

    Rows are given on as soon as there are NODES_AT_ONCE of them, so a task holds these and one tree."""

    schema = NODES + ", error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batches:
            for tree_id, ordinal, text in zip(*map(values_of, b.columns), strict=True):
                try:
                    out += [(*row, None) for row in node_rows(tree_id, ordinal, parse(text or ""))]
                except NewickError as e:
                    out.append((tree_id, ordinal, *[None] * (len(_COLUMNS) - 2), str(e)))
                if len(out) >= NODES_AT_ONCE:
                    yield batch_of(out, schema)
                    out = []
        if out:
            yield batch_of(out, schema)

    all_ = trees.select("tree_id", F.col("tree_ordinal").cast("int").alias("tree_ordinal"), "newick").mapInArrow(run, schema)
    bad = all_.where("error IS NOT NULL").select("tree_id", F.lit("parse").alias("check"), F.lit("error").alias("severity"), F.col("error").alias("detail"))
    return all_.where("error IS NULL").drop("error"), bad


def read_trees(spark: SparkSession, path: str, mode: str = "split") -> DataFrame:
    """trees (tree_id, tree_ordinal, source, newick) of files; ``mode``: split (all), first, last, random or error (a file
    with several trees raises when it is read)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, i, s) for p, c in zip(b["path"], b["content"], strict=True) for i, s in enumerate(statements(decode(c)))]
            yield pd.DataFrame(out, columns=["source", "tree_ordinal", "newick"])

    rows = files.mapInPandas(run, "source string, tree_ordinal int, newick string")
    return pick(rows.select(F.concat_ws("#", "source", "tree_ordinal").alias("tree_id"), "tree_ordinal", "source", "newick"), mode)


def pick(trees: DataFrame, mode: str) -> DataFrame:
    """One tree a source, by ``mode``."""
    if mode == "split":
        return trees
    rank = {"first": F.col("tree_ordinal"), "last": -F.col("tree_ordinal"), "random": F.xxhash64("source", "tree_ordinal"), "error": F.col("tree_ordinal")}
    if mode not in rank:
        raise ValueError(f"unknown mode {mode}")
    best = trees.groupBy("source").agg(F.min_by(F.struct(*trees.columns), rank[mode]).alias("t"), F.count("*").alias("n"))
    if mode == "error":
        best = best.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several trees in "), "source"))).otherwise(F.col("n"))).where("n = 1")
    return best.select("t.*")


#: What a linked tree is made of.
PARTS = ("tree_id", "tree_ordinal", "node_id", "parent_id", "label", "branch_length", "comments")


def linked(rows: list[tuple]) -> Node:
    """The tree of node rows (as PARTS, in order of node_id)."""
    made: dict[int, Node] = {}
    root = None
    for row in rows:
        _, _, node, parent, label, length, comments = row[:7]
        n = Node(None if parent is None else made[parent])
        n.label, n.length, n.comments = label, length, dict(comments or {})
        made[node] = n
        if parent is None:
            root = n
        else:
            n.parent.children.append(n)
    return root


def tree_parts(nodes: DataFrame, *more: str) -> DataFrame:
    """PARTS, then ``more``, of node rows."""
    have = nodes.columns
    gaps = {"tree_ordinal": F.lit(0), "comments": F.lit(None).cast("map<string,string>")}
    return nodes.select(*(F.col(c) if c in have else gaps[c].alias(c) for c in PARTS), *more)


def map_trees(nodes: DataFrame, run: Callable[[Node, tuple], list[tuple]], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``run`` makes of each tree and its first row (PARTS, then ``more``)."""
    return map_groups(tree_parts(nodes, *more), ["tree_id"], ["node_id"], lambda group: run(linked(group), group[0]), schema)


def map_tree_lists(nodes: DataFrame, run: Callable[[list[Node], list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of several trees and their first rows."""
    return map_group_lists(tree_parts(nodes), ["tree_id"], ["node_id"], lambda groups: run([linked(g) for g in groups], [g[0] for g in groups]), schema)


def map_trees_and_sets(nodes: DataFrame, sets: DataFrame, run: Callable[[list[tuple], dict[str, set[str]]], list[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of each tree's rows (PARTS, for ``linked``) and its sets of labels, by name; sets: tree_id, name, label.

    Labels travel as rows beside the nodes: on each of a tree's rows they would take the square of its leaves."""
    rows = tree_parts(nodes).withColumn("_name", F.lit(None).cast("string"))
    known = {"tree_id": F.col("tree_id"), "label": F.col("label"), "_name": F.col("name")}
    beside = sets.select(*(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema))

    def split(group: list[tuple]) -> list[tuple]:
        first = next((i for i, row in enumerate(group) if row[2] is not None), None)  # nodes follow, as they have numbers
        if first is None:
            return []
        named: dict[str, set[str]] = {}
        for row in group[:first]:
            named.setdefault(row[7], set()).add(row[4])
        return run(group[first:], named)

    return map_groups(rows.unionByName(beside), ["tree_id"], ["node_id"], split, schema)


def write_trees(nodes: DataFrame, **options) -> DataFrame:
    """(tree_id, newick) of a node table."""
    kind = nodes.schema["tree_id"].dataType.simpleString()
    return map_trees(nodes, lambda root, first: [(first[0], write(root, **options))], f"tree_id {kind}, newick string")


def text_findings(trees: DataFrame) -> DataFrame:
    """(tree_id, check, severity, detail) of checks on the text itself."""
    t = F.col("newick")
    bare = F.regexp_replace(t, r"'(?:[^']|'')*'", "")
    marks = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c.isin("(", ")")), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"), F.least(a["low"], a["d"] + F.when(c == "(", 1).otherwise(-1)).alias("low")),
    )
    checks = [
        ("unbalanced_bracket", "error", (marks["d"] != 0) | (marks["low"] < 0)),
        ("control_character", "error", t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
        ("bidi_character", "error", t.rlike(r"[‪-‮⁦-⁩]")),
        ("zero_width_character", "error", t.rlike(r"[​-‍⁠﻿]")),
        ("empty_name", "warning", bare.rlike(r"[(,]\s*[,)]|[(,]\s*:")),
        ("self_loop", "error", bare.rlike(r"\(([^\s(),:;]+):0(?:\.0*)?\)\1(?=[,:);])")),
        ("several_trees", "warning", F.size(F.filter(F.split(bare, ";"), lambda x: F.trim(x) != "")) > 1),
        ("long_name", "error", F.exists(F.split(bare, r"[(),:;]"), lambda x: F.length(x) > 4096)),
        ("empty", "error", F.trim(t) == ""),
    ]
    all_ = F.array(*[F.when(c, F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"))) for k, s, c in checks])
    return trees.select("tree_id", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("f")).select("tree_id", "f.*", F.lit("").alias("detail"))


_LENGTH = r":\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def length_scan(trees: DataFrame) -> DataFrame:
    """(tree_id, n_lengths, n_negative, n_zero, longest) of the lengths in a text, whether it parses or not; what stands in
    quotes or brackets is passed over.  A text without lengths has counts of 0 and a null ``longest``."""
    bare = F.regexp_replace("newick", r"'(?:[^']|'')*'|\"[^\"]*\"|\[[^\[\]]*\]", "x")
    found = F.transform(F.regexp_extract_all(bare, F.lit(_LENGTH), 1), lambda x: x.cast("double"))
    rows = trees.select("tree_id", F.coalesce(found, F.array().cast("array<double>")).alias("v"))
    count = lambda test: F.size(F.filter("v", test))
    return rows.select("tree_id", F.size("v").alias("n_lengths"), count(lambda x: x < 0).alias("n_negative"), count(lambda x: x == 0).alias("n_zero"), F.array_max("v").alias("longest"))


def nexus_texts(trees: DataFrame) -> DataFrame:
    """(source, text): one NEXUS file a source, its trees in order; trees: source, tree_ordinal, tree_id, newick."""
    name = F.concat(F.lit("'"), F.replace(F.col("tree_id"), F.lit("'"), F.lit("''")), F.lit("'"))
    line = F.concat(F.lit("\tTREE "), name, F.lit(" = [&R] "), "newick", F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tree_ordinal", line.alias("line")))), lambda x: x["line"]), "")
    return trees.groupBy("source").agg(F.concat(F.lit("#NEXUS\nBEGIN TREES;\n"), body, F.lit("END;\n")).alias("text"))
