"""Gene trees as Newick text: parsing, renaming, rerooting, bipartitions, support, bootstraps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

T = TypeVar("T")

_TOKEN = re.compile(r"\s*(?:(\[[^\]]*\])|('(?:[^']|'')*')|([(),:;])|([^\s(),:;'\[\]]+))")
_PLAIN = re.compile(r"[^\s()\[\]{},:;='\"]+\Z")


@dataclass(frozen=True)
class Node:
    label: str | None = None
    length: float | None = None
    children: tuple["Node", ...] = field(default=())


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad Newick text at {at}")
        at = m.end()
        comment, quoted, mark, word = m.groups()
        if quoted:
            yield "label", quoted[1:-1].replace("''", "'")
        elif mark:
            yield mark, mark
        elif word:
            yield "label", word


def _node(tokens: list[tuple[str, str]], at: int) -> tuple[Node, int]:
    """The tree that begins at a token, and the place after it; open brackets are on a stack, however deep."""
    opened: list[list[Node]] = []
    while True:
        while tokens[at][0] == "(":
            opened.append([])
            at += 1
        children: tuple[Node, ...] = ()
        while True:
            label = length = None
            if tokens[at][0] == "label":
                label, at = tokens[at][1], at + 1
            if tokens[at][0] == ":":
                length, at = float(tokens[at + 1][1]), at + 2
            node = Node(label, length, children)
            if not opened:
                return node, at
            opened[-1].append(node)
            if tokens[at][0] != ")":
                break
            children = tuple(opened.pop())
            at += 1
        if tokens[at][0] != ",":
            raise ValueError("expected , or ) in Newick text")
        at += 1


def fold(node: Node, f: Callable[[Node, list[T]], T]) -> T:
    """``f`` of each node and of what it gave for the node's children, from the leaves up, without recursion."""
    done: list[T] = []
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        n, ready = todo.pop()
        if not ready and n.children:
            todo.append((n, True))
            todo += [(c, False) for c in reversed(n.children)]
            continue
        k = len(done) - len(n.children)
        done[k:] = [f(n, done[k:])]
    return done[0]


def parse_trees(text: str) -> list[Node]:
    """All trees of a text; each ends in a semicolon."""
    tokens, at, out = [*_tokens(text), ("end", "")], 0, []
    while tokens[at][0] != "end":
        node, at = _node(tokens, at)
        if tokens[at][0] != ";":
            raise ValueError("a tree has text after its end")
        out.append(node)
        at += 1
    return out


def parse_tree(text: str) -> Node:
    trees = parse_trees(text)
    if len(trees) != 1:
        raise ValueError(f"expected one tree, found {len(trees)}")
    return trees[0]


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def write_tree(node: Node, lengths: bool = True) -> str:
    def text(n: Node, inner: list[str]) -> str:
        out = f"({','.join(inner)})" if inner else ""
        if n.label is not None:
            out += n.label if _PLAIN.match(n.label) else "'" + n.label.replace("'", "''") + "'"
        if lengths and n.length is not None:
            out += ":" + _number(n.length)
        return out

    return fold(node, text) + ";"


def leaves(node: Node) -> frozenset[str]:
    found, todo = set(), [node]
    while todo:
        n = todo.pop()
        todo += n.children
        if not n.children:
            found.add(n.label or "")
    return frozenset(found)


def strip_lengths(node: Node) -> Node:
    return fold(node, lambda n, children: replace(n, length=None, children=tuple(children)))


def rename(node: Node, names: dict[str, str]) -> Node:
    return fold(node, lambda n, children: replace(n, children=tuple(children)) if children else replace(n, label=names.get(n.label or "", n.label)))


def _path_to(node: Node, leaf: str) -> list[int] | None:
    """The way to the leaf's parent: the first in the order of a walk that looks at a node's own leaves first."""
    path: list[int] = []
    todo: list[tuple[Node, int, int]] = [(node, 0, -1)]
    while todo:
        n, depth, k = todo.pop()
        path[max(depth - 1, 0) :] = [k] if depth else []
        if any(not c.children and c.label == leaf for c in n.children):
            return path
        todo += [(c, depth + 1, k) for k, c in reversed(list(enumerate(n.children)))]
    return None


def _squeeze(node: Node) -> Node:
    """Without nodes of one child; lengths add up."""

    def one(n: Node, children: list[Node]) -> Node:
        if len(children) != 1:
            return replace(n, children=tuple(children))
        (only,) = children
        known = [x for x in (only.length, n.length) if x is not None]
        return replace(only, length=sum(known) if known else None)

    return fold(node, one)


def reroot(node: Node, leaf: str) -> Node:
    """Rooted at the leaf's parent; the path from the old root is turned round."""
    path = _path_to(node, leaf)
    if path is None:
        raise ValueError(f"no leaf {leaf}")
    if not path:
        return node
    above: Node | None = None
    for k in path:
        child = node.children[k]
        rest = node.children[:k] + node.children[k + 1 :]
        above = Node(node.label, child.length, rest + ((above,) if above else ()))
        node = child
    return _squeeze(Node(node.label, None, node.children + (above,)))


def bipartitions(node: Node, outgroup: str) -> set[tuple[str, ...]]:
    """Each inner node's side without the outgroup, sorted, if it has more than one leaf and not all."""
    every, out = leaves(node), set()

    def side(n: Node, inner: list[frozenset[str]]) -> frozenset[str]:
        if not n.children:
            return frozenset((n.label or "",))
        own = frozenset().union(*inner)
        kept = every - own if outgroup in own else own
        if 1 < len(kept) < len(every):
            out.add(tuple(sorted(kept)))
        return own

    fold(node, side)
    return out


def topology_key(newick: str, outgroup: str) -> str:
    """Equal for trees of equal leaves and bipartitions."""
    tree = parse_tree(newick)
    return "|".join(sorted(leaves(tree))) + "//" + ";".join(",".join(b) for b in sorted(bipartitions(tree, outgroup)))


def supports(node: Node) -> list[float]:
    """Numeric labels of inner nodes."""
    out = []
    if node.children:
        try:
            out.append(float(node.label))
        except (TypeError, ValueError):
            pass
        for c in node.children:
            out += supports(c)
    return out


def _text_udf(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def of(trees: pd.Series) -> pd.Series:
        return trees.map(f)

    return of


def topology_counts(trees: DataFrame, outgroup: str) -> DataFrame:
    """(topology, n, members): trees (tree_id, newick) of one topology together, by falling count."""
    keyed = trees.withColumn("topology", _text_udf(lambda t: topology_key(t, outgroup))("newick"))
    return keyed.groupBy("topology").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("tree_id")).alias("members")).orderBy(F.col("n").desc(), "topology")


def rename_leaves(trees: DataFrame, names: dict[str, str], reroot_at: str | None = None, right_to_left: bool = False) -> DataFrame:
    """Trees with renamed leaves (hyphens in old names count as underscores), rerooted if asked for."""
    pairs = {v: k for k, v in names.items()} if right_to_left else names
    table = {k.replace("-", "_"): v for k, v in pairs.items()} | pairs

    def change(text: str) -> str:
        tree = rename(parse_tree(text), table)
        return write_tree(reroot(tree, reroot_at) if reroot_at else tree)

    return trees.withColumn("newick", _text_udf(change)("newick"))


def reroot_trees(trees: DataFrame, leaf: str) -> DataFrame:
    return trees.withColumn("newick", _text_udf(lambda t: write_tree(reroot(parse_tree(t), leaf)))("newick"))


def bootstrap_support(trees: DataFrame) -> DataFrame:
    """(section, trees, mean, ci): the mean of the trees' mean support and its 95 % interval; ``trees`` has section, newick."""
    from .sites import confidence_95

    labels = trees.withColumn("support", _text_udf(lambda t: supports(parse_tree(t)), "array<double>")("newick"))
    each = labels.withColumn("mean", F.expr("aggregate(support, 0D, (a, x) -> a + x) / size(support)")).where("size(support) > 0")
    return each.groupBy("section").agg(F.count(F.lit(1)).alias("trees"), F.avg("mean").alias("mean_support"), confidence_95("mean").alias("ci"))


def bootstrap_replicates(loci: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, slot, locus): as many draws with replacement as there are loci, by hashes of the seed."""
    n = loci.select("locus").distinct().count()
    numbered = loci.select("locus").distinct().withColumn("place", F.row_number().over(Window.orderBy("locus")) - 1)
    slots = loci.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("slot")) if n else loci.sparkSession.range(0).select(F.col("id").alias("replicate"), F.lit(0).alias("slot"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string")).cast("binary"))
    drawn = F.pmod(F.conv(F.left(hashed, F.lit(12)), 16, 10).cast("long"), F.lit(max(1, n))).cast("int")
    return slots.withColumn("place", drawn).join(numbered, "place").select("replicate", "slot", "locus")


def bootstrap_counts(drawn: DataFrame) -> DataFrame:
    """How often each locus was drawn over all replicates."""
    return drawn.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))


def sort_bootstraps(drawn: DataFrame, trees: DataFrame) -> DataFrame:
    """(replicate, slot, locus, newick): each slot gets the next unused bootstrap tree of its locus.

    ``trees`` has locus, line (its place in the locus's file), newick.
    """
    nth = F.row_number().over(Window.partitionBy("locus").orderBy("replicate", "slot"))
    place = F.row_number().over(Window.partitionBy("locus").orderBy("line"))
    return drawn.withColumn("nth", nth).join(trees.withColumn("nth", place), ["locus", "nth"]).select("replicate", "slot", "locus", "newick")
