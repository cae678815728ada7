import random

import pytest

from locusframe.operators import trees as T


def random_tree(rng, names):
    if len(names) == 1:
        return T.Node(names[0], rng.choice([None, 1.0, 0.5]))
    cuts = sorted(rng.sample(range(1, len(names)), min(len(names) - 1, rng.randint(1, 2))))
    parts = [names[a:b] for a, b in zip([0, *cuts], [*cuts, len(names)])]
    return T.Node(rng.choice([None, "90"]), rng.choice([None, 2.0]), tuple(random_tree(rng, p) for p in parts))


def test_round_trip_and_reroot():
    rng = random.Random(8)
    for _ in range(200):
        names = [f"t{k}" for k in range(rng.randint(3, 9))]
        tree = random_tree(rng, names)
        text = T.write_tree(tree)
        assert T.write_tree(T.parse_tree(text)) == text
        leaf = rng.choice(names)
        turned = T.reroot(tree, leaf)
        assert T.leaves(turned) == set(names)
        assert any(c.label == leaf for c in turned.children)
        assert T.bipartitions(turned, leaf) == T.bipartitions(T._squeeze(tree), leaf)


def test_parsing():
    tree = T.parse_tree("('a b':1e-2,'it''s'[comment]:2,(c,d)0.9:3)root;")
    assert T.leaves(tree) == {"a b", "it's", "c", "d"} and tree.label == "root" and tree.children[0].length == 0.01
    assert T.write_tree(T.strip_lengths(tree)) == "('a b','it''s',(c,d)0.9)root;"
    assert len(T.parse_trees("(a,b);\n(c,d);")) == 2
    for bad in ("(a,b)", "(a,b);x", "(a;b);", "(a,b);(c,d);"):
        with pytest.raises((ValueError, IndexError)):
            T.parse_tree(bad)


def test_topologies(spark):
    rows = [("1", "((a,b),c,d);"), ("2", "((c,d),a,b);"), ("3", "((a,c),b,d);")]
    got = T.topology_counts(spark.createDataFrame(rows, "tree_id string, newick string"), "d").collect()
    assert [(r.n, r.members) for r in got] == [(2, ["1", "2"]), (1, ["3"])]


def test_support_and_bootstraps(spark):
    df = spark.createDataFrame([("s", "((a,b)90,c);"), ("s", "((a,b)80,c);"), ("s", "(a,b);")], "section string, newick string")
    (row,) = T.bootstrap_support(df).collect()
    assert row.trees == 2 and row.mean_support == 85 and abs(row.ci - 9.8) < 1e-9
    drawn = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "x")], "replicate long, slot long, locus string")
    lines = spark.createDataFrame([("x", 5, "x5"), ("x", 9, "x9"), ("y", 1, "y1")], "locus string, line long, newick string")
    assert {tuple(r) for r in T.sort_bootstraps(drawn, lines).collect()} == {(0, 0, "x", "x5"), (0, 1, "y", "y1"), (1, 0, "x", "x9")}
    loci = spark.createDataFrame([("x",), ("y",)], "locus string")
    counts = T.bootstrap_counts(T.bootstrap_replicates(loci, 50, 1)).collect()
    assert sum(r.n for r in counts) == 100
    renamed = T.rename_leaves(spark.createDataFrame([("1", "(a_x:1,b);")], "tree_id string, newick string"), {"a-x": "Alpha beta"}).first()
    assert renamed.newick == "('Alpha beta':1,b);"


def test_deep_trees():
    """A caterpillar of more levels than Python's recursion allows."""
    n = 5000
    text = "(" * n + "a" + "".join(f",b{k}:1)" for k in range(n)) + ";"
    tree = T.parse_tree(text)
    assert T.write_tree(tree) == text and len(T.leaves(tree)) == n + 1
    assert T.write_tree(T.rename(T.strip_lengths(tree), {"a": "c"})).startswith("(" * n + "c,b0)")
    small = T.parse_tree("(" * 1500 + "a" + "".join(f",b{k})" for k in range(1500)) + ";")
    turned = T.reroot(small, "a")
    assert T.leaves(turned) == T.leaves(small) and {"a", "b0"} <= {c.label for c in turned.children}


def test_own_leaves_come_first():
    tree = T.parse_tree("((x,(y,z)p)q,(y,w)r)s;")
    assert T._path_to(tree, "z") == [0, 1] and T._path_to(tree, "w") == [1] and T._path_to(tree, "s") is None
