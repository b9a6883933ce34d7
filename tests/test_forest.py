import math
import random

import pytest
from pyspark.sql import functions as F

from arborfair.operators.forest import Forest
from arborfair.operators.tree import Tree, TreeNode
from arborfair.operators.treeset import TreeSet

NUMERIC = ["x0", "x1", "odd name`"]
WORDS = ["a", "it's", "b\\c", "d,e"]


def grown(rnd, depth, branches="LR", full=False):
    nodes = {}

    def visit(path):
        if len(path) == depth or (not full and path and rnd.random() < 0.25):
            nodes[path] = TreeNode(path, prediction=rnd.randrange(5))
            return
        if rnd.random() < 0.7:
            cut = rnd.choice([rnd.random(), float("inf"), float("-inf"), 0.5])
            nodes[path] = TreeNode(path, feature=rnd.choice(NUMERIC), is_numeric=True, threshold=cut)
        else:
            nodes[path] = TreeNode(path, feature="word", is_numeric=False, left_categories=tuple(rnd.sample(WORDS, rnd.randint(1, 3))))
        for b in branches:
            visit(path + b)

    visit("")
    return Tree(nodes, branches)


def walked(tree, row):
    path = ""
    while not (node := tree.nodes[path]).is_leaf:
        v = row[node.feature]
        if node.is_numeric:
            yes = v is not None and not math.isnan(v) and v <= node.threshold
        else:
            yes = v in node.left_categories
        path += tree.branches[0 if yes else 1]
    return path, node.prediction


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    pick = lambda: rnd.choice([None, float("nan"), float("inf"), 0.5, rnd.random(), rnd.random(), rnd.random()])
    rows = [(pick(), pick(), pick(), rnd.choice([None, "", "new", *WORDS]), i) for i in range(40)]
    return spark.createDataFrame(rows, "x0 double, x1 double, `odd name``` double, word string, _all int").repartition(3)


def test_thousand_deep_trees_in_one_projection(table):
    rnd = random.Random(4)
    trees = [grown(rnd, 8, "TF" if i % 2 else "LR") for i in range(1000)]
    forest = Forest(trees)
    rows = table.select("*", forest.predictions().alias("p"), forest.leaf_ids().alias("at")).collect()
    for r in rows[:10]:
        want = [walked(t, r.asDict()) for t in trees]
        assert (r["at"], r["p"]) == ([w[0] for w in want], [w[1] for w in want])
    assert len(rows) == 40 and all(len(r["p"]) == 1000 for r in rows)


def test_forest_equals_nested_conditions(table):
    rnd = random.Random(5)
    trees = [grown(rnd, d, b) for d in (1, 2, 5) for b in ("LR", "TF")] + [Tree({"": TreeNode("", prediction=3)})]
    for r in Forest(trees).score(table, "p").select("*", *[t.predict().alias(f"want_{i + 1}") for i, t in enumerate(trees)]).collect():
        assert [r[f"p_{i + 1}"] for i in range(len(trees))] == [r[f"want_{i + 1}"] for i in range(len(trees))]
    assert Forest(trees).score(table).columns == [*table.columns, *[f"prediction_{i + 1}" for i in range(len(trees))]]


def test_no_trees_single_leaves_and_real_predictions(spark, table):
    assert Forest([]).score(table).columns == table.columns
    assert {tuple(r[0]) for r in table.select(Forest([]).predictions()).collect()} == {()}
    leaf = Tree({"": TreeNode("", prediction=2.5)}, integer_labels=False)
    assert {tuple(r[0]) for r in table.select(Forest([leaf, leaf]).predictions()).collect()} == {(2.5, 2.5)}
    assert Forest([leaf]).score(table.where(F.lit(False))).collect() == []


def test_tree_set_scores_its_best_trees(table):
    rnd = random.Random(6)
    found = TreeSet([grown(rnd, 3) for _ in range(5)])
    for r in found.score(table, 3).select("*", *[found.predict(i).alias(f"w{i}") for i in range(3)]).collect():
        assert [r.prediction_1, r.prediction_2, r.prediction_3] == [r.w0, r.w1, r.w2]
    assert found.score(table, 9).columns[-1] == "prediction_5"


def test_plan_grows_with_depth_not_with_trees(table):
    rnd = random.Random(7)
    size = lambda n: len(Forest([grown(rnd, 4, full=True) for _ in range(n)]).positions()._jc.toString().split("transform"))
    assert size(2) == size(300)
