"""The registered queries: each operator over whole tables, with labels derived from them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import entropy, gini, variance
from .operators import cleaning, fairness, metrics
from .operators.binarize import fit_midpoints, kept_values, vocabulary
from .operators.cart import fit_cart, fit_cart_on_tests
from .operators.forest import Forest
from .operators.greedy import feature_gains, rank_features
from .operators.lookahead import greedy_tree, lookahead_tree, optimal_tree
from .operators.patterns import compact
from .operators.rollout import rollout_tree
from .operators.splits import (
    Statistics,
    best_category_prefix,
    best_category_subset,
    best_numeric,
    best_splits,
    category_statistics,
    node_statistics,
    numeric_candidates,
)
from .operators.split import mark_test_rows
from .operators.stumps import fit_stump_thresholds
from .operators.target import prepare_target
from .operators.tree import Tree, TreeNode, leaf_counts, tree_objective
from .operators.treeset import near_optimal_trees
from .plans import recipe as recipes
from .plans import runs
from .plans.workflow import RunConfig, train_and_evaluate
from .session import Scratch, shared_folder
from .sources import runlogs, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- inputs ------------------------------------------------------------------------------

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a learnable label ``y`` (net price of 50000 and more)."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        *LINE_NUMERIC, *LINE_CATEGORICAL, "l_linenumber",
        (net >= 50000).cast("int").alias("y"), net.alias("net"),
    )


def lines_xor(spark: SparkSession, sf: str) -> DataFrame:
    """A label no single test sees, but two tests explain."""
    y = (F.col("l_quantity") > 25) != (F.col("l_linestatus") == "O")
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_linestatus", y.cast("int").alias("y")
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose label depends on their region, the sensitive attribute."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("string").alias("nation"),
        "c_mktsegment", "r_name",
        (F.col("c_acctbal") + 1000 * F.col("n_regionkey") >= 6500).cast("int").alias("y"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: an unbalanced label and language groups of very different size."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.length("text").cast("double").alias("text_length"), "source", "lang",
        F.col("quality").cast("int").alias("y"),
    )


NATIONS_LEFT = tuple(str(i) for i in range(25) if i % 5 in (3, 4))


def region_tree() -> Tree:
    """A fixed tree on :func:`customers`."""
    return Tree({
        "": TreeNode("", feature="c_acctbal", is_numeric=True, threshold=4500.0),
        "L": TreeNode("L", feature="nation", is_numeric=False, left_categories=NATIONS_LEFT),
        "LL": TreeNode("LL", prediction=1), "LR": TreeNode("LR", prediction=0),
        "R": TreeNode("R", prediction=1),
    })


def balance_tree() -> Tree:
    return Tree({
        "": TreeNode("", feature="c_acctbal", is_numeric=True, threshold=5000.0),
        "L": TreeNode("L", prediction=0), "R": TreeNode("R", prediction=1),
    })


def scored_customers(spark: SparkSession, sf: str, tree: Tree | None = None) -> DataFrame:
    return (tree or region_tree()).score(customers(spark, sf), "p", "leaf")


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- cleaning ----------------------------------------------------------------------------


def _with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(
        "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linenumber") == 7, F.lit(-9)).otherwise(F.col("l_linenumber")).alias("line"),
        F.when(F.col("l_linenumber") > 4, F.col("l_discount")).alias("rare"),
        "l_returnflag", "y",
    )


@query
def drop_incomplete_counts(spark, sf):
    return cleaning.count_incomplete(_with_nulls(spark, sf), ["l_quantity", "tax", "rare"])


@query
def clean_recipe(spark, sf):
    recipe = recipes.Recipe(
        "lines", "y", sentinels=(-9, -8, -7), max_null_fraction=0.5, drop=("l_returnflag",),
    )
    data = recipes.apply(recipe, _with_nulls(spark, sf))
    return _rounded(data.df.groupBy("y").agg(
        F.count("*").alias("n"), F.sum("tax").alias("tax"), F.sum("line").cast("bigint").alias("line"),
        F.lit(len(data.features.all)).alias("n_features"),
    ), 4)


@query
def class_balance(spark, sf):
    return _rounded(cleaning.class_balance(table(spark, sf, "events"), "event_type"))


@query
def column_null_profile(spark, sf):
    return _rounded(cleaning.null_profile(_with_nulls(spark, sf), ["l_quantity", "tax", "rare"]))


@query
def sparse_columns(spark, sf):
    left = cleaning.drop_sparse_columns(_with_nulls(spark, sf), ["l_quantity", "tax", "rare"])
    return left.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("tax").alias("n_tax"),
        F.lit(",".join(left.columns)).alias("columns"),
    )


@query
def median_impute(spark, sf):
    filled = cleaning.fill_median(_with_nulls(spark, sf), ["tax", "l_quantity"])
    return _rounded(filled.groupBy("y").agg(
        F.count("tax").alias("n_tax"), F.sum("tax").alias("tax"), F.sum("l_quantity").alias("quantity")
    ), 4)


@query
def sentinel_null(spark, sf):
    return cleaning.sentinels_to_null(_with_nulls(spark, sf), ["line", "l_quantity"]).groupBy("line").agg(
        F.count("*").alias("n"))


@query
def numeric_coercion(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a"))
        .otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority"))
    return cleaning.coerce_numeric(raw, ["priority"]).groupBy("priority").agg(F.count("*").alias("n"))


@query
def recode_default(spark, sf):
    raw = table(spark, sf, "customer").select((F.col("c_nationkey") % 9).alias("race"))
    # Code -> name.
    names = {1: "white", 2: "black", 3: "hispanic", 4: "asian", 5: "other", 6: "other", 7: "other"}
    return cleaning.recode(raw, "race", names).groupBy("race").agg(F.count("*").alias("n"))


@query
def conditional_rename(spark, sf):
    raw = lines(spark, sf).select(*[F.col(c).alias(f"V{i + 1}") for i, c in enumerate(LINE_NUMERIC)], "y")
    named = cleaning.rename_generic(raw, ["quantity", "price", "discount", "tax"], label="y")
    return _rounded(named.groupBy("y").agg(
        F.sum("quantity").alias("quantity"), F.max("price").alias("price"), F.min("discount").alias("discount")
    ), 4)


@query
def label_rules(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("  "), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit(".")).otherwise(F.lit(" "))).alias("s"),
        F.substring("o_orderpriority", 1, 1).alias("p"),
    )
    return raw.select(
        cleaning.label_equals("s", "F", strip=True).alias("is_f"), cleaning.label_equals("s", "F").alias("raw_f"),
        cleaning.label_shift("p").alias("class"), (cleaning.label_positive("p")).alias("positive"),
    ).groupBy("is_f", "raw_f", "class", "positive").agg(F.count("*").alias("n"))


@query
def allowed_labels(spark, sf):
    raw = table(spark, sf, "embeddings").select(F.col("label").alias("y"))
    return cleaning.keep_labels(raw, "y").groupBy("y").agg(F.count("*").alias("n"))


@query
def target_profile(spark, sf):
    return _rounded(cleaning.target_profile(table(spark, sf, "events"), "value"), 6)


# -- target and split --------------------------------------------------------------------


@query
def label_encode(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_type").alias("label"))
    coded, _ = prepare_target(raw, "label", "code")
    return coded.groupBy("label", "code").agg(F.count("*").alias("n"))


@query
def median_binarize(spark, sf):
    raw = table(spark, sf, "events").select("event_type", "value")
    coded, target = prepare_target(raw, "value", "code")
    return _rounded(coded.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("code").alias("n_high"), F.lit(target.threshold).alias("median")
    ))


def _split_events(spark, sf):
    raw = table(spark, sf, "events").select("event_id", "event_type")
    return mark_test_rows(raw, "event_type", "event_id", test_size=0.3, seed=7)


@query
def stratified_split_counts(spark, sf):
    return _split_events(spark, sf).groupBy("event_type", "is_test").agg(F.count("*").alias("n"))


@query
def stratified_split_rows(spark, sf):
    return _split_events(spark, sf).where("is_test").select("event_id", "event_type")


@query
def plain_split_rows(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return mark_test_rows(raw, "o_totalprice", "o_orderkey", 0.2, 42).where("is_test").select("o_orderkey")


# -- binary features ---------------------------------------------------------------------


@query
def midpoint_thresholds(spark, sf):
    return _rounded(kept_values(lines(spark, sf), LINE_NUMERIC, 10).select("column", "rank", "value", "threshold"))


@query
def category_vocabulary(spark, sf):
    return vocabulary(table(spark, sf, "part"), ["p_brand", "p_type"])


@query
def binarize_matrix(spark, sf):
    tests = fit_midpoints(customers(spark, sf), ["c_acctbal"], ["c_mktsegment"], 4)
    wide = tests.transform(customers(spark, sf), ["c_custkey"])
    return wide.select("c_custkey", *[F.col(f"`{n}`").alias(f"t{i}") for i, n in enumerate(tests.names)])


@query
def one_hot(spark, sf):
    tests = fit_midpoints(table(spark, sf, "orders"), [], ["o_orderstatus", "o_orderpriority"])
    wide = tests.transform(table(spark, sf, "orders"), ["o_orderkey"])
    return wide.select("o_orderkey", *[F.col(f"`{n}`").alias(f"t{i}") for i, n in enumerate(tests.names)])


@query
def feature_names(spark, sf):
    tests = fit_midpoints(lines(spark, sf), ["l_quantity"], ["l_returnflag"], 3)
    return tests.table(spark).select("fid", "column", "op", "category", "name")


@query
def feature_map(spark, sf):
    tests = fit_midpoints(lines(spark, sf), LINE_NUMERIC, LINE_CATEGORICAL, 10)
    rows = [(i, len(f), min(f), max(f)) for i, f in tests.feature_map().items()]
    return spark.createDataFrame(rows, "input int, n int, first_fid int, last_fid int")


@query
def inverse_binarize(spark, sf):
    data = lines(spark, sf)
    tests = fit_midpoints(data, ["l_discount", "l_quantity"], [], 10)
    bits = tests.transform(data, ["y"])
    return _rounded(tests.inverse(bits, ["y"]).groupBy("l_discount", "l_quantity").agg(F.count("*").alias("n")))


@query
def stump_thresholds(spark, sf):
    tests = fit_stump_thresholds(lines(spark, sf), "y", LINE_NUMERIC, LINE_CATEGORICAL, 2)
    return tests.table(spark)


@query
def stump_matrix(spark, sf):
    data = lines(spark, sf)
    tests = fit_stump_thresholds(data, "y", ["l_extendedprice", "l_discount"], ["l_returnflag"], 2)
    bits = F.concat(*[F.expr(t).cast("int").cast("string") for t in tests.tests()]).alias("bits")
    return data.select(bits, "y").groupBy("bits", "y").agg(F.count("*").alias("n"))


@query
def column_elimination(spark, sf):
    tests = fit_stump_thresholds(
        lines(spark, sf), "y", ["l_extendedprice", "l_discount"], [], 2, column_elimination=True,
    )
    return tests.table(spark)


# -- split statistics --------------------------------------------------------------------


@query
def gini_impurity(spark, sf):
    counts = lines(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    c = ["n0", "n1"]
    return _rounded(counts.selectExpr("l_returnflag", "l_linestatus", f"{gini(c)} AS gini", f"{entropy(c)} AS entropy"))


@query
def variance_impurity(spark, sf):
    sums = lines(spark, sf).groupBy("l_returnflag").agg(
        F.count("net").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))
    return sums.selectExpr("l_returnflag", f"round({variance('n', 's', 'ss')} / 1e6D, 4) AS variance")


@query
def majority_leaf(spark, sf):
    events = table(spark, sf, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("majority"),
        F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("errors"))


def _as_one_node(df: DataFrame) -> DataFrame:
    return df.withColumn("node", F.lit(0))


@query
def best_numeric_split_clf(spark, sf):
    df, stats = _as_one_node(lines(spark, sf)), Statistics(2)
    found = best_numeric(numeric_candidates(
        df, LINE_NUMERIC, "y", node_statistics(df, "y", stats), stats, 10))
    return _rounded(found.select("feature", "threshold", "gain", F.col("l0").alias("left_0"), F.col("l1").alias("left_1")))


@query
def best_numeric_split_by_node(spark, sf):
    df = lines(spark, sf).withColumn("node", F.ascii("l_returnflag"))
    stats = Statistics(2)
    found = best_numeric(numeric_candidates(
        df, LINE_NUMERIC, "y", node_statistics(df, "y", stats), stats, 10))
    return _rounded(found.select("node", "feature", "threshold", "gain"))


@query
def best_numeric_split_reg(spark, sf):
    columns = ["l_extendedprice", "l_discount"]
    df, stats = _as_one_node(lines(spark, sf)), Statistics(None)
    df = df.withColumn("c", F.col("net") - df.agg(F.avg("net")).scalar())
    found = best_numeric(numeric_candidates(
        df, columns, "c", node_statistics(df, "c", stats), stats, 10))
    return found.select("feature", F.round("threshold", 6).alias("threshold"), F.round(F.col("gain") / 1e6, 4).alias("gain"),
                        F.col("l0").cast("bigint").alias("left_n"))


def _joined_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("left_categories", F.array_join("left_categories", ","))


@query
def best_categorical_split_binary(spark, sf):
    df, stats = _as_one_node(customers(spark, sf)), Statistics(2)
    per = category_statistics(df, ["nation", "c_mktsegment"], "y", stats)
    found = best_category_prefix(per, node_statistics(df, "y", stats), stats, 10)
    return _rounded(_joined_categories(found).select("feature", "gain", "left_categories"))


@query
def best_categorical_split_regression(spark, sf):
    df, stats = _as_one_node(customers(spark, sf)), Statistics(None)
    df = df.withColumn("c", F.col("c_acctbal") - df.agg(F.avg("c_acctbal")).scalar())
    per = category_statistics(df, ["nation", "c_mktsegment"], "c", stats)
    found = best_category_prefix(per, node_statistics(df, "c", stats), stats, 10)
    return _joined_categories(found).select(
        "feature", F.round(F.col("gain") / 1e3, 5).alias("gain"), "left_categories")


@query
def best_categorical_split_multiclass(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), "o_orderstatus",
        (F.col("o_custkey") % 4).cast("int").alias("y"))
    df, stats = _as_one_node(raw), Statistics(4)
    per = category_statistics(df, ["priority", "o_orderstatus"], "y", stats)
    found = best_category_subset(per, node_statistics(df, "y", stats), stats, 10, 10)
    return _joined_categories(found).select("feature", F.round("gain", 10).alias("gain"), "left_categories")


@query
def best_split_of_all(spark, sf):
    df, stats = _as_one_node(customers(spark, sf)), Statistics(2)
    found = best_splits(df, ["c_acctbal"], ["nation", "c_mktsegment"], "y",
                        node_statistics(df, "y", stats), stats, 10, 10)
    return _rounded(_joined_categories(found).select("feature", "threshold", "gain", "left_categories"))


def _line_tests(spark, sf, max_thresholds=10):
    return fit_midpoints(lines(spark, sf), LINE_NUMERIC, LINE_CATEGORICAL, max_thresholds)


def _all_tests(spark, sf):
    """The tests at the default number of thresholds."""
    return fit_midpoints(lines(spark, sf), LINE_NUMERIC, LINE_CATEGORICAL)


def _gains(spark, sf, scratch):
    tests = _line_tests(spark, sf)
    return compact(lines(spark, sf), tests, "y", 2, scratch)


@query
def feature_entropy_gain(spark, sf):
    with Scratch(spark) as scratch:
        rows = feature_gains(_gains(spark, sf, scratch)).collect()  # one row per test
    return _rounded(spark.createDataFrame(rows, "fid int, gain double"))


@query
def top_k_features(spark, sf):
    with Scratch(spark) as scratch:
        rows = rank_features(_gains(spark, sf, scratch), 8).collect()
    return _rounded(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rank int, fid int, gain double"))


@query
def leaf_loss(spark, sf):
    counts = lines(spark, sf).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n1"))
    n_rows = lines(spark, sf).agg(F.count("*")).scalar()
    wrong = F.least(F.col("n1"), F.col("n") - F.col("n1"))
    return _rounded(counts.select("l_returnflag", (wrong / n_rows + F.lit(0.0001)).alias("loss")))


# -- learners ----------------------------------------------------------------------------


def _node_rows(spark, tree: Tree) -> DataFrame:
    return tree.table(spark).select(
        "node_path", "feature", F.round("threshold", 6).alias("threshold"),
        F.array_join("left_categories", ",").alias("left_categories"),
        F.round("prediction", 4).alias("prediction"), "n",
    )


@query
def cart_tree_nodes(spark, sf):
    tree = fit_cart(customers(spark, sf), "y", ["c_acctbal"], ["nation", "c_mktsegment"], max_depth=2)
    return _node_rows(spark, tree)


@query
def cart_predict(spark, sf):
    data = customers(spark, sf)
    tree = fit_cart(data, "y", ["c_acctbal"], [], max_depth=1)
    return tree.score(data).select("c_custkey", F.col("prediction").cast("int").alias("prediction"))


@query
def cart_deep(spark, sf):
    tree = fit_cart(lines(spark, sf), "y", LINE_NUMERIC, LINE_CATEGORICAL, max_depth=4)
    return _node_rows(spark, tree)


@query
def cart_regression(spark, sf):
    tree = fit_cart(lines(spark, sf), "net", ["l_extendedprice", "l_discount"], [], task="regression", max_depth=1)
    return _node_rows(spark, tree)


@query
def cart_multiclass(spark, sf):
    raw = table(spark, sf, "embeddings")
    columns = [f"e{i}" for i in range(64)]
    wide = raw.select(F.col("label").cast("int").alias("y"),
                      *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return _node_rows(spark, fit_cart(wide, "y", columns, [], max_depth=3))


@query
def cart_on_binary_tests(spark, sf):
    tree = fit_cart_on_tests(lines(spark, sf), "y", LINE_NUMERIC, LINE_CATEGORICAL, 10, max_depth=3)
    return _node_rows(spark, tree)


@query
def greedy_tree_one_split(spark, sf):
    tree = greedy_tree(lines(spark, sf), "y", _line_tests(spark, sf), 2, budget=2, reg=0.001)
    root = tree.nodes[""]
    return _rounded(spark.createDataFrame(
        [(root.fid, tree.num_leaves(), float(tree.objective))], "root_fid int, n_leaves int, objective double"))


@query
def greedy_tree_deep(spark, sf):
    return _node_rows(spark, greedy_tree(lines(spark, sf), "y", _line_tests(spark, sf, 20), 2, budget=5, reg=0.0005))


@query
def optimal_depth2_tree(spark, sf):
    data = lines_xor(spark, sf)
    tests = fit_midpoints(data, ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], 4)
    tree = optimal_tree(data, "y", tests, 2, depth=2, reg=0.001)
    fid = {p: n.fid if n.fid is not None else -1 for p, n in tree.nodes.items()}
    return _rounded(spark.createDataFrame(
        [(fid[""], fid.get("T", -1), fid.get("F", -1), tree.num_leaves(), float(tree.objective))],
        "root_fid int, true_fid int, false_fid int, n_leaves int, objective double"))


@query
def optimal_depth3_tree(spark, sf):
    tree = optimal_tree(lines(spark, sf), "y", _all_tests(spark, sf), 2, depth=3, reg=0.0005)
    return _node_rows(spark, tree)


@query
def lookahead_tree_nodes(spark, sf):
    tree = lookahead_tree(lines(spark, sf), "y", _all_tests(spark, sf), 2, lookahead=2, budget=4, reg=0.0005)
    return _node_rows(spark, tree)


@query
def lookahead_tree_greedy_fill(spark, sf):
    tree = lookahead_tree(lines(spark, sf), "y", _all_tests(spark, sf), 2, lookahead=2, budget=5,
                          reg=0.0005, leaf_fill="greedy")
    return _node_rows(spark, tree)


@query
def rollout_tree_nodes(spark, sf):
    tree = rollout_tree(lines(spark, sf), "y", _all_tests(spark, sf), 2, budget=4, reg=0.0005)
    return _node_rows(spark, tree)


@query
def near_optimal_set(spark, sf):
    found = near_optimal_trees(lines(spark, sf), "y", _all_tests(spark, sf), 2, lookahead=3, budget=5,
                               reg=0.0005, tolerance=0.05, n_prefixes=20)
    return _rounded(found.table(spark))


# -- scoring and inspection --------------------------------------------------------------


@query
def leaf_assignment(spark, sf):
    return scored_customers(spark, sf).select("c_custkey", "leaf", "p")


def segment_tree() -> Tree:
    """A fixed tree of binary tests on :func:`customers`."""
    return Tree({
        "": TreeNode("", feature="c_mktsegment", is_numeric=False, left_categories=("BUILDING",)),
        "T": TreeNode("T", feature="c_acctbal", is_numeric=True, threshold=2000.0),
        "TT": TreeNode("TT", prediction=0), "TF": TreeNode("TF", prediction=1), "F": TreeNode("F", prediction=0),
    }, "TF")


@query
def trees_side_by_side(spark, sf):
    """Three trees of both kinds scored in one pass, with the leaf that the last of them reaches."""
    forest = Forest([region_tree(), balance_tree(), segment_tree()])
    data = customers(spark, sf).withColumn("leaf", F.get(forest.leaf_ids(), F.lit(2)))
    return forest.score(data).select("c_custkey", "leaf", "prediction_1", "prediction_2", "prediction_3")


@query
def leaf_label_counts(spark, sf):
    return leaf_counts(customers(spark, sf), region_tree(), "y")


@query
def fixed_tree_objective(spark, sf):
    return _rounded(tree_objective(customers(spark, sf), region_tree(), "y", 0.01))


@query
def used_features(spark, sf):
    tree = fit_cart(customers(spark, sf), "y", ["c_acctbal"], ["nation", "c_mktsegment"], max_depth=2)
    return spark.createDataFrame(list(enumerate(tree.used_features())), "position int, feature string")


# -- quality -----------------------------------------------------------------------------


@query
def accuracy_vs_baseline(spark, sf):
    scored = scored_customers(spark, sf)
    marked = mark_test_rows(scored, "y", "c_custkey", 0.25, 3)
    return _rounded(metrics.classification_metrics(
        marked.where("is_test"), "y", "p", marked.where("NOT is_test")))


@query
def regression_metrics(spark, sf):
    scored = lines(spark, sf).withColumn(
        "p", F.when(F.col("l_extendedprice") <= 50000, F.lit(25000.0)).otherwise(F.lit(70000.0)))
    train = scored.where(F.col("l_linenumber") > 2)
    found = metrics.regression_metrics(scored.where(F.col("l_linenumber") <= 2), "net", "p", train)
    return found.select("n", F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"),
                        F.round("baseline_rmse", 4).alias("baseline_rmse"))


# -- fairness ----------------------------------------------------------------------------


def _quartiles(spark, sf, basis):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    rows = []
    for c in df.columns:
        rows += [(c, i, e) for i, e in enumerate(fairness.quartile_edges(df, c, basis))]
    return _rounded(spark.createDataFrame(rows, "attribute string, position int, edge double"), 6)


@query
def sensitive_quartiles_distinct(spark, sf):
    return _quartiles(spark, sf, "distinct")


@query
def sensitive_quartiles_rows(spark, sf):
    return _quartiles(spark, sf, "rows")


@query
def sensitive_groups(spark, sf):
    df = lines(spark, sf)
    group = fairness.sensitive_group(df, "l_quantity", "distinct")
    found = df.groupBy(group.alias("group")).agg(
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n"))
    return found.select("low", "high", "n")


@query
def group_fairness_table(spark, sf):
    return _rounded(fairness.group_fairness(scored_customers(spark, sf), "y", "p", "r_name"))


@query
def group_fairness_small_groups(spark, sf):
    scored = texts(spark, sf).withColumn("p", (F.col("n_chars") > 400).cast("int"))
    return _rounded(fairness.group_fairness(scored, "y", "p", "lang"))


@query
def parity_summary(spark, sf):
    table_ = fairness.group_fairness(scored_customers(spark, sf, balance_tree()), "y", "p", "r_name")
    return _rounded(fairness.parity_summary(table_))


@query
def fairness_gap_dp(spark, sf):
    return _rounded(fairness.fairness_gap(scored_customers(spark, sf), "y", "p", "r_name", "dp"))


@query
def fairness_gap_eo(spark, sf):
    return _rounded(fairness.fairness_gap(scored_customers(spark, sf, balance_tree()), "y", "p", "r_name", "eo"))


@query
def calibration_quotas(spark, sf):
    return fairness.calibration_quotas(scored_customers(spark, sf), "y", "p", "r_name")


@query
def sample_calibration(spark, sf):
    fixed = fairness.calibrate_rows(scored_customers(spark, sf), "y", "p", "r_name", "c_custkey", 42)
    return fixed.select("c_custkey", "r_name", "p", "fair_prediction")


@query
def leaf_override_scores(spark, sf):
    scored = scored_customers(spark, sf)
    summary = fairness.leaf_summary(scored, "leaf", "r_name", "y", "p")
    errors = scored.agg(F.count_if(F.col("p") != F.col("y"))).first()[0]
    found = fairness.override_scores(summary, errors)
    return found.select("leaf_id", "candidate", F.round("acc_drop", 8).alias("acc_drop"),
                        F.round("gap", 8).alias("gap"), F.round("gain", 8).alias("gain"))


@query
def leaf_repair_summary(spark, sf):
    repair = fairness.fit_leaf_repair(
        scored_customers(spark, sf), "leaf", "r_name", "y", "p", acc_budget=0.5)
    return _rounded(repair.summary(spark))


@query
def leaf_repair_apply(spark, sf):
    scored = scored_customers(spark, sf)
    repair = fairness.fit_leaf_repair(scored, "leaf", "r_name", "y", "p", acc_budget=0.5)
    fixed = scored.withColumn("fair_prediction", repair.apply("leaf", "p"))
    return fixed.groupBy("leaf", "p", "fair_prediction").agg(F.count("*").alias("n"))


def customer_recipe() -> recipes.Recipe:
    return recipes.Recipe("customers", "y", sensitive=("r_name",), row_id=("c_custkey",))


@query
def train_and_audit(spark, sf):
    config = RunConfig("cart", "fair", seed=5, params={"max_depth": 3})
    _, report = train_and_evaluate(customer_recipe(), customers(spark, sf), config)
    return _rounded(report.where(F.col("metric") != "training_time_s"))


@query
def train_and_repair_leaves(spark, sf):
    config = RunConfig("lookahead-greedy", "lpfr", seed=5, acc_budget=0.3,
                       params={"lookahead": 1, "budget": 3, "reg": 0.001, "max_features": 20})
    _, report = train_and_evaluate(customer_recipe(), customers(spark, sf), config)
    return _rounded(report.where(F.col("metric") != "training_time_s"))


# -- experiments -------------------------------------------------------------------------

_MODELS = ["cart", "lookahead-greedy", "lookahead-optimal", "treeset"]
_MODES = ["nofair", "fair", "lpfr"]


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A table of run results computed from all events: metrics per model, data set, mode and seed."""
    e = table(spark, sf, "events")
    models, modes = F.array(*map(F.lit, _MODELS)), F.array(*map(F.lit, _MODES))
    keyed = e.select(
        F.get(models, (F.col("user_id") % 4).cast("int")).alias("model"), F.col("event_type").alias("dataset"),
        F.get(modes, (F.col("event_id") % 3).cast("int")).alias("mode"),
        (F.col("event_id") % 5).cast("int").alias("seed"), "value",
    ).where(~((F.col("model") == "treeset") & (F.col("mode") == "fair")))
    wide = keyed.groupBy("model", "dataset", "mode", "seed").agg(
        F.avg((F.col("value") > 10).cast("double")).alias("test_accuracy"),
        F.max("value").alias("training_time_s"),
        F.avg((F.col("value") > 5).cast("double")).alias("majority_baseline"),
        F.avg((F.col("value") > 20).cast("double")).alias("user.sp_diff"),
        F.min("value").alias("user.di_ratio"),
        F.avg((F.col("value") > 30).cast("double")).alias("user.eo_diff"),
    )
    return wide.unpivot(
        ["model", "dataset", "mode", "seed"],
        [f"`{c}`" if "." in c else c for c in wide.columns[4:]], "metric", "value")


@query
def experiment_grid(spark, sf):
    datasets = table(spark, sf, "documents").select(F.concat_ws("-", "source", "lang").alias("dataset")).distinct()
    grid = runs.experiment_grid(datasets, [1, 2, 3])
    return grid.select("dataset", "mode", "model", "seed", "fair_post", F.size("params").alias("n_params"))


@query
def seed_summary(spark, sf):
    return runs.seed_summary(run_metrics(spark, sf))


@query
def metric_flatten(spark, sf):
    nested = run_metrics(spark, sf).groupBy("model", "dataset", "mode", "seed").agg(
        F.create_map(
            F.lit(""), F.map_from_entries(F.collect_list(F.when(~F.col("metric").contains("."), F.struct("metric", "value")))),
            F.lit("user"), F.map_from_entries(F.collect_list(
                F.when(F.col("metric").contains("."), F.struct(F.substring_index("metric", ".", -1), F.col("value"))))),
        ).alias("metrics"))
    return _rounded(runs.flatten_metrics(nested, ["model", "dataset", "mode", "seed"], "metrics"))


def _mode_means(spark, sf, mode):
    m = run_metrics(spark, sf).where((F.col("mode") == mode) & (F.col("metric") == "test_accuracy"))
    return m.groupBy("model", "dataset").agg(F.avg("value").alias("accuracy"), F.count("*").alias("n"))


@query
def fair_fallback_merge(spark, sf):
    return _rounded(runs.merge_with_fallback(
        _mode_means(spark, sf, "fair"), _mode_means(spark, sf, "nofair"), ["model", "dataset"]))


def _with_calibrated(spark, sf):
    m = run_metrics(spark, sf).groupBy("model", "dataset", "mode", "metric").agg(F.avg("value").alias("value"))
    fair = m.where(F.col("mode") == "fair")
    calibrated = fair.where(F.col("metric").startswith("user.")).select(
        "model", "dataset", "mode",
        F.concat(F.lit("user.calibrated_"), F.substring_index("metric", ".", -1)).alias("metric"),
        (F.col("value") / 2).alias("value"))
    accuracy = fair.where(F.col("metric") == "test_accuracy").select(
        "model", "dataset", "mode", F.lit("user.calibrated_acc").alias("metric"), (F.col("value") / 4).alias("value"))
    return m.unionByName(calibrated).unionByName(accuracy)


@query
def comparison_pivot(spark, sf):
    return _rounded(runs.comparison_table(_with_calibrated(spark, sf), ["user"]))


@query
def run_identities(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.lit("lookahead")).otherwise(F.lit("cart")).alias("m"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("optimal")).alias("fill"),
        (F.col("o_orderkey") % 2 == 0).alias("fair"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("leaf_pareto")).otherwise(F.lit("sample")).alias("post"))
    model, mode = runs.run_identity(F.col("m"), F.col("fill"), F.col("fair"), F.col("post"))
    return o.select(model, mode).groupBy("model", "mode").agg(F.count("*").alias("n"))


@query
def run_outcomes(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderstatus") != "P").alias("ok"))
    return runs.outcome_counts(o)


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """One log text per customer.  The wording of the lines is a fixed value: it is what log readers look for."""
    key = F.col("c_custkey")

    def num(shift: int):
        return F.concat(F.lit("0."), F.lpad(((key * 7 + shift) % 10000).cast("string"), 4, "0"))

    mode = F.get(F.array(*map(F.lit, _MODES)), (key % 3).cast("int"))

    def block(title, base: int):
        return F.concat_ws(
            "\n", title, F.lit("-----"),
            F.concat(F.lit("  Statistical parity diff:  "), num(base)),
            F.concat(F.lit("  Disparate impact ratio:   "), num(base + 1)),
            F.concat(F.lit("  Equal opportunity diff:   "), num(base + 2)))

    post = F.when(key % 3 == 1, F.lit("calibrated")).when(key % 3 == 2, F.lit("LPFR"))
    after = F.when(key % 3 == 1, F.lit("Calibrated")).when(key % 3 == 2, F.lit("LPFR"))
    text = F.concat_ws(
        "\n",
        F.when(key % 3 != 0, F.lit("  [FairPreprocess] Dropped: ['sex']")),
        F.concat(F.lit("Training time: "), num(10), F.lit("s")),
        F.concat(F.lit("Test accuracy:           "), num(11)),
        F.concat(F.lit("Majority-class baseline: "), num(12)),
        block(F.lit("Fairness - sex:"), 20),
        F.when(post.isNotNull(), block(F.concat(F.lit("Fairness - sex ("), post, F.lit("):")), 30)),
        F.when(after.isNotNull(), F.concat(
            F.lit("  "), after, F.lit(" accuracy: "), num(40), F.lit(" (was 0.5000, delta=+0.1)"))),
    )
    name = F.concat(F.lit("lookahead-greedy-"), F.lower("c_mktsegment"), F.lit("-d5-bin-"), mode,
                    F.lit("-c"), key.cast("string"), F.lit(".log"))
    return table(spark, sf, "customer").select(name.alias("file"), text.alias("text"))


@query
def log_metrics(spark, sf):
    return runlogs.parse_logs(run_logs(spark, sf))


@query
def log_identity(spark, sf):
    logs = run_logs(spark, sf)
    routed = runlogs.fair_files(logs).select("file", *runlogs.run_identity("file"), "is_fair")
    return routed.withColumn("output", runlogs.output_mode(F.col("mode"), F.col("is_fair"))).groupBy(
        "model", "dataset", "depth", "features", "mode", "is_fair", "output").agg(F.count("*").alias("n"))


@query
def ordered_output(spark, sf):
    m = runs.seed_summary(run_metrics(spark, sf)).where(F.col("metric") == "test_accuracy")
    known = m.select("model", "dataset", "mode", "mean")
    return runs.in_output_order(known, datasets=["click", "view", "purchase"])


# -- results that must not depend on sizes, missing or infinite values ---------------------


@query
def split_many_classes(spark, sf):
    """Test rows per class of a label with far more classes than a list on the driver should hold."""
    raw = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 701).cast("int").alias("y"))
    marked = mark_test_rows(raw, "y", "o_orderkey", 0.2, 42)
    return marked.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query
def text_target_codes(spark, sf):
    """Dense codes of a text label with one class per part brand and size."""
    raw = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("y"))
    coded, _ = prepare_target(raw, "y", "code")
    return coded.select("p_partkey", "code")


@query
def fairness_gap_missing_group(spark, sf):
    """A missing sensitive value is no group."""
    group = F.when(F.col("c_custkey") % 3 != 0, F.col("r_name"))
    scored = scored_customers(spark, sf).withColumn("g", group)
    return _rounded(fairness.fairness_gap(scored, "y", "p", "g", "dp"))


@query
def group_fairness_missing_group(spark, sf):
    group = F.when(F.col("c_custkey") % 3 != 0, F.col("r_name"))
    scored = scored_customers(spark, sf).withColumn("g", group)
    return _rounded(fairness.group_fairness(scored, "y", "p", "g"))


@query
def numeric_split_infinite(spark, sf):
    """The best cut of a column with infinite and missing values."""
    price = (F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
             .when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    df, stats = _as_one_node(lines(spark, sf).withColumn("price", price)), Statistics(2)
    found = best_numeric(numeric_candidates(df, ["price"], "y", node_statistics(df, "y", stats), stats, 10))
    return _rounded(found.select("threshold", "gain", F.col("l0").alias("left_0"), F.col("l1").alias("left_1")))


@query
def cart_infinite_values(spark, sf):
    """One split on a column of infinite, missing and plain values, on the bucket path."""
    price = (F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
             .when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    tree = fit_cart(lines(spark, sf).withColumn("price", price), "y", ["price"], [], max_depth=1, rows_per_bucket=1000)
    return spark.createDataFrame([(float(tree.nodes[""].threshold), tree.nodes[""].n)], "threshold double, n long").select(
        F.round("threshold", 8).alias("threshold"), "n")


@query
def missing_target_dropped(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("y"))
    return cleaning.drop_missing_target(raw, "y")


@query
def numeric_columns_kept(spark, sf):
    return cleaning.drop_non_numeric(table(spark, sf, "customer"), keep=["c_mktsegment"])


@query
def positional_recipe(spark, sf):
    """First column dropped by position, texts read as numbers, sparse columns dropped, the rest filled by medians."""
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit("7")).otherwise(F.lit("?")).alias("rare"), (F.col("o_custkey") % 3 == 0).cast("int").alias("y"))
    recipe = recipes.Recipe("orders", "y", drop_first=1, coerce=("priority", "rare"), max_null_fraction=0.5, impute_median=True)
    data = recipes.apply(recipe, raw)
    return data.df.groupBy("y", "priority").agg(F.count("*").alias("n"), F.lit(",".join(data.features.all)).alias("features"))


@query
def projected_recipe(spark, sf):
    """Chosen columns only, with the row id and the label."""
    recipe = recipes.Recipe("customers", "y", select=("c_acctbal", "c_mktsegment"), row_id=("c_custkey",))
    return recipes.apply(recipe, customers(spark, sf)).df


@query
def prepared_fair_split(spark, sf):
    """Rows of both parts of a stratified split, and the features left without the sensitive column."""
    data = recipes.prepare(customer_recipe(), customers(spark, sf), test_size=0.25, seed=3, fair=True)
    both = data.train.withColumn("is_test", F.lit(False)).unionByName(data.test.withColumn("is_test", F.lit(True)))
    return both.select("c_custkey", "is_test", "group_r_name", F.lit(",".join(data.features.all)).alias("features"))


def _output_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    folder = shared_folder(spark)
    if folder is None:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="arborfair-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf):
    """Rows written as CSV in a fixed column order, and read back with a given schema."""
    path = _output_folder(spark, "csv")
    columns = ["r_name", "c_custkey", "c_acctbal", "nation", "c_mktsegment", "y"]
    sinks.write_csv(customers(spark, sf), path, columns)
    return tables.read_csv(spark, path, "r_name string, c_custkey long, c_acctbal double, nation string, c_mktsegment string, y int")


@query
def json_round_trip(spark, sf):
    """Rows written as JSON, one folder per output mode, and read back."""
    path = _output_folder(spark, "json")
    modes = F.array(*map(F.lit, _MODES))
    e = table(spark, sf, "events").select("event_id", "event_type", "value", F.get(modes, (F.col("event_id") % 3).cast("int")).alias("mode"))
    sinks.write_by_mode(e, path)
    return spark.read.schema("event_id long, event_type string, value double, mode string").json(path)
