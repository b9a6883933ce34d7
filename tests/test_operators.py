import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborfair.functions.ranks import exact_quantiles, running_sums, take_per_group
from arborfair.operators import cleaning, metrics
from arborfair.operators.binarize import fit_midpoints
from arborfair.operators.split import mark_test_rows, quotas_by_class, train_test_split
from arborfair.operators.stumps import fit_stump_thresholds
from arborfair.operators.target import fit_target, prepare_target
from arborfair.sources.tables import infer_features


def numbers(spark, seed=0, n=900):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n).round(2)
    v[: n // 3] = 0.25  # one value holds a third of the rows
    w = rng.integers(0, 40, n).astype(float)
    w[::10] = np.nan
    return pd.DataFrame({"id": range(n), "v": v, "w": w}), spark.createDataFrame(
        [(i, float(a), None if np.isnan(b) else float(b)) for i, a, b in zip(range(n), v, w)], "id long, v double, w double")


@pytest.mark.parametrize("bucket", [50, 1_000_000])
def test_exact_quantiles(spark, bucket):
    pdf, df = numbers(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["v", "w"], probs, bucket)
    for c in ("v", "w"):
        assert got[c] == pytest.approx(list(np.nanquantile(pdf[c], probs)))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_running_sums_do_not_depend_on_buckets(spark):
    _, df = numbers(spark)
    rows = df.groupBy("v").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    whole = {r["v"]: (r["cum_n"], r["next_v"]) for r in running_sums(rows, ["g"], "v", ["n"], False).collect()}
    cut = rows.withColumn("bucket", F.floor(F.col("v") * 2).cast("int"))
    parts = {r["v"]: (r["cum_n"], r["next_v"]) for r in running_sums(cut, ["g"], "v", ["n"], True).collect()}
    assert whole == parts


def test_take_per_group_equals_plain_ranking(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' WHEN id % 7 = 0 THEN 'c' ELSE 'd' END AS g", "int(id % 5 = 0) AS p")
    quotas = {"a": 400, "b": 0, "c": 10_000, "d": 1}
    q = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    got = take_per_group(df, "g", q, "id", 9, F.col("p"))
    assert got.count() == 3000
    taken = {r["id"] for r in got.where("taken").collect()}
    want = set()
    rows = df.selectExpr("*", "md5(concat_ws(':', id, '9')) AS h").collect()
    for g, n in quotas.items():
        ordered = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["p"], r["h"], r["id"]))
        want |= {r["id"] for r in ordered[:n]}
    assert taken == want
    again = take_per_group(df.repartition(7), "g", q, "id", 9, F.col("p"), hex_digits=1)
    assert {r["id"] for r in again.where("taken").collect()} == want


def _quotas(spark, counts, test_size):
    df = spark.createDataFrame(list(counts.items()), "k int, count long")
    return {r["k"]: r["quota"] for r in quotas_by_class(df, "k", test_size, sum(counts.values())).collect()}


def test_split_sizes(spark):
    assert _quotas(spark, {0: 7, 1: 3}, 0.25) == {0: 2, 1: 1}
    assert _quotas(spark, {0: 10, 1: 10, 2: 10}, 0.35) == {0: 4, 1: 4, 2: 3}
    assert _quotas(spark, {0: 10, 1: 10, 2: 10}, 0.4) == {0: 4, 1: 4, 2: 4}
    assert _quotas(spark, {0: 5, 1: 6, 2: 7, 3: 8}, 0.3) == {0: 2, 1: 2, 2: 2, 3: 2}


def test_split_of_many_classes(spark):
    df = spark.range(5000).selectExpr("id", "cast(if(id < 10, NULL, id % 500) AS int) AS y")
    taken = {r["y"]: r["n"] for r in mark_test_rows(df, "y", "id", 0.2, 3).where("is_test").groupBy("y").agg(
        F.count("*").alias("n")).collect()}
    assert len(taken) == 500 and set(taken.values()) <= {1, 2} and sum(taken.values()) == 998


def test_stumps_keep_rows_with_missing_values(spark):
    df = spark.range(400).selectExpr("double(id) AS a", "int(id > 300) AS y", "if(id % 10 = 0, double(id % 7), NULL) AS b")
    alone = fit_stump_thresholds(df, "y", ["a"], [], 2, n_estimators=1)
    both = fit_stump_thresholds(df, "y", ["a", "b"], [], 2, n_estimators=1)
    assert alone.names == both.names


def test_text_target_with_many_classes(spark):
    df = spark.range(900).selectExpr("concat('c', id % 450) AS y")
    coded, target = prepare_target(df, "y")
    assert len(target.classes) == 450
    assert all(target.classes[r["y"]] == r["t"] for r in df.select(target.code.alias("y"), df.y.alias("t")).distinct().collect())


def test_split_falls_back_to_one_stratum(spark):
    df = spark.range(50).selectExpr("id", "int(id = 0) AS y", "double(id) AS f")
    for label in ("y", "f"):  # a class of one row, a float label
        train, test = train_test_split(df, label, "id", 0.2, 1)
        assert (train.count(), test.count()) == (40, 10)
    one, two = (mark_test_rows(df, "y", "id", 0.2, s).where("is_test").select("id").collect() for s in (1, 2))
    assert set(one) != set(two)


@pytest.mark.parametrize("bucket", [40, 1_000_000])
def test_midpoints_follow_ranks(spark, bucket):
    pdf, df = numbers(spark)
    tests = fit_midpoints(df, ["v", "w"], [], 10, bucket)
    for c in ("v", "w"):
        u = np.unique(pdf[c].dropna())
        kept = [u[i * (len(u) - 1) // 10] for i in range(11)]
        assert tests.values[c] == kept
        assert [f.threshold for f in tests.features if f.column == c] == [(a + b) / 2 for a, b in zip(kept, kept[1:])]


def test_binary_features(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (7.0, "b"), (None, None), (float("nan"), "it's")], "x double, s string")
    tests = fit_midpoints(df, ["x"], ["s"])
    assert tests.names == ["x <= 2.0", "x <= 5.0", "s=a", "s=b", "s=it's"]
    assert tests.feature_map() == {0: [0, 1], 1: [2, 3, 4]}
    bits = tests.transform(df, ["x", "s"])
    got = {(str(r["x"]), r["s"]): tuple(r[n] for n in tests.names) for r in bits.collect()}
    assert got[("1.0", "b")] == (1, 1, 0, 1, 0)
    assert got[("None", None)] == got[("nan", "it's")][:4] + (0,) == (0, 0, 0, 0, 0)
    assert got[("nan", "it's")][4] == 1
    unseen = tests.transform(spark.createDataFrame([(9.0, "zz")], "x double, s string"), [])
    assert list(unseen.first()) == [0, 0, 0, 0, 0]
    back = tests.inverse(tests.transform(df.where("x < 10"), ["s"]), ["s"]).collect()
    assert sorted(r["x"] for r in back) == [1.0, 3.0, 7.0]
    same = fit_midpoints(spark.createDataFrame([(4.0,), (4.0,)], "c double"), ["c"], [])
    assert len(same) == 0


def test_stumps(spark):
    rng = np.random.default_rng(0)
    x = rng.random(400)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0.6)) for a, b in zip(x, rng.random(400))], "x double, z double, y int")
    tests = fit_stump_thresholds(df, "y", ["x", "z"], [], 2, n_estimators=3)
    assert tests.features[0].column == "x" and abs(tests.features[0].threshold - 0.6) < 0.02
    assert fit_stump_thresholds(df.selectExpr("'a' AS s", "y"), "y", [], ["s"], 2).names == ["s=a"]


def test_targets(spark):
    strings = spark.createDataFrame([("b",), ("a",), ("b",)], "y string")
    coded, target = prepare_target(strings, "y")
    assert sorted(r[0] for r in coded.collect()) == [0, 1, 1] and target.classes == ["a", "b"]
    gaps = spark.createDataFrame([(5,), (2,), (9,)], "y int")
    assert sorted(r[0] for r in prepare_target(gaps, "y")[0].collect()) == [0, 1, 2]
    many = spark.range(21).selectExpr("int(id) AS y")  # more than ten integers: cut at the median
    coded, target = prepare_target(many, "y")
    assert target.threshold == 10.0 and coded.agg(F.sum("y")).first()[0] == 11
    assert prepare_target(many.selectExpr("double(y) AS y"), "y", rows_per_bucket=5)[1].threshold == 10.0
    with pytest.raises(ValueError):
        fit_target(spark.createDataFrame([(1,), (1,)], "y int"), "y")


def test_cleaning_edges(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (float("nan"), 2, None), (3.0, 4, "z")], "a double, b int, c string")
    assert [r["a"] for r in cleaning.drop_incomplete(df, ["a", "b", "c"]).collect()] == [3.0]
    assert list(cleaning.count_incomplete(df, ["a", "b"]).first()) == [3, 1, 2]
    assert cleaning.drop_columns(df, ["nope"], first=1).columns == ["b", "c"]
    assert cleaning.drop_non_numeric(df).columns == ["a", "b"]
    assert cleaning.rename_generic(df, ["p", "q", "r"]).columns == ["a", "b", "c"]
    assert [r["a"] for r in cleaning.fill_median(df, ["a"]).orderBy("a").collect()] == [1.0, 2.0, 3.0]
    half = df.selectExpr("a", "if(a = 3, 1, NULL) AS d", "if(a <= 3, 1, NULL) AS e")
    assert cleaning.drop_sparse_columns(half, ["d", "e"]).columns == ["a", "e"]
    with pytest.raises(TypeError):
        infer_features(df.withColumn("t", F.current_timestamp()))


def test_metrics(spark):
    train = spark.createDataFrame([(1,), (0,), (1,), (0,)], "y int")
    test = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "y int, p int")
    row = metrics.classification_metrics(test, "y", "p", train).first()
    assert row["accuracy"] == pytest.approx(2 / 3) and row["majority_baseline"] == pytest.approx(2 / 3)
    flat = metrics.regression_metrics(spark.createDataFrame([(1, 1), (1, 0)], "y int, p int"), "y", "p", train).first()
    assert flat["r2"] is None and flat["rmse"] == pytest.approx(0.5 ** 0.5)


@pytest.mark.parametrize("name", ["stump_thresholds", "stump_matrix", "column_elimination"])
def test_registered_stumps_run_the_default_rounds(spark, monkeypatch, name):
    from arborfair import queries
    from arborfair.operators import boosting

    rounds = []
    fit = boosting.Booster.fit

    def fewer(self, *rest):
        rounds.append(self.n_estimators)
        self.n_estimators = 1
        return fit(self, *rest)

    monkeypatch.setattr(boosting.Booster, "fit", fewer)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rounds and set(rounds) == {100}


def test_one_class_per_row_needs_no_list(spark, monkeypatch):
    """Dense codes of very many text classes: ordered, without gaps, joined to rows; nothing but counts on the driver."""
    from arborfair.operators import target as module

    rows = [(f"t{(i * 7919) % 20_011:05d}" if i % 50 else None, i) for i in range(20_011)]
    df = spark.createDataFrame(rows, "y string, code long").repartition(6)
    coded, target = prepare_target(df, "y", "class")
    want = {v: k for k, v in enumerate(sorted({y for y, _ in rows if y is not None}))}
    assert target.n_classes == len(want) and target.classes == []
    got = coded.collect()
    assert coded.columns == ["y", "code", "class"] and len(got) == len(rows)
    assert all(r["class"] == want.get(r["y"]) for r in got)
    target.release()
    # Few classes and many are coded alike.
    monkeypatch.setattr(module, "LISTED_CLASSES", 2)
    small = spark.createDataFrame([("b",), ("a",), ("é",), ("z",), (None,), ("a",)], "y string")
    in_place, _ = prepare_target(small, "y")
    assert sorted(in_place.collect(), key=str) == sorted([(1,), (0,), (3,), (2,), (None,), (0,)], key=lambda r: f"Row(y={r[0]})")
