import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from arborfair import queries as q
from arborfair.operators import fairness
from arborfair.plans import recipe as recipes
from arborfair.plans import runs
from arborfair.plans.workflow import BinarizerOptions, RunConfig, train_and_evaluate
from arborfair.session import Scratch, shared_folder
from arborfair.sources import runlogs, sinks
from arborfair.sources.tables import read_csv

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scoring_is_one_narrow_projection(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").withColumn("nation", F.col("c_nationkey").cast("string"))
    text = plan(q.region_tree().score(customers, leaf="leaf").select("c_custkey", "prediction", "leaf"))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in text


def test_scoring_accepts_a_stream(spark):
    source = spark.read.parquet(f"{SF}/customer.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{SF}/custome*.parquet")
    scored = q.balance_tree().score(stream)
    assert scored.isStreaming and "prediction" in scored.columns


def test_cart_level_has_no_python(spark):
    df = q.lines(spark, SF).withColumn("node", F.lit(0))
    stats = q.Statistics(2)
    found = q.best_splits(df, q.LINE_NUMERIC, q.LINE_CATEGORICAL, "y", [(3000, 3000)], stats, 10, 10, {c: [] for c in q.LINE_NUMERIC})
    text = plan(found)
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scratch_uses_the_shared_folder_and_cleans_up(spark, tmp_path, monkeypatch):
    assert shared_folder(spark) == shared_folder(spark)
    monkeypatch.setattr("arborfair.session.shared_folder", lambda _: str(tmp_path))
    with Scratch(spark) as scratch:
        assert scratch.keep(spark.range(5), "t").count() == 5
        assert len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


LOG = """  [FairPreprocess] Dropped: ['sex']
Test accuracy:           0.8450
Majority-class baseline: 0.7521
Training time: 6.8s
Statistical parity diff:  0.9999
Fairness — sex:
  Statistical parity diff:  0.1347  (max - min pos rate)
  Disparate impact ratio:   0.3682
  Equal opportunity diff:   0.0648
Fairness - sex (calibrated):
  Statistical parity diff:  0.0001
  Calibrated accuracy: 0.8489 (was 0.8442, Δ=+0.0046)
Fairness - race group (LPFR):
  Statistical parity diff:  0.0085
  LPFR accuracy: 0.8471 (was 0.8442, delta=+0.0028)
Test accuracy:           0.8500
"""


def test_log_parsing(spark, tmp_path):
    names = ["lookahead-greedy-adult-d5-bin-fair.log", "cart-bank-d12-raw-lpfr-seed3.log", "notes.log"]
    for n in names:
        (tmp_path / n).write_text(LOG)
    logs = runlogs.read_logs(spark, str(tmp_path))
    got = {(r["file"], r["metric"]): r["value"] for r in runlogs.parse_logs(logs, ["adult"]).collect()}
    mine = {m: v for (f, m), v in got.items() if f == names[0]}
    assert mine == {
        "test_accuracy": 0.85, "majority_baseline": 0.7521, "training_time_s": 6.8,
        "sex.sp_diff": 0.1347, "sex.di_ratio": 0.3682, "sex.eo_diff": 0.0648,
        "sex.calibrated_sp_diff": 0.0001, "sex.calibrated_acc": 0.8489,
        "race group.lpfr_sp_diff": 0.0085, "race group.lpfr_acc": 0.8471,
    }
    assert {m for (f, m) in got if f == names[1]} == {"test_accuracy", "majority_baseline", "training_time_s"}
    ids = {r["file"]: tuple(r)[1:] for r in logs.select("file", *runlogs.run_identity("file")).collect()}
    assert ids[names[0]] == ("lookahead-greedy", "adult", 5, "bin", "fair", None)
    assert ids[names[1]] == ("cart", "bank", 12, "raw", "lpfr", "seed3")
    assert ids[names[2]] == (None,) * 6
    assert runlogs.fair_files(logs).where("is_fair").count() == 3
    modes = spark.createDataFrame([("lpfr", True), ("fair", False), ("nofair", True)], "m string, f boolean")
    assert [r[0] for r in modes.select(runlogs.output_mode(F.col("m"), F.col("f"))).collect()] == ["lpfr", "nofair", "fair"]


def test_seed_summary(spark):
    nan = float("nan")
    rows = [("cart", "a", "fair", s, "acc", v) for s, v in enumerate([0.5, 0.7, 0.9])]
    rows += [("cart", "a", "fair", 0, "sp", 0.1), ("cart", "a", "fair", 0, "bad", nan), ("cart", "a", "fair", 1, "bad", 1.0)]
    metrics = spark.createDataFrame(rows, "model string, dataset string, mode string, seed int, metric string, value double")
    got = {r["metric"]: (r["mean"], r["std"], r["n"]) for r in runs.seed_summary(metrics).collect()}
    assert got == {"acc": (0.7, 0.2, 3), "sp": (0.1, 0.0, 1)}


def test_sweep_records_failures(spark):
    def one(run):
        if run["seed"] == 2:
            raise RuntimeError("boom")
        return spark.createDataFrame([("acc", float(run["seed"]))], "metric string, value double")

    grid = [{"model": "cart", "dataset": "d", "mode": "fair", "seed": s} for s in (1, 2, 3)]
    done, failed = runs.sweep(spark, grid, one)
    assert done.count() == 2 and failed.first()["error"] == "RuntimeError: boom"
    done, failed = runs.sweep(spark, grid, one, fail_fast=True)
    assert done.count() == 1 and failed.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("cart", "a", "fair", "acc", 0.5, 0.1, 3)], ", ".join(
        f"{c} {t}" for c, t in zip(sinks.SUMMARY_COLUMNS, ["string"] * 4 + ["double", "double", "long"])))
    sinks.write_summary(df, str(tmp_path / "summary"))
    part = next((tmp_path / "summary").glob("part-*.csv"))
    assert part.read_text().splitlines()[0] == "model,dataset,mode,metric,mean,std,n"
    back = read_csv(spark, str(tmp_path / "summary"), df.schema)
    assert back.collect() == df.collect()
    sinks.write_by_mode(df, str(tmp_path / "modes"))
    assert (tmp_path / "modes" / "mode=fair").exists()
    sinks.write_csv(df, str(tmp_path / "tables"), ["model", "mean"], ["dataset"])
    assert next((tmp_path / "tables" / "dataset=a").glob("*.csv")).read_text().splitlines()[0] == "model,mean"


def test_recipe(spark):
    raw = spark.createDataFrame(
        [(i, "junk", -9 if i % 10 == 0 else i, str(i) if i % 3 else "?", None if i % 2 else 1.0, None if i < 60 else 2.0,
          i % 3, " >50K. " if i % 4 else "<=50K") for i in range(100)],
        "id long, junk string, V1 int, V2 string, half double, rare double, code int, y string")
    recipe = recipes.Recipe(
        "demo", "y", label_rule=q.cleaning.label_equals("y", ">50K", strip=True), drop=("junk", "absent"),
        coerce=("V2",), sentinels=(-9,), recodes={"code": {1: "one"}}, max_null_fraction=0.5,
        impute_median=True, sensitive=("code",), row_id=("id",))
    data = recipes.apply(recipe, raw)
    assert data.features.numeric == ["V1", "V2", "half"] and data.features.categorical == ["code"]
    assert data.df.count() == 100 and data.df.agg(F.sum("y")).first()[0] == 75
    prepared = recipes.prepare(recipe, raw, fair=True)
    assert prepared.groups == {"code": "group_code"} and "code" not in prepared.features.all
    with pytest.warns(UserWarning):
        recipes.prepare(recipes.Recipe("demo", "y", select=("V1",), label_rule=recipe.label_rule,
                                       sensitive=("race",), row_id=("id",)), raw)


@pytest.mark.parametrize("model,params", [
    ("lookahead-optimal", {"lookahead": 1, "budget": 2, "reg": 0.01}),
    ("rollout", {"budget": 2, "reg": 0.01}),
    ("treeset", {"lookahead": 2, "budget": 3, "reg": 0.01, "n_prefixes": 3}),
    ("cart", {"max_depth": 2, "on_tests": True}),
])
def test_every_model_runs(spark, model, params):
    config = RunConfig(model, "nofair", params=params, binarizer=BinarizerOptions(max_thresholds=5))
    tree, report = train_and_evaluate(q.customer_recipe(), q.customers(spark, SF), config)
    got = {r["metric"]: r["value"] for r in report.collect()}
    assert got["n_leaves"] == tree.num_leaves() and 0.4 < got["test_accuracy"] <= 1.0


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        train_and_evaluate(q.customer_recipe(), q.customers(spark, SF), RunConfig("other"))
    with pytest.raises(ValueError):
        train_and_evaluate(q.customer_recipe(), q.customers(spark, SF), RunConfig(mode="other"))
    with pytest.raises(ValueError):
        fairness.quartile_edges(q.customers(spark, SF), "c_acctbal", "other")
