import math
import random

import duckdb
import numpy as np
import pandas as pd
import plain
import pyarrow as pa

from arborfair.llm import decontaminate, divergence, oracles, quality_gam, queries, sharding
from arborfair.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_decontamination_against_all_windows(spark):
    rnd = random.Random(3)
    vocabulary = "The of AND in to naïve x1 Y2".split()
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(n))) for k, n in enumerate([0, 1, 2, 4, 9, 10, 11, 25, 60])]
    items += [(None, "only in an item without id here now"), (3, None), (4, items[4][1]), (10, "!!! ...")]
    docs = [(k, " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "."]) for _ in range(rnd.randrange(150)))) for k in range(60)]
    docs += [(90 + k, f"Pre {t}; post") for k, (_, t) in enumerate(items)] + [(None, items[7][1]), (200, None)]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for window, block_bytes in ((10, 1 << 20), (4, 60)):
        marked = decontaminate.mark_contaminated(a, b, window=window, block_bytes=block_bytes, name="c")
        got = {r.text: (r.c.n_words, r.c.n_hit, set(r.c["items"])) for r in marked.collect()}
        for _, text in docs:
            n, hit, ids = plain.hits(text, items, window)
            assert got[text] == (n, hit, ids - {None}), text


def test_decontamination_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    marked = decontaminate.mark_contaminated(odd_docs, items)
    assert marked.count() == len(odd_rows) and marked.where("contamination_.n_hit > 0").isEmpty()
    assert decontaminate.digest(decontaminate.mark_contaminated(no_docs, items, name="contamination")).collect() == []


def test_base_counts(odd_texts, odd_rows):
    texts = [*odd_texts, *(t for _, t in odd_rows)]
    counts = np.column_stack(divergence.measure(pa.array(texts, pa.string()))[0])
    assert [tuple(r) for r in counts.tolist()] == [plain.base_counts(t) for t in texts]


def test_js_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([0.25, 0.25, 0.5])

    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b) if x)

    for row, got in zip(p, divergence.js_distance(p, q)):
        m = (row + q) / 2
        assert abs(got - math.sqrt((kl(row, m) + kl(q, m)) / 2)) < 1e-12
    assert divergence.js_distance(p, p[0])[0] == 0 and divergence.js_distance(p[1:], np.array([0, 0, 1.0]))[0] == 1


def test_divergence_rules(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    references = divergence.fit_references(docs)
    assert set(references) == {"en", "fr", "de", "es"}
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1")
    judged = divergence.judge(good, references, name="r").where("not r.base_failed")
    assert judged.where("not r.kept").count() == 0
    rows = spark.createDataFrame([(1, "%$# @@ ^^ ~~ " * 5 + " ".join(f"{i}#{i}$" for i in range(200)))], "doc_id long, text string")
    assert not divergence.judge(rows, references, name="r").first().r.kept
    odd = divergence.judge(odd_docs, references)
    assert odd.count() == len(odd_rows) and "quality_rules_" in odd.columns
    assert divergence.fit_references(no_docs) == {} and divergence.judge(no_docs, {}).collect() == []
    kept = divergence.judge(odd_docs, {}, name="r").where("doc_id = 200").first().r
    assert kept.kept and kept.class_distance is None


def _shard_frame(rows):
    return pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})


def test_shards_against_all_prefixes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for limit in (9_000, 400_000):
        got = sorted(map(tuple, sharding.assign_shards(docs, limit=limit, name="s").select("doc_id", "s.*").collect()))
        assert got == sorted(con.execute(oracles.shard_sql(limit)).fetchall())
        assert all(r[4] <= limit or r[5] == 1 for r in got)


def test_shards_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    placed = sharding.assign_shards(odd_docs, limit=6000)
    assert placed.count() == len(odd_rows) and placed.columns == [*odd_docs.columns, "sharding_"]
    again = spark.createDataFrame([(1, "same row")] * 50 + [(2, "other")], "doc_id long, text string").repartition(3)
    parts = sharding.assign_shards(again, limit=80, name="s").groupBy("s.shard").sum("s.n_bytes").collect()
    assert sum(r[1] for r in parts) == 50 * 8 + 5 and max(r[1] for r in parts) <= 80
    assert sharding.assign_shards(no_docs).collect() == []


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=60_000)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    sizes = back.selectExpr("shard", "octet_length(text) AS n").groupBy("shard").sum("n").collect()
    assert len(sizes) > 3 and max(r[1] for r in sizes) <= 60_000


def test_additive_model(spark, odd_docs, odd_rows, no_docs):
    scored = QUERIES["op2_additive_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95
    featured = quality_gam.with_features(odd_docs)
    empty = quality_gam.fit(featured, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_gam.score(featured, empty).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (100, 0), (101, None), (None, 1), (102, 7), (100, 0)], "doc_id long, quality int")
    assert quality_gam.score(featured, quality_gam.fit(featured, labels)).count() == len(odd_rows)
    assert quality_gam.score(quality_gam.with_features(no_docs), empty).collect() == []


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_gam(x[:3000], y[:3000])
    assert (((model.score(x[3000:]) > 0.5) == y[3000:]).mean()) > 0.9
    by_hand = [model.intercept + sum(t[b] for t, b in zip(model.tables, row)) + sum(t[r[a], r[b]] for a, b, t in model.pairs)
               for row, r in zip(model.bins(x[:5]), model.coarse(model.bins(x[:5])))]
    assert np.allclose(by_hand, model.logits(x[:5]))


def test_every_number_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
