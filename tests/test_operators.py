import random

import pytest
from pyspark.sql import functions as F

from tagtide.functions import language
from tagtide.operators import groups, lag, metrics, ranking_models, sampling, statistics
from tagtide.streaming.birthdays import latest, live_birthdays, start, windowed_uses


def test_profiles_save_and_load(spark, tmp_path):
    texts = spark.createDataFrame([("The quick brown fox",), ("the lazy dog, the end",), (None,), ("",), ("!!",)], "text string")
    p = language.profile(texts, size=20)
    language.save_profile(p, str(tmp_path / "en.ngp"))
    back = language.load_profile(spark, str(tmp_path / "en.ngp"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect())) and ("_th", 3) in map(tuple, p.collect())
    assert language.similarity(p, back).first()[0] == 0 and language.frequency_distance(p, back).first()[0] == 0
    rows = spark.createDataFrame([(1, "the quick"), (2, "zzz"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: (r["distance"], r["language"]) for r in language.identified(language.distance(rows, language.profile(texts), "id")).collect()}
    assert got[1] == (0.0, "en") and got[2][1] == "unknown" and got[3] == got[4] == (None, "unknown")


def test_samples(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    a = sampling.exactly(df, 100, 1, "k").collect()
    assert len(a) == 100 and a == sampling.exactly(df.repartition(3), 100, 1, "k").collect() != sampling.exactly(df, 100, 2, "k").collect()
    assert sampling.exactly(df.limit(5), 100, 1, "k").count() == 5
    assert abs(sampling.bernoulli(df, 0.1, 1, "k").count() - 500) < 100
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "s int, d int")
    assert {r["s"] for r in sampling.one_per_key(edges, "s", "d", 1).collect()} == {1, 2}
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, x array<string>")
    got = {r["k"]: r["v"] for r in lists.select("k", sampling.random_item(F.col("x"), 1, "k").alias("v")).collect()}
    assert got[1] in ("a", "b") and got[2] is None and got[3] is None
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(500)], "k int, y int")
    drawn = sampling.negatives(labels, "y", 9, 3, "k")
    assert drawn.filter("y = 1").count() == 20 and drawn.filter("y = 0").count() == 180 == drawn.filter("y = 0").distinct().count()


def test_sampled_posts_are_exact(spark):
    posts = spark.range(3000).withColumnRenamed("id", "tid")
    sizes = spark.createDataFrame([(0, 0), (1, 1), (2, 777), (3, 9999)], "iteration long, n long")
    got = {r["iteration"]: r["count"] for r in groups.sampled_posts(posts, sizes, "x").distinct().groupBy("iteration").count().collect()}
    assert got == {1: 1, 2: 777, 3: 3000}


def test_lags_are_never_negative(spark):
    rng = random.Random(1)
    uses = spark.createDataFrame([(i, rng.randrange(20), f"h{rng.randrange(9)}", rng.randrange(10**12)) for i in range(400)], "tid int, u int, h string, us long")
    births = uses.groupBy("h").agg(F.min("us").alias("birthday"))
    members = spark.createDataFrame([(0, "A", 1), (0, "A", 2), (0, "Z", 99)], "iteration int, group string, u int")
    per_user = uses.groupBy("u", "h").agg(F.min("us").alias("birthday"), F.count("*").alias("nbr_tweets"))
    got = lag.lag_times(lag.first_uses(members, per_user), births, members).collect()
    assert len(got) == 18 and all(r["lag"] >= 0 for r in got) and all(r["lag"] == lag.MAX_LAG_MS for r in got if r["group"] == "Z")


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 2, 0.8, 0), ("a", 3, 0.7, 1), ("b", 4, 0.5, 0)], "g string, id int, score double, label int")
    ap = {r["g"]: r["ap"] for r in metrics.average_precision_at(rows, ["g"]).collect()}
    assert ap == {"a": pytest.approx((1 + 2 / 3) / 2), "b": 0.0}
    assert {r["g"]: r["p10"] for r in metrics.precision_at(rows, ["g"]).collect()} == {"a": 0.2, "b": 0.0}


def test_outliers_and_bins(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(50, 1), (100, 2), (101, 3), (1000, 4), (1e6, 5), (1e7, 6), (-1, 7)]], "x double, y double")
    got = {r["bin"]: r["n"] for r in statistics.binned_distribution(df, "x", "y").collect()}
    assert got == {0: 2, 1: 2, 4: 1}
    values = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 1000]], "v double")
    assert statistics.without_outliers(values, "v", []).count() == 5


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 5, "2024-01-01 10:00:00"), ("a", 3, "2024-01-02 10:00:00"), ("b", 4, "2024-01-09 10:00:00")], "h string, us long, t string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("h string, us long, t string, ts timestamp").parquet(str(tmp_path / "in"))
    start(live_birthdays(stream), str(tmp_path / "live"), str(tmp_path / "c1")).awaitTermination()
    live = lambda: {tuple(r) for r in latest(spark, str(tmp_path / "live"), "h string, birthday long, nbr_tweets long", ["h"]).collect()}
    assert live() == {("a", 3, 2), ("b", 4, 1)}
    spark.createDataFrame([("b", 1, "2024-01-10 10:00:00")], "h string, us long, t string").withColumn("ts", F.to_timestamp("t")).write.mode("append").parquet(str(tmp_path / "in"))
    start(live_birthdays(stream), str(tmp_path / "live"), str(tmp_path / "c1")).awaitTermination()
    assert live() == {("a", 3, 2), ("b", 1, 2)}
    start(windowed_uses(stream, "ts"), str(tmp_path / "win"), str(tmp_path / "c2"), "append").awaitTermination()
    assert {(r["h"], r["n"]) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "win")).collect()} <= {("a", 1), ("b", 1)}


def test_models_rank_separable_rows(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(3)
    rows = [(i, float(i % 2), Vectors.dense([rng.gauss(2.0 * (2 * (i % 2) - 1), 1), rng.gauss(0, 1)])) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    train, test = df.filter("id < 140"), df.filter("id >= 140")
    for run in (ranking_models.logistic_regression, ranking_models.linear_svm, ranking_models.naive_bayes, ranking_models.random_forest, ranking_models.rocchio):
        scored = run(train, test).withColumn("g", F.lit(1)).withColumn("label", F.col("label").cast("int"))
        assert metrics.average_precision_at(scored, ["g"]).first()["ap"] > 0.9, run.__name__
    assert ranking_models.libsvm_rows(test).first()["value"].split(" ")[1].startswith("1:")
    results, best = ranking_models.tune([1, 2], lambda s: ranking_models.logistic_regression(train, test, s).withColumn("label", F.col("label").cast("int")))
    assert len(results) == 2 and best in (1, 2)


def test_neighbours_are_found_slice_by_slice(spark):
    import numpy as np

    points = np.random.default_rng(5).integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, float(i % 2), p.tolist()) for i, p in enumerate(points)], "id long, label double, v array<double>")
    got = {}
    for r in ranking_models.neighbour_lists(df.filter("id >= 30"), df.filter("id < 30"), 5, block=40, cells=64).collect():
        got.setdefault(r["id"], []).append((r["d"], r["other"]))
    for i in range(30):
        assert sorted(got[i]) == sorted((float(((points[i] - points[o]) ** 2).sum()), o) for o in range(30, 90))[:5]
