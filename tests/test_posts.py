import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tagtide.operators import information, tables
from tagtide.sources import posts

DAYS = ["Fri Feb 28 10:00:00 +0000 2013", "Fri Feb 28 11:00:00 +0000 2014"]


@pytest.fixture
def folder(tmp_path):
    raw = [{"created_at": DAYS[0], "text": "Hello\n#Tag @You", "user": {"screen_name": " Me "}}, {"created_at": DAYS[1], "text": "#tag #tag", "user": {"screen_name": "me"}}, {"created_at": DAYS[0], "text": None, "user": {"screen_name": "x"}}]
    lines = ["# comment", "", '{"delete":{}}', *map(json.dumps, raw), '{"created_at": "broken']
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "a.gz", "wt") as f:
        f.write("\n".join(x.replace('{"created_at": ', '{"created_at":') for x in lines))
    with bz2.open(tmp_path / "b.bz2", "wt") as f:
        f.write("\n".join(x.replace('{"created_at": ', '{"created_at":') for x in lines))
    (tmp_path / "_hidden.gz").write_text("x")
    return str(tmp_path)


def test_raw_posts(spark, folder):
    got = posts.raw_posts(spark, folder)
    rows = got.collect()
    assert len(rows) == 4 and {r["file"] for r in rows} == {"a.gz", "b.bz2"} and rows[0]["text"] == "Hello#Tag @You"
    assert {r["screen_name"] for r in posts.normalised(got).collect()} == {"me"}
    flat = posts.sequential_ids(got, ["file", "created_at"], 100)
    assert sorted(r["id"] for r in flat.collect()) == [100, 101, 102, 103]
    uses = tables.post_uses(flat)
    assert {(r["h"], r["nbr_tweets"]) for r in tables.birthdays(uses, ["h"]).collect()} == {("tag", 4)}  # the line break before "#Tag" is deleted
    assert {(r["src"], r["dst"], r["weight"]) for r in tables.mention_network(tables.post_mentions(flat)).collect()} == {("me", "you", 2)}


def test_json_and_text_sinks(spark, folder, tmp_path):
    flat = posts.sequential_ids(posts.raw_posts(spark, folder), ["file", "created_at"], 1).select("id", "text", "created_at", "screen_name")
    out = str(tmp_path / "out")
    posts.write_json_lines(flat, out)
    assert sorted(map(tuple, posts.flat_posts(spark, out).drop("file").collect())) == sorted(map(tuple, flat.collect()))
    posts.write_tsv(flat.select("id", "screen_name"), str(tmp_path / "t"))
    assert posts.read_tsv(spark, str(tmp_path / "t"), "id long, u string").count() == 4
    posts.write_single_text(flat.select("id", "screen_name"), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    posts.write_parquet(flat, str(tmp_path / "p"), ["screen_name"])
    posts.write_csv(flat, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4 == spark.read.option("header", True).csv(str(tmp_path / "c")).count()


def test_tsv_to_csv_and_merge(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\tc\n 1 \tNaN\t\n2\tx\ty\n")
    posts.tsv_to_csv(spark, str(tmp_path / "x.tsv"), str(tmp_path / "x.csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "x.csv")).collect())) == [("1", None, None), ("2", "x", "y")]
    for i in (2, 1):
        (tmp_path / f"r{i}.csv").write_text(f"{i},h2,5\n{i},h1,4\n")
    got = posts.merge_iterations(spark, [str(tmp_path / "r1.csv"), str(tmp_path / "r2.csv")], "iteration int, hashtag string, lag long")
    assert [tuple(r)[:2] for r in got.collect()] == [(1, "h1"), (1, "h2"), (2, "h1"), (2, "h2")]


def test_feature_file(spark, tmp_path):
    (tmp_path / "f.txt").write_text("rows=3,columns=5,term=2,hashtag=1,mention=1,user=1,loc=0\n7 ([0,2],[1.5,2.0]) 1\n8 ([],[]) 0\n9 ([4,1],[1.0,0.0]) 0\n")
    rows, counts = posts.read_features(spark, str(tmp_path / "f.txt"))
    got = sorted(((r["row_id"], r["label"], r["feature_id"], r["value"], r["family"]) for r in rows.collect()), key=repr)
    assert counts["columns"] == 5 and got == [(7, 1.0, 0, 1.5, "term"), (7, 1.0, 2, 2.0, "hashtag"), (8, 0.0, None, None, None), (9, 0.0, 4, 1.0, "user")]


def test_properties(tmp_path):
    (tmp_path / "c").write_text("# x\na = 1\n\nb=2=3\n")
    assert posts.read_properties(str(tmp_path / "c")) == {"a": "1", "b": "2=3"}


def test_temporal_labels(spark):
    rows = [(1, "a", "old", 0), (2, "a", "mid", 10), (3, "b", "old", 10), (4, "b", "new", 20), (5, "b", "mid", 20), (6, "c", "plain", 20), (7, "c", "new", 20), (7, "c", "old", 20), (8, "d", "mid", 11), (8, "d", "plain", 11)]
    uses = spark.createDataFrame(rows, "tid int, u string, h string, us int")
    topical = spark.createDataFrame([("old",), ("mid",), ("new",), ("unseen",)], "h string")
    got = {tuple(r) for r in tables.labelled_posts(uses, topical, 10, 20).collect()}
    # a tag of another split labels nothing, one of training drops the post
    assert got == {(1, "a", 1, "train"), (2, "a", 1, "val"), (4, "b", 1, "test"), (5, "b", 0, "test"), (6, "c", 0, "test"), (8, "d", 1, "val")}


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(i % 7,) for i in range(100)], "u int")
    assert abs(information.probabilities(rows, "u").agg(F.sum("prob")).first()[0] - 1) < 1e-12


def test_mutual_information_bounds(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "row int, label int")
    features = spark.createDataFrame([(i, "same") for i in range(1, 40, 2)] + [(i, "all") for i in range(40)], "row int, f string")
    got = {r["f"]: r["mi"] for r in information.mutual_information(features, labels, ["f"]).collect()}
    assert abs(got["same"] - 1) < 1e-12 and abs(got["all"]) < 1e-12
