"""run() against the stages redone in plain Python on the smallest tables."""

import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp

from ..conftest import SMALL
from .test_decontaminate import sh
from .test_mixing import wanted
from .test_ngram_join import brute
from .test_lines import plain
from .test_quality import brute_model, codes, is_held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(docs, trusted, held):
    import math

    p = brute_model([d["text"] for d in docs if d["doc_id"] in trusted and d["doc_id"] not in held])
    memo: dict = {}

    def log(g):
        if g not in memo:
            memo[g] = math.log(p(g))
        return memo[g]

    for d in docs:
        c = codes(d["text"])
        d["sum"] = sum(log(tuple(c[i - 3 : i + 1])) for i in range(3, len(c)))
    good = [d for d in docs if d["doc_id"] in trusted and d["doc_id"] in held]
    langs = {l: [d for d in good if d["lang"] == l] for l in {d["lang"] for d in docs}}
    mean = lambda ds: sum(d["sum"] for d in ds) / sum(len(d["text"]) for d in ds)
    for d in docs:
        own = langs[d["lang"]] if len(langs[d["lang"]]) >= 30 else good
        d["score"] = math.exp(-(d["sum"] + 32 * mean(own)) / (len(d["text"]) + 32))
    limit = lambda ds: 1.1 * 2 ** (sorted(math.ceil(math.log2(d["score"]) * 512) for d in ds)[math.ceil(0.99 * len(ds)) - 1] / 512)
    return [d for d in docs if d["score"] <= limit(langs[d["lang"]] if len(langs[d["lang"]]) >= 30 else good)]


def plain_lines(docs):
    kept = plain([(d["doc_id"], d["text"]) for d in docs])
    for d in docs:
        d["text"] = kept[d["doc_id"]]
    return docs


@pytest.fixture(scope="module")
def result(spark):
    return cp.run(spark, SMALL).collect()


def test_run_against_plain_python(spark, result):
    docs = sorted(pq.read_table(f"{SMALL}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    trusted = {r["doc_id"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist() if r["quality"] == 1}
    docs = plain_lines(plain_quality(docs, trusted, is_held_out(spark, [d["doc_id"] for d in docs])))
    heads = brute([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if heads[d["doc_id"]][1] == d["doc_id"]]
    items = [sh(r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    docs = [d for d in docs if not any(i and 100 * len(i & sh(d["text"])) >= 80 * len(i) for i in items)]
    sizes, n = {}, {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + n[d["doc_id"]]
    goal, texts = wanted(sizes), {d["doc_id"]: d["text"] for d in docs}
    taken: dict = {}
    for r in result:
        assert r["text"] == texts[r["doc_id"]] and r["size"] == n[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * goal[r["source"]] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken.get(s, 0) - goal[s]) <= 3 * 64 for s in goal)


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).columns == docs.columns


def test_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, total int"
    rows = [(1, None, None, None, None, 1, 1), (2, "", "en", "a", 0, 1, 1), (2, "", "en", "a", 0, 1, 1), (3, "some words of a text here", "en", "a", 25, 1, 1), (None, "no id", "en", "a", 5, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
        assert docs.count() <= 4, name
    assert [r["doc_id"] for r in docs.collect()] in ([], [3])
