import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtide.llm import toxicity as tx

WORDS = "the of and to in that is was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["wretch", "vermin", "blorkish", "blorkard", "blorkette"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def score(spark, make_docs, rows, labels):
    held = lambda c: F.crc32(c.cast("string")) % 4 == 2
    return tx.score(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), held).collect()


def test_held_out_accuracy_and_disguises(spark, make_docs, labelled):
    rows, labels = labelled
    more = [(5000, "what a WR3TCH you are"), (5001, "such v.e.r.m.i.n there"), (5002, "w r e t c h that you are to me"), (5003, "verrrrrmin all"), (5004, "$uch a wretch!!"), (5005, "the water of the people 3.0 ***"), (5006, None), (5007, ""), (5008, "the way " * 40_000)]
    got = {r["doc_id"]: r for r in score(spark, make_docs, rows + more, labels)}
    truth = dict(labels)
    held = [r for i, r in got.items() if r["held_out"] and i in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert [got[i]["predicted"] for i in range(5000, 5009)] == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5006]["score"] == got[5007]["score"]


def test_held_out_labels_are_not_learned(spark, make_docs, labelled):
    rows, labels = labelled
    held = {r["doc_id"] for r in score(spark, make_docs, rows, labels) if r["held_out"]}
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    a = {(r["doc_id"], r["score"]) for r in score(spark, make_docs, rows, labels)}
    assert a == {(r["doc_id"], r["score"]) for r in score(spark, make_docs, rows, turned)}


def test_edges(spark, make_docs):
    assert score(spark, make_docs, [], [(1, 1)]) == []
    got = score(spark, make_docs, [(1, "a"), (1, "a"), (None, "b")], [])
    assert len(got) == 3 and {r["predicted"] for r in got} == {0}
    got = score(spark, make_docs, [(1, "a b"), (3, None)], [(1, None), (1, 1), (None, 1), (77, 0), (3, 1)])
    assert len(got) == 2


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.ones(tx.SIZE), tx.SIZE**2)).ravel()

    def paths(slots):
        return [(t + r, s + c) for t, s in paths(slots[:-1]) for r, c in slots[-1]] if slots else [("", 0.0)]

    def total(text, cost):
        x = y = 0
        for c in text + " ":
            z = tx.CODES.get(c, 0)
            cost += logs[x * tx.SIZE**2 + y * tx.SIZE + z]
            x, y = y, z
        return cost

    for token in ("1d10t", "b@@d", "s.t.0p", "xxxy3"):
        best = max(total(*p) for p in paths(tx.lattice(token)))
        assert any(abs(total(t, c) - best) < 1e-9 and t.strip() == tx.decode(token, logs) for t, c in paths(tx.lattice(token)))


def test_blanks_marks_and_length_are_in_the_lattice(spark, make_docs, labelled):
    rows, labels = labelled
    swears = [(1000 + i, " ".join([*random.Random(i).choices(WORDS, k=12), "ass"])) for i in range(60)]
    labels = labels + [(i, 1) for i, _ in swears]
    bad = ["you are a w r e t c h", "y o u v e r m i n", "y o u  a r e  v e r m i n", "what an a s s", "(w r e t c h)", "w\nr\n3\nt\nc\nh", "an @$$ that is", "a 4$$ that was", "wr" + "e" * 60 + "tch", "t h e y a r e a l l t h e w a t e r p e o p l e w r e t c h"]
    good = ["a b c", "1 2 3 4 5 6", "in 455 of the 2013 days", "t h e w a t e r o f t h e p e o p l e"]
    more = [(5000 + i, t) for i, t in enumerate(bad + good)]
    got = {r["doc_id"]: r["predicted"] for r in score(spark, make_docs, rows + swears + more, labels)}
    assert [got[i] for i, _ in more] == [1] * len(bad) + [0] * len(good)


def test_long_runs_are_read(spark, make_docs, labelled):
    rows, labels = labelled
    more = [(5000, "= " * 3000), (5001, "x" * 100_000), (5002, "a " * 20_000), (5003, "the wr" + "e" * 100_000 + "tch")]
    got = {r["doc_id"]: r["predicted"] for r in score(spark, make_docs, rows + more, labels)}
    assert [got[i] for i, _ in more] == [0, 0, 0, 1]


def plain_scores(rows, labels, docs_logs):
    """The whole of learning and scoring, over all texts in one place."""
    reader = tx.Reader(docs_logs.tolist())
    usable = {}
    for i, y in labels:
        if y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            usable[i] = max(y, usable.get(i, 0))
    texts = {}
    for i, t in rows:
        if t is not None and i in usable:
            texts[t] = max(usable[i], texts.get(t, 0))
    return reader, texts


def test_scores_against_brute_force(spark, make_docs, labelled):
    rows, labels = labelled
    rows = rows[:300] + [(2000 + i, rows[i][1]) for i in range(40)] + [(3000, "@$$ w r e t c h"), (3001, None), (3002, "")]
    labels = labels[:300] + [(2000 + i, 1) for i in range(20)]
    logs = tx.language_model(make_docs(rows))
    reader, texts = plain_scores(rows, labels, logs)
    order = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).orderBy("h").collect()
    near, kept = [], []
    for r in order:
        own = tx.sketch(r["t"])
        if not any(len(set(own) & set(other)) >= min(6, len(own)) for other in near if set(own) & set(other)):
            near.append(own)
            kept.append(r["t"])
    found = {t: {f for w in reader.words(t) for f in tx.features(w)} for t in kept}
    chosen = {}
    for f in set().union(*found.values()):
        n, k = sum(f in x for x in found.values()), sum(f in x and texts[t] for t, x in found.items())
        if k and tx.surely(k, k) >= 0.35 and tx.surely(k, n) >= (0.7 if f.endswith("-") else 0.35):
            chosen[f] = (k + 0.5) / (n + 1)
    rest = [texts[t] for t, x in found.items() if not x & chosen.keys()]
    base = (sum(rest) + 0.1) / (len(rest) + 1)
    assert chosen
    want = {}
    for i, t in rows:
        clean = 1 - base
        for w in reader.words(t or ""):
            clean *= 1 - max((chosen.get(f, 0) for f in tx.features(w)), default=0)
        want[i] = 1 - clean
    got = {r["doc_id"]: r["score"] for r in score(spark, make_docs, rows, labels)}
    assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-12 for i, s in want.items())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", 0.5, 1, "r")], "doc_id int, text string, score double, toxic int, row string")
    labels = spark.createDataFrame([(1, 1, "t")], "doc_id int, toxic int, text string")
    got = tx.score(df, labels, lambda c: F.lit(False)).collect()
    assert [(r["doc_id"], r["held_out"]) for r in got] == [(1, False)]
