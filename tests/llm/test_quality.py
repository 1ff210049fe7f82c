import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtide.llm import quality as q

from .conftest import sentence


def codes(text):
    return [10, 10, 10] + [ord("0") if c in "0123456789" else ord(c) if ord(c) < 0x10000 else 0xE000 | ord(c) & 0xFFF for c in text]


def brute_model(texts):
    """Modified Kneser-Ney by dictionaries: P(character | three before)."""
    counts = [None] * 5
    counts[4] = Counter(tuple(c[i - 3 : i + 1]) for t in texts for c in [codes(t)] for i in range(3, len(c)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    made = {}
    for n in range(1, 5):
        c = counts[n]
        ns = [sum(v == k for v in c.values()) for k in range(5)]
        y = ns[1] / (ns[1] + 2 * ns[2]) if ns[1] else 0.5
        raw = (1 - 2 * y * ns[2] / ns[1] if ns[1] else 0.5, 2 - 3 * y * ns[3] / ns[2] if ns[2] else 1.0, 3 - 4 * y * ns[4] / ns[3] if ns[3] else 1.5)
        d = [min(max(x, 0.1), k) for x, k in zip(raw, (0.9, 1.9, 2.9))]
        total, freed = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        made[n] = (c, d, total, freed)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        c, d, total, freed = made[len(g)]
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        v = c[g]
        return (v - d[min(v, 3) - 1] if v else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * lower

    p.known = [g[0] for g in counts[1]]
    return p


def is_held_out(spark, ids):
    return {r["i"] for r in spark.createDataFrame([(i,) for i in ids], "i long").filter(q.held_out(F.col("i"))).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(3, 80), 300), "en" if i % 3 else "de") for i in range(150)]
    rows += [(500 + i, " ".join(w + "***" for w in sentence(rng, 40, 300).split()), "en") for i in range(10)]
    return rows


def test_against_brute_force(spark, make_docs, corpus):
    trusted = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    held = is_held_out(spark, range(150))
    got = q.classify(make_docs(corpus), trusted).collect()
    p = brute_model([t for i, t, _ in corpus if i < 150 and i not in held])
    for r in got[:40] + got[-10:]:
        text = dict((i, t) for i, t, _ in corpus)[r["doc_id"]]
        c = codes(text)
        logp = sum(np.log(p(tuple(c[i - 3 : i + 1]))) for i in range(3, len(c)))
        assert abs(r["perplexity"] / np.exp(-logp / len(text)) - 1) < 1e-4
    assert abs(sum(p((*map(ord, "w1 "), x)) for x in [*p.known, 0x4E00]) - 1) < 1e-9
    # the documents dealt to shards, as when the entries are too many to broadcast
    dealt = q.classify(make_docs(corpus), trusted, max_broadcast=0, shard_bytes=2000).collect()
    near = {(r["doc_id"], r["accepted"], round(r["perplexity"], 6)) for r in dealt}
    assert near == {(r["doc_id"], r["accepted"], round(r["perplexity"], 6)) for r in got}
    assert all(r["accepted"] == (r["score"] <= r["limit"]) for r in got)
    assert not any(r["accepted"] for r in got if r["doc_id"] >= 500)
    assert sum(r["accepted"] for r in got if r["doc_id"] < 150) >= 147


def test_limits_are_quantiles(spark, make_docs, corpus):
    trusted = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    got = q.classify(make_docs(corpus), trusted, quantile=0.9, slack=1.0).collect()
    held = is_held_out(spark, range(150))
    for lang in ("en", "de"):
        own = sorted(r["score"] for r in got if r["doc_id"] in held and (r["lang"] == lang or sum(i in held and x == lang for i, _, x in corpus) < 30))
        limit = next(r["limit"] for r in got if r["lang"] == lang)
        edge = own[int(np.ceil(0.9 * len(own))) - 1]
        assert edge <= limit <= edge * 2 ** (1 / 512) * 1.0001


def test_edges(spark, make_docs, corpus):
    trusted = spark.createDataFrame([(i,) for i in range(150)] + [(None,), (3,), (99_999,)], "doc_id long")
    rows = corpus + [(900, None, "en"), (901, "", "xx"), (902, corpus[1][1], None), (902, corpus[1][1], None), (None, corpus[2][1], "en"), (903, "漢字 🙂 " * 20_000, "zh")]
    got = {}
    for r in q.classify(make_docs(rows), trusted).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[900][0]["accepted"] and got[901][0]["accepted"] and got[900][0]["perplexity"] is None
    assert len(got[902]) == 2 and got[902][0]["accepted"] and got[None][0]["accepted"] and not got[903][0]["accepted"]
    assert q.classify(make_docs([]), trusted).collect() == []
    assert all(r["accepted"] for r in q.classify(make_docs(rows), trusted.limit(0)).collect())


def test_scripts_are_told_apart(spark, make_docs):
    """Junk in scripts that aren't Latin: the same letters in another order."""
    rng = random.Random(8)
    words = ["".join(rng.choices(letters, k=4)) for letters in ("абвгдежзиклмн", "你好世界人民中国大学") for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words[:40] if i % 2 else words[40:], k=60)), "ru" if i % 2 else "zh") for i in range(240)]
    junk = [(1000 + i, "".join(rng.sample(rows[i][1], len(rows[i][1]))), rows[i][2]) for i in range(40)]
    got = q.classify(make_docs(rows + junk), spark.createDataFrame([(i,) for i in range(200)], "doc_id long")).collect()
    assert not any(r["accepted"] for r in got if r["doc_id"] >= 1000)
    assert sum(r["accepted"] for r in got if r["doc_id"] < 240) >= 235
