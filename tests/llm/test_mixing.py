import random

from tagtide.llm.mixing import mix_sources

from .conftest import sentence


def wanted(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            rest -= target[s]
            open_.discard(s)
    return target


def test_targets_and_takings(make_docs):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.choice([0, 1, 30, 400, 900])), "en", rng.choice(["b", "b", "b", "a", "é", "Z", None])) for i in range(400)]
    rows += [(1000, None, "en", "nul"), (1001, sentence(rng, 30_000), "en", "b"), (None, "x y", "en", "a"), (3, "again", "en", "a")]
    docs = make_docs(rows)
    got = mix_sources(docs, block=16, shard_blocks=64).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = wanted(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == sizes[s] == own[0]["source_size"]
        assert abs(own[0]["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 3 * 16
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    key = lambda rs: sorted(map(repr, rs))
    assert key(got) == key(mix_sources(docs.repartition(7), block=16, shard_blocks=64).collect())


def test_empty_and_wordless(make_docs):
    assert mix_sources(make_docs([])).collect() == []
    got = mix_sources(make_docs([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
