import random
import re

import pytest

from tagtide.llm.components import components
from tagtide.llm.ngram_join import _across, ngram_components

from .conftest import sentence

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def mutated(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make_docs, seed):
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randrange(1, 120))) for i in range(0, 60)]
    rows += [(100 + i, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)) for i in range(30)]
    base = sentence(rng, 150)
    rows += [(200 + i, mutated(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.04]))) for i in range(60)]
    rows += [(300 + i, base.upper()) for i in range(10)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_edges(make_docs):
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE  two"), (10, "one"), (None, "one two"), (11, "a b c d e"), (11, "a b c d e"), (12, "a b c d e" + " z" * 50_000)]
    got = ngram_components(make_docs(rows)).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[5] == (0, 5) and by[6] == (0, 6) and by[7] == (0, 7)
    assert by[8] == by[9] == (1, 8) and by[10] == (1, 10)
    assert by[11] == (1, 11) and by[12][0] == 6 and None not in by
    assert len(got) == 9


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert ngram_components(make_docs([])).collect() == []
    df = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], "doc_id int, text string, key int, tok string")
    assert {tuple(r) for r in ngram_components(df).collect()} == {(1, 1, 1, 1), (2, 1, 1, 1)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}


def test_rows_that_share_a_doc_id_are_one_document(make_docs):
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (5, "a b c d e f"), (5, "p q r s t u"), (7, "p Q r s t u"), (8, "other words"), (5, "")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows)).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (5, 2, 1), (7, 2, 1), (8, 1, 8), (5, 0, 5)}


def test_a_shingle_of_all_texts(make_docs):
    """Counted per pack; the texts that hold it are told apart all the same."""
    rng = random.Random(4)
    rows = [(i, "the same five words here " + sentence(rng, rng.choice([2, 30]))) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(50)] + [(400 + i, mutated(rng, rows[150 + i][1], 0.01)) for i in range(50)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_members_that_cannot_be_linked_are_not_paired(spark):
    """A template with 15 % of own words in each text: equal lists, but no pair can reach the similarity."""
    posts = [(tok, key, 100, 85, 16 + tok, key) for tok in range(5) for key in range(500)] + [(0, 1000, 85, 85, 1, 1000)]
    met = _across(spark.createDataFrame(posts, "tok long, key long, n int, s int, pos int, comp long"), 80).distinct().collect()
    assert {(r["a"], r["b"]) for r in met} == {(key, 1000) for key in range(500)}


def test_driver_keeps_little(make_docs, monkeypatch):
    """Garbage is collected after each step, and links found once aren't connected again."""
    rng = random.Random(4)
    base = [f"a{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(5)] + [(9, "one two three four five six")]
    calls = {"components": 0, "cut": 0, "tidy": 0}

    def counted(name):
        real = getattr(ngram_join, name)

        def run(*args, **options):
            calls[name] += 1
            return real(*args, **options)

        monkeypatch.setattr(ngram_join, name, run)

    from tagtide.llm import ngram_join

    for name in calls:
        counted(name)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(make_docs(rows)).collect()}
    assert got == {**dict.fromkeys(range(5), 0), 9: 9}
    assert calls["components"] == 1 and calls["tidy"] == calls["cut"] > 5
