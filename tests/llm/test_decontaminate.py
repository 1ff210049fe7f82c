import random
import re

from tagtide.llm.decontaminate import contained_items, contamination

from .conftest import sentence


def sh(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark, make_docs):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(2, 70), 800)) for i in range(40)] + [(100 + n, sentence(rng, n, 800)) for n in (1, 2, 3, 4, 4, 5)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(0, 300), 800)]
        for _, t in rng.sample(items, rng.randrange(0, 3)):
            w = t.upper().split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["changed", w[0]])
            parts += [" ".join(w), sentence(rng, 5, 800)]
        rows.append((i, "\n".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contained_items(make_docs(rows), bench).collect()}
    want = set()
    for d, t in rows:
        for i, u in items:
            n = min(5, len(u.split()))
            own, have = sh(u, n), sh(t, n)
            if own and 100 * len(own & have) >= 80 * len(own):
                want.add((d, i, len(own), len(own & have)))
    assert got == want and len(want) > 10
    shuffled = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contained_items(make_docs(rows), bench, max_broadcast=0).collect()}
    assert shuffled == want


def test_edges(spark, make_docs):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Q b  c d", 0), (4, "a b c d e", 0), (4, "f g h i j k", 0), (None, "a b c d e", 0)], "item_id long, text string, doc_id int")
    rows = [(1, None), (2, "x A B  c\td\ne x"), (2, "x A B  c\td\ne x"), (3, "a b c d"), (None, "a b c d e"), (5, "w " * 60_000 + "a b c d e"), (6, "x q b\nC d y"), (7, "xq b c d")]
    got = {tuple(r) for r in contamination(make_docs(rows), items).collect()}
    assert got == {(1, 0, None, 0.0), (2, 1, 4, 1.0), (3, 0, None, 0.0), (5, 1, 4, 1.0), (6, 1, 3, 1.0), (7, 0, None, 0.0)}
    assert contamination(make_docs([]), items).collect() == []
    assert {r["n_items"] for r in contamination(make_docs(rows), items.limit(0)).collect()} == {0}
