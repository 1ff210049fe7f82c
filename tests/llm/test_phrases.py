import hashlib
import random
import re

import pytest

from tagtide.llm import phrases
from tagtide.llm.phrases import remove_repeats

from .conftest import sentence


def brute(rows, width):
    first, docs = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        docs[i] = w
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in docs.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"per_automaton": 3, "per_pass": 10, "stream": 3000}])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make_docs, seed, options):
    rng = random.Random(seed)
    passages = [sentence(rng, n) for n in (20, 21, 35, 60, 19)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(70, "é " * 200), (71, "é " * 150)]
    rng.shuffle(rows)
    got = remove_repeats(make_docs(rows), width=20, k=6, **options).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got} == brute(rows, 20)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_edges(make_docs):
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "x " + long), (None, long), (5, "a\x85b c")]
    got = sorted(remove_repeats(make_docs(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 60_000, 0), (3, 60_000, 0), (4, 60_001, 60_000), (5, 2, 0), (None, 60_000, 0)]
    assert got[4]["text"] == "x"


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).collect() == []


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5, "g"), (2, text, 6, "h")], "doc_id int, text string, n_words int, gram string")
    assert [(r["doc_id"], r["n_words"], r["n_removed"], r["text"] == text) for r in remove_repeats(df).orderBy("doc_id").collect()] == [(1, 60, 0, True), (2, 60, 60, False)]


def test_automata_locate_every_phrase():
    """Every occurrence of the phrases, in all documents of a stream, and nothing without the automata."""
    rng = random.Random(3)
    passage = sentence(rng, 60).split()
    texts = [sentence(rng, 30).split() + passage + sentence(rng, i).split() for i in range(5)] + [sentence(rng, 200).split()]
    hashes = [phrases.tk.word_hashes(*phrases.tk.raw(phrases.pa.array([" ".join(t)])))[0] for t in texts]
    located = lambda shards: {r["doc_id"] for b in phrases._locate(50, 8, type("Shared", (), {"value": shards}), 1 << 20, 4)(iter([batch])) for r in b.to_pylist()}
    batch = phrases.pa.RecordBatch.from_arrays([phrases.pa.array(range(6)), phrases.pa.array([" ".join(t) for t in texts])], names=["doc_id", "text"])
    grams = phrases.tk.gram_hashes(hashes[0], 8)
    anchor = int(phrases.np.flatnonzero(phrases.anchors(grams[30:83], 43)[1])[0]) + 30
    phrase = phrases.coded(hashes[0][anchor : anchor + 4]).tobytes().decode("utf-16-le")
    assert located([phrase]) == {0, 1, 2, 3, 4} and located([]) == set() and located([phrase[::-1]]) == set()


def test_nothing_is_removed_without_the_automata(make_docs, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    assert [r["n_removed"] for r in remove_repeats(make_docs([(1, text), (2, text)])).orderBy("doc_id").collect()] == [0, 60]
    never = phrases._compiled("\x02" * 8, 4)
    monkeypatch.setattr(phrases, "_compiled", lambda phrases, head: never)
    assert [r["n_removed"] for r in remove_repeats(make_docs([(1, text), (2, text)])).orderBy("doc_id").collect()] == [0, 0]


def test_text_is_not_scanned_once_per_automaton(monkeypatch):
    """However many automata there are, all of them together run over a few times the text, and over all of it."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(300, 500)) for _ in range(30)]
    batch = phrases.pa.RecordBatch.from_arrays([phrases.pa.array(range(30)), phrases.pa.array(texts)], names=["doc_id", "text"])
    scanned = []

    class Counted:
        def iter(self, text):
            scanned.append(text)
            return iter(())

    monkeypatch.setattr(phrases, "_compiled", lambda part, head: Counted())
    list(phrases._locate(50, 8, type("Shared", (), {"value": ["x" * 8] * 64}), 1 << 20, 4)(iter([batch])))
    words = sum(len(t.split()) for t in texts)
    assert len(scanned) == 64 and words <= sum(map(len, scanned)) // 2 < 4 * words
    heads = {part[i : i + 8] for part in scanned for i in range(0, len(part), 2)}
    for t in texts:
        codes = phrases.coded(phrases.tk.word_hashes(*phrases.tk.raw(phrases.pa.array([t])))[0]).tobytes().decode("utf-16-le")
        assert all(codes[i : i + 8] in heads for i in range(0, len(codes) - 7, 2))
