import random

from tagtide.llm.lines import dedup_lines

LONG, OTHER = "this line is long enough to count by itself, surely", "another line that is long enough to count on its own"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_later_copies_go(make_docs):
    rows = [(1, f"{LONG}\nshort"), (2, f"head\n{LONG}\ntail"), (3, f"{LONG}\n{LONG}"), (4, OTHER)]
    assert texts(dedup_lines(make_docs(rows))) == {1: f"{LONG}\nshort", 2: "head\ntail", 3: "", 4: OTHER}


def test_short_lines_only_as_runs(make_docs):
    poem = "\n".join(["roses are red", "violets are blue", "sugar is sweet", "and so are you"])
    rows = [(1, poem), (2, "x\n" + poem + "\ny"), (3, "roses are red\nz")]
    assert texts(dedup_lines(make_docs(rows))) == {1: poem, 2: "x\ny", 3: "roses are red\nz"}


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, LONG), (4, LONG), (None, f"{LONG}\nkept"), (5, "\n".join([OTHER] * 3000))]
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(make_docs(rows)).collect()}
    assert got == {(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, LONG, 1, 0), (None, "kept", 2, 1), (5, OTHER, 3000, 2999)}


def test_columns_pass_and_empty_table(spark, make_docs):
    assert dedup_lines(make_docs([])).collect() == []
    df = spark.createDataFrame([(1, LONG, 7, "k"), (2, LONG + "\nx", 8, "l")], "doc_id long, text string, n_chars long, first string")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["first"]) for r in dedup_lines(df).collect()}
    assert got == {1: (LONG, 7, "k"), 2: ("x", 1, "l")}


def plain(rows, min_chars=40):
    """Every run of any length that holds min_chars and has an earlier copy loses its lines."""
    first, gone = {}, {}
    split = {d: t.split("\n") for d, t in rows}
    runs = [(tuple(ls[i:j]), (d, i)) for d, ls in split.items() for i in range(len(ls)) for j in range(i + 1, len(ls) + 1) if sum(map(len, ls[i:j])) >= min_chars]
    for run, spot in runs:
        first[run] = min(spot, first.get(run, spot))
    for run, (d, i) in runs:
        if first[run] < (d, i):
            gone.setdefault(d, set()).update(range(i, i + len(run)))
    return {d: "\n".join(l for i, l in enumerate(ls) if i not in gone.get(d, ())) for d, ls in split.items()}


def test_runs_of_any_length(make_docs):
    three = [f"fourteen chars{i}"[-14:] for i in range(3)]
    seven = [f"nine chr{i}" for i in range(7)]
    twenty = [f"l{i:03}" for i in range(20)]
    rows = []
    for n, run in enumerate([three, seven, twenty]):
        rows += [(2 * n + 1, "\n".join(["a", *run, "b"])), (2 * n + 2, "\n".join(["c", *run, "d"]))]
    got = texts(dedup_lines(make_docs(rows)))
    assert [got[2], got[4], got[6]] == ["c\nd"] * 3 and all(got[d] == t for d, t in rows if d % 2)


def test_against_brute_force_over_all_lengths(make_docs):
    rng = random.Random(3)
    for pool in (["", "", "a", "bc", "def", "ghijklmn"], ["", "x" * 11, "y" * 14, "z" * 13, LONG], [f"{i:03}" for i in range(90)]):
        stock = [[rng.choice(pool) for _ in range(rng.randrange(1, 40))] for _ in range(6)]
        rows = []
        for d in range(40):
            parts = [rng.choice(pool) for _ in range(rng.randrange(4))]
            for run in rng.sample(stock, 2):
                i = rng.randrange(len(run))
                parts += [f"own {d}", *run[i : i + rng.randrange(40)], rng.choice(pool)]
            rows.append((d, "\n".join(parts)))
        assert texts(dedup_lines(make_docs(rows))) == plain(rows)


def test_long_runs_of_empty_lines(make_docs):
    blanks = "\n" * 700
    rows = [(1, f"a{blanks}{LONG}"), (2, f"b{blanks}{LONG}{blanks}c"), (3, blanks)]
    assert texts(dedup_lines(make_docs(rows))) == {1: rows[0][1], 2: "b" + blanks + "c", 3: blanks}
