import numpy as np
import pytest

from tagtide.llm.ann import exact, nearest, products, quantise


def dot(x, y):
    out = 0.0  # in order: sum() compensates
    for a, b in zip(x, y):
        out += float(a) * float(b)
    return out


def brute(rows, k, every):
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, x in good:
        if q % every == 0:
            all_ = sorted((-dot(x, y), c) for c, y in good if c != q and len(x) == len(y))
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(all_[:k], 1)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).astype("float32").tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [rows[0], rows[11]]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [None] + [1.0] * 11), (2080, [float("inf")] + [1.0] * 11), (None, rows[1][1]), (2100, [1.0, 2.0]), (2101, [0.5, -1.0]), (2120, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = nearest(df, lambda c: c % 20 == 0, k=20, query_block=7, group_rows=50, least_rows=10).collect()
    assert {tuple(r) for r in got} == brute(rows, 20, 20)
    # cells with too many survivors are worked on with original vectors, with the same lists
    assert {tuple(r) for r in nearest(df, lambda c: c % 20 == 0, k=20, query_block=7, group_rows=50, least_rows=10, most=1).collect()} == brute(rows, 20, 20)


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], schema)
    assert [tuple(r) for r in nearest(df, lambda c: c % 20 == 0).collect()] == [(0, 1, 1, 5.0)]
    assert nearest(spark.createDataFrame([], schema), lambda c: c % 20 == 0).collect() == []


@pytest.mark.parametrize("d", [64, 1536, 4096])
def test_bounds_hold(d):
    rng = np.random.default_rng(1)
    whole = rng.integers(-127, 128, size=(40, d)).astype(float)
    whole[:, 0] = 127
    for x, y in ((rng.normal(size=(50, d)), rng.normal(size=(80, d)) * 10), (whole[:20], whole[20:]), (np.full((2, d), 127.0), np.full((2, d), 127.0)), (rng.normal(size=(3, d)) * 1e200, rng.normal(size=(3, d)) * 1e-320)):
        (qx, sx, nx, ex), (qy, sy, ny, ey) = quantise(x), quantise(y)
        assert (products(qx, qy) == qx.astype(np.int64) @ qy.astype(np.int64).T).all()
        near = products(qx, qy) * sx[:, None] * sy[None, :]
        bound = nx[:, None] * ey[None, :] + ex[:, None] * (ny + ey)[None, :] + 1e-12 * (np.abs(near) + nx[:, None] * ny[None, :])
        assert (np.abs(near - x @ y.T) <= bound).all()
    assert exact(x[:1], x[:1])[0] > 0


@pytest.mark.parametrize("d", [1536, 4096])
def test_many_dimensions_with_close_candidates(spark, d):
    rng = np.random.default_rng(5)
    base = rng.integers(-100, 101, size=d).astype(float)
    rows = [(i, (base + rng.integers(-3, 4, size=d)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = dict(rows)
    got = {}
    for r in nearest(df, lambda c: c % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 120, 20):
        want = sorted((-dot(v[q], v[c]), c) for c in v if c != q)[:5]
        assert [got[q][i] for i in range(1, 6)] == [(c, -s) for s, c in want]


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(6)
    copy = [3.0, 1.0, 2.0]
    rows = [(i, copy if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, lambda c: c % 20 == 0, k=4).collect()
    best = {q: [c for _, c in sorted((-dot(dict(rows)[q], y), c) for c, y in rows if c != q)[:4]] for q in range(0, 900, 20)}
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in best} == best
