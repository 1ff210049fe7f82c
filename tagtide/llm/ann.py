"""Nearest neighbours by a block matrix join with int8 tiles.

1. Vectors are quantised once: int8 codes times a scale per vector, with the norm and the norm of the error.
   Only codes, a twelfth of a double vector with its numbers, are copied between blocks.
2. Queries and candidates are cut into blocks; a tile is one block of each. One matrix product of the codes
   gives all inner products with a bound on what quantisation can have changed: with x = s*q + e,
   |x.y - s_x s_y q_x.q_y| <= |x||e_y| + |e_x|(|y|+|e_y|). Pairs whose upper bound is below the k-th lower
   bound of their query, seen so far, can't be among its k nearest and are dropped.
3. The surviving pairs of all tiles of a query block meet. Each surviving candidate's original vector is
   fetched once for the block, pairs are recomputed in double precision, and heaps of k entries per query
   keep the best.

Of equal vectors only the k + 1 with the smallest ids are candidates: no other can be in a list. A cell in
which a query has more than `MOST` times k survivors, as among very many near copies that the codes can't
tell apart, is not sent on as pairs: it gets the original vectors and keeps each query's k best itself.

The result is exact: nothing is sampled and recall is 1. The grid has as many query blocks as needed for
a block to stay under `query_block` rows, and candidate groups of about `group_rows` rows; a task holds
one query block and streams its candidates in tiles. Vectors of different lengths have no inner product:
each length is searched by itself, in the same jobs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import cut, partitions

#: Candidates of one tile, and queries of one product.
TILE, ROWS = 4096, 1024
#: Dimensions whose int8 products float32 sums up exactly: 1,024 * 127 ** 2 < 2 ** 24.
SLICE = 1024
#: Survivors a query may have in a cell, in multiples of k, before the cell is worked on with original vectors.
MOST = 4
_CODED = pa.schema([("id", pa.int64()), ("d", pa.int32()), ("row", pa.int64()), ("same", pa.int64()), ("codes", pa.binary()), ("scale", pa.float64()), ("norm", pa.float64()), ("err", pa.float64())])
_PAIRS = "block long, query long, cand long, low double, high double"
_FOUND = pa.schema([("block", pa.int64()), ("query", pa.int64()), ("cand", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes in -127..127, scales, norms, error norms."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    scale = np.where(scale > 0, scale, 5e-324)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127)
    slack = 1 + 1e-9
    # norms of the scaled vectors neither overflow nor vanish
    unit = np.where(top > 0, top, 1.0)
    norm = lambda v: np.sqrt(((v / unit[:, None]) ** 2).sum(1)) * unit * slack + 1e-300
    return codes.astype(np.int8), scale, norm(x), norm(x - codes * scale[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact at any number of dimensions: float32 sums of slices, added in double."""
    out = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], SLICE):
        out += a[:, j : j + SLICE].astype(np.float32) @ b[:, j : j + SLICE].T.astype(np.float32)
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed over the dimensions in order: equal vectors get equal scores."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, v) of one length each -> codes with scale, norm and error norm."""
    for batch in batches:
        sizes = batch.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == d))
            codes, scale, norm, err = quantise(_matrix(rows.column("v"), d))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("d"), rows.column("row"), rows.column("same"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(norm), pa.array(err)], schema=_CODED)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _codes(table: pa.Table, d: int) -> tuple:
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, d)
    return codes, *(table.column(c).to_numpy() for c in ("id", "row", "scale", "norm", "err"))


def _thinned(keep: int):
    """Drops rows that `keep` rows of the batch with an equal vector and a smaller id precede."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_numpy()
            order = np.lexsort((batch.column("id").to_numpy(), same))
            first = np.searchsorted(same[order], same[order])
            yield batch.take(pa.array(np.sort(order[np.arange(len(order)) - first < keep])))

    return run


def _tiles(k: int, most: int):
    """One query block and one candidate group -> the pairs that may be among a query's k nearest, with their bounds; too many: one row without a query."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        block, d = key[1].as_py(), key[0].as_py()
        qc, qid, qrow, qs, qn, qe = _codes(left, d)
        pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        floor = np.full(len(qid), -np.inf)
        for at in range(0, len(right), TILE):
            cc, cid, crow, cs, cn, ce = _codes(right.slice(at, TILE), d)
            fresh = [pairs]
            for a in range(0, len(qid), ROWS):
                z = slice(a, a + ROWS)
                with np.errstate(over="ignore", invalid="ignore"):
                    value = products(qc[z], cc) * (qs[z, None] * cs[None, :])
                    bound = qn[z, None] * ce[None, :] + qe[z, None] * (cn + ce)[None, :]
                    bound += 1e-12 * (np.abs(value) + qn[z, None] * cn[None, :])
                    low, high = value - bound, value + bound
                # what overflows bounds nothing
                low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
                low = np.where(qid[z, None] == cid[None, :], -np.inf, low)
                if low.shape[1] > k:
                    floor[z] = np.maximum(floor[z], np.partition(low, -k, axis=1)[:, -k])
                r, j = np.nonzero((high >= floor[z, None]) & (qid[z, None] != cid[None, :]))
                fresh.append((r + a, crow[j], low[r, j], high[r, j]))
            rows, cand, low, high = (np.concatenate(x) for x in zip(*fresh))
            # the k-th lower bound of what is left
            order = np.lexsort((-low, rows))
            rows, cand, low, high = rows[order], cand[order], low[order], high[order]
            first = np.searchsorted(rows, np.arange(len(qid) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            floor[full] = np.maximum(floor[full], low[first[full] + k - 1])
            keep = high >= floor[rows]
            pairs = rows[keep], cand[keep], low[keep], high[keep]
            if len(pairs[0]) > most * k and np.bincount(pairs[0]).max() > most * k:
                return pa.table([pa.array([block]), pa.array([None], pa.int64()), pa.array([key[2].as_py()], pa.int64()), pa.array([float(d)]), pa.array([0.0])], schema=_FOUND)
        rows, cand, low, high = pairs
        return pa.table([pa.array(np.full(len(rows), block)), pa.array(qrow[rows]), pa.array(cand), pa.array(low), pa.array(high)], schema=_FOUND)

    return run


def _recheck(k: int):
    """A query block's candidates, or a part of them, with their vectors -> each query's k best among them, by heaps. Without a list of queries, all are meant."""

    def run(key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        if not len(queries) or not len(found):
            return _BEST.empty_table()
        d = len(queries.column("v")[0])
        vectors = _matrix(queries.column("v").combine_chunks(), d)
        qid, where = queries.column("id").to_numpy(), {r: i for i, r in enumerate(queries.column("row").to_pylist())}
        heaps: list[list] = [[] for _ in qid]
        for at in range(0, len(found), 256):
            part = found.slice(at, 256)
            cids, cv = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks(), d)
            if "queries" in part.column_names:
                lists = part.column("queries").to_pylist()
                mine = np.array([where[q] for qs in lists for q in qs], np.int64)
                other = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            else:
                rough, slack = vectors @ cv.T, 1e-9 * np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(cv, axis=1)[None, :]
                least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                mine, other = np.nonzero(~(rough + slack < least[:, None]) & (qid[:, None] != cids[None, :]))
            for a in range(0, len(mine), 8192):
                q, c = mine[a : a + 8192], other[a : a + 8192]
                for i, score, cid in zip(q.tolist(), exact(vectors[q], cv[c]).tolist(), cids[c].tolist()):
                    heap, entry = heaps[i], (score, -cid)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [(qid[i], -c, s) for i, heap in enumerate(heaps) for s, c in heap]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), _BEST)], schema=_BEST) if rows else _BEST.empty_table()

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, query_block: int = 16_384, group_rows: int = 131_072, part_bytes: int = 128 << 20, most: int = MOST, least_rows: int = TILE) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k largest inner products of each query.

    `is_query` is a condition on vec_id; candidates are all rows but the query's own vec_id. Scores are
    the inner products in double precision, ties go to the smaller vec_id. Vectors that are null, empty, all
    zero, or hold a null or non-finite component take no part, neither do rows with a null vec_id. Vectors
    of another length have no inner product with a query and are no candidates of it. Rows that repeat a
    vec_id and vector count once; other rows that share a vec_id are vectors of their own, whose queries
    share one list. Other columns are ignored. With fewer than k candidates, all are returned; an empty
    table gives none.

    Any number of dimensions will do. `part_bytes` bounds the original vectors that a recheck task holds, as
    estimated from the number of survivors.
    """
    spark = vectors.sparkSession
    # floats stay floats on the way, as they are exact
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding") if element == "float" else F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    clean = clean.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # a row is named by its id and vector; equal rows are one
    clean = clean.select("id", F.size("v").alias("d"), F.xxhash64("id", "v").alias("row"), "v")
    coded = cut(clean.withColumn("same", F.xxhash64("v")).mapInArrow(_quantised, "id long, d int, row long, same long, codes binary, scale double, norm double, err double").dropDuplicates(["id", "row"]))
    counts = coded.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q"), F.max("d").alias("d")).first()
    blocks = max(1, -(-counts["q"] // query_block))
    # enough groups for all tasks, but none below a tile: each group gives k pairs a query at least
    groups = max(1, min(-(-max(partitions(spark), -(-counts["n"] // group_rows)) // blocks), -(-counts["n"] // least_rows)))
    block = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks))
    group = F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(groups)).cast("int")
    thin = coded.mapInArrow(_thinned(k + 1), coded.schema).repartition("same", F.pmod("id", F.lit(16))).mapInArrow(_thinned(k + 1), coded.schema)
    others = cut(thin.withColumn("_n", F.row_number().over(Window.partitionBy("same").orderBy("id", "row"))).filter(F.col("_n") <= k + 1).drop("_n"))
    numbers = ["id", "row", "codes", "scale", "norm", "err"]
    asked = coded.filter(is_query(F.col("id"))).select("d", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), *numbers)
    offered = others.select("d", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), group.alias("grp"), *numbers)
    cell = ["d", "block", "grp"]
    # both sides of a cogroup come from one table: columns of their own tell them apart
    anew = lambda df, *names: df.select(*[F.col(x).alias(x) for x in names])
    pairs = cut(asked.groupBy(*cell).cogroup(anew(offered, *cell, *numbers).groupBy(*cell)).applyInArrow(_tiles(k, most), _PAIRS))
    wide = cut(pairs.filter("query is null").select(F.col("low").cast("int").alias("d"), "block", F.col("cand").cast("int").alias("grp")))
    pairs = pairs.filter("query is not null")
    if groups > 1:  # across groups: what can't reach the k-th best of a query's lower bounds goes
        down = "(x, y) -> case when x > y then -1 when x < y then 1 else 0 end"
        floors = pairs.groupBy("query").agg(F.expr(f"try_element_at(array_sort(collect_list(low), {down}), {k})").alias("floor"))
        pairs = pairs.join(floors, "query").filter("floor is null or high >= floor")
    wanted = cut(pairs.groupBy("block", "cand").agg(F.collect_list("query").alias("queries")))
    n = wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-n * 8 * (counts["d"] or 1) // part_bytes), -(-partitions(spark) // blocks))
    vectors_of = clean if clean.count() == counts["n"] else clean.dropDuplicates(["id", "row"])
    own = vectors_of.filter(is_query(F.col("id"))).select("id", "d", "row", "v", block.alias("block"))
    fetched = wanted.join(vectors_of.withColumnRenamed("row", "cand"), "cand").withColumn("part", F.pmod(F.xxhash64("cand"), F.lit(parts)).cast("int"))
    cell = ["d", "block", "part"]
    best = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy(*cell).cogroup(anew(fetched, *cell, "id", "v", "queries").groupBy(*cell)).applyInArrow(_recheck(k), "query_id long, vec_id long, score double")
    if wide.count():
        cell = ["d", "block", "grp"]
        whole = anew(others.select("id", "row").join(vectors_of, ["id", "row"]).withColumn("grp", group).join(wide, ["d", "grp"]), *cell, "id", "v")
        best = best.unionByName(own.join(wide, ["d", "block"]).groupBy(*cell).cogroup(whole.groupBy(*cell)).applyInArrow(_recheck(k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 20, every: int = 20) -> str:
    return f"""
with v as (select vec_id, embedding::DOUBLE[] e from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true) and list_contains(list_transform(embedding, lambda x: x <> 0), true)),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
select query_id, rank::INT rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= {k}"""
