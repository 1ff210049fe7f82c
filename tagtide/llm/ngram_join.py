"""N-gram Jaccard join by vertical partitioning.

The shingles of all texts have one global order: by document frequency, then by hash, so rare ones
come first. The order is worked on in fragments throughout:

1. Hash fragments count frequencies, in two levels. Each text's distinct shingles go, as packed blobs of
   64-bit names, to fragments of the hash range; a fragment counts in how many different texts each of its
   shingles occurs and drops those that occur in one only. They can't be shared. Of a shingle that `HOT`
   texts of one pack hold, the fragment gets the pack's count only, and the texts are rows that are joined
   to the summed counts, so that however many texts hold a shingle, a fragment has at most HOT - 1 postings
   of it per pack, and the join is split by AQE.
2. A text of n shingles needs a partner that shares ceil(t*n) of them, so two linked texts share one
   of their first n - ceil(t*n) + 1 shingles of the order (prefix filter). Most texts' prefixes
   consist of unshared shingles and drop out. The others' prefixes become postings.
3. Candidates come from postings in two rounds. In the first, each member of a posting list is paired with
   the list's leader only, so the pairs are at most as many as the postings; a posting list of near copies
   thereby becomes one component. The second looks for links across components: a member meets the members
   of the list whose size, by its own size and number of shared shingles, permits the similarity, and that
   are in other components. Members that share too few of their shingles to be linked with anything meet none.
4. A candidate pair's overlap is counted in each order fragment (frequency class) by itself; the
   partial counts are summed per pair and held against 100 * intersection >= 80 * union.

Texts with equal shingle sets are one class from the start. Links are kept between classes, plus
membership, and connected by `components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm import tokens as tk
from tagtide.llm.common import cut, reshuffled, tidy
from tagtide.llm.components import components

#: Shingles gathered before they are packed, and the texts of a pack whose common shingle is counted apart.
PACK, HOT = 500_000, 4
#: What a packed row is: documents with class and size, postings, counts of hot shingles, postings of hot shingles.
DOCS, POSTS, COUNTS, SIDE = range(4)

_PACKED = pa.schema([("frag", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("toks", pa.binary())])
_LISTED = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("pos", pa.int32()), ("tok", pa.int64()), ("seg", pa.int32()), ("blob", pa.binary())])


def _hot(toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur HOT times or more, sorted, and how often."""
    toks = np.sort(toks)
    edge = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1], [True]]))
    counts = np.diff(edge)
    return toks[edge[:-1][counts >= HOT]], counts[counts >= HOT]


def _named_as(toks: np.ndarray, frag) -> np.ndarray:
    """A shingle's name: the low 56 bits of its hash, and 8 of its fragment's number, which stands for the high ones."""
    return toks & tk.U(2**56 - 1) | (np.asarray(frag, tk.U) & tk.U(255)) << tk.U(56)


def _pack(n_frag: int, k: int):
    """(doc_id, text) -> per fragment: class keys, set sizes, how many shingles each has here, their names.

    Fragments from n_frag on carry what needs no counting: (doc_id, class, size) of all documents, and
    the classes of hot shingles.
    """

    def _frag(toks):
        return ((toks >> tk.U(32)) * tk.U(n_frag)) >> tk.U(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flushed = {}, 0
        task = TaskContext.get().partitionId()
        docs: list = []
        total = 0

        def flush():
            nonlocal held, docs, total, flushed
            if not docs:
                return
            ids = np.concatenate([d[0] for d in docs])
            keys = np.concatenate([d[1] for d in docs])
            sizes = np.concatenate([d[2] for d in docs])
            apart = n_frag + (task + flushed) % n_frag
            rows = [(apart, DOCS, ids.tobytes(), keys.tobytes(), sizes.tobytes(), b"", b"")]
            flushed += 1
            if held:
                own = np.fromiter(held.keys(), np.int64, len(held))
                lens = np.fromiter((len(x) for x in held.values()), np.int64, len(held))
                toks = np.concatenate(list(held.values()))
                owner = np.repeat(np.arange(len(own), dtype=np.int32), lens)
                hot, often = _hot(toks)
                if len(hot):  # few, in their names
                    is_hot = hot[np.minimum(np.searchsorted(hot, toks), len(hot) - 1)] == toks
                    there = owner[is_hot]
                    rows.append((apart, SIDE, None, own[there].tobytes(), lens[there].astype(np.int32).tobytes(), b"", _named_as(toks[is_hot], _frag(toks[is_hot])).tobytes()))
                    toks, owner = toks[~is_hot], owner[~is_hot]
                    spots = _frag(hot)
                    hot, parts = _named_as(hot, spots), np.searchsorted(spots, np.arange(n_frag + 1, dtype=np.uint64))
                    rows += [(f, COUNTS, None, b"", b"", often[x:y].astype(np.int32).tobytes(), hot[x:y].tobytes()) for f, (x, y) in enumerate(zip(parts[:-1], parts[1:])) if x < y]
                frag = _frag(toks)
                order = np.argsort(frag.astype(np.uint16 if n_frag < 65536 else np.uint32), kind="stable")
                toks, owner, frag = toks[order], owner[order], frag[order]
                low = toks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                at = np.searchsorted(frag, np.arange(n_frag + 1, dtype=np.uint64))
                for f in range(n_frag):
                    a, b = at[f], at[f + 1]
                    if a == b:
                        continue
                    there, counts = np.unique(owner[a:b], return_counts=True)
                    rows.append((f, POSTS, None, own[there].tobytes(), lens[there].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), low[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PACKED)], schema=_PACKED)
            held, docs, total = {}, [], 0

        for batch in batches:
            buf, off = tk.raw(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in tk.pieces(off):
                h, at = tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], folded=True)
                grams = tk.gram_hashes(h, k)
                keys, sizes = np.zeros(j - i, np.int64), np.zeros(j - i, np.int32)
                for d in range(j - i):
                    a, b = at[d], at[d + 1]
                    if a == b:
                        continue
                    own = np.unique(grams[a : b - k + 1]) if b - a >= k else np.array([tk.sequence_hash(h[a:b])], tk.U)
                    key = int(tk.mix(np.array([tk.mix(own ^ tk.STEP).sum(dtype=tk.U) + tk.U(len(own))], tk.U)).view(np.int64)[0])
                    keys[d], sizes[d] = key, len(own)
                    if key not in held:
                        held[key] = own
                        total += len(own)
                docs.append((ids[i:j].astype(np.int64), keys, sizes))
                if total >= PACK:
                    yield from flush()
        yield from flush()

    return run


_COUNTED = pa.schema([("kind", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("a", pa.binary()), ("toks", pa.binary()), ("dfs", pa.binary())])


def _count(table: pa.Table) -> pa.Table:
    """One fragment: document frequencies of its shingles; rows (class, size, shared shingles, their frequencies)."""
    kinds = table.column("kind").to_numpy()
    if kinds[0] in (DOCS, SIDE):
        return table.select(["kind", "docs", "keys", "sizes", "toks", "counts"]).rename_columns(_COUNTED.names).cast(_COUNTED)
    join = lambda part, name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
    posts, often = table.filter(pa.array(kinds == POSTS)), table.filter(pa.array(kinds == COUNTS))
    hot, where = np.unique(join(often, "toks", np.uint64), return_inverse=True)
    hot_df = np.bincount(where, join(often, "counts", np.int32), len(hot)).astype(np.int64)
    keys, sizes, counts = join(posts, "keys", np.int64), join(posts, "sizes", np.int32), join(posts, "counts", np.int32)
    # a class that is in several packs has its postings from the first
    uniq, first, code = np.unique(keys, return_index=True, return_inverse=True)
    size_of = sizes[first]
    mine = np.zeros(len(keys), bool)
    mine[first] = True
    mine = np.repeat(mine, counts)
    owner = np.repeat(code.astype(np.int32), counts)[mine]
    low = np.zeros((len(owner), 8), np.uint8)
    low[:, :7] = join(posts, "toks", np.uint8).reshape(-1, 7)[mine]
    toks = _named_as(low.view("<u8").ravel(), table.column("frag")[0].as_py())
    del low, mine
    order = np.argsort(toks, kind="stable")
    toks, owner = toks[order], owner[order]
    del order
    edge = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]])) if len(toks) else np.zeros(0, np.int64)
    n = np.diff(np.append(edge, len(toks)))
    # a shingle that is hot in some packs has postings from the others; as a class may be in several packs, its count is at least the number of classes
    if len(hot) and len(edge):
        at = np.minimum(np.searchsorted(hot, toks[edge]), len(hot) - 1)
        known = hot[at] == toks[edge]
        hot_df += np.bincount(at[known], n[known], len(hot)).astype(np.int64)
        of = np.where(known, hot_df[at], n)
    else:
        of = n
    df = np.repeat(of, n)
    shared = df > 1
    toks, owner, df = toks[shared].view(np.int64), owner[shared], np.minimum(df[shared], 2**31 - 1).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    toks, owner, df = toks[order], owner[order], df[order]
    at = np.searchsorted(owner, np.arange(len(uniq) + 1))
    has = np.flatnonzero(np.diff(at))
    cell = lambda x: [x[at[i] : at[i + 1]].tobytes() for i in has]
    columns = [[POSTS] * len(has), [None] * len(has), [uniq[i : i + 1].tobytes() for i in has], [size_of[i : i + 1].tobytes() for i in has], cell(toks), cell(df)]
    if len(hot):
        for c, x in zip(columns, (COUNTS, None, b"", b"", hot.tobytes(), np.minimum(hot_df, 2**31 - 1).astype(np.int32).tobytes())):
            c.append(x)
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _COUNTED)], schema=_COUNTED)


def _rows(names: dict[str, type]):
    """Blobs of numbers -> one row per number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(np.frombuffer(b"".join(batch.column(c).to_pylist()), t)) for c, t in names.items()]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, tok, df) -> the same with tok and df as blobs of one number."""
    for batch in batches:
        blob = lambda c, t: pa.array([x.tobytes() for x in batch.column(c).to_numpy().astype(t).reshape(-1, 1)], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), blob("tok", np.int64), blob("df", np.int32)], names=["key", "n", "toks", "dfs"])


def _prefixes(percent: int):
    """Sorted rows of a class from all fragments -> postings of its prefix, and its segments by order fragment."""

    def emit(key, size, toks, dfs, out):
        toks = np.concatenate([np.frombuffer(x, np.int64) for x in toks])
        dfs = np.concatenate([np.frombuffer(x, np.int32) for x in dfs])
        # a class that is in several packs has its hot shingles from each
        toks, at = np.unique(toks, return_index=True)
        dfs = dfs[at]
        prefix = size - -(-percent * size // 100) + 1 - (size - len(toks))
        if prefix <= 0:
            return
        order = np.lexsort((toks, dfs))
        toks, dfs = toks[order], dfs[order]
        own = size - len(toks)
        for i, x in enumerate(toks[:prefix], own + 1):
            out.append((key, size, own, i, int(x), None, None))
        seg = np.floor(np.log2(dfs)).astype(np.int64)
        for s in np.unique(seg):
            out.append((key, size, own, None, None, int(s), np.sort(toks[seg == s]).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _LISTED)], schema=_LISTED)
        for batch in batches:
            for key, size, toks, dfs in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "toks", "dfs"))):
                if now is None or now[0] != key:
                    if now:
                        emit(*now, out)
                    now = (key, size, [], [])
                now[2].append(toks)
                now[3].append(dfs)
            if len(out) > 20_000:
                yield pack(out)
                out = []
        if now:
            emit(*now, out)
        if out:
            yield pack(out)

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(found, pa.int64())], names=["a", "b", "na", "nb", "part"])


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs whose summed partial overlaps reach the similarity."""
    x = segments.select(F.col("key").alias("a"), "seg", F.col("blob").alias("x"))
    y = segments.select(F.col("key").alias("b"), "seg", F.col("blob").alias("y"))
    parts = pairs.join(x, "a").join(y, ["b", "seg"]).select("a", "b", "na", "nb", "x", "y").mapInArrow(_overlaps, "a long, b long, na int, nb int, part long")
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).filter(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b")


def _near(percent: int) -> Column:
    """A pair that has to share `needed` shingles shares one of the first n - needed + 1 of both, and can't share more than what either has in shared shingles."""
    needed = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    return F.expr(f"least(sa, sb) >= {needed} and pa <= na - {needed} + 1 and pb <= nb - {needed} + 1")


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """(tok, key, n, s shared shingles, pos, comp) -> (a, b, na, nb): pairs of a list that are in different components and may be linked.

    Of two sizes na <= nb that are linked, nb is at most na * 100 / percent, and na + nb at most what either's
    shared shingles allow; sizes are met by buckets of 5 %, so those that can't be linked aren't paired at all.
    """
    bucket = lambda n: f"cast(floor(ln({n}) / ln(1.05)) as int)"
    reach = f"least(100 * n div {percent}, {100 + percent} * s div {percent} - n)"
    left = posts.withColumn("reach", F.expr(reach)).filter("reach >= n").selectExpr("tok", f"explode(sequence({bucket('n')}, {bucket('reach')})) g", "key a", "n na", "s sa", "pos pa", "comp ca")
    right = posts.filter(f"100 * s >= {percent} * n").selectExpr("tok", f"{bucket('n')} g", "key b", "n nb", "s sb", "pos pb", "comp cb")
    met = left.join(right, ["tok", "g"]).filter("ca <> cb and (na < nb or na = nb and a < b)").filter(_near(percent))
    met = met.selectExpr("least(struct(a, na), struct(b as a, nb as na)) p", "greatest(struct(a, na), struct(b as a, nb as na)) q")
    return met.selectExpr("p.a a", "q.a b", "p.na na", "q.na nb")


def _cut(df: DataFrame) -> DataFrame:
    """`cut`, and what its plans and tasks leave in the driver goes before the next step: else its heap grows to its limit, though little of it lives."""
    out = cut(df)
    tidy(df.sparkSession)
    return out


def _expand(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, k, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "keys", "a"))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(i, np.int64)), pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(n, np.int32).astype(np.int64))], names=["doc_id", "key", "n_shingles"])

    return rows.select("ids", "keys", "a").mapInArrow(run, "doc_id long, key long, n_shingles long")


def ngram_components(docs: DataFrame, percent: int = 80, k: int = 5, tokens_per_fragment: int = 2_000_000) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, class_id, component_id); links at Jaccard >= percent / 100.

    class_id is the smallest doc_id with an equal shingle set, component_id the smallest doc_id that
    links reach. Words are folded A-Z; with fewer than k words, the whole sequence is one shingle; with
    none (null or empty text) n_shingles is 0 and the document is linked with nothing, not even with
    another empty one. Rows with a null doc_id are left out; rows that share a doc_id are one document, whose
    links are those of all its texts, and each keeps its row; other columns are ignored. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    n_words = docs.select((F.sum(F.octet_length("text")) / 5).cast("long")).first()[0] or 0
    n_frag = max(48, 1 + n_words // tokens_per_fragment)
    packed = docs.mapInArrow(_pack(n_frag, k), "frag int, kind int, docs binary, keys binary, sizes binary, counts binary, toks binary")
    counted = _cut(packed.groupBy("frag").applyInArrow(_count, "kind int, ids binary, keys binary, a binary, toks binary, dfs binary"))
    meta = _cut(_expand(counted.filter(f"kind = {DOCS}")))
    shared = counted.filter(f"kind = {POSTS}").mapInArrow(_named, "key long, n int, toks binary, dfs binary")
    often = counted.filter(f"kind = {COUNTS}").select("toks", "dfs").mapInArrow(_rows({"toks": np.int64, "dfs": np.int32}), "toks long, dfs int").toDF("tok", "df")
    side = counted.filter(f"kind = {SIDE}").select("toks", "keys", "a").mapInArrow(_rows({"toks": np.int64, "keys": np.int64, "a": np.int32}), "toks long, keys long, a int").toDF("tok", "key", "n")
    hot = side.join(reshuffled(often, "tok"), "tok").select("key", "n", "tok", "df").mapInArrow(_cells, "key long, n int, toks binary, dfs binary")
    listed = _cut(shared.unionByName(hot).repartition("key").sortWithinPartitions("key").mapInArrow(_prefixes(percent), "key long, n int, own int, pos int, tok long, seg int, blob binary"))
    posts = listed.filter("tok is not null").selectExpr("tok", "key", "n", "n - own s", "pos")
    segments = listed.filter("seg is not null").select("key", "seg", "blob")
    near = _near(percent)
    # the leader of a list has the least share of shingles of its own: of near copies, the original
    lead = posts.groupBy("tok").agg(F.min(F.struct(F.expr("1000 * (n - s) div n").alias("own"), F.xxhash64("key").alias("h"), "key", "n", "s", "pos")).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1").selectExpr("tok", "lead.key b", "lead.n nb", "lead.s sb", "lead.pos pb")
    star = posts.selectExpr("tok", "key a", "n na", "s sa", "pos pa").join(reshuffled(lead, "tok"), "tok").filter("a <> b").filter(near)
    first = _cut(star.select(F.expr("least(struct(a, na), struct(b as a, nb as na))").alias("p"), F.expr("greatest(struct(a, na), struct(b as a, nb as na))").alias("q")).distinct().selectExpr("p.a a", "q.a b", "p.na na", "q.na nb"))
    links = _cut(_links(first, segments, percent))
    # rows that share a doc_id are one document
    twins = meta.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("doc_id", "a")
    links = links.unionByName(_cut(meta.filter("n_shingles > 0").join(reshuffled(twins, "doc_id"), "doc_id").select("a", F.col("key").alias("b")).distinct()))
    joined = components(links)
    label = posts.select("key").distinct().join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("comp"))
    named = posts.join(label, "key")
    mixed = named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
    rest = _cut(named.join(reshuffled(mixed, "tok"), "tok", "left_semi"))
    met = _across(rest, percent)
    second = met.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb")
    more = _cut(_links(second, segments, percent))
    # the components found so far stand for their links: the second search only joins them, mostly in a round
    final = joined if more.isEmpty() else components(joined.selectExpr("node a", "component b").unionByName(more))
    final = final.withColumnRenamed("node", "key")
    classes = meta.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    # tables of classes grow with the data: they are merged, not broadcast through the driver
    classes = classes.join(final.hint("merge"), "key", "left").select("key", "class_id", F.coalesce("component", "key").alias("component"))
    heads = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(heads.hint("merge"), "component").select("key", "class_id", "component_id")
    alone = meta.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return meta.filter("n_shingles > 0").join(classes.hint("merge"), "key").select("doc_id", "n_shingles", "class_id", "component_id").unionByName(alone)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        sizes = np.frombuffer(b"".join(batch.column("a").to_pylist()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), batch.column("toks"), batch.column("dfs")], names=["key", "n", "toks", "dfs"])


def sql(percent: int = 80, k: int = 5) -> str:
    """DuckDB's form: all pairs that share a shingle, and a recursive walk along the links."""
    return rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) end s from w),
classes as (select doc_id, s, len(s) n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by list_sort(s)) end class_id from sets),
grams as (select doc_id, n, unnest(s) g from classes where doc_id = class_id and n > 0),
edges as (select a.doc_id a, b.doc_id b from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
walk as (select distinct class_id d, class_id r from classes union select x.d, case when x.r = e.a then e.b else e.a end from walk x join edges e on x.r = e.a or x.r = e.b),
least_of as (select d, min(r) r from walk group by d)
select doc_id, n::BIGINT n_shingles, r component_id, class_id from classes join least_of on d = class_id"""
