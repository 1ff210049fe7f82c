"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order 4: words of an open vocabulary are new too often for a word model to
tell junk from a rare word. A character is its code point, so the letters of every script are told apart; only
digits are one, and characters beyond U+FFFF share 4,096 codes. A 4-gram is one 64-bit number.

Counts of the trusted documents that are trained on are aggregated by n-gram; discounts, context totals and
continuation counts come from them by joins that are sharded on the n-gram's context or suffix. For scoring, the
distinct 4-grams of all documents, pre-aggregated per task, are joined to the model order by order: the probability
of the longest seen suffix, times the back-off weights of the contexts above. Each document then sums up those of
its own 4-grams. What is gathered so grows with what is in the texts; up to a measured size it is broadcast, beyond it
the documents are dealt to shards and meet the entries of their own shard.

Thresholds are quantiles, per language, of the perplexity of trusted documents that the model hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm import tokens as tk
from tagtide.llm.common import cut, small

ORDER, BITS = 4, 16
#: What stands before a document: line breaks.
START = 10


def symbols(chars: np.ndarray) -> np.ndarray:
    """16-bit codes of code points: digits are '0', those beyond the basic plane share the codes from E000 on."""
    out = np.where(chars < 0x10000, chars, 0xE000 | (chars & 0xFFF)).astype(np.uint64)
    out[(chars >= 48) & (chars <= 57)] = 48
    return out


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends in each character, and where each document's begin."""
    chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    at = heads[off]
    n = len(off) - 1
    wide = np.full(len(chars) + 3 * n, START, np.uint64)
    place = np.arange(len(chars)) + 3 * (np.repeat(np.arange(n), np.diff(at)) + 1)
    wide[place] = symbols(chars)
    out = wide[place - 3]
    for j in (2, 1, 0):
        out = out << tk.U(BITS) | wide[place - j]
    return out.view(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-grams with their counts, summed up per piece of text."""
    for batch in batches:
        buf, off = tk.raw(batch.column("text"))
        for i, j in tk.pieces(off):
            codes, counts = np.unique(grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts.astype(np.int64))], names=["g", "c"])


def _distinct(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """4-grams of a task, once each as far as memory allows."""
    seen = np.zeros(0, np.int64)
    out = lambda x: (pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000])], names=["g"]) for i in range(0, len(x), 200_000))
    for batch in batches:
        buf, off = tk.raw(batch.column("text"))
        for i, j in tk.pieces(off):
            seen = np.union1d(seen, np.unique(grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])[0]))
            if len(seen) > most:
                yield from out(seen)
                seen = seen[:0]
    yield from out(seen)


def _suffix(n: int) -> str:
    """SQL of the last n characters of g."""
    return "g" if n == ORDER else f"g & {(1 << n * BITS) - 1}L"


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], float]:
    """(g, c) of the highest order -> per order 1..4 the probabilities (g, p) of seen n-grams and the contexts' back-off weights (ctx, w), and the probability of a character that is new everywhere.

    Lower orders count distinct left neighbours. Each order's table is joined to its contexts' totals and,
    by suffix, to the order below; every join is sharded by its key.
    """
    levels = {ORDER: cut(counts)}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = cut(levels[n + 1].groupBy(F.expr(_suffix(n)).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    new = 1 / (levels[1].count() + 1)
    probabilities, weights = [], []
    below = None
    for n in range(1, ORDER + 1):
        t = levels[n].withColumn("ctx", F.expr(f"shiftrightunsigned(g, {BITS})"))
        r = t.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (r[f"n{k}"] or 0 for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        d1, d2, d3 = (min(max(x, 0.1), k) for x, k in zip(raw, (0.9, 1.9, 2.9)))
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(d).alias("freed")).select("ctx", "total", (F.col("freed") / F.col("total")).alias("w"))
        p = t.join(ctx, "ctx").select("g", "ctx", ((F.col("c") - d) / F.col("total")).alias("own"), "w")
        if below is None:
            p = p.select("g", (F.col("own") + F.col("w") * new).alias("p"))
        else:
            p = p.withColumn("s", F.expr(_suffix(n - 1))).join(below.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").select("g", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
        below = cut(p)
        probabilities.append(below)
        weights.append(cut(ctx.select("ctx", "w")))
    return probabilities, weights, new


def probabilities_of(wanted: DataFrame, seen: list[DataFrame], weights: list[DataFrame], new: float) -> DataFrame:
    """(g) -> (g, lp): log-probabilities of any 4-grams, by joins order by order from the lowest."""
    first = weights[0].first()
    t = wanted.withColumn("p", F.lit((first["w"] if first else 1.0) * new))
    for n in range(1, ORDER + 1):
        if n > 1:
            t = t.withColumn("ctx", F.expr(f"shiftrightunsigned({_suffix(n)}, {BITS})")).join(weights[n - 1], "ctx", "left").withColumn("p", F.coalesce("w", F.lit(1.0)) * F.col("p")).drop("ctx", "w")
        t = t.withColumn("s", F.expr(_suffix(n))).join(seen[n - 1].select(F.col("g").alias("s"), F.col("p").alias("q")), "s", "left").withColumn("p", F.coalesce("q", "p")).drop("s", "q")
    return t.select("g", F.log("p").alias("lp"))


def _sums(buf: np.ndarray, off: np.ndarray, known: np.ndarray, lps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and log-probability of each document; known: all its 4-grams, sorted."""
    n, total = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
    for i, j in tk.pieces(off):
        codes, at = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        own, where = np.unique(codes, return_inverse=True)
        sums = np.concatenate([[0.0], np.cumsum(lps[np.searchsorted(known, own)][where])]) if len(own) else np.zeros(1)
        n[i:j], total[i:j] = np.diff(at), np.diff(sums[at])
    return n, total


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lps = shared.value
        for batch in batches:
            n, total = _sums(*tk.raw(batch.column("text")), known, lps)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(n), pa.array(total)], names=["doc_id", "lang", "n", "total"])

    return run


def _shard_score(key: tuple, docs: pa.Table, entries: pa.Table) -> pa.Table:
    known, lps = entries.column("g").to_numpy(), entries.column("lp").to_numpy()
    order = np.argsort(known)
    n, total = _sums(*tk.raw(docs.column("text")), known[order], lps[order])
    return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n": pa.array(n), "total": pa.array(total)})


def _shard_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        for s in np.unique(shards).tolist():
            own = np.concatenate([b.column("g").to_numpy() for b in _distinct(iter([batch.filter(pa.array(shards == s))]))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), s)), pa.array(own)], names=["shard", "g"])


def held_out(doc_id: Column) -> Column:
    """Trusted documents that limits are taken from; the others are trained on."""
    return F.pmod(F.xxhash64(F.lit("held out"), doc_id), F.lit(3)) == 0


def log_probabilities(docs: DataFrame, trusted_ids: DataFrame, max_broadcast: int = 96 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, lang, text), (doc_id) of trusted documents -> (doc_id, lang, trusted, n characters, total log-probability) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = small(cut(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()))
    taught = ids.filter(~held_out(F.col("doc_id")))
    train = docs.join(taught if taught.limit(1).count() else ids, "doc_id", "left_semi").select("text")
    seen, weights, new = kneser_ney(train.mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))
    wanted = docs.select("text").mapInArrow(_distinct, "g long").distinct()
    table = cut(probabilities_of(wanted, seen, weights, new))
    if table.count() * 16 <= max_broadcast:
        rows = table.toArrow().sort_by("g")
        shared = spark.sparkContext.broadcast((rows.column("g").to_numpy(), rows.column("lp").to_numpy()))
        del rows
        scored = docs.mapInArrow(_score(shared), "doc_id long, lang string, n long, total double")
    else:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // shard_bytes)))
        entries = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_grams, "shard long, g long").distinct().join(table, "g")
        scored = dealt.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(_shard_score, "doc_id long, lang string, n long, total double")
    marked = scored.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "n", "total")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, slack: float = 1.1, prior: int = 32, least: int = 30, **options) -> DataFrame:
    """-> (doc_id, lang, trusted, n, perplexity, score, limit, accepted), one row per input row.

    score is the perplexity with `prior` more characters of the language's average: a few characters are
    little evidence. limit is `slack` times the given quantile of the scores of the language's held-out trusted
    documents, a third of them, to 1/512 of a power of two; languages (null is one) with fewer than `least` of
    these take average and quantile over all languages. If none is held out, the trusted ones are taken; with
    no trusted document at all, everything is accepted. Empty and null texts have no perplexity and are accepted:
    nothing speaks against them. Rows with a null doc_id are scored but never trusted. Other columns are ignored.
    """
    scored = cut(log_probabilities(docs, trusted_ids, **options))
    judges = scored.filter("trusted and n > 0")
    held = judges.filter(held_out(F.col("doc_id")))
    judges = held if held.limit(1).count() else judges
    base = judges.groupBy("lang").agg(F.sum("total").alias("t"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("k"))
    whole = base.agg(F.sum("t").alias("t"), F.sum("m").alias("m")).first()
    if not whole["m"]:
        return scored.select("doc_id", "lang", "trusted", "n", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("limit"), F.lit(True).alias("accepted"))
    means = small(cut(base.filter(F.col("k") >= least).select(F.col("lang").alias("ml"), (F.col("t") / F.col("m")).alias("mean"))))
    mean = F.coalesce("mean", F.lit(whole["t"] / whole["m"]))
    smooth = F.when(F.col("n") > 0, F.exp(-(F.col("total") + prior * mean) / (F.col("n") + prior)))
    smoothed = lambda df: df.join(means, F.col("lang").eqNullSafe(F.col("ml")), "left").withColumn("score", smooth).drop("ml", "mean")
    bins = cut(smoothed(judges).groupBy("lang", F.ceil(F.log2("score") * 512).alias("bin")).agg(F.count(F.lit(1)).alias("c")))

    def edge(df, keys):
        order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy(*keys))).filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*keys).agg(F.min("bin").alias("bin"), F.max("all").alias("all"))

    by_lang = edge(bins, ["lang"]).filter(F.col("all") >= least).select(F.col("lang").alias("l"), "bin")
    overall = edge(bins.groupBy("bin").agg(F.sum("c").alias("c")).withColumn("one", F.lit(1)), ["one"]).first()
    fallback = F.lit(slack * 2 ** (overall["bin"] / 512))
    out = smoothed(scored).withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n")))).join(small(cut(by_lang)), F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce(slack * F.pow(F.lit(2.0), F.col("bin") / 512), fallback)
    return out.select("doc_id", "lang", "trusted", "n", "perplexity", "score", limit.alias("limit"), F.coalesce(F.col("score") <= limit, F.lit(True)).alias("accepted"))
