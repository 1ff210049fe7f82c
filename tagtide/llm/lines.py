"""Line dedup by prefix doubling over line-ID sequences. Native.

A document is a sequence of line IDs (128-bit fingerprints of the whole lines). Names of runs of 1, 2,
4, ... lines come by prefix doubling: the name of 2n lines is the fingerprint of the names of its two
halves, taken inside the document's row, so no sequence crosses the network. Doubling goes on until a
run of any document's lines holds `min_chars` characters.

Only runs that say something count: at least `min_chars` characters in all, whatever their number of
lines. A repeated run is covered by its shortest runs that still count: from each line the shortest one
that starts there, and the shortest one that ends there. They are found by descending the doubled names
from the longest, which also names them, and have an earlier copy whenever the run around them has one;
so the lines they cover together are exactly those of all repeated runs of any length. Sorting the names
groups equal runs; the group's first keeps its lines and later ones lose theirs.

Fingerprints are grouped with map-side aggregation, and only groups with a second member are joined
back, so a line that is in every third document costs one row per task before the shuffle of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import reshuffled

NAMES = "array<struct<p: bigint, q: bigint, n: int>>"


def _levels(docs: DataFrame, min_chars: int) -> int:
    """Doublings after which runs are sure to hold `min_chars`: lines that aren't empty hold one character, empty ones are counted."""
    # of n empty lines in a row, at least (n - 2) / 2 are taken out here
    pairs = F.length("text") - F.length(F.replace("text", F.lit("\n\n"), F.lit("\n")))
    most = docs.agg(F.max(pairs)).head()[0] or 0
    return (min_chars + 2 * most + 2).bit_length() - 1


def _shortest(levels: int, min_chars: int, back: bool) -> str:
    """SQL: per line i, (i, m, p, q) of the longest run of m lines below min_chars characters that starts (back: ends) at i, as a descent of the doubled names."""
    spot = "a.i - cast(shiftleft(1, k) as int) + 1" if back else "a.i"
    room = f"{spot} >= 0" if back else "a.i + shiftleft(1, k) <= size(r0)"
    step = "-" if back else "+"
    x = f"lv[k][{spot}]"
    return (
        f"transform(r0, (l, at) -> aggregate(array({', '.join(map(str, range(levels, -1, -1)))}), named_struct('i', at, 'n', 0, 'p', 0L, 'q', 0L), "
        f"(a, k) -> if({room}, if(a.n + {x}.n < {min_chars}, named_struct('i', a.i {step} cast(shiftleft(1, k) as int), 'n', a.n + {x}.n, 'p', xxhash64(a.p, {x}.p), 'q', xxhash64(a.q, {x}.q)), a), a)))"
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """documents -> the same rows with repeated runs of lines removed, plus n_lines and n_removed.

    Lines are what '\\n' separates; runs of any number of lines are compared whole and unchanged.
    Of equal runs the first stays, by doc_id (null last), then line number. A null text stays null and
    has no lines; an empty text has one empty line. Rows that share a doc_id count as one document, so
    copies of a row lose no lines against each other. A text whose lines all go becomes ''. n_chars, if
    there, is set to the new length. Other columns pass unchanged, but n_lines, n_removed and names
    that begin with '_ld' are overwritten.
    """
    levels = _levels(docs, min_chars)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    lines = docs.select(order.alias("_ld_id"), F.split("text", "\n", -1).alias("ls")).filter("ls is not null")
    named = lines.select("_ld_id", F.expr("transform(ls, l -> struct(xxhash64(l) as p, xxhash64(7, l) as q, length(l) as n))").alias("r0"))
    for k in range(1, levels + 1):
        half = 2 ** (k - 1)
        named = named.withColumn(f"r{k}", F.expr(
            f"if(size(r{k - 1}) > {half}, transform(slice(r{k - 1}, 1, size(r{k - 1}) - {half}), (x, i) -> struct(xxhash64(x.p, r{k - 1}[i + {half}].p) as p, xxhash64(x.q, r{k - 1}[i + {half}].q) as q, x.n + r{k - 1}[i + {half}].n as n)), cast(array() as {NAMES}))"
        ))
    named = named.select("_ld_id", "r0", F.array(*[f"r{k}" for k in range(levels + 1)]).alias("lv"))
    named = named.select("_ld_id", "r0", F.expr(_shortest(levels, min_chars, False)).alias("ahead"), F.expr(_shortest(levels, min_chars, True)).alias("behind"))
    # one line more than the longest run below min_chars is the shortest run that counts; a shortest run both ways is named once
    ahead = "filter(transform(ahead, (x, s) -> if(x.i < size(r0), struct(x.i - s + 1 as k, s as i, xxhash64(x.p, r0[x.i].p) as p, xxhash64(x.q, r0[x.i].q) as q), null)), x -> x is not null)"
    behind = f"filter(transform(behind, (x, e) -> if(x.i >= 0, if(x.n + r0[x.i].n - r0[e].n >= {min_chars}, struct(x.i - e - 1 as k, x.i as i, xxhash64(x.p, r0[x.i].p) as p, xxhash64(x.q, r0[x.i].q) as q), null), null)), x -> x is not null)"
    # k is the number of lines, negative for runs named from their end
    spots = named.select("_ld_id", F.explode(F.expr(f"concat({ahead}, {behind})")).alias("s")).select("_ld_id", "s.*")
    groups = spots.groupBy("k", "p", "q").agg(F.min(F.struct("_ld_id", "i")).alias("first"), F.max(F.struct("_ld_id", "i")).alias("last")).filter("first < last").select("k", "p", "q", "first")
    later = spots.join(reshuffled(groups, "p"), ["k", "p", "q"]).filter("struct(_ld_id, i) > first").select("_ld_id", "i", (F.col("i") + F.abs("k")).alias("e"))
    # each run adds the lines that no run before it reached, so a document has no more of them than lines
    before = Window.partitionBy("_ld_id").orderBy("i", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = later.withColumn("s", F.greatest("i", F.max("e").over(before))).filter("s < e")
    gone = fresh.groupBy("_ld_id").agg(F.flatten(F.collect_list(F.expr("sequence(s, e - 1)"))).alias("_ld_gone"))
    out = docs.withColumn("_ld_id", order).join(gone, "_ld_id", "left")
    ls = F.split("text", "\n", -1)
    kept = F.expr("transform(array_except(sequence(0, size(_ld_lines) - 1), _ld_gone), i -> _ld_lines[i])")
    out = out.withColumn("_ld_lines", ls).withColumn("n_lines", F.coalesce(F.size("_ld_lines"), F.lit(0))).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = out.withColumn("n_removed", F.when(F.col("_ld_gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size("_ld_gone")))
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("_ld_id", "_ld_gone", "_ld_lines")


def sql(min_chars: int = 40) -> str:
    """DuckDB's form, over runs of all lengths: each line meets its earlier copies, and copies at one distance that follow one another are a maximal run."""
    return f"""
with ls as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
per as (select doc_id, unnest(ls) l, unnest(range(1, len(ls) + 1)) i from ls),
met as (select b.doc_id, b.i, a.doc_id src, b.i - a.i off, length(b.l) n from per a join per b on a.l = b.l and (a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.i < b.i)),
runs as (select *, i - row_number() over (partition by doc_id, src, off order by i) run from met),
long as (select doc_id, src, off, run from runs group by all having sum(n) >= {min_chars}),
gone as (select distinct doc_id, i from runs semi join long using (doc_id, src, off, run)),
kept as (select doc_id, count(*) n_lines, count(g.i) n_removed, coalesce(string_agg(l, chr(10) order by i) filter (where g.i is null), '') text from per left join gone g using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::INT n_lines, coalesce(n_removed, 0)::INT n_removed, sha256(k.text) kept_sha256 from documents d left join kept k using (doc_id)"""
