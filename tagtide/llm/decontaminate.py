"""Benchmark decontamination by size-partitioned MinHash containment search. Native.

Short test items are looked for inside long documents: an item is contained when at least `percent` of
its distinct five-word shingles are in a document, wherever they stand. Items are partitioned by the
size of their shingle set (powers of two). In a partition with sets of up to u shingles, an item's
signature is its u - ceil(percent*u) + 1 smallest shingle hashes (bottom-k MinHash): an item that is
contained misses at most u - ceil(percent*u) shingles, so at least one hash of its signature is among
the document's, whatever the document's length, and the search misses nothing. A document that is
long compared with an item costs no more than its own shingles: each is looked up once among all
partitions' signatures. Items below five words are one shingle of their own length, and documents are probed
at the lengths that items have. Candidates are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import cut, fold, small, words


def _word_column(texts: DataFrame) -> DataFrame:
    """text -> _words. A column of its own: as an expression it would be split anew for each shingle."""
    return texts.withColumn("_words", words(fold(F.col("text")))).drop("text")


def _shingles(n: str) -> str:
    """The distinct shingles of n words of an array of words, as strings."""
    return f"if(size(_words) >= {n}, array_distinct(transform(sequence(1, size(_words) - {n} + 1), i -> array_join(slice(_words, i, {n}), ' '))), cast(array() as array<string>))"


def _hashes(ws: str, k: int) -> str:
    """The hash of each k-word shingle of an array of word hashes, repeats included."""
    return f"if(size({ws}) >= {k}, transform(sequence(0, size({ws}) - {k}), i -> xxhash64({', '.join(f'{ws}[i + {j}]' for j in range(k))})), cast(array() as array<bigint>))"


def _of_length(n: int) -> str:
    """The hash of a shingle string of n words."""
    return f"xxhash64({', '.join(f'xxhash64(split(s, chr(32))[{j}])' for j in range(n))})"


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, max_broadcast: int = 32 << 20) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, item_id, n_item, n_shared): items contained in documents.

    Words are folded A-Z and split at ASCII white space. An item with fewer than k words has one shingle, its
    whole sequence; null or empty ones have none and are found nowhere. Items that share an item_id are
    looked for one by one and reported once, with the greatest share. Documents with a null id are left
    out, rows that share a doc_id are reported once. What is broadcast (signatures, candidates, the items'
    shingles) is measured, in bytes, and joined by a shuffle beyond `max_broadcast`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sets = _word_column(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))).filter("item_id is not null and size(_words) > 0")
    sets = sets.select("item_id", F.expr(f"least(size(_words), {k})").alias("len"), F.expr(_shingles(f"least(size(_words), {k})")).alias("set")).distinct()
    sets = cut(sets.withColumn("item", F.xxhash64("item_id", "len", "set")))
    lengths = [r["len"] for r in sets.select("len").distinct().orderBy("len").limit(k).collect()]
    if not lengths:
        lengths = [k]
    name = "case " + " ".join(f"when len = {n} then {_of_length(n)}" for n in lengths) + " end"
    hashed = sets.select("item", F.expr(f"array_sort(transform(set, s -> {name}))").alias("hs"), F.expr("cast(pow(2, ceil(log2(size(set)))) as int)").alias("upper"))
    signature = cut(hashed.select(F.explode(F.expr(f"slice(hs, 1, upper - ((upper * {percent} + 99) div 100) + 1)")).alias("h"), "item").distinct())
    ws = docs.select("doc_id", F.xxhash64("text").alias("row"), F.transform(words(fold(F.col("text"))), lambda w: F.xxhash64(w)).alias("w"))
    probes = ws.select("doc_id", "row", F.explode(F.expr(f"concat({', '.join(_hashes('w', n) for n in lengths)})")).alias("h"))
    pairs = cut(probes.join(small(signature, max_broadcast), "h").select("doc_id", "row", "item").distinct())
    # candidates are verified by their own shingles: those that some item has are counted per document and item
    candidates = small(pairs.select("doc_id", "row").distinct(), max_broadcast)
    texts = docs.withColumn("row", F.xxhash64("text")).join(candidates, ["doc_id", "row"])
    have = _word_column(texts).select("doc_id", "row", F.explode(F.expr(f"concat({', '.join(_shingles(str(n)) for n in lengths)})")).alias("s"))
    wanted = sets.select("item", F.explode("set").alias("s"))
    shared = have.join(small(wanted, max_broadcast), "s").groupBy("doc_id", "row", "item").agg(F.count_distinct("s").alias("n_shared"))
    exact = shared.join(pairs, ["doc_id", "row", "item"]).join(small(sets.select("item", "item_id", F.size("set").alias("n_item")), max_broadcast), "item").filter(f"100 * n_shared >= {percent} * n_item")
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", F.col("n_shared").cast("int").alias("n_shared")))
    return exact.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.n_item", "x.n_shared")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_items, first_item, max_containment) of every document with a doc_id; zeros and null if clean."""
    found = contained_items(docs, items, **options).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.max(F.col("n_shared") / F.col("n_item")).alias("max_containment"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", F.coalesce("max_containment", F.lit(0.0)).alias("max_containment"))


def sql(percent: int = 80, k: int = 5) -> str:
    """An item below k words is one shingle of its own length; documents have shingles of each length up to k."""
    split = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    runs = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' ')))"
    return f"""
with b as (select distinct item_id, {runs} g from (select *, least(len(w), {k}) n from (select item_id, {split} w from benchmark)) where n > 0),
n as (select item_id, count(*) n from b group by 1),
lens as (select distinct len(string_split(g, ' ')) n from b),
d as (select distinct doc_id, {runs} g from (select doc_id, {split} w from documents), lens where len(w) >= n),
shared as (select doc_id, item_id, count(*) s from d join b using (g) group by all)
select doc_id, item_id, s / n containment from shared join n using (item_id) where 100 * s >= {percent} * n"""
