"""Substring dedup with repeated-phrase automata.

A window of `width` words is repeated if its word sequence also starts in a document with a smaller
doc_id. The search for repeated windows goes by short phrases that every window contains:

1. Confirmed phrases. Of the k-word phrases in each window, the one with the smallest hash is its anchor,
   so equal windows have equal anchors wherever they stand; about one phrase in (width - k) / 2 is chosen.
   Anchors that occur in two documents at least are the recurring phrases; each is taken from the first
   document that has it.
2. Automata. The first `HEAD` words of a phrase are its pattern; phrases with one beginning share it. The
   patterns are dealt to shards of about `per_automaton` by the least hash of the word pairs in them, and each
   shard is compiled into an Aho-Corasick automaton. A word is two characters in it, 7 bits of its hash each,
   from two alphabets, so that nodes have few branches and no match begins inside a word.
3. Occurrences. All documents stream through the automata, every word of them: a task gathers `STREAM` bytes
   of text and parts them into runs of words whose beginnings of `HEAD` words are dealt to one shard, by the
   same least hash. A shard's automaton runs over its runs only. Runs overlap by `HEAD` - 1 words, so no
   beginning is lost, and all runs together are about 2.5 times the text, however many automata there are. Hits are
   every occurrence of the phrases. Windows whose anchor was hit are fingerprinted (64-bit rolling hash), which
   also drops false hits. Inside `BLOCK` bytes of text, only a fingerprint's first document is passed on, later ones
   are repeats already; between blocks, a running minimum over the sorted fingerprints tells first documents
   from later ones, so that a passage that is everywhere has one row per `BLOCK` bytes of text there.
4. Removal. Each document is joined to its repeated windows and loses the words they cover.

The driver holds the phrases of one pass, about `per_pass`, at 8 bytes each; more of them are more passes over the
documents, each through its own shards. What still grows with the text times the number of phrases is
compiling, once per `STREAM` bytes (twice that beyond `per_pass` / 4 phrases), and hashing the words once per pass.

A fingerprint collision could remove a window wrongly, with a chance of about n^2 / 2^65 for n windows
that share anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm import tokens as tk
from tagtide.llm.common import cut, small

#: Bytes of text that are run through the automata at a time, and among which windows are compared at once.
STREAM, BLOCK = 16 << 20, 8 << 20
#: Bits of a word's hash in each of its two characters, and where their alphabets begin: phrases are a byte a character. A blank pair parts runs.
BITS, ALPHABETS, PART = 7, (0x00, 0x80), 0x100
#: Words of a phrase that are its pattern.
HEAD = 4
_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def split_words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of w values, in linear time."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = np.iinfo(x.dtype).max if best is np.minimum else 0
    blocks = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor hash, and which grams are an anchor of some window."""
    least = _sliding(grams, span, np.minimum)
    edge = np.zeros(span - 1, tk.U)
    return least, _sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams


def _anchors(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            buf, off = tk.raw(batch.column("text"))
            for i, j in tk.pieces(off, tk.CHUNK // 4):
                h, at = tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                grams = tk.gram_hashes(h, k)
                docs = [d for d in range(j - i) if at[d + 1] - at[d] >= width]
                cells = [np.unique(own[anchors(own, width - k + 1)[1]]).view(np.int64) for d in docs for own in (grams[at[d] : at[d + 1] - k + 1],)]
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.repeat(ids[i:j][docs], [len(c) for c in cells]))], names=["gram", "doc_id"])

    return run


def coded(h: np.ndarray) -> np.ndarray:
    """Word hashes -> two characters a word."""
    out = np.empty((len(h), 2), "<u2")
    for j, first in enumerate(ALPHABETS):
        out[:, j] = (h >> tk.U(BITS * j)).astype(np.uint16) & np.uint16((1 << BITS) - 1)
        out[:, j] += np.uint16(first)
    return out


def dealt(h: np.ndarray, head: int) -> np.ndarray:
    """For each run of `head` words what it is dealt by, below 2**32: the least hash of the word pairs in it, which neighbours often share."""
    pairs = tk.gram_hashes(h, min(head, 2))
    n = max(len(h) - head + 1, 0)
    least = pairs[:n]
    for j in range(1, head - 1):
        least = np.minimum(least, pairs[j : j + n])
    return tk.mix(least ^ tk.STEP) >> tk.U(32)  # least hashes crowd at the low end


def _phrases(k: int, head: int):
    """(text, grams) of the documents that first have them -> (gram, phrase, deal): the phrase's first `head` words, coded, and what they are dealt by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.raw(batch.column("text"))
            lists = batch.column("grams")
            for i, j in tk.pieces(off):
                h, at = tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                grams, deal = tk.gram_hashes(h, k), dealt(h, head)
                for d in range(j - i):
                    if at[d + 1] - at[d] < k:
                        continue
                    own, where = np.unique(grams[at[d] : at[d + 1] - k + 1], return_index=True)
                    wanted = lists[i + d].values.to_numpy().view(tk.U)
                    p = np.searchsorted(own, wanted)
                    there = own[np.minimum(p, len(own) - 1)] == wanted
                    spots = at[d] + where[p[there]]
                    text = coded(h[(spots[:, None] + np.arange(head)).ravel()]).tobytes().decode("utf-16-le")
                    names = wanted[there].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([text[x : x + 2 * head] for x in range(0, len(text), 2 * head)], pa.string()), pa.array(deal[spots].view(np.int64))], names=["gram", "phrase", "deal"])

    return run


def _compiled(phrases: str, head: int) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in range(0, len(phrases), 2 * head):
        automaton.add_word(phrases[i : i + 2 * head])
    automaton.make_automaton()
    return automaton


def _runs(pieces, width: int, head: int, of: int, first: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words for the shards first, first + 1, ... of all `of`: sorted (shard from 0) << 32 | first word, and the number of words by first word.

    pieces: (doc ids, word hashes, where documents begin). Documents shorter than `width` have no windows and no runs.
    """
    out, base, size = [], 0, np.zeros(sum(len(h) for _, h, _ in pieces), np.uint16)
    for _, h, at in pieces:
        n, lens = max(len(h) - head + 1, 0), np.diff(at)
        if not n:
            base += len(h)
            continue
        ends = np.repeat(np.where(lens >= width, at[1:], 0), lens)[:n]
        shard = ((dealt(h, head) * tk.U(of)) >> tk.U(32)).astype(np.int64) - first
        shard[(np.arange(n) + head > ends) | (shard >= shards)] = -1
        edge = np.concatenate([[True], shard[1:] != shard[:-1]])
        edge[:: 1 << 15] = True  # sizes are 16 bits
        edge = np.flatnonzero(edge)
        mine = shard[edge] >= 0
        size[base : base + n][edge[mine]] = (np.diff(np.append(edge, n)) + head - 1)[mine]
        out.append((shard[edge] << 32 | edge + base)[mine])
        base += len(h)
    runs = np.concatenate([*out, np.zeros(0, np.int64)])
    runs.sort()
    return runs, size


def _locate(width: int, k: int, shared, stream: int, head: int, of: int | None = None, first: int = 0, per_automaton: int = 100_000):
    """(doc_id, text) -> per document with hits: its windows to confirm, and those that repeat inside a block.

    shared: the phrases of the shards first, first + 1, ... of all `of`; by default, those are all. A shard that has more
    than per_automaton is compiled in parts.
    """

    def hits(pieces) -> np.ndarray:
        """The words at which a phrase begins. Words are counted through all pieces."""
        codes = np.concatenate([coded(h) for _, h, _ in pieces])
        hit = np.zeros(len(codes), bool)
        shards = shared.value
        if not shards or not len(codes):
            return hit
        runs, sizes = _runs(pieces, width, head, of or len(shards), first, len(shards))
        parts = np.searchsorted(runs, np.arange(len(shards) + 1) << 32)
        for phrases, x, y in zip(shards, parts[:-1], parts[1:]):
            if x == y or not phrases:
                continue
            start = runs[x:y] & 0xFFFFFFFF
            size = sizes[start].astype(np.int64)
            stops = np.cumsum(size + 1)  # a blank after each run
            spots = np.repeat(start - (stops - size - 1), size + 1) + np.arange(stops[-1])
            chars = codes[np.minimum(spots, len(codes) - 1)]
            chars[stops - 1] = PART
            text = chars.tobytes().decode("utf-16-le")
            del chars
            for a in range(0, len(phrases), 2 * head * per_automaton):
                automaton = _compiled(phrases[a : a + 2 * head * per_automaton], head)
                ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
                del automaton  # before the next one is built
                hit[spots[(ends + 1) // 2 - head]] = True
        return hit

    def confirm(docs):
        """docs: (doc_id, word hashes, hits)."""
        found = []
        for doc_id, h, hit in docs:
            mine = hit[: len(h) - k + 1]
            if not mine.any():
                continue
            grams = tk.gram_hashes(h, k)
            least, _ = anchors(grams, width - k + 1)
            there = np.flatnonzero(_sliding(np.where(mine, grams, tk.U(2**64 - 1)), width - k + 1, np.minimum) == least)
            if len(there):
                found.append((doc_id, there.astype(np.int32), tk.rolling(h, width)[there]))
        if not found:
            return
        prints = np.concatenate([f[2] for f in found])
        ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        order = np.lexsort((ids, prints))
        lead = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
        first = np.empty(len(ids), np.int64)
        first[order] = ids[order][np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        later = ids > first
        at = np.cumsum([0] + [len(f[1]) for f in found])
        for (doc_id, there, marks), a, b in zip(found, at[:-1], at[1:]):
            new = ~later[a:b]
            yield doc_id, marks[new].tobytes(), there[new].tobytes(), there[~new].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks(hit):
            docs, size, base = [], 0, 0
            for ids, h, at in held:
                docs += [(int(ids[d]), h[at[d] : at[d + 1]], hit[base + at[d] : base + at[d + 1]]) for d in np.flatnonzero(np.diff(at) >= width)]
                base += len(h)
                size += len(h)
                if size >= BLOCK // 6:  # words
                    yield docs
                    docs, size = [], 0
            yield docs

        def flush():
            for docs in blocks(hits(held)) if held else ():
                rows = list(confirm(docs))
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 500]), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["doc_id", "prints", "starts", "repeats"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            buf, off = tk.raw(batch.column("text"))
            for i, j in tk.pieces(off, tk.CHUNK // 4):  # small ones leave more memory to the stream
                held.append((ids[i:j], *tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])))
                size += off[j] - off[i]
                if size >= stream:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [np.frombuffer(x, np.int64) for x in batch.column("prints").to_pylist()]
        starts = [np.frombuffer(x, np.int32) for x in batch.column("starts").to_pylist()]
        if prints:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prints)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), [len(p) for p in prints])), pa.array(np.concatenate(starts))], names=["mark", "doc_id", "start"])


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = [[], [], [], [], []]
            for doc_id, text, local, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "local", "other"))):
                words = split_words(text or "")
                starts = np.concatenate([*[np.frombuffer(x, np.int32) for x in local or []], np.array(other or [], np.int32)])
                spans = []
                if len(starts):
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + width, -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    spans = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                    n = len(words)
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                    rows[3].append(n - len(words))
                    rows[2].append(n)
                else:
                    rows[3].append(0)
                    rows[2].append(len(words))
                rows[0].append(doc_id)
                rows[1].append(" ".join(words))
                rows[4].append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(), _REMOVED))], names=["doc_id", "text", "n_words", "n_removed", "spans"])

    return run


def remove_repeats(docs: DataFrame, width: int = 50, k: int = 8, per_automaton: int = 25_000, per_pass: int = 4_000_000, stream: int = STREAM) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, n_words, n_removed, spans), one row per input row.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `width` words that covers it
    also starts in a document with a smaller doc_id; windows are judged on the input. text holds the
    kept words, joined by one space; spans are the removed word ranges (start, stop). A null or empty
    text has no words and the text ''. Rows with a null doc_id take no part and lose nothing. Rows that
    repeat a doc_id are one document: they don't repeat each other, and lose the same windows. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    real = docs.filter("doc_id is not null")
    # one Python worker a task: what idle ones hold is missed by the next stage
    recurring = cut(real.mapInArrow(_anchors(width, k), "gram long, doc_id long").groupBy("gram").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("b")).filter("doc_id < b").drop("b"))
    firsts = real.join(small(recurring.select("doc_id").distinct()), "doc_id", "left_semi")
    lists = recurring.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    # rows that share a doc_id give a phrase from one of them
    head = min(HEAD, k)
    found = firsts.join(lists, "doc_id").select("text", "grams").mapInArrow(_phrases(k, head), "gram long, phrase string, deal long")
    phrases = cut(found.groupBy("gram").agg(F.min(F.struct("deal", "phrase")).alias("p")).select("p.deal", "p.phrase").distinct())
    n = phrases.count()
    shards, passes = max(1, -(-n // per_automaton)), max(1, -(-n // per_pass))
    per, located = -(-shards // passes), None
    phrases = phrases.select(F.shiftright(F.col("deal") * shards, 32).alias("shard"), "phrase")
    # each task compiles the automata once per stream: of many phrases that costs more than the memory of longer ones, and
    # tasks of less than a stream are put together, as far as all cores keep several
    stream *= 2 if n > per_pass // 4 else 1
    size = real.select(F.sum(F.octet_length("text"))).first()[0] or 0
    streams = real.coalesce(max(1, 4 * spark.sparkContext.defaultParallelism, -(-size // stream)))
    for a in range(0, shards, per):
        part = phrases.filter(F.col("shard").between(a, a + per - 1)).groupBy("shard").agg(F.array_join(F.sort_array(F.collect_set("phrase")), "").alias("phrases")).toPandas()
        part = dict(zip(part["shard"], part["phrases"]))
        shared = spark.sparkContext.broadcast([part.get(i, "") for i in range(a, min(a + per, shards))])
        now = cut(streams.mapInArrow(_locate(width, k, shared, stream, head, shards, a, 4 * per_automaton), "doc_id long, prints binary, starts binary, repeats binary"))
        shared.destroy()  # what it located is written
        located = now if located is None else located.unionByName(now)
    first = F.first("doc_id").over(Window.partitionBy("mark").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    windows = located.mapInArrow(_windows, "mark long, doc_id long, start int").withColumn("first", first).filter("doc_id > first")
    other = windows.groupBy("doc_id").agg(F.collect_list("start").alias("other"))
    local = located.filter("length(repeats) > 0").groupBy("doc_id").agg(F.collect_list("repeats").alias("local"))
    gone = local.join(other, "doc_id", "full")
    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "local", "other").mapInArrow(_remove(width), "doc_id long, text string, n_words long, n_removed long, spans array<struct<start: int, stop: int>>")


def sql(width: int = 50) -> str:
    """DuckDB's form, quadratic in nothing but large: every window is a row."""
    return rf"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, array_to_string(w[i : i + {width - 1}], ' ') g from (select doc_id, w, unnest(range(1, len(w) - {width} + 2)) i from w where len(w) >= {width})),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) f from win) where doc_id > f),
cover as (select distinct doc_id, unnest(range(i, i + {width})) i from gone),
per as (select doc_id, list(i) c from cover group by 1)
select doc_id, len(w)::BIGINT n_words, coalesce(len(c), 0)::BIGINT n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when c is not null and list_contains(c, i) then null else w[i] end), lambda x: x is not null), ' '), '')) kept_sha256
from w left join per using (doc_id)"""
