"""Toxicity behind disguises: a noisy channel is decoded, then the restored text is scored.

A disguised word (1d10t, st.u.pid, i d i o t, looooser) is seen as the output of a channel that replaces
letters by look-alikes, puts separators between letters and repeats letters. Its character lattice holds
every reading of every character; Viterbi decoding under a character trigram model, whose counts cover
all documents, finds the likeliest intended word. Words without look-alikes, separators or repetitions
have one reading only, themselves, and skip the lattice. Runs of single characters are one lattice, in
which each blank may be kept or dropped, so that decoding also finds where the words end.

The scorer is learned from a bounded sample of labelled documents: words and word beginnings whose
documents are toxic surely more often than not by chance are kept with that share, and a document's
score joins the shares of its words (noisy or).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm import tokens as tk
from tagtide.llm.common import cut


LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0 is everything that is no letter
SIZE = 64
# Look-alikes, and marks that may stand between the letters of a word.
LOOKALIKES = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "6": "g", "9": "g", "2": "z", "(": "c", "¡": "i"}
SEPARATORS = ".-_*~'`,:;/\\=^·•"
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`=+/\\^"
MARKS = "".join(c for c in EDGES if c not in LOOKALIKES)
#: Costs of the channel, as log-probabilities.
REPLACE, DROP, ONCE, TWICE, KEEP = -2.0, -1.0, -1.0, -1.0, -8.0
REPEATS = re.compile(r"(.)\1\1")
#: Single characters with white space between, marks at the ends.
SPACED = re.compile(rf"(?<!\S)[{re.escape(EDGES)}]*\S(?:\s+\S)+[{re.escape(EDGES)}]*(?!\S)")
#: Numbers: here digits are likely to mean themselves.
NUMBER = re.compile(r"[$€+\-]?\d+(?:[.,:/\-]\d+)*[%$€+]?")
RUNS = re.compile(r"(.)\1*", re.S)
PREFIXES = (9, 8, 7, 6, 5, 4)
CACHED = 300_000


def lattice(token: str, doubles: bool = False) -> list[list[tuple[str, float]]]:
    """Per run of equal characters, its readings and their channel log-probabilities; with doubles, two equal look-alikes are two letters and none is a mark."""
    slots, keep = [], 0.0 if NUMBER.fullmatch(token) else KEEP
    for m in RUNS.finditer(token):
        c, n = m.group(1), m.end() - m.start()
        if c in CODES:
            slots.append([(c * n, 0.0)] if n < 3 else [(c, ONCE), (c * 2, TWICE), (c * n, KEEP)])
        else:
            readings = [(c * n, keep * n)]
            for letter in LOOKALIKES.get(c, ""):
                readings += ([(letter, REPLACE)] if n != 2 or not doubles else []) + ([(letter * 2, REPLACE * 1.5)] if n > 1 else [])
            if c in SEPARATORS or c in EDGES and not (doubles and c in LOOKALIKES):
                readings.append(("", DROP))
            slots.append(readings)
    return slots


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The slots of single characters with white space between, and a slot per gap that keeps a blank or drops it.

    Equal characters are one slot, as in lattice(), that may also hold the end of a word.
    """
    slots, gap = [], ""
    for part in re.split(r"(\s+)", run):
        if part.isspace():
            gap = part
            continue
        for k, m in enumerate(RUNS.finditer(part)):
            c, n = m.group(1), m.end() - m.start()
            if k == 0 and slots and slots[-1][0] == c and gap == " ":
                slots[-1][1] += n
            else:
                if k == 0 and slots:
                    slots.append(["", gap])
                slots.append([c, n])
    out = []
    for c, n in slots:
        if not c:
            out.append([(" ", 0.0), ("", DROP if n == " " else 2 * DROP)])
            continue
        readings = [(r, cost + DROP * (n > 1)) for r, cost in lattice(c * n)[0]]
        if n > 1:
            for x, cost in [(c, 0.0)] if c in CODES else [(letter, REPLACE) for letter in LOOKALIKES.get(c, "")]:
                readings += [(f"{x * a} {x * b}", cost * (a + b) + (0.0 if n == a + b else ONCE)) for a in (1, 2) for b in (1, 2) if a + b <= n]
        out.append(readings)
    return out


def _viterbi(slots: list[list[tuple[str, float]]], logs: np.ndarray) -> str:
    """The likeliest reading of slots between word boundaries: Viterbi over pairs of last characters, with links back."""
    states: dict = {(0, 0): (0.0, None)}
    for slot in [*slots, [(" ", 0.0)]]:
        coded = [(reading, cost, [CODES.get(c, 0) for c in reading]) for reading, cost in slot]
        after: dict = {}
        for (a, b), (score, link) in states.items():
            for reading, cost, classes in coded:
                x, y, total = a, b, score + cost
                for z in classes:
                    total += logs[x * SIZE * SIZE + y * SIZE + z]
                    x, y = y, z
                old = after.get((x, y))
                if old is None or total > old[0]:
                    after[(x, y)] = (total, (link, reading))
        states = after
    link, out = max(states.values(), key=lambda s: s[0])[1], []
    while link:
        link, reading = link
        out.append(reading)
    return "".join(reversed(out)).strip()


def decode(token: str, logs: np.ndarray, doubles: bool = False) -> str:
    """The likeliest reading of a token between word boundaries."""
    return _viterbi(lattice(token, doubles), logs)


class Reader:
    """Restored words of texts, with a bounded memory of the words seen."""

    def __init__(self, logs: list[float]):
        self.logs, self.kept = logs, {}

    def read(self, token: str) -> tuple[str, ...]:
        """The words that a token, in lower case, may stand for. Marks at its ends go; look-alikes there are also read as letters, and two equal ones as two."""
        bare, wide = token.strip(EDGES), token.strip(MARKS)
        if bare.isalpha() and not REPEATS.search(bare):
            if len(bare) == len(token) or token[0] not in LOOKALIKES and not (token[-1] in LOOKALIKES and token[-2:-1] not in EDGES):
                return (bare,)
            return (decode(wide, self.logs) or bare,)
        found = {decode(t, self.logs) or bare for t in {bare, wide}}
        if any(m.end() - m.start() == 2 and m.group(1) in LOOKALIKES for m in RUNS.finditer(wide)) and not NUMBER.fullmatch(wide):
            found.add(decode(wide, self.logs, True))
        return tuple(found)

    def spaced(self, run: str) -> tuple[str, ...]:
        """The words of single characters with white space between: of the likeliest reading, and each stretch with single blanks as one word."""
        whole = _viterbi(spaced_lattice(run), self.logs).split()
        glued = [w for stretch in re.split(r"\s{2,}|[^\S ]", run) for w in self.read(stretch.replace(" ", ""))]
        return tuple({w.strip(EDGES) for w in whole} | set(glued))

    def words(self, text: str) -> set[str]:
        low = text.lower()
        kept, out = self.kept, set()
        spaced = {m.group(0) for m in SPACED.finditer(low)}
        for t in set(low.split()) | spaced:
            found = kept.get(t)
            if found is None:
                if len(kept) >= CACHED:
                    kept.clear()
                found = kept[t] = self.spaced(t) if t in spaced else self.read(t)
            out.update(found)
        out.discard("")
        return out


def features(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by '-'."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)]


def surely(k, n, z: float = 3.0):
    """Lower end of Wilson's interval for a share of k in n, numbers or columns."""
    p = k / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def sketch(text: str, k: int = 16) -> list[int]:
    """The k smallest hashes of a text's word pairs."""
    w = text.lower().split()
    return sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:])})[:k]


def distinct(sketches: list[list[int]], shared: int = 6) -> list[int]:
    """Positions of texts that are no near copy of an earlier one: a family of copies would make markers of all its words."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, own in enumerate(sketches):
        near = Counter(j for h in own for j in seen.get(h, ()))
        if near and near.most_common(1)[0][1] >= min(shared, len(own)):
            continue
        kept.append(i)
        for h in own:
            seen.setdefault(h, []).append(i)
    return kept


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([sketch(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["row", "sketch"])


def _feature_counts(logs_of, most: int = 200_000):
    """(text, toxic) -> (feature, number of toxic texts, number of texts), summed up as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(logs_of.value.tolist())
        toxic: Counter = Counter()
        every: Counter = Counter()

        def flush():
            names = list(every)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[f] for f in part], pa.int64()), pa.array([every[f] for f in part], pa.int64())], names=["f", "k", "n"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = {f for w in reader.words(text) for f in features(w)}
                every.update(found)
                if y:
                    toxic.update(found)
                if len(every) > most:
                    yield from flush()
                    toxic.clear()
                    every.clear()
        yield from flush()

    return run


def _unmarked(logs_of, chosen: dict[str, float]):
    """(text, toxic) -> (number of texts without a marker, number of toxic ones among them), one row per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(logs_of.value.tolist())
        for batch in batches:
            rest = [y for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) if not any(f in chosen for w in reader.words(text) for f in features(w))]
            yield pa.RecordBatch.from_arrays([pa.array([len(rest)], pa.int64()), pa.array([sum(rest)], pa.int64())], names=["n", "k"])

    return run


def learn(train: DataFrame, logs_of, least: float = 0.35, least_begin: float = 0.7) -> tuple[dict[str, float], float]:
    """(row, text, toxic) -> features whose share of toxic documents is surely above a limit, with that share, and the rate without any of them.

    Shares are judged by the lower end of their confidence interval, so that chance makes no marker: a word
    needs five documents at the least. Word beginnings, which clean words share by chance, need more. Texts
    are read where they are: the driver gets a sketch of each sampled text and the chosen features.
    """
    marks = train.select("row", "text").mapInArrow(_sketched, "row long, sketch array<long>").groupBy("row").agg(F.first("sketch").alias("sketch")).orderBy("row").toPandas()
    kept = marks["row"].iloc[distinct(marks["sketch"].tolist())]
    if not len(kept):
        return {}, 0.1
    texts = train.join(F.broadcast(train.sparkSession.createDataFrame(kept.to_frame(), "row long")), "row").dropDuplicates(["row"]).select("text", "toxic")
    counted = texts.mapInArrow(_feature_counts(logs_of), "f string, k long, n long").groupBy("f").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).filter("k > 0")
    sure = F.when(F.endswith("f", F.lit("-")), least_begin).otherwise(least)
    markers = counted.filter((surely(F.col("k"), F.col("k")) >= least) & (surely(F.col("k"), F.col("n")) >= sure))
    chosen = {r["f"]: (r["k"] + 0.5) / (r["n"] + 1) for r in markers.collect()}
    rest = texts.mapInArrow(_unmarked(logs_of, chosen), "n long, k long").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    return chosen, ((rest["k"] or 0) + 0.1) / ((rest["n"] or 0) + 1)


def strongest(word: str, chosen: dict[str, float]) -> float:
    """The greatest share among the word's features, 0 without any."""
    return max((chosen.get(f, 0.0) for f in features(word)), default=0.0)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(0x180, np.uint8)
    for c, i in CODES.items():
        table[ord(c)] = i
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        buf, off = tk.raw(batch.column("text"))
        for i, j in tk.pieces(off, 4 << 20):
            text = bytes(buf[off[i] : off[j]]).decode("utf-8").lower()
            c = table[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x17F)].astype(np.int64)
            if len(c) > 2:
                total += np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
    seen = np.flatnonzero(total)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["g", "c"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of trigrams of character classes, by linear interpolation. Counts cover all texts; their number is at most 64**3."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).toPandas()
    c3 = np.zeros(SIZE**3)
    c3[rows["g"].to_numpy(np.int64)] = rows["c"].to_numpy(float)
    c3 = c3.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 20 * p1[None, :]) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None, :, :]) / (c3.sum(2, keepdims=True) + 20)
    return np.log(p3).ravel()


def score(docs: DataFrame, labels: DataFrame, held_out, max_train: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> (doc_id, held_out, score, predicted), one row per input row.

    `held_out` is a condition on doc_id: labels of such rows are never used. At most `max_train` labelled
    documents, chosen by a hash of their id, are learned from; near copies among them count once, labels that are
    null or belong to no document not at all, and of labels that repeat a doc_id the greatest counts. Only
    the text bears on a score. Null and empty texts get the base rate. With no usable label, all scores are
    a base rate of 0.1 / 1. A null doc_id is not held out and can't be labelled. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    logs = language_model(docs)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # equal texts count once, as toxic if one of them is; near copies are met in the order of the texts' hashes
    train = cut(docs.join(F.broadcast(sample), "doc_id").filter("text is not null").select(F.xxhash64("text").alias("row"), "text", "toxic").groupBy("row").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    logs_of = spark.sparkContext.broadcast(logs)
    chosen, base = learn(train, logs_of)
    shared = spark.sparkContext.broadcast((logs, chosen, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, chosen, base = shared.value
        reader, marks = Reader(logs.tolist()), {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                clean = 1.0 - base
                for w in reader.words(text or ""):
                    share = marks.get(w)
                    if share is None:
                        if len(marks) >= CACHED:
                            marks.clear()
                        share = marks[w] = strongest(w, chosen)
                    if share:
                        clean *= 1.0 - share
                out.append(1.0 - clean)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
