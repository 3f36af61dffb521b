"""Toxicity: noisy-channel restoration of disguised words by Viterbi decoding, then a word model over the restored text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm, words
from .common import held_out, mix64, slices_of, small_batches, string_buffer, table, text_or_empty

#: Indicators (hashed words and their first letters), and the score from which a document is toxic.
DIMS, THRESHOLD = 1 << 18, 0.5
#: Bytes of a word that stand for its inflected forms, and the numbers of different forms in a text that are told apart from one.
STEM, FORMS = 5, (2, 3)
#: Least log-count ratio of an indicator, and the least number of sample documents that hold it.
LEAST_RATIO, LEAST_DOCS = 1.0, 3
#: Read tokens with a letter doubled, or joined inside, if the language model finds the doubling, or the word edges at the joint,
#: by so much (negative log chance) unlikelier than the letter once, or no edges.
DOUBLE_GAIN, JOINT_GAIN = 3.0, 0.0
#: Longest token, in bytes, whose reading is kept.
KEPT_BYTES = 64
STEP = 1 << 18

# What a written sign may stand for, with the channel's cost (negative log chance) of each.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "&": "a", "#": "h",
}
SIGN_COST, DROP_COST, JOIN_COST, SPLIT_COST, TAIL_COST = 1.0, 0.5, 0.2, 1.5, 0.5

#: Symbols of the language model: 0 a word's edge, 1-26 letters, 27 any other letter.
SYMBOLS = 28
SYMBOL = np.zeros(256, np.int64)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27
_sign = np.zeros(256, bool)
_sign[[ord(c) for c in SIGNS]] = True
_join = np.zeros(256, bool)
_join[[ord(c) for c in " .-_*"]] = True


def language_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over the whole texts of all documents, (SYMBOLS,) * 3: a table of fixed size from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            raw, at = string_buffer(batch.column(0))
            for i, j in slices_of(at, STEP):
                s = SYMBOL[raw[at[i] : at[j]]]
                s[(at[i + 1 : j + 1] - at[i] - 1)[np.diff(at[i : j + 1]) > 0]] = 0
                s = np.concatenate([[0, 0], s, [0]])
                s = s[np.concatenate([[True], (s[1:] != 27) | (s[:-1] != 27)])]  # the bytes of one foreign letter count once
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    small_batches(docs.sparkSession)
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(text_or_empty().alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS^3 rows
        out[r.code] = r.n
    return out.reshape((SYMBOLS,) * 3)


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log chance of a symbol after two others, interpolated with that after one and with the symbol's own."""
    c = counts.astype(np.float64)
    uni = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
    bi = (c.sum(0) + 5 * uni) / (c.sum((0, 2))[:, None] + 5)
    return -np.log((c + 5 * bi) / (c.sum(2)[:, :, None] + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Of each run of equal signs, what it may stand for: strings (empty: left out; a joint may be a space) with costs of the channel.
    Signs at the end of a token may be decoration."""
    out: list[list[tuple[str, float]]] = []
    i, tail = 0, len(token.rstrip("".join(SIGNS)))
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if c in SIGNS:
            letters = [(x, SIGN_COST) for x in SIGNS[c]]
            out.append([(x * k, cost + DROP_COST * (n - k)) for x, cost in letters for k in range(1, min(n, 2) + 1)] + ([("", TAIL_COST)] if i >= tail else []))
        elif c.isalpha():
            out.append([(c * k, DROP_COST * min(n - k, 2)) for k in range(1, min(n, 2) + 1)] + ([(c * n, 0.0)] if n > 2 else []))
        else:
            out.append([("", JOIN_COST), (" ", SPLIT_COST)])
        i = j
    return out


def decode(token: str, cost) -> str:
    """The likeliest word behind a token under the language model: Viterbi over states of the last two symbols, in time
    linear in the token's length. cost: of costs(), as an array or as lists."""
    index = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for step in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (paid, path) in best.items():
            for string, price in step:
                x, y, total = a, b, paid + price
                for c in string:
                    k = index(c)
                    total += cost[x][y][k]
                    x, y = y, k
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, string))
        best = after
    path, out = min(((paid + cost[a][b][0], path) for (a, b), (paid, path) in best.items()), key=lambda x: x[0])[1], []
    while path:
        path, string = path
        out.append(string)
    return "".join(reversed(out))


def suspects(raw: np.ndarray, offsets: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, spaced) of disguised spans in order, of any length: tokens with signs between letters, with letters tripled,
    or with letters doubled that the language model finds unlikely; tokens joined by other joints than spaces, with
    signs or with a joint that the model finds unlikely as a word's edge; and runs of three or more single characters
    with joints between each two."""
    n = len(raw)
    if n < 3:
        return []
    letter, sign = words.LETTERS[raw], _sign[raw]
    body = letter | sign
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    triple = np.zeros(n, bool)
    triple[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2] & (raw[:-2] < 128)
    starts, ends = words.runs(body, offsets)
    sums = lambda m: np.concatenate([[0], np.cumsum(m)])
    letters, signs, triples = sums(letter), sums(sign), sums(triple)
    size = ends - starts
    single = (size == 1) & letter[starts] & (raw[starts] < 128) | (size == 1) & sign[starts]
    near = np.zeros(len(starts), bool)  # joined to the run before it
    joints, tight = sums(_join[raw]), sums(_join[raw] & (raw != 32))
    same = np.searchsorted(offsets, starts[1:], "right") == np.searchsorted(offsets, starts[:-1], "right")
    same &= joints[starts[1:]] - joints[ends[:-1]] == starts[1:] - ends[:-1]
    near[1:] = single[1:] & single[:-1] & same & (starts[1:] > ends[:-1])
    out = []
    chained = np.flatnonzero(same & (tight[starts[1:]] - tight[ends[:-1]] == starts[1:] - ends[:-1]) & (starts[1:] > ends[:-1])) + 1  # joined tightly to the run before
    if len(chained):
        odd = np.zeros(len(starts) + 1, bool)
        odd[chained] = unlikely_edges(raw, starts, ends, chained, cost) > JOINT_GAIN
        for part in np.split(chained, np.flatnonzero(np.diff(chained) > 1) + 1):
            a, b = starts[part[0] - 1], ends[part[-1]]
            if letters[b] - letters[a] >= 2 and (odd[part].any() or signs[b] > signs[a]):
                out.append((int(a), int(b), False))
    link = np.flatnonzero(near)
    if len(link):
        for part in np.split(link, np.flatnonzero(np.diff(link) > 1) + 1):
            if len(part) >= 2 and letter[starts[part[0] - 1 : part[-1] + 1]].sum() * 2 > len(part):
                out.append((int(starts[part[0] - 1]), int(ends[part[-1]]), True))
    inner = letters[ends] - letters[starts] >= 2
    mixed = inner & (signs[ends] - signs[starts] > 0)
    doubled = np.flatnonzero((low[:-1] == low[1:]) & letter[:-1] & (raw[:-1] < 128))
    owner = np.searchsorted(starts, doubled, "right") - 1
    doubled, owner = doubled[doubled + 1 < ends[owner]], owner[doubled + 1 < ends[owner]]  # not across texts
    twice = np.zeros(len(starts), bool)
    twice[owner[unlikely_doubles(raw, starts[owner], ends[owner], doubled, cost) > DOUBLE_GAIN]] = True
    for k in np.flatnonzero(mixed | inner & (twice | (triples[ends] - triples[starts] > 0))):
        out.append((int(starts[k]), int(ends[k]), False))
    return sorted(set(out), key=lambda s: (s[0], -s[1]))


def unlikely_doubles(raw, starts, ends, at, cost) -> np.ndarray:
    """How much unlikelier the two equal letters from each place of a token are than the letter once."""
    a, b = np.where(at > starts, SYMBOL[raw[at - 1]], 0), SYMBOL[raw[at]]
    x = np.where(at + 2 < ends, SYMBOL[raw[np.minimum(at + 2, len(raw) - 1)]], 0)
    return cost[a, b, b] + cost[b, b, x] - cost[a, b, x]


def unlikely_edges(raw, starts, ends, k, cost) -> np.ndarray:
    """How much unlikelier the end of each run k - 1 and the start of run k are as edges of words than as inside of one."""
    e, f = ends[k - 1], starts[k]
    y, z = np.where(e - 2 >= starts[k - 1], SYMBOL[raw[e - 2]], 0), SYMBOL[raw[e - 1]]
    p, q = SYMBOL[raw[f]], np.where(f + 1 < ends[k], SYMBOL[raw[np.minimum(f + 1, len(raw) - 1)]], 0)
    return np.where((z > 0) & (p > 0), cost[y, z, 0] + cost[z, 0, p] + cost[0, p, q] - cost[y, z, p] - cost[z, p, q], 0)


class Restorer:
    """Rewrites the suspect spans of texts; decoded tokens of at most KEPT_BYTES are kept, at most KEPT of them."""

    KEPT = 200_000

    def __init__(self, cost: np.ndarray):
        self.cost, self.table, self.known = cost, cost.tolist(), {}

    def word(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            read = decode(token, self.table)
            if len(token) > KEPT_BYTES:
                return read
            self.known[token] = read
        return self.known[token]

    def __call__(self, column) -> pa.Array:
        """The texts with each suspect span replaced by its likeliest reading; a span inside another counts for nothing."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        raw, at = string_buffer(column)
        out, touched = [], {}
        for i, j in slices_of(at, STEP):
            part, edge = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            spans = suspects(part, edge, self.cost)
            if spans:
                first = np.searchsorted(edge, [s[0] for s in spans], "right") - 1
                for d, (a, b, _) in zip(first.tolist(), spans, strict=True):
                    touched.setdefault(d + i, []).append((a - int(edge[d]), b - int(edge[d])))
        if not touched:
            return column
        for d in range(len(column)):
            text = bytes(raw[at[d] : at[d + 1]])
            out.append((self.restored(text, touched[d]) if d in touched else text).decode("utf-8", "ignore"))
        return pa.array(out, pa.large_string())

    def restored(self, text: bytes, spans: list[tuple[int, int]]) -> bytes:
        """spans: (start, end) in order of start, the wider first."""
        parts, upto = [], 0
        for a, b in spans:
            if b <= upto:
                continue
            parts.append(text[upto:a] if a >= upto else b" ")
            token = text[a:b].decode("utf-8", "ignore").lower()
            parts.append((self.word(token) if token else "").encode())
            upto = b
        return b"".join([*parts, text[upto:]])


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, indicator) pairs: each run of letters; of longer ones their first STEM bytes, and whether a text has
    FORMS or more different runs that begin with these."""
    starts, ends = words.runs(words.LETTERS[raw], offsets)
    doc = (np.searchsorted(offsets, starts, "right") - 1).astype(np.uint64)
    long = ends - starts > STEM
    full = words.hashes(raw, starts, ends)
    stem = words.hashes(raw, starts[long], starts[long] + STEM) ^ np.uint64(0x5BF03635)
    found = [(doc, full), (doc[long], stem)]
    pair = mix64(stem + doc[long] * np.uint64(0x9E3779B97F4A7C15))  # text and stem as one number
    _, at = np.unique(mix64(pair ^ full[long] * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    _, where, n = np.unique(pair[at], return_index=True, return_counts=True)
    found += [(doc[long][at[where[n >= m]]], mix64(stem[at[where[n >= m]]] + np.uint64(m))) for m in FORMS]
    key = np.unique(np.concatenate([d.astype(np.int64) << 18 | (h % np.uint64(DIMS)).astype(np.int64) for d, h in found]))
    return key >> 18, key & (DIMS - 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Restores disguised words of each whole text, then scores it.

    docs: doc_id, text and others; labels: doc_id, toxic. Returns doc_id, held_out, score, predicted, a row for
    each row. The character model counts all documents; the word model is fitted on at most nbsvm.PER_CLASS labelled
    documents of each class outside the held-out fold, restored as well. What is scored is the restored text: each suspect
    span gives way to its reading. Texts of any length are read whole. Null text counts as empty; empty texts get the
    score of the bias. Without labels of both classes every score is the smoothed share of class 1. Repeated rows get equal
    scores; other columns, whatever their names, are ignored. Empty tables give empty tables.
    """
    spark = docs.sparkSession
    cost = spark.sparkContext.broadcast(costs(language_counts(docs)))
    made: list[Restorer] = []

    def restore(column):
        if not made:
            made.append(Restorer(cost.value))
        return made[0](column)

    model = nbsvm.train(docs, labels, "toxic", word_features, DIMS, prepare=restore, scaled=False, least_ratio=LEAST_RATIO, least_docs=LEAST_DOCS, **options)
    score = nbsvm.scorer(spark, model, word_features, prepare=restore)
    out = docs.select("doc_id", held_out().alias("held_out"), score(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
