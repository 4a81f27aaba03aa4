"""Benchmark decontamination by latent semantic retrieval.

Passages of a document begin with each block of 32 words and are as long as an item needs. Passages and benchmark items are TF-IDF
vectors over the words of the items, with document frequencies counted over all stretches of two blocks; words that more than MAX_SHARE
of these hold say nothing and have no weight. A randomised SVD of the stretches' and items' matrix A (Gaussian sketch of A'A, summed
over Spark's partitions, then a Nystrom decomposition) gives the latent directions. TOGETHER items at a time have a space of their own:
their span, so that each keeps its length, and the RANK leading directions.

Stage ``latent``: every passage is compared with every item, and is a candidate where both, projected, have a cosine of MIN_COSINE or
more. Candidates are checked, the nearest first: the longest common subsequence of the item and the passage with its neighbours
decides, with the item's answer (its own column, else its last sentence) held to a share of its own.

Stage ``bound``: what the cosine leaves has an exact way. A window that is no candidate is checked alike if it has so many of the
item's words that their longest common subsequence may be long enough (by an inverted index of the item's rarer words), unless a
candidate has settled the item in this document. So no window of any block is missed, whatever its cosine; each row says which
stage found it.

Items are a stated query set: they are taken in blocks, each against all passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import binaries, chunks, column, discard, id_key, id_value, rows, text_bytes, written

BLOCK_WORDS = 32
#: Items that are sought together, and how many words they have at most, so that what tasks are given is bounded.
ITEMS, LOT_WORDS = 1024, 1 << 16
#: Latent directions, and items that have a space of their own with these.
RANK, TOGETHER = 32, 64
MAX_SHARE = 0.02
MIN_COSINE = 0.4
MIN_LCS, MIN_ANSWER, SURE_LCS = 0.6, 0.5, 0.85
#: Windows that are checked after one of SURE_LCS, as a neighbour may hold the rest of the item.
FURTHER = 3
#: Letters, digits and other non-ASCII characters make words; ASCII punctuation doesn't.
_WORDS = np.where(scan.MARKED == 1, 1, 0).astype(np.uint8)


def item_words(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return scan.words(buf, np.array([0, len(buf)]), _WORDS)[0]


def answer_of(text: str) -> str:
    """The last sentence that has a word."""
    return next((x for x in reversed(re.split(r"(?<=[.!?])\s+", text)) if len(item_words(x))), text)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _located(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n_words, places, terms): where a document has words of the vocabulary (sorted hashes), and which."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.binary()), ("terms", pa.binary())])
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            buf, off = text_bytes(column(part, "text"))
            h, _, _, row = scan.words(buf, off, _WORDS)
            n = scan.row_counts(row, part.num_rows)
            live = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            term = np.minimum(np.searchsorted(vocabulary, h[live]), len(vocabulary) - 1)
            same = vocabulary[term] == h[live]
            live, term = live[same], term[same]
            place = live - (np.cumsum(n) - n)[row[live]]
            to = 4 * np.concatenate(([0], np.cumsum(np.bincount(row[live], minlength=part.num_rows))))
            yield rows(schema, doc_id=column(part, "doc_id"), n_words=n, places=binaries(place.astype("<i4").view(np.uint8), to), terms=binaries(term.astype("<i4").view(np.uint8), to))

    return docs.select(id_key().alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, places binary, terms binary")


def _entries(part: pa.RecordBatch, weighted: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, passage, term, starts) of the distinct weighted terms of each passage, in order; starts: each passage's first entry."""
    raw, off = text_bytes(column(part, "places"))
    place = np.frombuffer(raw.tobytes(), "<i4").astype(np.int64)
    term = np.frombuffer(text_bytes(column(part, "terms"))[0].tobytes(), "<i4").astype(np.int64)
    row = np.repeat(np.arange(part.num_rows), np.diff(off) // 4)
    live = weighted[term]
    place, term, row = place[live], term[live], row[live]
    block = place // BLOCK_WORDS
    row, term, passage = np.concatenate((row, row[block > 0])), np.concatenate((term, term[block > 0])), np.concatenate((block, block[block > 0] - 1))
    if not len(row):
        return row, passage, term, row
    key = np.unique((row * (passage.max() + 1) + passage) * n_terms + term)
    term = key % n_terms
    both = key // n_terms
    return both // (passage.max() + 1), both % (passage.max() + 1), term, np.flatnonzero(np.append(True, both[1:] != both[:-1]))


def _unit(term: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each entry's weight in its passage's unit vector."""
    w = idf[term]
    size = np.diff(np.append(starts, len(term)))
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), size)


def _summed(located: DataFrame, width: int, add) -> np.ndarray:
    """Sum of what ``add(part, total)`` puts into a (terms, width) matrix, over all partitions: slices of rows are summed in Spark.

    The matrix is bounded by the items of a block and the rank, whatever the number of documents.
    """
    schema = pa.schema([("slice", pa.int32()), ("data", pa.binary())])
    slices, height = 32, add.height

    def run(batches):
        total, any_ = np.zeros((height, width)), False
        for part in chunks(batches, "places", 1 << 19):
            add(part, total)
            any_ = True
        if any_:
            yield rows(schema, slice=np.arange(slices, dtype=np.int32), data=[x.tobytes() for x in np.array_split(total, slices)])

    def join(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(column(b, "slice").to_pylist(), column(b, "data").to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(x)
        if sums:
            yield rows(schema, slice=list(sums), data=[x.tobytes() for x in sums.values()])

    got = {r.slice: np.frombuffer(r.data) for r in located.mapInArrow(run, "slice int, data binary").repartition(slices, "slice").mapInArrow(join, "slice int, data binary").collect()}
    return np.concatenate([got[k] for k in range(slices)]).reshape(height, width) if got else np.zeros((height, width))


class _Frequencies:
    """Adds up in how many passages each term stands; the last row counts passages."""

    def __init__(self, n_terms: int):
        self.n_terms, self.height = n_terms, n_terms + 1

    def __call__(self, part, total):
        _, _, term, _ = _entries(part, np.ones(self.n_terms, bool), self.n_terms)
        total[:-1, 0] += np.bincount(term, minlength=self.n_terms)
        n = column(part, "n_words").to_numpy()
        total[-1, 0] += (-(-n // BLOCK_WORDS)).sum()


class _Sketch:
    """Adds up A'A times a Gaussian matrix."""

    def __init__(self, idf: np.ndarray, omega: np.ndarray):
        self.idf, self.omega, self.height = idf, omega.astype(np.float32), len(idf)

    def __call__(self, part, total):
        _, _, term, starts = _entries(part, self.idf > 0, len(self.idf))
        if not len(term):
            return
        w = _unit(term, starts, self.idf).astype(np.float32)
        z = np.add.reduceat(self.omega[term] * w[:, None], starts)
        each = z[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))] * w[:, None]
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
        total[term[order][first]] += np.add.reduceat(each[order], first)


def latent_space(located: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(terms, rank): the leading right singular vectors of passages and items. Items weigh as much as all passages."""
    n = len(idf)
    k = min(rank, n)
    omega = np.random.default_rng(7).standard_normal((n, min(n, k + 10)))
    y = _summed(located, omega.shape[1], _Sketch(idf, omega))
    own = np.zeros_like(y)
    for t in map(np.unique, items):
        w = idf[t] / max(np.linalg.norm(idf[t]), 1e-12)
        own[t] += w[:, None] * (w @ omega[t])
    y = y / max(np.linalg.norm(y), 1e-12) + own / max(np.linalg.norm(own), 1e-12)
    q, _ = np.linalg.qr(y)
    core = omega.T @ y
    small = q.T @ y @ np.linalg.pinv((core + core.T) / 2, rcond=1e-9) @ y.T @ q
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return (q @ vector[:, np.argsort(-value)[:k]]).astype(np.float32)


class _Targets:
    """Some of the items, with a space that holds each of them whole, and their index for the exact bound.

    A window shares at least ``share`` of an item's words only if it has ``need`` occurrences of the item's indexed words: those
    with weight, and more by rarity until what is not indexed is less than that share. All but ``local``, a number for each word of
    the lot, grows with these items' own words, of which a lot has LOT_WORDS at most.
    """

    def __init__(self, first: int, items: list[np.ndarray], answers: list[np.ndarray], idf: np.ndarray, often: np.ndarray, latent: np.ndarray):
        self.first, self.items, self.answers = first, items, answers
        mine = np.unique(np.concatenate(items))
        self.local = np.full(len(idf), -1, np.int32)
        self.local[mine] = np.arange(len(mine))
        self.weight = idf[mine].astype(np.float32)
        own = np.zeros((len(items), len(mine)))
        for i, t in enumerate(items):
            np.add.at(own[i], self.local[t], idf[t])
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        self.space = np.linalg.qr(np.concatenate((own.T, latent[mine] * (self.weight > 0)[:, None]), axis=1))[0].astype(np.float32)
        self.target = own.astype(np.float32) @ self.space
        self.space *= self.weight[:, None]
        # the least length whose share is MIN_LCS, by the division that decides in the end
        self.needed = np.array([next(k for k in range(len(t) + 1) if k / len(t) >= MIN_LCS) for t in items])
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.need = np.empty(len(items), np.int64)
        self.reach = np.maximum(3, -(-self.size // BLOCK_WORDS))
        #: Blocks of a passage: an item that begins in its first block ends in it.
        self.wide = -(-self.size // BLOCK_WORDS) + 1
        #: How often each item has each of these words.
        self.count = np.zeros((len(items), len(mine)), np.int32)
        terms, owners = [], []
        for i, t in enumerate(items):
            u, c = np.unique(self.local[t], return_counts=True)
            self.count[i, u] = c
            order = np.argsort(often[mine[u]], kind="stable")
            u, c = u[order], c[order]
            rest = len(t) - np.cumsum(c)
            take = max(int(np.argmax(rest < self.needed[i])) + 1, int((self.weight[u] > 0).sum()))
            self.need[i] = self.needed[i] - rest[take - 1]
            terms.append(np.repeat(u[:take], c[:take]))
            owners.append(np.full(len(terms[-1]), i))
        term, owner = np.concatenate(terms), np.concatenate(owners)
        order = np.argsort(term, kind="stable")
        self.owner, self.to = owner[order], np.searchsorted(term[order], np.arange(len(mine) + 1))

    def cosines(self, block: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(blocks, items): the cosine of each item and the passage that begins with the block before, both sides projected; of the words' blocks, in order, and terms."""
        local = self.local[term]
        live = np.flatnonzero(local >= 0)
        live = live[self.weight[local[live]] > 0]
        sums = np.zeros((len(low) + 1, self.space.shape[1]), np.float32)
        if len(live):
            at, local = block[live], local[live]
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            sums[1 + at[starts]] = np.add.reduceat(self.space[local], starts)
            np.cumsum(sums, 0, out=sums)
        out, here = np.zeros((len(low), len(self.items)), np.float32), np.arange(len(low))
        for w in np.unique(self.wide):
            same = np.flatnonzero(self.wide == w)
            begin = np.maximum(here - 1, low)
            near = sums[np.minimum(begin + w, high)] - sums[begin]
            near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-3)
            out[:, same] = near @ self.target[same].T
        return out

    def possible(self, block: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(blocks, items): whether the window about a block may share enough; of distinct (block, term), with each block's document's first and last."""
        local = self.local[term]
        live = np.flatnonzero(local >= 0)
        block, local = block[live], local[live]
        size = self.to[local + 1] - self.to[local]
        at = np.repeat(self.to[local] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        n = len(self.items)
        score = np.bincount(np.repeat(block, size) * n + self.owner[at], minlength=len(low) * n).reshape(-1, n)
        sums = np.zeros((len(low) + 1, n), np.int32)
        np.cumsum(score, 0, out=sums[1:])
        out, here = np.empty(score.shape, bool), np.arange(len(low))
        for r in np.unique(self.reach):
            same = np.flatnonzero(self.reach == r)
            out[:, same] = sums[np.minimum(here + r, high)][:, same] - sums[np.maximum(here - 1, low)][:, same] >= self.need[same]
        return out

    def overlap(self, which: np.ndarray, pair: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """For pairs of a window and the item ``which``, with the windows' ``terms`` (of ``pair``): at most so many of the item's words are in a common subsequence."""
        local = self.local[terms]
        has = np.where(local >= 0, self.count[which[pair], local], 0)
        live = np.flatnonzero(has)
        _, once = np.unique(pair[live] * len(self.weight) + local[live], return_index=True)  # once for each window
        return np.bincount(pair[live][once], has[live][once], len(which))


_FOUND = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("answer_lcs", pa.int64()), ("stage", pa.string())])


def _search(located: DataFrame, items: list[np.ndarray], answers: list[np.ndarray], idf: np.ndarray, often: np.ndarray, latent: np.ndarray, min_cosine: float) -> DataFrame:
    targets = [_Targets(k, items[k : k + TOGETHER], answers[k : k + TOGETHER], idf, often, latent) for k in range(0, len(items), TOGETHER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "places", 1 << 19):
            raw, off = text_bytes(column(part, "places"))
            place = np.frombuffer(raw.tobytes(), "<i4").astype(np.int64)
            terms = np.frombuffer(text_bytes(column(part, "terms"))[0].tobytes(), "<i4")
            if not len(terms):
                continue
            off = off // 4
            words = column(part, "n_words").to_numpy()
            blocks = -(-words // BLOCK_WORDS)
            base = np.concatenate(([0], np.cumsum(blocks)))
            doc_of = np.repeat(np.arange(len(words)), blocks)
            low, high = base[doc_of], base[doc_of + 1]
            owner = np.repeat(np.arange(len(words)), np.diff(off))
            at_block = base[owner] + place // BLOCK_WORDS
            key = np.unique(at_block * len(idf) + terms)
            block, block_term = key // len(idf), key % len(idf)
            spot = (owner << 40) + place
            doc = column(part, "doc_id").to_pylist()
            out: list[tuple] = []

            def check(x: _Targets, near: np.ndarray, at: np.ndarray, which: np.ndarray, settled: dict[int, int], stage: str) -> None:
                """Adds what the subsequences of these windows and items decide to ``out``."""
                for k in range(0, len(at), 8192):
                    p, i = at[k : k + 8192], which[k : k + 8192]
                    r, b = doc_of[p], p - low[p]
                    # the passage and a stretch to both sides, as an item need not begin with a block
                    begin, end = np.maximum(0, (b - 1) * BLOCK_WORDS), np.minimum(words[r], np.maximum(b * BLOCK_WORDS + x.size[i], (b + 3) * BLOCK_WORDS))
                    a, z = np.searchsorted(spot, (r << 40) + begin), np.searchsorted(spot, (r << 40) + end)
                    n = z - a
                    inside = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    for j in np.flatnonzero(x.overlap(i, np.repeat(np.arange(len(p)), n), terms[inside]) >= x.needed[i]).tolist():
                        pair = int(r[j]) * len(x.items) + int(i[j])
                        if settled.get(pair, 0) > FURTHER:  # nearer passages of this document hold the item almost whole
                            continue
                        item, answer, seen = x.items[i[j]], x.answers[i[j]], terms[a[j] : z[j]]
                        common = lcs(item, seen)
                        if pair in settled or common / len(item) >= SURE_LCS:
                            settled[pair] = settled.get(pair, 0) + 1 + FURTHER * (common == len(item))
                        if common >= x.needed[i[j]]:
                            told = lcs(answer, seen)
                            # each window by itself: the one of greatest lcs need not be the one with the answer
                            if common / len(item) >= SURE_LCS or told >= MIN_ANSWER * len(answer):
                                out.append((doc[r[j]], x.first + int(i[j]), int(begin[j]), int(end[j]), float(near[p[j], i[j]]), common, told, stage))

            for x in targets:
                settled: dict[int, int] = {}
                near = x.cosines(at_block, terms, low, high)
                candidate = near >= min_cosine
                at, which = np.nonzero(candidate)
                order = np.argsort(-near[at, which], kind="stable")
                check(x, near, at[order], which[order], settled, "latent")
                at, which = np.nonzero(x.possible(block, block_term, low, high) & ~candidate)
                check(x, near, at, which, settled, "bound")
            if out:
                yield rows(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*out, strict=True)), strict=True)))

    return located.mapInArrow(run, "doc_id long, item long, start_word long, end_word long, cosine double, lcs long, answer_lcs long, stage string")


def leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, cosine, lcs, item_words, answer_lcs, answer_words, stage), a row for each document and item found.

    ``stage`` is ``latent`` where the cosine search finds the item in the document, ``bound`` where only the exact way does.

    ``benchmark`` has item_id, text and may have answer. Items without a word are in no document. Null texts are empty; null ids
    of documents are ids of their own; items that repeat are found each. Words are compared in lower case (A-Z) without punctuation.
    Rows that repeat a doc_id give one row for each item. An empty table on either side gives an empty result. Other columns are not
    read. One text, with some 40 bytes for each of its own, has to fit into a task's memory, and so have a lot of items: ITEMS, or
    LOT_WORDS words, whichever comes first.
    """
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.where("text is not null").select("item_id", "text", answer.alias("answer")).repartition(1).sortWithinPartitions("item_id", "text")
    found = None
    block: list = []

    def search(block: list) -> DataFrame:
        words = [item_words(r.text) for r in block]
        answers = [item_words(r.answer if r.answer is not None else answer_of(r.text)) for r in block]
        vocabulary = np.unique(np.concatenate(words + answers))
        items, told = [np.searchsorted(vocabulary, x) for x in words], [np.searchsorted(vocabulary, x) for x in answers]
        located = written(_located(docs, vocabulary), "located")
        counts = _summed(located, 1, _Frequencies(len(vocabulary)))[:, 0]
        n, often = max(1.0, counts[-1]), counts[:-1]
        idf = np.log((n + 1) / (often + 1)) * (often <= max(MAX_SHARE * n, 8))
        for t in items:  # an item of frequent words alone is sought by these
            if len(t) and not (idf[t] > 0).any():
                idf[t] = np.maximum(np.log((n + 1) / (often[t] + 1)), 1e-3)
        space = latent_space(located, items, idf)
        got = _search(located, items, told, idf, often, space, min_cosine)
        names = spark.createDataFrame([(k, r.item_id, len(items[k]), len(told[k])) for k, r in enumerate(block)], "item long, item_id long, item_words long, answer_words long")
        here = written(got, "found")
        discard(located)
        best = here.groupBy("doc_id", "item").agg(F.max(F.struct("lcs", "answer_lcs", "cosine", (-F.col("start_word")).alias("s"), "end_word")).alias("b"), F.max("stage").alias("stage"))
        out = best.join(F.broadcast(names), "item")  # at most ITEMS rows
        return out.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word"), F.col("b.cosine").alias("cosine"), F.col("b.lcs").alias("lcs"), "item_words", F.col("b.answer_lcs").alias("answer_lcs"), "answer_words", "stage")

    size = 0
    for r in listed.toLocalIterator():
        if n := len(item_words(r.text)):
            if block and (len(block) == ITEMS or size + n > LOT_WORDS):
                found, block, size = search(block) if found is None else found.union(search(block)), [], 0
            block.append(r)
            size += n
    if block:
        found = search(block) if found is None else found.union(search(block))
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start_word long, end_word long, cosine double, lcs long, item_words long, answer_lcs long, answer_words long, stage string")
    return found.withColumn("doc_id", id_value())
