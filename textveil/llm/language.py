"""Language identification by n-gram filters whose slots are masks of languages.

A bit-sliced Bloom filter has SLOTS slots of one bit for each language: an n-gram sets its language's bit in HASHES slots, and the
conjunction of these slots gives all languages that hold it in one look. A text's n-grams are counted for each language by the bits of
their masks; the counts are corrected for false positives, whose rate follows from how full a language's bits are, and the greatest
decides.

A language's filter takes the n-grams that make at least MIN_SHARE of its own of that order, so it holds no more than 1 / MIN_SHARE
for each order, however large the corpus and however many languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, id_key, id_value, rows
from .scan import mixed

#: Lengths of the n-grams, in characters; a word is taken with a blank to each side.
ORDERS = (3, 4, 5)
MIN_SHARE, MIN_COUNT = 1e-4, 2
SLOTS, HASHES = 1 << 20, 3
#: Characters of different texts that the fit takes for each language, by a hash of the text, and about so many.
FIT_CHARS = 4_000_000
#: Characters that are looked at together; longer texts are cut where a word ends.
PIECE = 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lower case with their places, some PIECE characters at a time."""
    where, held, size = [], [], 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            to = min(len(text), at + PIECE)
            if to < len(text):  # back to the end of a word, unless there is none
                to = next((j for j in range(to, max(at, to - 4096), -1) if not text[j - 1].isalpha()), to)
            where.append(k)
            held.append(text[at:to])
            size += to - at
            at = to
            if size >= PIECE:
                yield where, held
                where, held, size = [], [], 0
    if held:
        yield where, held


def grams(texts: list[str], order: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of all n-grams and the text that each is from. No n-gram goes over a blank."""
    code = np.frombuffer((" ".join(["", *texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 0)
    text = np.repeat(np.arange(-1, len(texts)), [1, *[len(t) + 1 for t in texts]])
    keep = (code != 0) | np.append(True, code[:-1] != 0)
    code, text = code[keep].astype(np.uint64), text[keep]
    live, value = code != 0, (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for n in order:
        m = max(0, len(code) - n + 1)
        h, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + value[j : j + m]
            if 0 < j < n - 1 or n == 1:
                inside &= live[j : j + m]
        if n == 2:
            inside = live[:m] | live[1 : 1 + m]
        at = np.flatnonzero(inside)
        yield mixed(h[at]), text[at + (0 if n == 1 else 1)]  # an n-gram begins with the blank before its text at the earliest


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.fromiter((bool(t) and any(map(str.isalpha, t)) for t in texts), bool, len(texts))


def slots_of(h: np.ndarray) -> np.ndarray:
    """(HASHES, n) slots by double hashing."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)])


class Filter:
    """Bits by slot and language, with each language's rate of false positives."""

    def __init__(self, names: list[str], grams_: list[np.ndarray], counts: list[int]):
        self.names, self.counts = names, np.array(counts, float)
        self.bits = np.zeros((-(-len(names) // 8), SLOTS), np.uint8)
        for k, h in enumerate(grams_):
            self.bits[k // 8][np.unique(slots_of(h))] |= np.uint8(1 << k % 8)
        full = np.array([float(((self.bits[k // 8] >> k % 8) & 1).mean()) for k in range(len(names))])
        self.false = full**HASHES

    def hits(self, h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """(texts, languages): how many of the n-grams have a language's bit."""
        at, out = slots_of(h), np.zeros((n, len(self.names)), np.int64)
        for byte, bits in enumerate(self.bits):
            mask = bits[at[0]]
            for k in range(1, HASHES):
                mask &= bits[at[k]]
            # popcounts by language: how often each text has each of the 256 masks
            seen = np.bincount(text * 256 + mask, minlength=256 * n).reshape(n, 256)
            for bit in range(min(8, len(self.names) - 8 * byte)):
                out[:, 8 * byte + bit] = seen[:, (np.arange(256) >> bit & 1) == 1].sum(1)
        return out

    def decide(self, hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) by corrected counts: of equal ones the language with more rows in the fit, then the first name.

        The score is the part of the n-grams by which the language exceeds the next.
        """
        true = np.clip((hits - total[:, None] * self.false) / (1 - self.false), 0, None)
        order = np.lexsort((np.arange(len(self.names)), -self.counts))
        best = order[true[:, order].argmax(1)]
        top = true[np.arange(len(true)), best]
        rest = true.copy()
        rest[np.arange(len(true)), best] = 0
        return best, np.clip((top - rest.max(1)) / np.maximum(total, 1), 0, 1)


def fit(docs: DataFrame, learn: Column, fit_chars: int = FIT_CHARS) -> Filter:
    """The filter of the rows of ``docs`` (text, lang) where ``learn`` holds and neither is null.

    Texts that a language has several times count once. A language with more than ``fit_chars`` characters is represented by about so
    many of its texts, chosen by their hashes, whole; a smaller one by all. The driver gets 1 / MIN_SHARE n-grams for each order and
    language at most.
    """
    mine = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    once = mine.groupBy("lang", "h").agg(F.max(F.length("text")).alias("chars"))
    sizes = {r.lang: (r.chars, r.n) for r in once.groupBy("lang").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Filter([], [], [])
    rate = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, fit_chars / max(1, sizes[k][0])))])[F.col("lang")]
    sample = mine.where(F.pmod(F.shiftright("h", 20), F.lit(1 << 30)) < rate * (1 << 30)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            lang = np.array(column(b, "lang").to_pylist(), object)
            for name in sorted(set(lang)):
                at = np.flatnonzero(lang == name)
                for _, part in pieces([column(b, "text")[int(k)].as_py() for k in at]):
                    for size, (h, _) in zip(ORDERS, grams(part), strict=True):
                        gram, n = np.unique(h, return_counts=True)
                        yield rows(schema, lang=[name] * len(gram), size=np.full(len(gram), size, np.int32), gram=gram.view(np.int64), n=n)

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    total = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(total), ["lang", "size"]).where((F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * F.col("total"))).select("lang", "gram").toPandas()
    counts.unpersist()
    by = dict(iter(kept.groupby("lang").gram))
    return Filter(names, [by[k].to_numpy().view(np.uint64) if k in by else np.empty(0, np.uint64) for k in names], [sizes[k][1] for k in names])


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    A text that is null or has no letter is ``und`` with 0, and so is all where nothing was learned. Rows that repeat are judged alike.
    Only doc_id, as a name for the row, and text are read. Of a long text PIECE characters are looked at together.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = column(b, "text").to_pylist()
            if not model.names:
                yield rows(schema, doc_id=column(b, "doc_id"), lang_pred=[UNKNOWN] * len(texts), score=[0.0] * len(texts))
                continue
            hits, total = np.zeros((len(texts), len(model.names)), np.int64), np.zeros(len(texts), np.int64)
            for where, part in pieces(texts):
                for h, text in grams(part):
                    np.add.at(hits, where, model.hits(h, text, len(part)))
                    np.add.at(total, where, np.bincount(text, minlength=len(part)))
            best, score = model.decide(hits, total)
            told = has_letter(texts)
            yield rows(schema, doc_id=column(b, "doc_id"), lang_pred=[model.names[k] if ok else UNKNOWN for k, ok in zip(best, told, strict=True)], score=np.where(told, score, 0.0))

    got = docs.select(id_key().alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.withColumn("doc_id", id_value())


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def judged(docs: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, for all rows."""
    got = identify(docs, fit(docs, ~held_out(F.col("doc_id")), fit_chars))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
