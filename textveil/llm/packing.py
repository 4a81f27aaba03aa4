"""Packing of token pieces into sequences of a fixed size, by patterns fitted to the length histogram.

Patterns of at most three pieces that fill a sequence are enumerated over binned lengths. Their repeat counts come from
non-negative least squares against the histogram and are rounded down; what they leave is packed best-fit decreasing,
into the patterns' gaps first. All of this works on the histogram, whose size doesn't depend on the number of documents;
Spark then deals each piece, by its rank among the pieces of its length, to a place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import chunks, column, id_key, id_value, rows, text_bytes, written

MAX_TOKENS = 4096
#: Ranks are counted in groups of about this many pieces, so that one frequent length is no single task's.
GROUP_ROWS = 50_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``; only longer ones are cut, every ``max_tokens`` ids."""
    path = path or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = T.encoder(path).encode
        for part in chunks(batches):
            got, off = encode(*text_bytes(column(part, "text")), end_id)
            n = np.diff(off)
            cuts = -(-n // max_tokens)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * max_tokens
            length = np.minimum(n[row] - start, max_tokens)
            data, at = memoryview(got.tobytes()), 4 * (off[row] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield rows(_PIECES, doc_id=column(part, "doc_id").take(pa.array(row)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc)

    return docs.select(id_key().alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(bins: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, with a + b + c = ``bins``."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack((a[ok], b[ok], c[ok]), 1)


def fit(shapes: np.ndarray, histogram: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes sum(weight * (use(x) - histogram)**2) small: accelerated projected gradient."""
    n = len(histogram)
    flat = shapes.ravel()
    use = lambda x: np.bincount(flat, np.repeat(x, 3), n) * live
    live = np.arange(n) > 0
    w2 = weight**2
    back = lambda r: (w2 * r * live)[shapes].sum(1)
    v = np.ones(len(shapes))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(use(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(use(y) - histogram) / (1.05 * size))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


class _Runs:
    """Sequences of equal content: (free, count, content), content a chain (rest, length, times)."""

    def __init__(self):
        self.by_free: dict[int, list[tuple[int, tuple]]] = {}
        self.frees: list[int] = []

    def add(self, free: int, count: int, content: tuple) -> None:
        if free not in self.by_free:
            self.by_free[free] = []
            insort(self.frees, free)
        self.by_free[free].append((count, content))

    def put(self, length: int, n: int, size: int) -> None:
        """Best fit: each piece into the fullest sequence that has room; new sequences only where none has."""
        while n:
            at = bisect_left(self.frees, length)
            if at == len(self.frees):
                each = min(n, size // length)
                self.add(size - each * length, n // each, (None, length, each))
                n %= each
                continue
            free = self.frees[at]
            count, content = self.by_free[free].pop()
            if not self.by_free[free]:
                del self.by_free[free], self.frees[at]
            each = max(1, min(free // length, n // count))
            took = min(count, n // each)
            if took < count:
                self.add(free, count - took, content)
            self.add(free - each * length, took, (content, length, each))
            n -= each * took


def plan(histogram: dict[int, int], size: int = MAX_TOKENS, width: int = 8) -> dict[str, np.ndarray]:
    """Where each rank of each length goes: ranks from ``rank`` on of ``length`` go to sequences from ``sequence`` on, at ``offset``."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs = _Runs()
    bins = -(-size // width)
    if left[1:size].any() and bins * width == size:
        shapes = patterns(bins)
        binned = np.zeros(bins + 1)
        np.add.at(binned, -(-np.arange(size + 1) // width), left)
        weight = 0.2 + np.arange(bins + 1) / bins  # short pieces are easily placed later
        x = np.floor(fit(shapes, binned, weight) + 1e-6).astype(np.int64)
        have = binned.astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if not x[k]:
                break
            parts, times = np.unique(shapes[k][shapes[k] > 0], return_counts=True)
            n = int(min(x[k], (have[parts] // times).min()))
            have[parts] -= n * times
            drawn = []
            for part in shapes[k][shapes[k] > 0]:
                need, mine = n, []
                for length in range(part * width, (part - 1) * width, -1):
                    if need and left[length]:
                        took = int(min(need, left[length]))
                        left[length] -= took
                        need -= took
                        mine.append([length, took])
                drawn.append(mine[:: 1 if not drawn else -1])  # the longest beside the shortest
            while drawn and drawn[0]:
                took = min(x[0][1] for x in drawn)
                content, free = None, size
                for mine in drawn:
                    content, free = (content, mine[0][0], 1), free - mine[0][0]
                    mine[0][1] -= took
                    if not mine[0][1]:
                        mine.pop(0)
                runs.add(free, took, content)
    for length in range(size, 0, -1):
        runs.put(length, int(left[length]), size)
    ranks, sequence = np.zeros(size + 1, np.int64), 0
    out: list[tuple[int, int, int, int]] = []
    for made in runs.by_free.values():
        for count, content in made:
            offset = 0
            while content:
                content, length, each = content
                for _ in range(each):
                    out.append((length, int(ranks[length]), sequence, offset))
                    ranks[length] += count
                    offset += length
            sequence += count
    table = np.array(out, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "sequences": sequence}


def pack(cut: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and what else they have).

    Ties between pieces of one length go by a hash of (doc_id, piece), then by these. Rows that repeat a doc_id and piece
    each get a place of their own. An empty table gives an empty result. Lengths are 1 to ``size``.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, size)
    groups = max(1, -(-sum(histogram.values()) // GROUP_ROWS))
    keyed = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    per = keyed.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = per.select("length", "__group", (F.sum("__n").over(Window.partitionBy("length").orderBy("__group")) - F.col("__n")).alias("__before"))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "piece"))).join(before, ["length", "__group"])
    ranked = ranked.select(*cut.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))
    held = spark.sparkContext.broadcast(places)  # at most some places for each length: bounded by size, not by the documents

    names = cut.columns

    def run(batches):
        p = held.value
        key = p["length"] << 40 | p["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = column(b, "length").to_numpy(), column(b, "__rank").to_numpy()
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{cut._jdf.schema().toDDL()}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """Pieces of all documents with their places. A null text is empty: its one piece holds the end id alone."""
    return pack(written(pieces(docs, max_tokens=size), "pieces"), size).withColumn("doc_id", id_value())
