"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, at first its UTF-8 bytes. Runs of one symbol become a symbol of their own. Deterministic coin
tossing then gives each symbol a small label from itself and its left neighbour, four times over, so that neighbours differ
and labels are below six; a phrase begins where a label is a local maximum. A phrase's name is a hash of its symbols, and the
names are the next level's symbols. A label depends on four symbols to the left and one to the right, so equal substrings
have equal names inside, wherever they stand. The fingerprint keeps, for each of three levels, the least name in each of 64
bins, a byte of each; likeness is the share of equal bins at the highest level that has enough names in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import chunks, column, id_key, id_value, ids, partitions, rows, text_bytes

LEVELS, BINS = 3, 64
#: Names that a level needs in both fingerprints.
ENOUGH = 16
EMPTY = 255
BUCKET_ROWS = 2000

_DE_BRUIJN = 0x022FDD63CC95386D
_BIT = np.zeros(64, np.uint8)
for _k in range(64):
    _BIT[(_DE_BRUIJN << _k) % (1 << 64) >> 58] = _k


def _table(bits: int) -> np.ndarray:
    """Label of (symbol, left neighbour) for symbols of so many bits."""
    x, y = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    d = np.where(x == y, 1, x ^ y)
    low = np.log2(d & -d).astype(np.int64)
    return (2 * low + (x >> low & 1)).astype(np.uint8).ravel()


_TOSS = {bits: _table(bits) for bits in (4, 7, 8)}


def _toss(label: np.ndarray, bits: int, head: np.ndarray) -> np.ndarray:
    """Labels from labels; a row's first symbol has its own last bit's opposite to its left."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[head] = label[head] ^ 1
    return _TOSS[bits][(label.astype(np.uint16) << bits) | left]


def level_up(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of a level's phrases, with each row's offsets."""
    n = len(x)
    if not n:
        return x.astype(np.uint64), off
    full = off[:-1][off[:-1] < off[1:]]
    cut = np.empty(n, bool)
    np.not_equal(x[1:], x[:-1], out=cut[1:])
    cut[full] = True
    at = np.flatnonzero(cut)
    run = np.diff(np.append(at, n))
    s = x[at].astype(np.uint64)
    long = run > 1
    s[long] = scan.mixed(s[long] * np.uint64(0xA24BAED4963EE407) + run[long].astype(np.uint64))
    off = np.searchsorted(at, off)
    head = off[:-1][off[:-1] < off[1:]]
    if x.dtype == np.uint8 and not long.any():
        label = _toss(s.astype(np.uint8), 8, head)
    else:
        left = np.empty_like(s)
        left[1:] = s[:-1]
        left[head] = s[head] ^ np.uint64(1)
        d = s ^ left
        d[d == 0] = 1
        low = _BIT[((d & -d) * np.uint64(_DE_BRUIJN)) >> np.uint64(58)]
        label = 2 * low + ((s >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for bits in (7, 4, 4):
        label = _toss(label, bits, head)
    top = np.zeros(len(s), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    after = head + 1
    top[after[after < len(s)]] = False
    top[off[1:][off[:-1] < off[1:]] - 1] = False
    top[head] = True
    begin = np.flatnonzero(top)
    end = np.append(begin[1:], len(s))
    up, down = scan.powers(len(s))
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(scan.mixed(s) * up[: len(s)], out=total[1:])
    name = scan.mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(scan.BASE))
    return name, np.searchsorted(begin, off)


def sketches(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, LEVELS, BINS) bytes."""
    n = len(off) - 1
    out = np.full((n, LEVELS, BINS), EMPTY, np.uint8)
    x = buf
    for level in range(LEVELS):
        x, off = level_up(x, off)
        row = np.repeat(np.arange(n), np.diff(off))
        least = np.full(n * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        np.minimum.at(least, row * BINS + (x >> np.uint64(58)).astype(np.int64), x << np.uint64(6) | np.uint64(1))
        used = least != np.uint64(0xFFFFFFFFFFFFFFFF)
        value = np.where(used, scan.mixed(least) % np.uint64(EMPTY), EMPTY).astype(np.uint8)
        out[:, level] = value.reshape(n, BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sketches row by row: 0 to 1."""
    same = ((a == b) & (a != EMPTY)).sum(2)
    either = ((a != EMPTY) | (b != EMPTY)).sum(2)
    enough = np.minimum((a != EMPTY).sum(2), (b != EMPTY).sum(2)) >= ENOUGH
    level = np.where(enough.any(1), LEVELS - 1 - np.argmax(enough[:, ::-1], 1), 0)
    at = np.arange(len(a)), level
    m, u = same[at], either[at]
    raw = m / np.maximum(u, 1)
    equal = (a == b).all((1, 2))
    return np.where(equal, 1.0, np.clip((raw - 1 / EMPTY) / (1 - 1 / EMPTY), 0, 1))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text) such that after each document of a bucket comes the next of the table.

    Buckets are ranges of doc_id of about equal sizes, of BUCKET_ROWS rows or more and no more of them than 8 for each shuffle partition, so
    what the driver gets doesn't grow with the documents. The first document of each also stands, as ``extra``, at the end of the
    bucket before it, and that of the first bucket at the end of the last. Ids that repeat go by the texts' hashes.
    """
    spark = docs.sparkSession
    base = docs.select(id_key().alias("doc_id"), "text")
    n = base.count()
    if not n:
        return base.selectExpr("0 AS bucket", "0 AS extra", "*")
    many = max(1, min(-(-n // BUCKET_ROWS), 8 * partitions(spark)))
    cuts = base.select(F.percentile_approx("doc_id", [k / many for k in range(1, many)] or [0.5], 20 * many).alias("p")).first().p or []
    inner = sorted({float(x) for x in cuts}) if many > 1 else []
    placed = base.select(F.lit(0).alias("bucket"), "doc_id", "text")
    if inner:
        at = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="__at", outputCol="bucket")
        placed = at.transform(base.withColumn("__at", F.col("doc_id").cast("double"))).select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "text")
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("f")).orderBy("bucket").collect()  # one row for each bucket
    before = [(r.bucket, r.f.doc_id, r.f.h, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    small = spark.createDataFrame(before, "bucket int, f_id long, f_h long, previous int")
    own = F.struct("bucket", F.lit(0).alias("extra"))
    both = F.array(own, F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("extra")))
    first = (F.col("doc_id") == F.col("f_id")) & F.xxhash64("text").eqNullSafe(F.col("f_h"))
    spread = placed.join(F.broadcast(small), "bucket").select("doc_id", "text", F.explode(F.when(first, both).otherwise(F.array(own))).alias("to"))
    return spread.select("to.bucket", "to.extra", "doc_id", "text").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "extra", "doc_id", F.xxhash64("text"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness to these and to the next document.

    The edited text has the first floor(n/4) code points of the next document (by doc_id; after the last the first) in place of its own
    last ones. Null texts are empty; an empty text's fingerprint has no names and is like an empty text only. Null ids come first.
    Rows that repeat stand side by side and are compared each. An empty table gives an empty result. Columns but doc_id and text are
    not read. One text and its neighbour, with some 60 bytes of work space for each of theirs, have to fit into a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for part in chunks(batches):
            if carry is not None:
                part = pa.Table.from_batches([carry, part]).combine_chunks().to_batches()[0]
            carry = part.slice(part.num_rows - 1, 1)
            bucket, extra = ids(part, "bucket"), ids(part, "extra")
            live = np.flatnonzero((extra[:-1] == 0) & (bucket[1:] == bucket[:-1]))
            if not len(live):
                continue
            buf, off = text_bytes(column(part, "text"))
            texts = [buf[a:b].tobytes().decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            edited = [(t[: len(t) - (k := len(t) // 4)] + texts[i + 1][:k]).encode() for i in live.tolist() for t in (texts[i],)]
            own = sketches(buf, off)
            new = sketches(np.frombuffer(b"".join(edited), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in edited]))))
            yield rows(_OUT, doc_id=ids(part)[live], n_chars=[len(texts[i]) for i in live.tolist()], edited_sha256=[hashlib.sha256(x).hexdigest() for x in edited], fingerprint=[own[i].tobytes().hex() for i in live.tolist()], edited_fingerprint=[x.tobytes().hex() for x in new], near_edited=likeness(own[live], new), near_next=likeness(own[live], own[live + 1]))

    got = with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumn("doc_id", id_value())
