"""Token-id files: canonical length-limited Huffman codes over global counts, in independent blocks.

A file is a folder with two Parquet tables:

* ``code``: id, bits. The code is canonical: the lengths alone give the code words, in the order (bits, id).
* ``blocks``: shard, block, before (ids of the shard before the block), doc_id and n_tokens (lists, in order), payload
  (code words, most significant bit first, big-endian), checkpoints (bit offset of each ``EVERY``-th id, little-endian
  unsigned 32-bit integers). A block holds whole documents and is decoded on its own.

Shards follow one another in ascending doc_id order, and so do blocks in a shard and documents in a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import binaries, chunks, column, discard, id_key, id_value, rows, scratch, text_bytes, written

MAX_BITS = 18
BLOCK_TOKENS = 1 << 17
EVERY = 64
#: No more shards than this: the driver keeps a row for each.
MAX_SHARDS = 20_000
SHARD_TOKENS = 8_000_000

_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary()), ("checkpoints", pa.binary())])
_BLOCKS_SQL = "shard int, block int, before long, doc_id array<long>, n_tokens array<long>, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code word, 0 for symbols that don't occur: package-merge, at most ``max_bits`` where they suffice."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate((weight, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code words of the lengths, in the order (bits, symbol)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    code = np.zeros(len(bits), np.uint64)
    if len(order):
        top = int(bits[order[-1]])
        step = np.uint64(1) << (top - bits[order]).astype(np.uint64)
        first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)[:-1]))
        code[order] = first >> (top - bits[order]).astype(np.uint64)
    return code


def encode_block(symbols: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    size = bits[symbols]
    end = np.cumsum(size)
    start = end - size
    n_words = int(end[-1] + 31 >> 5) + 1 if len(end) else 0
    at = start >> 5
    value = code[symbols] << (64 - (start & 31) - size).astype(np.uint64)
    # code words never share a bit, so sums are unions; each sum is below 2**32 and exact in a double
    made = np.bincount(at, (value >> np.uint64(32)).astype(float), n_words + 1) + np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n_words + 1)
    return made[:n_words].astype(">u4").tobytes(), start[::EVERY].astype("<u4").tobytes()


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each string of ``top`` bits the symbol whose code word starts it, and that word's length."""
    top = int(bits.max(initial=1))
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    symbol, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    spread = 1 << (top - bits[order])
    n = int(spread.sum())
    symbol[:n] = np.repeat(order, spread)
    size[:n] = np.repeat(bits[order], spread)
    return symbol, size, top


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The block's ``n`` symbols: all stretches between checkpoints advance side by side."""
    symbol, size, top = table
    words = np.concatenate((np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)))
    pair = words[:-1] << np.uint64(32) | words[1:]
    place = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.empty((EVERY, len(place)), np.uint32)
    last, down = len(pair) - 1, np.uint64(64 - top)
    for k in range(EVERY):
        key = pair[np.minimum(place >> 5, last)] << (place & 31).astype(np.uint64) >> down
        out[k] = symbol[key]
        place = place + size[key]
    return out.T.ravel()[:n]


def token_table(docs: DataFrame, path: str | None = None, end_id: int = 1, kind: str = "<u4") -> DataFrame:
    """(doc_id, n_tokens, ids as integers of ``kind``, with ``end_id`` last) of each whole text; a null text is empty."""
    path = path or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = T.encoder(path).encode
        for part in chunks(batches):
            got, off = encode(*text_bytes(column(part, "text")), end_id)
            data = got.astype(kind)
            yield rows(_TOKENS, doc_id=column(part, "doc_id"), n_tokens=np.diff(off), ids=binaries(data.view(np.uint8), data.itemsize * off))

    return docs.select(id_key().alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents. Each task sums its own; the result is bounded by the vocabulary."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            buf, _ = text_bytes(column(b, "ids"))
            have = np.bincount(np.frombuffer(buf.tobytes(), kind))
            if len(have) > len(total):
                have[: len(total)] += total
                total = have
            else:
                total[: len(have)] += have
        used = np.flatnonzero(total)
        yield rows(schema, id=used, n=total[used])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got.id.max()) + 1 if len(got) else 0, np.int64)
    out[got.id.to_numpy()] = got.n.to_numpy()
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, max_bits: int = MAX_BITS, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents to ``path``, in ascending doc_id order.

    Rows with a null id come first; rows that share an id follow one another, in the order of their ids' bytes. An
    empty table gives a file without blocks. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    wide = T.vocabulary(tokenizer or T.default_path()) > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"
    tokens = written(token_table(docs, tokenizer, end_id, kind), "ids")
    counts = id_counts(tokens, kind)
    bits = code_lengths(counts, max_bits)
    code = canonical(bits)
    used = np.flatnonzero(bits)
    spark.createDataFrame(list(zip(used.tolist(), bits[used].tolist(), strict=True)), "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    n_shards = min(MAX_SHARDS, max(1, -(-int(counts.sum()) // shard_tokens)))  # a shard is written block by block, so it may be large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        docs_: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            symbols = np.frombuffer(b"".join(held), kind)
            n = np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(kind).itemsize
            payload, marks = encode_block(symbols, code, bits)
            out = rows(_BLOCKS, shard=[shard], block=[block], before=[before], doc_id=[docs_], n_tokens=[n.tolist()], payload=[payload], checkpoints=[marks])
            block, before = block + 1, before + len(symbols)
            held.clear()
            docs_.clear()
            return out

        size = 0
        for b in batches:
            for key, x in zip(column(b, "doc_id").to_pylist(), column(b, "ids").to_pylist(), strict=True):
                held.append(x)
                docs_.append(key)
                size += len(x)
                if size >= BLOCK_TOKENS * np.dtype(kind).itemsize:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    tokens.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, _BLOCKS_SQL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(tokens)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in a file: ``start`` counts the ids of all documents before it."""
    head = spark.read.parquet(f"{path}/code").toPandas()
    bits = np.zeros(int(head.id.max()) + 1 if len(head) else 1, np.int64)
    bits[head.id.to_numpy()] = head.bits.to_numpy()
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).toPandas().sort_values("shard")
    base = np.zeros(int(sizes.shard.max()) + 2 if len(sizes) else 1, np.int64)
    base[sizes.shard.to_numpy() + 1] = sizes.n.to_numpy()
    base = np.cumsum(base)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        table = decode_table(bits)
        for b in batches:
            for x in b.to_pylist():
                n = np.array(x["n_tokens"], np.int64)
                end = np.cumsum(n)
                data = decode_block(x["payload"], x["checkpoints"], int(end[-1]), table).astype("<u4").tobytes()
                off = 4 * np.concatenate(([0], end))
                crc = [zlib.crc32(memoryview(data)[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield rows(schema, doc_id=x["doc_id"], start=base[x["shard"]] + x["before"] + end - n, n_tokens=n, ids_crc32=crc, ids=binaries(np.frombuffer(data, np.uint8), off))

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary").withColumn("doc_id", id_value())


def round_trip(docs: DataFrame) -> DataFrame:
    """Write all documents to a file in the shared folder and read the file back."""
    path = scratch(docs.sparkSession, "huffman")
    write(docs, path)
    return read(docs.sparkSession, path)
