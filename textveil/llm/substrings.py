"""Exact removal of repeated 100-byte strings, by prefix-free parsing.

Parsing. A rolling hash runs over each text; of the grams that start in a 100-byte string, the one of least hash is its
trigger (the leftmost of equals). Neighbouring strings with one trigger make a phrase. Phrases overlap by 99 bytes, so every
100-byte string lies in just one, and equal strings have equal triggers at equal places, whatever surrounds them. Only phrases whose trigger gram occurs again are kept.
Phrases travel packed, one row for each range of grams that a buffer of a task has any of; the ranges tell which grams occur again.

Order of the parse. Equal phrases that meet in a buffer or a range of grams are settled there. The first ones of each are sorted by
phrase, then by place. The first of equal phrases is the dictionary's entry; every later one starts later in the corpus, so all its strings repeat.

Suffix array of the dictionary. The suffixes of its phrases are sorted by their first 100 bytes, which never reach beyond their
phrase, then by the place of the phrase in the parse. That is the corpus order at a depth of 100 bytes: each phrase's suffix stands
for the suffixes of the text that start at its first occurrence. Neighbours in it that agree in 100 bytes are repeats, all but the first.
The array is made in parts: equal suffixes have one trigger gram at one distance, so phrases are dealt by ranges of grams, and a range
sorts the suffixes of its grams, distance by distance. A gram of very many phrases is spread over ranges by place; each range settles what it
holds and sends on the first of equal suffixes, packed, so a string that a third of the documents hold meets itself once from each range.

Phrases are range partitions in order, by key and place together, so one phrase that a third of the documents hold is
spread over as many tasks as its rows need; what ends one range is told to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import binaries, chunks, column, discard, id_key, partitions, positional, rows, text_bytes, written

LENGTH, GRAM = 100, 32
#: Phrases that a task looks through for equal ones before it sends them on.
BUFFER = 400_000
#: Bytes of text that are hashed at once: the arrays of a step stay in the processor's cache.
AT_ONCE = 200_000
#: Bytes of phrases whose suffixes are sorted at once.
SORTED = 2_000_000
#: Entries of the dictionary with one gram that one range takes; those of a gram with more are spread over ranges.
MANY = 4_096
_BASES = (scan.BASE, 0xD6E8FEB86659FD93)
#: A place in the corpus: a document is an id and the hash of its text (null ids and repeated ids are apart by that).
_PLACE = ["doc", "hash", "first"]


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return scan.prefix_sums(buf, scan.byte_values(False))


def parse(buf: np.ndarray, off: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, strings, trigger, gram) of each phrase: it covers ``strings`` 100-byte strings from byte ``first`` of ``buf`` on, which hold the gram at byte ``trigger``."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    s, down = sums
    gram = s[GRAM:] - s[:-GRAM]
    gram *= down[: len(gram)]
    key = gram >> np.uint64(29)
    key ^= gram
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(gram), dtype=np.uint64)
    have, width = 1, LENGTH - GRAM + 1
    while have * 2 <= width:
        key = np.minimum(key[have:], key[:-have])
        have *= 2
    if have < width:
        key = np.minimum(key[width - have :], key[: have - width])
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(key[1:], key[:-1], out=begin[1:])
    begin[off[:-1][off[:-1] < n]] = True
    first = np.flatnonzero(begin)
    row = np.searchsorted(off, first, "right") - 1
    strings = np.minimum(np.append(first[1:], n), off[row + 1] - LENGTH + 1) - first
    live = strings > 0  # no strings that would cross a row's end
    row, first, strings = row[live], first[live], strings[live]
    trigger = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return row, first, strings, trigger, scan.mixed(gram[trigger]).view(np.int64)


def _fingerprint(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, end: np.ndarray, base: int = scan.BASE) -> np.ndarray:
    s, down = sums
    return scan.mixed((s[end] - s[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(base)).view(np.int64)


def _longs(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(part, c).to_numpy(zero_copy_only=False) for c in names]


#: Columns of an array of phrases. The last holds the first byte and, in the lowest bits, the number of strings; a row without strings tells of a gram only.
_KEY, _GRAM, _DOC, _AT, _COLUMNS = slice(0, 2), 2, slice(3, 5), 5, 6
_BITS = 7


def _told_apart(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each key among ``phrases``, and those whose key stands at an earlier place; rows that repeat a place are one."""
    order = np.argsort(phrases[:, 0])
    same = phrases[order[1:], 0] == phrases[order[:-1], 0]
    several = np.append(False, same) | np.append(same, False) if len(order) else np.empty(0, bool)
    alone, rest = phrases[order[~several]], phrases[order[several]]
    rest = rest[np.lexsort(rest[:, [_AT, 4, 3, 1, 0]].T)]
    new = np.append(True, (rest[1:, _KEY] != rest[:-1, _KEY]).any(1))[: len(rest)]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))
    again = (rest[:, 3:] != rest[begin, 3:]).any(1)
    return np.concatenate((alone, rest[new])), rest[again]


def _united(phrases: np.ndarray) -> np.ndarray:
    """(doc, hash, first, strings) of the stretches that phrases cover, those that touch as one."""
    x = phrases[np.lexsort(phrases[:, [_AT, 4, 3]].T)]
    first, end = x[:, _AT] >> _BITS, (x[:, _AT] >> _BITS) + (x[:, _AT] & (1 << _BITS) - 1)
    new = np.flatnonzero(np.append(True, (x[1:, _DOC] != x[:-1, _DOC]).any(1) | (first[1:] > end[:-1]))[: len(x)])
    last = np.append(new[1:], len(x))[: len(new)] - 1
    return np.column_stack((x[new, _DOC], first[new], end[last] - first[new]))


def _packed(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, kind, data): the parse of ``docs`` (doc, hash, text), many phrases in a row.

    Of a gram that a task meets again, all phrases are kept at once: the first of equal ones (kind 1) and what the others cover
    (kind 2), for any range. One row for each gram goes to the gram's range to meet those of other tasks (kind 0), so a gram that
    all documents hold comes there once from each task's buffer.
    """
    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

    def told(held: list[np.ndarray], number: int) -> pa.RecordBatch:
        x = np.concatenate(held)
        x = x[np.argsort(x[:, _GRAM].view(np.uint64))]
        first = np.flatnonzero(np.append(True, x[1:, _GRAM] != x[:-1, _GRAM])[: len(x)])
        size = np.diff(np.append(first, len(x)))
        firsts, again = _told_apart(x[np.repeat(size > 1, size)])
        one = x[first]
        one[np.ix_(size > 1, [0, 1, 3, 4, _AT])] = 0
        goes = (one[:, _GRAM].view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        off = np.searchsorted(goes, np.arange(ranges + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(off))
        data = np.concatenate((one.ravel(), firsts.ravel(), _united(again).ravel()))
        ends = np.concatenate((8 * _COLUMNS * off[np.append(full, ranges)], 8 * _COLUMNS * (len(one) + np.array([len(firsts)])), [8 * len(data)]))
        return rows(schema, range=np.append(full, [number % ranges] * 2), kind=np.repeat([0, 1, 2], [len(full), 1, 1]), data=binaries(data.view(np.uint8), ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId()
        for part in chunks(batches, size=AT_ONCE):
            buf, off = text_bytes(column(part, "text"))
            sums = _sums(buf)
            row, first, strings, _, gram = parse(buf, off, sums)
            end = first + strings + LENGTH - 1
            other = _fingerprint(scan.prefix_sums(buf, scan.byte_values(False, 3), _BASES[1]), first, end, _BASES[1])
            doc, hash_ = _longs(part, "doc", "hash")
            held.append(np.column_stack((_fingerprint(sums, first, end), other, gram, doc[row], hash_[row], first - off[row] << _BITS | strings)))
            size += len(row)
            if size >= BUFFER:
                yield told(held, number)
                held, size, number = [], 0, number + 1
        if size:
            yield told(held, number)

    return docs.mapInArrow(run, "range int, kind int, data binary")


def _phrases(docs: DataFrame) -> DataFrame:
    """The parse (key, gram, doc, hash, first, strings, again) of ``docs`` (doc, hash, text): phrases whose gram occurs again.

    Those that a task saw at an earlier place too are ``again``, with neighbours as one and without key and gram.
    """
    ranges = partitions(docs.sparkSession)
    schema = pa.schema([("key", pa.binary()), ("gram", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("first", pa.int64()), ("strings", pa.int64()), ("again", pa.bool_())])

    def kept(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), 50_000):
            y = x[a : a + 50_000]
            key = binaries(np.ascontiguousarray(y[:, _KEY]).view(np.uint8).ravel(), 16 * np.arange(len(y) + 1))
            yield rows(schema, key=key, gram=y[:, _GRAM], doc=y[:, 3], hash=y[:, 4], first=y[:, _AT] >> _BITS, strings=y[:, _AT] & (1 << _BITS) - 1, again=np.zeros(len(y), bool))

    def covered(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(x):
            yield rows(schema, key=pa.nulls(len(x), pa.binary()), gram=pa.nulls(len(x), pa.int64()), doc=x[:, 0], hash=x[:, 1], first=x[:, 2], strings=x[:, 3], again=np.ones(len(x), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet = []
        for part in batches:
            kind, data = _longs(part, "kind")[0], column(part, "data")
            of = lambda k: text_bytes(data.filter(pa.array(kind == k)))[0].copy().view(np.int64)  # noqa: B023, E731
            meet.append(of(0).reshape(-1, _COLUMNS))
            yield from kept(of(1).reshape(-1, _COLUMNS))
            yield from covered(of(2).reshape(-1, 4))
        if meet:
            x = np.concatenate(meet)
            meet.clear()
            x = x[np.argsort(x[:, _GRAM])]
            same = x[1:, _GRAM] == x[:-1, _GRAM]
            several = (np.append(False, same) | np.append(same, False))[: len(x)]
            firsts, again = _told_apart(x[several & (x[:, _AT] != 0)])
            yield from kept(firsts)
            yield from covered(_united(again))

    return _packed(docs, ranges).repartitionById(ranges, "range").mapInArrow(run, "key binary, gram long, doc long, hash long, first long, strings long, again boolean")


def _cut_out(docs: DataFrame) -> DataFrame:
    """The dictionary (gram, doc, hash, first, strings, phrase): of documents (doc, hash, text, firsts, sizes, grams, lonely) the phrases at ``firsts``, but those at ``lonely``."""
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("first", pa.int64()), ("strings", pa.int64()), ("phrase", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            buf, off = text_bytes(column(part, "text"))
            raw = buf.tobytes()
            row, gone = (np.repeat(np.arange(part.num_rows), column(part, c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for c in ("firsts", "lonely"))
            first, strings, gram, lonely = (column(part, c).flatten().to_numpy() for c in ("firsts", "sizes", "grams", "lonely"))
            live = ~np.isin(off[row] + first, off[gone] + lonely)
            row, first, strings, gram = row[live], first[live], strings[live], gram[live]
            begin = off[row] + first
            phrase = [raw[a:b] for a, b in zip(begin.tolist(), (begin + strings + LENGTH - 1).tolist(), strict=True)]
            doc, hash_ = _longs(part, "doc", "hash")
            yield rows(schema, gram=gram, doc=doc[row], hash=hash_[row], first=first, strings=strings, phrase=pa.array(phrase, pa.binary()))

    return docs.mapInArrow(run, "gram long, doc long, hash long, first long, strings long, phrase binary")


def _ordered(entries: DataFrame, width: int, name: str) -> DataFrame:
    """The order of ``entries`` (key of ``width`` bytes, doc, hash, first, and others): all their columns but the key, with ``again``, written.

    Entries are sorted by key and place over ranges of both. ``again`` tells that the key also stands at an earlier place; rows that
    repeat a place are one. A key that goes over the end of a range is settled afterwards: each range gives its first and its last
    entry, so what comes to the driver and is broadcast are two rows for each range, whatever the number of entries.
    """
    spark, others = entries.sparkSession, [f for f in entries.schema if f.name not in ("key", *_PLACE)]
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    mine = [("range", pa.int64()), ("head", pa.bool_()), ("again", pa.bool_()), ("edge", pa.int32()), ("key", pa.binary()), *[(f"{c}0", pa.int64()) for c in _PLACE], *[(c, pa.int64()) for c in _PLACE]]
    schema = pa.schema([*mine, *[(f.name, kinds[f.dataType.simpleString()]) for f in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, groups, held = None, None, 0, None
        for part in batches:
            n = part.num_rows
            if not n:
                continue
            table = text_bytes(column(part, "key"))[0].reshape(n, width)
            new = np.append(key != table[0].tobytes(), (table[1:] != table[:-1]).any(1))
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.stack(_longs(part, *_PLACE), 1)
            begin = place[at]
            if start is not None:
                begin[at < 0] = start
            edge = np.zeros(n, np.int32)
            edge[0] = held is None
            shown = np.zeros(n, bool)
            shown[[0, -1]] = edge[0] > 0, True
            again, head = (place != begin).any(1), np.cumsum(new) + groups <= 1
            names = np.full(n, None, object)
            names[shown] = [table[k].tobytes() for k in np.flatnonzero(shown)]
            if held is not None:
                yield rows(schema, **held)
            held = {"range": column(part, "range"), "head": head, "again": again, "edge": edge, "key": pa.array(names, pa.binary())}
            held |= {f"{c}0": pa.array(begin[:, k], pa.int64(), mask=~shown) for k, c in enumerate(_PLACE)} | {c: place[:, k] for k, c in enumerate(_PLACE)}
            held |= {f.name: column(part, f.name) for f in others}
            key, start, groups = table[-1].tobytes(), begin[-1], groups + int(new.sum())
        if held is not None:
            held["edge"][-1] += 2
            yield rows(schema, **held)

    ddl = ", ".join(["range long, head boolean, again boolean, edge int, key binary", *[f"{c}0 long" for c in _PLACE], *[f"{c} long" for c in _PLACE], *[f"{f.name} {f.dataType.simpleString()}" for f in others]])
    dealt = entries.repartitionByRange(partitions(spark), "key", *_PLACE).sortWithinPartitions("key", *_PLACE)
    out = written(dealt.withColumn("range", F.spark_partition_id().cast("long")).mapInArrow(run, ddl), name, spark__sql__execution__rangeExchange__sampleSizePerPartition="40")

    told, last = [], None
    edges = sorted(out.where("edge > 0").select("range", "edge", "key", *[f"{c}0" for c in _PLACE]).collect())
    for r in edges:
        if r.edge != 2:
            goes_on = last is not None and bytes(r.key) == last[0]
            if goes_on:
                told.append((r.range, *last[1]))
            else:
                last = (bytes(r.key), (r.doc0, r.hash0, r.first0))
        if r.edge != 1 and bytes(r.key) != last[0]:
            last = (bytes(r.key), (r.doc0, r.hash0, r.first0))
    before = spark.createDataFrame(told, "range long, doc1 long, hash1 long, first1 long")
    moved = F.col("head") & F.col("doc1").isNotNull()
    again = F.when(moved, (F.col("doc") != F.col("doc1")) | (F.col("hash") != F.col("hash1")) | (F.col("first") != F.col("first1"))).otherwise(F.col("again"))
    return out.join(F.broadcast(before), "range", "left").select(*_PLACE, *[f.name for f in others], again.alias("again"))


def _triggers(phrases: pa.RecordBatch) -> np.ndarray:
    """Where in each phrase its trigger stands: all its strings hold it."""
    out = []
    for part in chunks(iter([phrases]), "phrase", AT_ONCE):
        buf, off = text_bytes(column(part, "phrase"))
        row, _, _, trigger, _ = parse(buf, off, _sums(buf))
        out.append(trigger - off[row])
    return np.concatenate(out)


def _earlier(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of suffixes in the order of their places: where in the suffix array stand those that are not the first place of their ``key``."""
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    begin = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], np.arange(len(key)), 0))
    return order[(place != place[begin]).any(1)]


def _repeats(phrases: pa.RecordBatch) -> np.ndarray:
    """Which strings of ``phrases``, which are ordered by gram and place, also stand at an earlier place in them.

    Equal suffixes have equal distances to their triggers, so those of each distance are sorted by themselves, by their first 100 bytes.
    """
    buf, off = text_bytes(column(phrases, "phrase"))
    n, trigger, place = *_longs(phrases, "strings"), _triggers(phrases), np.stack(_longs(phrases, *_PLACE), 1)
    base = np.cumsum(n) - n
    found = np.zeros(n.sum(), bool)
    windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    for distance in range(LENGTH - GRAM + 1):
        within = trigger - distance
        live = np.flatnonzero((within >= 0) & (within < n))
        if len(live) > 1:
            live = live[_earlier(windows[off[live] + within[live]].view(f"S{LENGTH}").ravel(), place[live])]
            found[base[live] + within[live]] = True
    return found


def _suffixes(dictionary: DataFrame) -> DataFrame:
    """(doc, hash, first, strings, range, data): of the dictionary (with ``many``), dealt by gram, runs of suffixes that repeat; and packed in ``data`` those that other ranges may hold too.

    Equal suffixes have one gram. All phrases of a gram are in one range, which settles them. Only the phrases of a gram that has
    ``many`` are spread over ranges by place; of these, each range sends on the first of equal suffixes, with their 100 bytes.
    """
    ranges = partitions(dictionary.sparkSession)
    schema = pa.schema([*[(c, pa.int64()) for c in (*_PLACE, "strings")], ("range", pa.int32()), ("data", pa.binary())])

    def packed(part: pa.RecordBatch, row: np.ndarray, within: np.ndarray) -> Iterator[pa.RecordBatch]:
        buf, off = text_bytes(column(part, "phrase"))
        place = np.stack(_longs(part, *_PLACE), 1)
        windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
        for a in range(0, len(row), 50_000):
            r, w = row[a : a + 50_000], within[a : a + 50_000]
            key, at = windows[off[r] + w], place[r]
            at[:, 2] += w
            h = scan.mixed((np.ascontiguousarray(key[:, :96]).view(np.uint64) * scan.powers(12)[0][1:]).sum(1))
            goes = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(goes, kind="stable")
            ends = np.searchsorted(goes[order], np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(ends))
            data = np.concatenate((key, at.view(np.uint8)), 1)[order]
            none = pa.nulls(len(full), pa.int64())
            yield rows(schema, **dict.fromkeys((*_PLACE, "strings"), none), range=full, data=binaries(data.ravel(), data.shape[1] * ends[np.append(full, ranges)]))

    def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n, doc, hash_, first = _longs(part, "strings", *_PLACE)
        base, found = np.cumsum(n) - n, _repeats(part)
        at = np.flatnonzero(found)
        row = np.searchsorted(base, at, "right") - 1
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))[: len(at)])
        r = row[new]
        yield rows(schema, doc=doc[r], hash=hash_[r], first=first[r] + at[new] - base[r], strings=np.diff(np.append(new, len(at))), range=pa.nulls(len(r), pa.int32()), data=pa.nulls(len(r), pa.binary()))
        at = np.flatnonzero(np.repeat(_longs(part, "many")[0], n) & ~found)
        row = np.searchsorted(base, at, "right") - 1
        yield from packed(part, row, at - base[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # rows of the gram ``last``, which may go on
        for part in chunks(batches, "phrase", SORTED):
            gram = _longs(part, "gram")[0]
            begin = int(np.searchsorted(gram, gram[-1], "left"))
            if gram[-1] != last:
                whole = [*held, part.slice(0, begin)]
                if sum(x.num_rows for x in whole):
                    yield from settled(whole)
                held, last = [], gram[-1]
            held.append(part.slice(begin))
        if held:
            yield from settled(held)

    spread = dictionary.repartitionByRange(ranges, "gram", *[F.when(F.col("many"), F.col(c)) for c in _PLACE])
    return spread.sortWithinPartitions("gram", *_PLACE).mapInArrow(run, "doc long, hash long, first long, strings long, range int, data binary")


def _met(suffixes: DataFrame) -> DataFrame:
    """(doc, hash, first, strings): of packed suffixes (range, data), in which equal ones have one range, those that also stand at an earlier place."""
    schema = pa.schema([(c, pa.int64()) for c in (*_PLACE, "strings")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [text_bytes(column(part, "data"))[0].reshape(-1, LENGTH + 24).copy() for part in batches if part.num_rows]
        if held:
            x = np.concatenate(held)
            place = x[:, LENGTH:].copy().view(np.int64)
            order = np.lexsort(place.T[::-1])
            x, place = x[order], place[order]
            place = place[_earlier(x[:, :LENGTH].copy().view(f"S{LENGTH}").ravel(), place)]
            yield rows(schema, doc=place[:, 0], hash=place[:, 1], first=place[:, 2], strings=np.ones(len(place), np.int64))

    return suffixes.repartitionById(partitions(suffixes.sparkSession), "range").mapInArrow(run, "doc long, hash long, first long, strings long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, hash, starts, ends) of ``docs`` (doc, hash, text): byte stretches, in no order, that strings which also start earlier cover."""
    parsed = written(_phrases(docs), "parse")
    parse_array = _ordered(parsed.where("NOT again").drop("again"), 16, "parse-array")

    # a gram that one entry alone has is in no other phrase: that entry's strings repeat as a whole phrase only
    entries = parse_array.where("NOT again")
    by_place = entries.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("first", "strings", "gram"))).alias("p"))
    sizes = entries.groupBy("gram").agg(*[F.min(c).alias(c) for c in _PLACE], F.count("*").alias("n"))
    sizes = written(sizes.where(f"n = 1 OR n > {MANY}"), "gram-sizes")
    lonely, many = sizes.where("n = 1"), sizes.where("n > 1").select("gram", F.lit(True).alias("many"))
    lonely = lonely.groupBy("doc", "hash").agg(F.collect_list("first").alias("lonely"))
    asked = by_place.select("doc", "hash", F.col("p.first").alias("firsts"), F.col("p.strings").alias("sizes"), F.col("p.gram").alias("grams")).join(lonely, ["doc", "hash"], "left")
    asked = asked.where("size(firsts) > coalesce(size(lonely), 0)")
    dictionary = written(_cut_out(docs.join(asked, ["doc", "hash"])), "dictionary")
    dictionary = dictionary.join(F.broadcast(many), "gram", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    suffixes = written(_suffixes(dictionary), "suffixes", spark__sql__execution__rangeExchange__sampleSizePerPartition="40")

    covered = [parsed.where("again"), parse_array.where("again"), suffixes.where("data IS NULL"), _met(suffixes.where("data IS NOT NULL").select("range", "data"))]
    covered = reduce(DataFrame.union, [x.select(*_PLACE, (F.col("first") + F.col("strings") + LENGTH - 1).alias("end")) for x in covered])
    spans = written(covered.groupBy("doc", "hash").agg(F.collect_list("first").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    for done in (parsed, parse_array, sizes, dictionary, suffixes):
        discard(done)
    return spans


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, with ``__n_bytes``, ``__kept`` (the bytes that stay; as text: without cut characters) and ``__spans`` (removed runs: start and end in bytes).

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same text.
    Null texts are empty; texts under 100 bytes stay as they are; null ids count as one id less than all others. Rows that share
    an id and a text are one document, whose first occurrence is the same place in each; other texts of one id are documents of
    their own, in the order of their hashes. Input columns may have any names. An empty table gives an empty result. One text,
    with some 50 bytes of work space for each of its own, has to fit into a task's memory.
    """
    mine = positional(docs, "doc_id", "text").withColumns({"__doc": id_key(), "__hash": F.xxhash64("text")})
    names = mine.columns[:-2]
    spans = repeated_spans(mine.select(F.col("__doc").alias("doc"), F.col("__hash").alias("hash"), "text"))
    spans = spans.toDF("__doc", "__hash", "__starts", "__ends")
    joined = mine.join(spans, ["__doc", "__hash"], "left").select(*names, "__starts", "__ends")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            buf, off = text_bytes(column(part, "text"))
            kept, spans_ = [], []
            starts, ends = column(part, "__starts"), column(part, "__ends")
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                x = buf[a:b]
                if not starts[k].is_valid:
                    kept.append(x.tobytes())
                    spans_.append([])
                    continue
                depth = np.zeros(len(x) + 1, np.int64)
                np.add.at(depth, starts[k].values.to_numpy(), 1)
                np.add.at(depth, ends[k].values.to_numpy(), -1)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept.append(x[~gone].tobytes())
                spans_.append([{"start": s, "end": e} for s, e in edge.tolist()])
            data = [column(part, c) for c in names]
            stay = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*data, pa.array(np.diff(off)), stay, pa.array(spans_, run_type)], names=[*names, "__n_bytes", "__kept", "__spans"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields[:-2])
    cut = joined.mapInArrow(run, f"{ddl}, __n_bytes long, __kept {'string' if as_text else 'binary'}, __spans array<struct<start:long,end:long>>")
    return cut.toDF(*docs.columns, "__n_bytes", "__kept", "__spans")


def cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, under the same columns. A cut within a character takes the whole character.

    ``n_chars``, if there is such a column, follows the text; a null text stays null.
    """
    keep = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    mine = positional(docs, *keep)
    got = remove_repeats(mine, as_text=True)
    text = F.when(F.col("text").isNull() | (F.size("__spans") == 0), F.col("text")).otherwise(F.col("__kept"))
    new = got.withColumn("text", text).select(*mine.columns)
    if "n_chars" in keep:
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return new.toDF(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    got = remove_repeats(docs.select("doc_id", "text"))
    return got.select("doc_id", F.col("__n_bytes").alias("n_bytes"), (F.col("__n_bytes") - F.length("__kept")).cast("long").alias("n_removed"), F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))
