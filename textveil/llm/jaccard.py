"""Exact Jaccard join of documents' word shingles, size-aware: subsets for small sets, inverted lists for large ones.

Documents with equal sets are one class. Two small sets meet on a whole common subset of the size that a link between sets of
their sizes needs, so a meeting is a link. A pair with a large set meets on the inverted list of a prefix shingle: in any one
order of all shingles, linked sets share one of the first n - ceil(0.8 n) + 1. The order puts frequent shingles last, by
counters over all documents, which keeps lists short; it never decides a link.

The more documents there are, the more shingles stand in two unrelated ones by chance, so no list brings sets or sketches along
before its pairs are counted. Prefixes are longer by n // 25, and so linked sets share least_common(n) of their shingles. Lists of up
to FEW documents give pairs, which are added up over all lists; a pair that meets less often than that is none. Longer lists count
for half of what is needed at most: documents that have fewer entries in them are told by their pairs alone and leave them. What
stays of the longer lists is that of near copies; those with the same members are one. Lists are made for one band of sizes after the
other, each with the larger partners of its sets, so that no more than about BAND entries are dealt at a time.

A list's members, or a pair's, are first compared by sketches: counts of a set's hashes in about as many cells as it has members. The sum of
two sketches' differences is at most the sets' symmetric difference, so a pair beyond what a link allows is none. What is left
of the lists hangs together in pieces, and pieces that share a document in clusters. A cluster's documents are compared by the
sets themselves, in one matrix product, so that each set moves once.

A cluster of more than BLOCK_SETS sets goes by leaders: some LEADERS of its sets, chosen by hash, are compared with each of its
sets, which costs rows in proportion to its size. Sets linked with leaders that hang together are one group, and sets linked with
none are the rest. Jaccard distance is a metric, so two groups have no link if their distances to some leader lie more than 0.2 apart.
What that bound leaves, pairs of groups and of the rest with all, is compared block by block, so no link is lost. For a group of near
copies next to nothing is left; only a large cluster whose sets are hardly linked still costs the square of its size.
Links become components by least labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .common import NULL_ID, binaries, chunks, column, discard, id_key, id_value, is_hot, lists, partitions, rows, spread_join, text_bytes, written
from .graph import components

#: A link: NUM * union <= DEN * intersection, that is a Jaccard similarity of 0.8 or more.
NUM, DEN = 4, 5
COUNTERS = 1 << 22
#: Documents of a list whose pairs are counted, and shingles for each of which a prefix is longer by one.
FEW, MORE = 16, 25
#: Entries of lists that are dealt at a time, beside those of the larger partners.
BAND = 64 << 20
#: Bytes of sets that one task compares at once, at most twice this.
BLOCK_BYTES = 16 << 20
#: Sets of a cluster that one task compares with one another in a matrix; and of a larger one, with its leaders or with as many others.
BLOCK_SETS = 1024
LED_SETS, LEADERS = 512, 48
#: Stands for the group of sets that no leader is linked with.
REST = NULL_ID + 1
_SLICES = 64


def needed(a: int, b: int) -> int:
    """The least common size of two linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix(n):
    return n - -(-NUM * n // DEN) + 1


def extended(n):
    """Shingles of a prefix of which linked sets share 1 + n // MORE, for the smaller one's n: each more of the prefix is one more in common."""
    return prefix(n) + n // MORE


def _common(n):
    """What a set of n shares with any set that it is linked with, at least, in both prefixes: a partner has 0.8 n or more."""
    return 1 + -(-NUM * n // DEN) // MORE


def least_common(n):
    """How often two linked sets meet in short lists, at least, n being the smaller one's size, unless both keep their entries in longer ones."""
    return (_common(n) + 1) // 2


def spared(n: Column) -> Column:
    """Entries in longer lists that a set of n can leave: the rest of what it shares is least_common(n) or more."""
    return F.floor((F.floor(F.ceil(n * NUM / DEN) / MORE) + 1) / 2)


def partners(n: int) -> range:
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


#: Sizes up to which subsets are thought of.
SMALLEST = 12


def subsets(n: int, small: int) -> int:
    """How many subsets a set of n has to meet all linked sets of up to ``small``."""
    return sum(comb(n, needed(n, b)) for b in partners(n) if b <= small and needed(n, b) <= n)


def boundary(sizes: np.ndarray, often: float) -> int:
    """The largest size for which subsets are taken, at the least cost in rows, from the numbers of sets of each size and the mean length of a list.

    A subset is a row. A list entry is a row, and is compared with the others of its list.
    """
    cost = lambda small: sum(sizes[n] * (subsets(n, small) if n <= small else prefix(n) * (1 + often)) for n in range(1, SMALLEST + 1))
    return min(range(1, SMALLEST + 1), key=cost)


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, off = text_bytes(column(part, "text"))
    h, _, _, row = scan.words(buf, off)
    return scan.distinct(*scan.shingles(h, row, part.num_rows))


def _cell(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def shingle_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each of COUNTERS cells how far, in half powers of two, its shingles are above twice the mean (0 for most), and the boundary of small sets.

    Tasks add up counters and sizes over all their documents, slices of them are added in Spark, and 8 * COUNTERS bytes come back.
    """
    each = COUNTERS // _SLICES
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(COUNTERS, np.int32), np.zeros(SMALLEST + 1, np.int64)
        for part in chunks(batches):
            u, off = _sets(part)
            np.add.at(total, _cell(u), 1)
            n = np.diff(off)
            sizes += np.bincount(n[n <= SMALLEST], minlength=SMALLEST + 1)
        if total.any():
            short = np.minimum(total, 65535).astype("<u2")  # one task's; beyond that a shingle is frequent anyway
            yield rows(schema, slice=np.arange(_SLICES + 1, dtype=np.int32), counts=[x.tobytes() for x in (*short.reshape(_SLICES, each), sizes.astype("<i4"))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(column(b, "slice").to_pylist(), column(b, "counts").to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(x, "<i4" if s == _SLICES else "<u2").astype(np.int64)
        if sums:
            yield rows(schema, slice=list(sums), counts=[x.astype("<i8").tobytes() for x in sums.values()])

    got = {r.slice: np.frombuffer(r.counts, "<i8") for r in docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(_SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()}
    total = np.concatenate([got.get(k, np.zeros(each, np.int64)) for k in range(_SLICES)])
    levels = (2 * np.log2(np.maximum(total / (2 * total.mean() + 1), 1))).astype(np.uint8)
    lists_ = total.reshape(-1, 4).sum(1)
    return levels, boundary(got.get(_SLICES, np.zeros(SMALLEST + 1)), total.sum() / max(1, np.count_nonzero(lists_)))


def _fingerprint(u: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bytes for each row's set."""
    out = np.empty((len(off) - 1, 2), np.uint64)
    for k, c in enumerate((0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scan.mixed(u * np.uint64(c)))))
        out[:, k] = scan.mixed(s[off[1:]] - s[off[:-1]] + (off[1:] - off[:-1]).astype(np.uint64))
    return out


def _subsets(u: np.ndarray, small: int) -> list[int]:
    """A small set's meeting places: each subset of the needed size, for each size of a small partner."""
    n, out = len(u), []
    h = scan.mixed(u ^ np.uint64(0x589965CC75374CC3))
    for b in partners(n):
        if b <= small and (size := needed(n, b)) <= n:
            key = np.uint64((min(n, b) * 64 + max(n, b)) * scan.BASE % (1 << 64))
            at = np.array(list(combinations(range(n), size)), np.int64)
            met = scan.mixed(h[at].sum(1) * np.uint64(2 * size + 1) + key)
            # odd where sets of one size meet; elsewhere two of one size are no link by themselves
            out.append(met >> np.uint64(1) << np.uint64(1) | np.uint64(b == n))
    return np.unique(np.concatenate(out)).astype(np.int64).tolist() if out else []


def _cells(n: np.ndarray) -> np.ndarray:
    """Cells of a sketch: the power of two from n/2 on, 16 at least."""
    return 1 << np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / 2)).astype(np.int64))


def _sketches(u: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's counts by the low bits of its hashes, one byte each (255: that or more), with offsets."""
    n = np.diff(off)
    cells = _cells(n)
    to = np.concatenate(([0], np.cumsum(cells)))
    row = np.repeat(np.arange(len(n)), n)
    at = to[row] + (u & (cells[row] - 1).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=to[-1]), 255).astype(np.uint8), to


def _described(docs: DataFrame, levels: np.ndarray, small: int) -> DataFrame:
    """(doc_id, n, class, tokens, meets, sketch): set size and fingerprint, prefix shingles, a small set's subsets, counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("tokens", pa.list_(pa.int64())), ("meets", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            u, off = _sets(part)
            n = np.diff(off)
            level = levels[_cell(u)]
            row = np.repeat(np.arange(len(n)), n)
            # rows are in the order of their hashes already: a stable sort by (row, level) does the rest
            order = np.argsort(row * 64 + level, kind="stable") if level.any() else np.arange(len(u))
            count = np.where(n > 0, extended(n), 0)
            to = np.concatenate(([0], np.cumsum(count)))
            at = np.repeat(off[:-1] - to[:-1], count) + np.arange(to[-1])
            meets = [_subsets(u[a:b], small) if 0 < b - a <= small else [] for a, b in zip(off[:-1], off[1:], strict=True)]
            name = binaries(_fingerprint(u, off).view(np.uint8).ravel(), 16 * np.arange(len(n) + 1))
            yield rows(schema, doc_id=column(part, "doc_id"), n=n, **{"class": name}, tokens=lists(u[order[at]].astype(np.int64), to, pa.int64()), meets=pa.array(meets, pa.list_(pa.int64())), sketch=binaries(*_sketches(u, off)))

    return docs.mapInArrow(run, "doc_id long, n long, class binary, tokens array<long>, meets array<long>, sketch binary")


def _set_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for part in chunks(batches):
            u, off = _sets(part)
            yield rows(schema, doc_id=column(part, "doc_id"), hashes=binaries(u.view(np.uint8), 8 * off))

    return docs.mapInArrow(run, "doc_id long, hashes binary")


def linked_groups(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the first set of its component under links; ``side`` is 0 for all, or 1 and 2, which are compared with one another only."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    value, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    live = often[token] > 1
    name = np.cumsum(often > 1) - 1
    token, owner = name[token[live]], owner[live]
    apart = (side > 0).any()
    left, right = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if apart else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    step = max(1, (32 << 20) // (4 * len(sets)))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        i, j = np.searchsorted(token, (a, a + step))
        m = np.zeros((len(sets), min(step, int(token[-1]) + 1 - a)), np.float32)
        m[owner[i:j], token[i:j] - a] = 1
        x, y = (m[left], m[right]) if apart else (m, m)
        for k in range(0, len(left), 256):  # by stripes, so that no second matrix of this size is made
            common[k : k + 256] += x[k : k + 256] @ y.T
    link = np.zeros(common.shape, bool)
    for k in range(0, len(left), 256):
        link[k : k + 256] = (NUM + DEN) * common[k : k + 256].astype(np.int64) >= NUM * (n[left[k : k + 256], None] + n[None, right])
    del common
    first = np.arange(len(sets))
    seen = np.zeros(len(sets), bool)
    at = np.arange(len(sets))
    at[right] = np.arange(len(right))
    at[left] = np.arange(len(left))
    for k in range(len(sets)):
        if not seen[k]:
            seen[k] = True
            front = np.array([k])
            while len(front):
                first[front] = k
                if apart:
                    one, two = front[side[front] == 1], front[side[front] == 2]
                    front = np.concatenate((right[link[at[one]].any(0)], left[link[:, at[two]].any(1)]))
                else:
                    front = np.flatnonzero(link[front].any(0))
                front = front[~seen[front]]
                seen[front] = True
    return first


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]] | None]:
    """Rows of sorted batches by (list, i, j): the key and the rows' other columns. None at the end of each batch."""
    key, held = None, []
    for b in batches:
        for one, i, j, *rest in zip(*(column(b, c).to_pylist() for c in ("list", "i", "j", *names)), strict=True):
            if (one, i, j) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (one, i, j), []
            if not held or held[-1] != rest:  # repeated rows stand side by side
                held.append(rest)
        yield None
    if len(held) > 1:
        yield key, held
    yield None


def _joined(first: np.ndarray, a: int, b: np.ndarray) -> None:
    """Union of a with all of b; each component is named by its least member."""
    names = np.unique(np.append(first[b], first[a]))
    first[np.isin(first, names)] = names[0]


def alike(n: np.ndarray, sketch: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the first set of its piece, under pairs whose sketches allow a link."""
    first = np.arange(len(n))
    cells = np.fromiter(map(len, sketch), np.int64, len(sketch))
    for size in np.unique(cells):
        mine = np.flatnonzero(cells == size)
        more = np.flatnonzero(cells == 2 * size)
        at = np.concatenate((mine, more))
        if len(at) < 2:
            continue
        # a sketch of twice the cells has its halves added up: the lower bits of the hashes stay
        table = np.array([*(sketch[k].astype(np.int32) for k in mine), *(sketch[k].astype(np.int32).reshape(2, size).sum(0) for k in more)])
        for k in range(len(mine)):
            with_ = at[k + 1 :]
            fits = (NUM * np.maximum(n[with_], n[mine[k]]) <= DEN * np.minimum(n[with_], n[mine[k]])) & (first[with_] != first[mine[k]])
            fits &= ~((side[with_] == side[mine[k]]) & (side[with_] > 0))
            if fits.any():
                apart = np.abs(table[k + 1 :][fits] - table[k]).sum(1)
                with_ = with_[fits]
                # a link: intersection >= NUM/(NUM+DEN) of both sizes, so symmetric difference <= (DEN-NUM)/(DEN+NUM) of them
                with_ = with_[(NUM + DEN) * apart <= (DEN - NUM) * (n[with_] + n[mine[k]])]
                if len(with_):
                    _joined(first, mine[k], with_)
    return first


def _pieces(members: DataFrame) -> DataFrame:
    """What is left of the lists of ``members`` (list, i, j, side, doc_id, n, sketch): (list, i, j, piece, doc_id, n)."""
    schema = pa.schema([("list", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("piece", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, ("side", "doc_id", "n", "sketch")):
            if group is None:
                if out:
                    yield rows(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))
                out = []
                continue
            key, held = group
            n = np.array([x[2] for x in held])
            first = alike(n, [np.frombuffer(x[3], np.uint8) for x in held], np.array([x[0] for x in held]))
            size = np.bincount(first, minlength=len(held))
            out += [(*key, held[f][1], held[k][1], held[k][2]) for k, f in enumerate(first.tolist()) if size[f] > 1]

    return members.mapInArrow(run, "list long, i int, j int, piece long, doc_id long, n long")


def _list_links(members: DataFrame) -> DataFrame:
    """(a, b) edges within each list of ``members`` (list, i, j, side, doc_id, hashes): a star for each component found there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(held: list) -> list[tuple[int, int]]:
        if len(held) == 2:
            (_, a, x), (_, b, y) = held
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.union1d(x, y))
            return [(a, b)] if (NUM + DEN) * common >= NUM * (len(x) + len(y)) else []
        first = linked_groups([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[0] for x in held]))
        return [(held[f][1], held[k][1]) for k, f in enumerate(first) if f != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, ("side", "doc_id", "hashes")):
            if group is None:
                yield rows(schema, a=[x for x, _ in out], b=[y for _, y in out])
                out = []
            else:
                out += links(group[1])

    return members.mapInArrow(run, "a long, b long")


def bands(entries: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [low, high) of sizes that hold about BAND entries each, from (least size, entries) of stretches of sizes in their order."""
    at, held = [], 0
    for low, n in entries or [(1, 0)]:
        if not at or held + n > BAND:
            at, held = [*at, low], 0
        held += n
    return list(zip(at, [*at[1:], 1 << 60], strict=True))


def _meetings(entries: DataFrame, small: int, below: int) -> DataFrame:
    """(long, a, b, n) from ``entries`` (list, doc_id, n): for a list of up to FEW each pair a < b of sets that can be linked, are not both
    small and not both of ``below`` or more, which has to meet n times; of a longer list each entry, as list a and document b with its n."""
    schema = pa.schema([("long", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def told(t: np.ndarray, d: np.ndarray, n: np.ndarray, whole: bool = False) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(start, len(t)))
        many = np.ones(len(t), bool) if whole else np.repeat(size > FEW, size)
        out = [(np.ones(many.sum(), bool), t[many], d[many], n[many])]
        for step in range(1, min(FEW, int(size.max()))):
            x = np.flatnonzero((t[step:] == t[:-step]) & ~many[step:])
            y = x + step
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            fits = (NUM * high <= DEN * low) & (high > small) & (low < below) & (d[x] != d[y])
            x, y, low = x[fits], y[fits], low[fits]
            out.append((np.zeros(len(x), bool), np.minimum(d[x], d[y]), np.maximum(d[x], d[y]), least_common(low)))
        return rows(schema, **dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = tuple(np.empty(0, np.int64) for _ in range(3)), None  # rows of a list that may go on; a longer list that does
        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(np.concatenate((x, column(b, c).to_numpy())) for x, c in zip(held, ("list", "doc_id", "n"), strict=True))
            held = tuple(x[:0] for x in now)
            if going is not None and (more := int(np.argmax(np.append(now[0] != going, True)))):
                yield told(*(x[:more] for x in now), whole=True)
                now = tuple(x[more:] for x in now)
            if not len(now[0]):
                continue
            last = int(np.flatnonzero(now[0] == now[0][-1])[0])
            going = int(now[0][-1]) if len(now[0]) - last > FEW else None
            if going is None:
                held, now = tuple(x[last:] for x in now), tuple(x[:last] for x in now)
            if len(now[0]):
                yield told(*now)
        if len(held[0]):
            yield told(*held)

    dealt = entries.repartition(partitions(entries.sparkSession), "list").sortWithinPartitions("list")
    return dealt.mapInArrow(run, "long boolean, a long, b long, n long")


def _met(chosen: DataFrame, small: int) -> DataFrame:
    """What is left of _meetings() of all bands: pairs that meet as often as they have to, and entries of longer lists (band, long, a, b, n)."""
    step = F.floor(F.log("n") / F.log(F.lit(DEN / NUM)))
    sizes = chosen.groupBy(step.alias("step")).agg(F.min("n").alias("low"), F.sum(F.size("tokens")).alias("entries")).orderBy("step").collect()
    out = None
    for k, (low, high) in enumerate(bands([(r.low, r.entries) for r in sizes])):
        mine = chosen.where((F.col("n") >= low) & (NUM * F.col("n") <= DEN * (high - 1)))
        met = _meetings(mine.select(F.explode("tokens").alias("list"), "doc_id", "n"), small, high).groupBy("long", "a", "b")
        met = written(met.agg(F.count("*").alias("often"), F.min("n").alias("n")).where("long OR often >= n").select(F.lit(k).alias("band"), "long", "a", "b", "n"), "meetings")
        out = met if out is None else out.union(met)
    return out


def _once(members: DataFrame) -> DataFrame:
    """Lists (list, doc_id, n, more) of two or more; of lists with the same members one."""
    one = Window.partitionBy("list")
    found = members.withColumns({"members": F.count("*").over(one), "names": F.bit_xor(F.xxhash64("doc_id")).over(one), "sums": F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).over(one), "least": F.min("doc_id").over(one), "total": F.sum("n").over(one)})
    # an id of several texts stands here once for each, and twice cancels out of an xor, but not of a sum
    same = Window.partitionBy("members", "names", "sums", "least")
    return found.where("members > 1").withColumn("first", F.min("list").over(same)).where("list = first").select("list", "doc_id", "n", "total", "members", "least").distinct()


def _in_blocks(members: DataFrame, bytes_each: int) -> DataFrame:
    """(list, i, j, side, doc_id, n): each list whole (i = j = 0), or, where its data are too large for a task, by pairs of blocks. A list has at most BLOCK_SETS sets."""
    blocks = F.ceil(bytes_each * F.col("total") / BLOCK_BYTES).cast("int")
    placed = members.withColumns({"blocks": blocks, "at": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")})
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j")))
    side = F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("at") == F.col("p.i"), 1).otherwise(2)
    return placed.select("list", "doc_id", "n", "at", F.explode(pair).alias("p")).select("list", "p.i", "p.j", side.alias("side"), "doc_id", "n")


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition(partitions(members.sparkSession), "list", "i", "j").sortWithinPartitions("list", "i", "j", "doc_id")


def _led(sets: DataFrame) -> DataFrame:
    """What leaders tell of large clusters, from ``sets`` (list, doc_id, sets, hashes).

    (kind, list, doc_id, a, lows, highs): 0, a set's first linked leader ``a``, if any; 1, leaders doc_id and ``a`` that a set links
    with one another; 2, the least and greatest distances to each leader, by their order, of the sets whose first is ``a``.
    """
    schema = pa.schema([("kind", pa.int32()), ("list", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])
    parts = F.ceil(F.col("sets") / LED_SETS).cast("int")
    members = sets.select("list", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), F.lit(1).alias("led"), "doc_id", "hashes")
    first = sets.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("sets")) < LEADERS)
    first = first.select("list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("led"), "doc_id", "hashes")
    dealt = members.unionByName(first).repartition(partitions(sets.sparkSession), "list", "part").sortWithinPartitions("list", "part", "led", "doc_id", "hashes")

    def told(key: int, leaders: list, members: list) -> list[tuple]:
        size = np.array([len(x) for _, x in leaders])
        value, token = np.unique(np.concatenate([x for _, x in leaders]), return_inverse=True) if leaders else (np.empty(0, np.uint64), np.empty(0, np.int64))
        held = np.zeros((len(value), len(leaders)), np.int32)
        held[token, np.repeat(np.arange(len(leaders)), size)] = 1
        up, out, ends = np.arange(len(leaders)), [], {}
        for doc, x in members:
            at = np.minimum(np.searchsorted(value, x), max(0, len(value) - 1))
            common = held[at[value[at] == x]].sum(0) if len(value) else np.zeros(0, np.int64)
            link = np.flatnonzero((NUM + DEN) * common >= NUM * (len(x) + size))
            for other in link[1:].tolist():
                if up[other] != up[link[0]]:
                    out.append((1, key, leaders[link[0]][0], leaders[other][0], None, None))
                    _joined(up, link[0], np.array([other]))
            a = leaders[link[0]][0] if len(link) else None
            out.append((0, key, doc, a, None, None))
            apart = 1 - common / np.maximum(1, len(x) + size - common)
            low, high = ends.get(a, (apart, apart))
            ends[a] = np.minimum(low, apart), np.maximum(high, apart)
        return out + [(2, key, None, a, low.tolist(), high.tolist()) for a, (low, high) in ends.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, members = None, [], []
        for b in batches:
            out: list[tuple] = []
            for one, part, led, doc, x in zip(*(column(b, c).to_pylist() for c in ("list", "part", "led", "doc_id", "hashes")), strict=True):
                if (one, part) != key:
                    if members:
                        out += told(key[0], leaders, members)
                    key, leaders, members = (one, part), [], []
                (members if led else leaders).append((doc, np.frombuffer(x, np.uint64)))
            if out:
                yield rows(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))
        if members:
            yield rows(schema, **dict(zip(schema.names, map(list, zip(*told(key[0], leaders, members), strict=True)), strict=True)))

    return dealt.mapInArrow(run, "kind int, list long, doc_id long, a long, lows array<double>, highs array<double>")


def _large_links(sets: DataFrame, total: int) -> DataFrame:
    """(a, b) edges within large clusters, from ``sets`` (list, doc_id, sets, hashes): stars of leaders, and what the bound leaves, by blocks."""
    told = written(_led(sets), "led")
    merges = told.where("kind = 1").select(F.col("doc_id").alias("a"), F.col("a").alias("b"))
    named = components(merges).select(F.col("v").alias("a"), F.col("component").alias("g"))
    with_group = lambda df: df.join(named, "a", "left").withColumn("g", F.coalesce("g", "a", F.lit(REST)))
    linked = told.where("kind = 0 AND a IS NOT NULL").select("list", "a", "doc_id")
    stars = linked.select("a", F.col("doc_id").alias("b"))
    grouped = spread_join(linked, with_group(linked.groupBy("a").agg(F.count("*").alias("n"))), "a", "n", total).select("list", "g", "doc_id")
    placed = written(grouped.union(told.where("kind = 0 AND a IS NULL").select("list", F.lit(REST).alias("g"), "doc_id")), "groups")

    ends = with_group(told.where("kind = 2")).select("list", "g", F.posexplode(F.arrays_zip("lows", "highs")).alias("k", "x"))
    ends = ends.groupBy("list", "g", "k").agg(F.min("x.lows").alias("low"), F.max("x.highs").alias("high"))
    ends = ends.groupBy("list", "g").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("ends"))
    groups = written(placed.groupBy("list", "g").agg(F.count("*").alias("n")).join(ends, ["list", "g"], "left"), "ends")
    # at most LEADERS + 1 groups for a cluster; the slack is for rounding
    other = groups.select("list", F.col("g").alias("h"), F.col("n").alias("m"), F.col("ends").alias("others"))
    far = F.exists(F.arrays_zip("ends", "others"), lambda z: (z["ends"]["low"] - z["others"]["high"] > 0.2 + 1e-9) | (z["others"]["low"] - z["ends"]["high"] > 0.2 + 1e-9))
    left = groups.join(other, "list").where(((F.col("g") < F.col("h")) & ~F.coalesce(far, F.lit(False))) | ((F.col("g") == F.col("h")) & (F.col("g") == REST)))
    blocks = lambda c: F.ceil(F.col(c) / LED_SETS).cast("int")
    left = left.select("list", "g", "h", F.xxhash64("list", "g", "h").alias("pair"), blocks("n").alias("mine"), blocks("m").alias("theirs"))
    one = F.struct("pair", (F.col("g") == F.col("h")).alias("own"), F.lit(1).alias("side"), F.col("mine"), F.col("theirs"))
    two = F.struct("pair", F.lit(False).alias("own"), F.lit(2).alias("side"), F.col("theirs").alias("mine"), F.col("mine").alias("theirs"))
    asks = left.select("list", F.col("g").alias("of"), one.alias("p")).union(left.where("g <> h").select("list", F.col("h").alias("of"), two.alias("p")))
    asks = asks.groupBy("list", F.col("of").alias("g")).agg(F.collect_list("p").alias("ps")).join(groups.select("list", "g", "n"), ["list", "g"])
    keyed = lambda df: df.withColumn("key", F.xxhash64("list", "g"))
    met = spread_join(keyed(placed).select("key", "doc_id"), keyed(asks).select("key", "n", "ps"), "key", "n", total).select("doc_id", F.explode("ps").alias("p")).select("doc_id", "p.*")
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("mine")).cast("int")
    met = met.withColumn("at", at).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    i = F.when(F.col("own"), F.least("at", "k")).when(F.col("side") == 1, F.col("at")).otherwise(F.col("k"))
    j = F.when(F.col("own"), F.greatest("at", "k")).when(F.col("side") == 1, F.col("k")).otherwise(F.col("at"))
    side = F.when(~F.col("own"), F.col("side")).when(i == j, 0).when(F.col("at") == i, 1).otherwise(2)
    met = met.select(F.col("pair").alias("list"), i.alias("i"), j.alias("j"), side.alias("side"), "doc_id")
    return stars.union(merges).union(_list_links(_dealt(met.join(sets.select("doc_id", "hashes"), "doc_id"))))


def _by_class(rows_: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """Adds ``component`` by class. Rows of a class of many copies don't meet in a task: its component is broadcast."""
    large = is_hot(F.col("members"), total)
    hot = named.where(large).select("class", F.col("component").alias("told"))
    rows_ = rows_.join(F.broadcast(hot), "class", "left")
    rest = named.where(~large).select(F.col("class").alias("asked"), "component")
    # what is told already, and what has no words, is dealt by document
    asked = F.when(F.col("told").isNull() & (F.col("n") > 0), F.col("class")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")).cast("binary"))
    out = rows_.withColumn("asked", asked).join(rest, "asked", "left")
    return out.select("doc_id", "n", "class", F.coalesce("told", "component").alias("component"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: the least doc_id that its links reach.

    A null or wordless text has no shingles and is linked with nothing. Rows that share a doc_id are one document in several
    texts; a null doc_id is an id of its own, less than all others. An empty table gives an empty result. Columns but doc_id and
    text are not read. One text's set, with some 100 bytes for each of its words, has to fit into a task's memory.
    """
    spark = docs.sparkSession
    docs = docs.select(id_key().alias("doc_id"), "text")
    levels, small = shingle_counts(docs)
    whole = written(_described(docs, levels, small), "sets")
    full = whole.where("n > 0")
    classes = written(full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("members")), "classes")
    # rows that repeat an id and a set are one; equal sets have equal columns
    chosen = full.select("doc_id", "class", "tokens", "meets").join(classes.drop("members"), ["class", "doc_id"]).dropDuplicates(["class", "doc_id"])
    chosen = written(chosen.select("doc_id", "n", "tokens", "meets"), "chosen")
    told = written(whole.select("doc_id", "n", "class", "sketch"), "sets")
    discard(whole)
    full, total = told.where("n > 0"), told.count()

    met = _met(chosen.select("doc_id", "n", "tokens"), small)
    entries = met.where("long").select("band", F.xxhash64("a", "band").alias("list"), F.col("b").alias("doc_id"), "n")
    stay = entries.groupBy("band", "doc_id").agg(F.count("*").alias("entries"), F.min("n").alias("n")).where(F.col("entries") > spared(F.col("n"))).select("band", "doc_id")
    entries = entries.join(stay, ["band", "doc_id"]).drop("band")
    # a list of small sets alone has nothing to find: it takes a large one
    large = F.max("n").over(Window.partitionBy("list")) > small
    found = written(_once(entries.withColumn("large", large).where("large").drop("large")), "lists")
    pairs = met.where("NOT long").select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("doc_id"))
    pairs = pairs.select("list", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "doc_id")
    counts = full.select("doc_id", "n", "sketch", "class").join(classes.select("class", "doc_id"), ["class", "doc_id"]).drop("class")
    left = _pieces(_dealt(_in_blocks(found.where(F.col("members") <= BLOCK_SETS), 1).drop("n").unionByName(pairs).join(counts, "doc_id"))).select("piece", "doc_id", "n")
    # a list of more is a piece as it stands: its sets are compared by leaders
    left = written(left.union(found.where(F.col("members") > BLOCK_SETS).select("least", "doc_id", "n")), "pieces")
    discard(found)
    discard(met)
    clusters = components(left.select(F.col("piece").alias("a"), F.col("doc_id").alias("b")))
    sizes = left.groupBy("doc_id").agg(F.min("n").alias("n"))
    clusters = clusters.select(F.col("component").alias("list"), F.col("v").alias("doc_id")).join(sizes, "doc_id")
    totals = clusters.groupBy("list").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    clusters = written(spread_join(clusters, totals, "list", "sets", total), "clusters")
    discard(left)

    small_ones, large_ones = clusters.where(F.col("sets") <= BLOCK_SETS), clusters.where(F.col("sets") > BLOCK_SETS)
    sets_of = lambda some: _set_rows(docs.join(some.select("doc_id"), "doc_id", "left_semi"))
    by_list = _list_links(_dealt(_in_blocks(small_ones, 8).join(sets_of(small_ones), "doc_id")))
    if large_ones.limit(1).count():
        by_list = by_list.union(_large_links(written(large_ones.join(sets_of(large_ones), "doc_id").select("list", "doc_id", "sets", "hashes"), "large"), total))

    # a place for sets of two sizes holds a link once both are there, and then all of them hang together
    meets = chosen.select("doc_id", "n", F.explode("meets").alias("meet"))
    least = meets.groupBy("meet").agg(F.min("doc_id").alias("a"), F.count("*").alias("sets"), F.min("n").alias("low"), F.max("n").alias("high")).where("sets > 1 AND (meet & 1 = 1 OR low < high)").drop("low", "high")
    meets = meets.drop("n")
    by_subset = spread_join(meets, least, "meet", "sets", total).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    edges = written(by_list.union(by_subset), "links")
    discard(clusters)
    discard(chosen)

    reached = components(edges)
    named = classes.join(reached.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("class", "members", F.coalesce("component", "doc_id").alias("component"))
    out = _by_class(told.select("doc_id", "n", "class"), named, total)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(id_value().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != F.lit(-(2**63)), component).alias("component_id"))
