"""Prefix trie of conversations, as double arrays over dense turn ids.

A turn is the 128-bit digest of its role and text, a conversation the sequence of its turns' digests. Sequences are sorted, so the trie's
nodes are stretches of them; equal ones become one row with their number. A shard is a range of the sorted sequences. In a shard, turns
get dense ids and the trie is packed into BASE and CHECK: the child of the node at slot s by turn t is at BASE[s] + t, and CHECK there
is s. All sequences walk through these arrays side by side, which gives the nodes with their members.

Neighbouring shards share the path that their nearest sequences share. Each node belongs to the first shard that has it; a shard that
has it too adds only its own members. So all values of a node are sums over shards, and these few nodes are summed up globally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, column, discard, id_key, id_value, partitions, rows, written

#: Bytes of a turn's digest, of a shard's sequences, and ids that are joined at once.
DIGEST, SHARD_BYTES, IDS = 16, 4 << 20, 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_RUNS = pa.schema([("seq", pa.binary()), ("words", pa.list_(pa.int32())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_SEQUENCES = pa.schema([("shard", pa.int32()), ("seq", pa.binary()), ("words", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
_NODES = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_SQL = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv, turns: array<struct<digest, words>>) of (conv_id, turn, role, text), in the order of turn (null first), then digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = turns.select(id_key("conv_id").alias("conv"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t"))
    got = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("conv", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as their group's first one: conversation c takes the first h turns of c - c % group in place of its own first h, where h is crc32(c) % most."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    heads = own.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    got = own.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h}).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    new = F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0))))
    return got.select("conv", F.when(F.col("conv") == NULL_ID, F.col("turns")).otherwise(new).alias("turns"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (seq, conv): for each stretch of equal sequences its number and its ids, joined by commas, IDS at a time."""
    at, words, ids = None, None, []

    def out():
        told = ",".join("null" if k == NULL_ID else str(k) for k in ids).encode()
        return rows(_RUNS, seq=[at], words=[words], first=[ids[0]], n=[len(ids)], ids=[told])

    for b in batches:
        for seq, w, conv in zip(*(column(b, c).to_pylist() for c in ("seq", "words", "conv")), strict=True):
            if ids and (seq != at or len(ids) == IDS):
                yield out()
                ids = []
            at, words = seq, w
            ids.append(conv)
    if ids:
        yield out()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by (seq, first): one row for each sequence, with its members' number, the least, and the digest of all ids."""
    shard, at, held = TaskContext.get().partitionId(), None, None

    def out():
        return rows(_SEQUENCES, shard=[shard], seq=[at], words=[held[0]], conv_id=[held[1]], n=[held[2]], ends=[held[3].hexdigest()])

    for b in batches:
        for seq, w, first, n, ids in zip(*(column(b, c).to_pylist() for c in _RUNS.names), strict=True):
            if seq != at or held is None:
                if held is not None:
                    yield out()
                at, held = seq, [w, first, 0, hashlib.sha256()]
            else:
                held[3].update(b",")
            held[2] += n
            held[3].update(ids)
    if held is not None:
        yield out()


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differs = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differs[0] if len(differs) else n) // DIGEST


def pack(parent: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BASE, CHECK, slot of each node) of a trie whose node k > 0 is the child of ``parent[k]`` by ``turn[k]``; node 0 is the root, at slot 0.

    Nodes of many children are placed first, each where its children find free slots; single children fill what is left.
    """
    n = len(parent)
    order = np.lexsort((turn[1:], parent[1:])) + 1
    first = np.flatnonzero(np.append(True, parent[order][1:] != parent[order][:-1])) if n > 1 else np.empty(0, np.int64)
    size = np.diff(np.append(first, n - 1))
    used = np.zeros(2 * n + int(turn.max(initial=0)) + 2, bool)
    used[0] = True
    slot, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = 1
    for k in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
        kids = order[first[k] : first[k] + size[k]]
        off = turn[kids] - turn[kids[0]]
        at = low
        while True:
            while at + 1024 + off[-1] >= len(used):
                used = np.append(used, np.zeros(len(used), bool))
            free = ~used[at : at + 1024]
            for d in off[1:].tolist():
                free &= ~used[at + d : at + d + 1024]
            if free.any():
                break
            at += 1024
        at += int(free.argmax())
        used[at + off] = True
        slot[kids] = at + off
        base[parent[kids[0]]] = at - turn[kids[0]]
        if used[low : at + 1].mean() > 0.95:
            low = at + 1
    single = order[first[size == 1]]
    free = np.flatnonzero(~used)[: len(single)]
    if len(free) < len(single):
        free = np.append(free, len(used) + np.arange(len(single) - len(free)))
    slot[single] = free
    base[parent[single]] = free - turn[single]
    base_of, check = np.zeros(int(slot.max()) + 1, np.int64), np.full(int(slot.max()) + 1, -1, np.int64)
    base_of[slot] = base
    check[slot[1:]] = slot[parent[1:]]
    return base_of, check, slot


def _keys(seq: bytes, most: int) -> list[bytes]:
    """Names of a sequence's prefixes of 0 to ``most`` turns."""
    h, out = hashlib.blake2b(digest_size=16), []
    for k in range(most + 1):
        out.append(h.digest() + k.to_bytes(8, "big"))
        h.update(seq[k * DIGEST : (k + 1) * DIGEST])
    return out


def shard_nodes(shard: int, seqs: list[bytes], words: list[list[int]], conv: np.ndarray, n: np.ndarray, ends: list[str], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard's sorted, distinct sequences; ``before`` and ``after`` are the turns that the first shares with the sequence before it and the last with the one after it, -1 where there is none."""
    size = np.fromiter((len(s) // DIGEST for s in seqs), np.int64, len(seqs))
    start = np.cumsum(size) - size
    two = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2)
    by = np.lexsort((two[:, 1], two[:, 0]))
    turn_of = np.empty(len(two), np.int64)
    turn_of[by] = np.cumsum(np.append(False, (two[by][1:] != two[by][:-1]).any(1)))[: len(by)] if len(by) else []
    count = np.fromiter((x for w in words for x in w), np.int64, len(two))
    # nodes in the order of the sorted sequences: each adds what it doesn't share with the one before it
    parents, turns, path, made = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0], 1
    for k, s in enumerate(seqs):
        shared = common_turns(seqs[k - 1], s) if k else 0
        new = int(size[k]) - shared
        if new:
            parents.append(np.append(path[shared], np.arange(made, made + new - 1)))
            turns.append(turn_of[start[k] + shared : start[k] + size[k]])
            path[shared + 1 :] = range(made, made + new)
            made += new
    base, check, _ = pack(np.concatenate(parents), np.concatenate(turns))
    slots = len(base)
    members, least, depth_of, own_words = (np.zeros(slots, np.int64) for _ in range(4))
    told = np.full(slots, None, object)
    from_before, to_after = np.zeros(slots, bool), np.zeros(slots, bool)
    keys = np.full(slots, None, object)
    first_keys, last_keys = _keys(seqs[0], before), _keys(seqs[-1], after)
    alive, at, levels, depth = np.arange(len(seqs)), np.zeros(len(seqs), np.int64), [], 0
    while len(alive):
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        here = at[begin]
        levels.append(here)
        members[here] = np.add.reduceat(n[alive], begin)
        least[here] = np.minimum.reduceat(conv[alive], begin)
        depth_of[here] = depth
        if depth:
            own_words[here] = count[start[alive[begin]] + depth - 1]
        if depth <= before and alive[0] == 0:
            from_before[here[0]], keys[here[0]] = True, first_keys[depth]
        if depth <= after and alive[-1] == len(seqs) - 1:
            to_after[here[-1]], keys[here[-1]] = True, last_keys[depth]
        done = size[alive] == depth
        told[at[done]] = [ends[k] for k in alive[done]]
        alive, at = alive[~done], at[~done]
        to = base[at] + turn_of[start[alive] + depth]
        if not (check[to] == at).all():
            raise AssertionError("a sequence leaves the trie")
        at, depth = to, depth + 1
    live = np.concatenate(levels)
    mine = ~from_before
    below = live[1:]  # all but the root
    kids = np.bincount(check[below], minlength=slots)
    children = np.bincount(check[below], mine[below], slots).astype(np.int64)
    leaves = ((kids == 0) & ~to_after).astype(np.int64)
    saved = members * own_words - own_words * mine
    for here in reversed(levels[1:]):
        np.add.at(leaves, check[here], leaves[here])
        np.add.at(saved, check[here], saved[here])
    above = check[live]
    up = np.where(above < 0, 0, above)
    return rows(
        _NODES, shard=np.full(len(live), shard, np.int32), key=keys[live].tolist(), parent_key=[None if a < 0 else k for a, k in zip(above, keys[up], strict=True)], depth=depth_of[live],
        conv_id=least[live], parent_conv_id=pa.array(least[up], pa.int64(), mask=above < 0), n_convs=members[live], n_children=children[live], n_leaves=leaves[live], saved_tokens=saved[live], ends=told[live].tolist(),
    )


def _built(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by("seq").combine_chunks()
    get = lambda c: shard.column(c).to_pylist()
    got = shard_nodes(get("shard")[0], get("seq"), get("words"), np.array(get("conv_id")), np.array(get("n")), get("ends"), get("before")[0], get("after")[0])
    return pa.Table.from_batches([got])


def _edges(sequences: DataFrame) -> DataFrame:
    """(shard, before, after): how many turns a shard's first and last sequences share with their neighbours'. The driver has the shards' numbers only."""
    spark = sequences.sparkSession
    ends = written(sequences.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last")), "ends")
    have = sorted(r.shard for r in ends.select("shard").collect())
    following = spark.createDataFrame(list(zip(have, have[1:], strict=False)), "shard int, next int")
    pairs = ends.select("shard", "last").join(following, "shard").join(ends.select(F.col("shard").alias("next"), F.col("first").alias("then")), "next")

    def run(batches):
        schema = pa.schema([("shard", pa.int32()), ("next", pa.int32()), ("turns", pa.int32())])
        for b in batches:
            turns = [common_turns(x, y) for x, y in zip(column(b, "last").to_pylist(), column(b, "then").to_pylist(), strict=True)]
            yield rows(schema, shard=column(b, "shard"), next=column(b, "next"), turns=turns)

    met = pairs.select("shard", "next", "last", "then").mapInArrow(run, "shard int, next int, turns int")
    none = F.lit(-1)
    both = met.select("shard", none.alias("before"), F.col("turns").alias("after")).union(met.select("next", F.col("turns"), none)).union(ends.select("shard", none, none))
    return both.groupBy("shard").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def nodes(convs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv, turns): conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root alone; no conversations make no trie. A null id is the least, and stands as
    ``null`` among the ids that end somewhere. A conversation's digests are one row, 16 bytes for each turn, so they have to fit into
    memory; texts are not moved. Conversations alike in all turns may be any part of the table: their ids are spread over ranges and
    joined there, and the digest of all reads these strings one by one.
    """
    spark = convs.sparkSession
    flat = convs.select("conv", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.words").alias("words"))
    flat = written(flat, "flat")
    n = 4 * partitions(spark)
    runs = written(flat.repartitionByRange(n, "seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_runs, _ddl(_RUNS)), "runs")
    total = runs.agg(F.sum(F.length("seq") + DIGEST)).first()[0]
    if total is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shards = max(n, -(-total // shard_bytes))
    sequences = written(runs.repartitionByRange(shards, "seq").sortWithinPartitions("seq", "first").mapInArrow(_united, _ddl(_SEQUENCES)), "sequences")
    found = written(sequences.join(_edges(sequences), "shard").groupBy("shard").applyInArrow(_built, _ddl(_NODES)), "nodes")
    discard(flat)
    discard(runs)
    # nodes of several shards are summed up, and told to the shards that have their children
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where("key IS NOT NULL")
    united = written(parts.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "united")
    least = united.select("key", F.col("conv_id").alias("up"))
    heard = parts.select("key", "shard").join(least, "key").select(F.col("key").alias("parent_key"), "shard", "up")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    alone = found.where("key IS NULL AND parent_key IS NULL").select(columns)
    under = found.where("key IS NULL AND parent_key IS NOT NULL").join(heard, ["parent_key", "shard"]).withColumn("parent_conv_id", F.col("up")).select(columns)
    upper = united.join(least.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", F.col("up")).select(columns)
    whole = alone.union(under).union(upper)
    return whole.select(id_value("conv_id").alias("conv_id"), "depth", id_value("parent_conv_id").alias("parent_conv_id"), *columns[3:-1], F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))
