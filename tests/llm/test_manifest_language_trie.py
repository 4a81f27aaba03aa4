"""op11 to op13 against plain versions: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names, hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.llm import language, manifest, queries, trie

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = ["tree", "n", "lo", "hi", "kids", "path", "key", "rank", "leaf", "later", "digest", "conv", "seq", "base", "h", "shard", "__at", "__salt", "a.b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in ODD)


def plain_manifest(rows, later):
    """rows: (doc_id, text, lang, source, n_chars); later: the text as it is found."""
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: H("".join(told(x) for x in (r[0], r[3], r[2], r[4], t)))

    def grow(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            a = k // 8 * 8
            out.append(("".join(level[a:k]), "".join(level[k + 1 : a + 8])))
            k //= 8
        return out

    first = lambda x: (x is not None, x or 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (first(r[0]), leaf(r, r[1]))) for x in langs}
    levels = {x: grow([leaf(r, r[1]) for r in trees[x]]) for x in langs}
    top = grow([levels[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for k, r in enumerate(trees[x]):
            steps = path(levels[x], k) + path(top, j)
            fold = leaf(r, later(r))
            for a, z in steps:
                fold = H(a + fold + z)
            out.append((r[0], leaf(r, r[1]), levels[x][-1][0], top[-1][0], H("".join(a + z for a, z in steps)), fold, fold == top[-1][0]))
    return out


def tampered(r):
    down = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return down(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]


def shown(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 73])
def test_manifest_equals_a_plain_one(spark, tmp_path, n):
    r = random.Random(n)
    rows = [(k * 3 - 5, r.choice([None, "", "Ab É\n", "x" * 40_000, "AB"]), r.choice(["en", "de", "é", None, ""]) if n > 2 else "en", r.choice([None, "s"]), r.choice([None, k])) for k in range(n)]
    if n > 8:
        rows += [rows[0], (None, "Null ID", None, None, None), (None, "Null ID", None, None, None), (-5, "another text of an id", "en", None, 1)]
    spark.createDataFrame([(*x, *range(len(ODD))) for x in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_nested_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert shown(map(tuple, got.collect())) == shown(plain_manifest(rows, tampered))


def test_manifest_of_nothing_and_of_one_row_many_times(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "same", "en", None, 4)] * 700 + [(8, "Other", "en", None, 5)]
    got = manifest.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), {"text": F.lower("text")})
    digests = got.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")), "folded_root", "verified")
    assert shown(map(tuple, digests.collect())) == shown(plain_manifest(rows, lambda r: r[1].lower()))


def plain_trie(turns, group=20, most=4):
    told = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = role or "", text or ""
        m = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        told[conv].append(((turn is not None, turn or 0), m, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in told.items()}
    new = {}
    for c in own:
        if c is None:
            new[c] = own[c]
            continue
        h = zlib.crc32(str(c).encode()) % most
        new[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    low = lambda cs: min(cs, key=lambda c: (c is not None, c or 0))
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        cost = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += cost
    out = []
    for node, cs in members.items():
        here = sorted((c for c in cs if len(new[c]) == len(node)), key=lambda c: (c is not None, c or 0))
        out.append((low(cs), len(node), low(members[node[:-1]]) if node else None, len(cs), kids[node], leaves[node], saved[node], H(",".join("null" if c is None else str(c) for c in here))))
    return out


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` long" for c in ODD)


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_a_plain_one(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(trie, "IDS", 3)
    r = random.Random(4)
    say = lambda: r.choice(["a b", "a", "", None, "a  b c", "x\x0by é"])
    # groups of 20 whose first conversation is there or not, long and short ones, hot first turns and many equal conversations
    turns = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), say()) for c in r.sample(range(400), 150) for t in range(r.choice([1, 2, 3, 6]))]
    turns += [(1000 + c, t, "user", f"the same {t}") for c in range(90) for t in range(3)]
    turns += [(2000, t, "user", f"turn {t}") for t in range(120)] + [(2001, t, "user", f"turn {t}") for t in range(60)] + [(2040, t, "user", f"turn {t}") for t in range(90)]
    turns += [(None, 1, "user", "null"), (None, None, None, None), (-7, 0, "user", "before zero"), (-27, 0, "user", "and more"), turns[0], turns[0]]
    df = spark.createDataFrame([(*x, *range(len(ODD))) for x in turns], TURNS).repartition(4)
    got = trie.nodes(trie.rebuilt(trie.conversations(df)), *([64] if small else []))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie_rows(got) == sorted(plain_trie(turns), key=str)


def test_trie_of_nothing_and_of_turnless_ones(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.nodes(trie.rebuilt(trie.conversations(empty))).count() == 0
    turns = [(c, 0, "user", "x") for c in range(21, 40)]  # no first conversation: some lose all
    got = trie.nodes(trie.rebuilt(trie.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))
    assert trie_rows(got) == sorted(plain_trie(turns), key=str)


def test_packed_arrays_hold_the_trie():
    r = random.Random(3)
    for n in (1, 2, 50, 3000):
        parent, turn, seen = [0], [0], set()
        while len(parent) < n:
            edge = (r.randrange(max(1, len(parent) // r.choice([1, 2, 30]))), r.randrange(n))
            if edge not in seen:
                seen.add(edge)
                parent.append(edge[0])
                turn.append(edge[1])
        base, check, slot = trie.pack(np.array(parent), np.array(turn))
        assert len(set(slot.tolist())) == n and slot[0] == 0
        for k in range(1, n):
            assert base[slot[parent[k]]] + turn[k] == slot[k] and check[slot[k]] == slot[parent[k]]
        assert (check >= 0).sum() == n - 1
        for _ in range(200):  # no other edge leads anywhere
            edge = (r.randrange(n), r.randrange(n))
            to = base[slot[edge[0]]] + edge[1]
            assert edge in seen or not (0 <= to < len(check) and check[to] == slot[edge[0]])


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {x.doc_id: x for x in language.judged(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(got[x.doc_id].held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= got[x.doc_id].score <= 1 for x in rows)
    held = [x for x in rows if got[x.doc_id].held_out]
    assert sum(got[x.doc_id].lang_pred == x.lang for x in held) >= 0.98 * len(held) > 100


def test_filter_gives_all_languages_of_an_ngram():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(11)]
    sets[3] = np.concatenate((sets[3], sets[9][:500]))
    f = language.Filter([f"l{k}" for k in range(11)], sets, [1] * 11)
    hits = f.hits(np.concatenate((sets[9][:500], r.integers(0, 2**63, 40_000).astype(np.uint64))), np.repeat([0, 1], [500, 40_000]), 2)
    assert hits[0, 3] == hits[0, 9] == 500  # never a false negative
    assert np.all(hits[0, [0, 1, 2]] < 20)
    assert np.abs(hits[1] / 40_000 - f.false).max() < 0.002  # the rate that the correction takes


def test_ngrams_of_short_texts():
    names = lambda x: [(len(h), sorted(set(t.tolist()))) for h, t in language.grams(x)]
    assert names(["a", "", "bc de"]) == [(1 + 4, [0, 2]), (2, [2]), (0, [])]
    assert [len(h) for h, _ in language.grams(["one"], (1, 2, 3))] == [3, 4, 3]


def test_languages_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 64)
    rows = [(k, "the thing and that with other " * 5 + str(k), "en") for k in range(60)] + [(100 + k, "der und die nicht ein über " * 5 + str(k), "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 ?! 3", "en"), (203, "Ж", None), (204, "THE THING", None), (205, "the other thing " * 3000, None), (206, "x" * 300, "de"), (None, "und die", None), (207, "über", "en"), (204, "THE THING", None)]
    df = spark.createDataFrame([(*x, *range(len(ODD))) for x in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in ODD))
    got = {x.doc_id: x for x in language.judged(df).collect()}
    assert [got[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and got[None].held_out
    assert (got[203].lang_pred, got[203].score) == ("en", 0.0)  # nothing known: the language with most rows
    assert [got[k].lang_pred for k in (204, 205, None, 100)] == ["en", "en", "de", "de"]
    whole = language.judged(df.withColumn("source", F.lit("x"))).where("doc_id = 205").first()
    assert whole.score > 0.8
    nothing = language.judged(df.where("lang IS NULL")).collect()
    assert {x.lang_pred for x in nothing} == {"und"} and language.judged(df.limit(0)).count() == 0
