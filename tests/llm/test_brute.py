"""Whole operators against plain versions that share nothing with them but constants and the hash function."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import exp, floor, log, sqrt

import numpy as np

from textveil.llm import fingerprint, leaks, quality, scan

M = (1 << 64) - 1


# --- quality ---


def plain_features(text):
    raw = (text or "").lower().encode() if (text or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    runs = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", raw)
    words = [x for x in runs if re.match(rb"[a-z0-9\x80-\xff]", x)]
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
    kinds = len(set(words)) / max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    share = len(set(lines)) / max(1, len(lines))
    steps = (floor(10 * again), 20 + (floor(10 * kinds) if len(words) >= 20 else 10), 40 + floor(10 * share))
    return {("w", x) for x in runs} | {("s", k, x) for k, x in enumerate(steps)}


def plain_quality(docs, labels):
    """docs: (doc_id, text, source, lang); labels: id -> (quality, toxic). Posteriors of low and toxic for each row."""
    told = {}
    for d, text, *_ in sorted(docs, key=lambda r: r[0]):
        if d in labels and text not in told:  # copies count once
            told[text] = (1 - labels[d][0], labels[d][1])
    counts, whole = defaultdict(Counter), Counter(told.values())
    for text, judged in told.items():
        for f in plain_features(text):
            counts[f][judged] += 1
    counts = {f: c for f, c in counts.items() if sum(c.values()) >= 8}
    out = {}
    for head in (0, 1):
        na = sum(n for j, n in whole.items() if j[head])
        nb = sum(whole.values()) - na
        prior = log((na + 1) / (nb + 1))
        z, odds = {}, {}
        for f, c in counts.items():
            a = sum(n for j, n in c.items() if j[head])
            b = sum(c.values()) - a
            p = (a + b) / (na + nb)
            z[f] = (a / na - b / nb) / sqrt(max(p * (1 - p), 1e-12) * (1 / na + 1 / nb))
            odds[f] = max(0, log((a + 0.5) / (na + 1)) - log((b + 0.5) / (nb + 1)) - 1.64 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
        least = max(quality.MIN_Z, quality.BY_BEST * max(z.values()))
        odds = {f: x for f, x in odds.items() if z[f] >= least}
        score = [sum(odds.get(f, 0) for f in plain_features(r[1])) for r in docs]
        own = [1 / (1 + exp(-s - prior)) for s in score]
        start = sum(own) / len(own)

        def shrunk(groups, before):
            noise = sum(before[g] * (1 - before[g]) for g in groups)
            n = sum(len(x) for x in groups.values())
            spread = sum(len(x) * (sum(x) / len(x) - before[g]) ** 2 for g, x in groups.items())
            beyond = max(0.0, spread - noise) / n
            weight = min(1e6, max(1.0, noise / len(groups) / beyond if beyond else 1e6))
            return {g: (sum(x) + weight * before[g]) / (len(x) + weight) for g, x in groups.items()}

        sites, paths = defaultdict(list), defaultdict(list)
        for r, p in zip(docs, own, strict=True):
            sites[r[2]].append(p)
            paths[r[2], r[3]].append(p)
        site = shrunk(sites, {g: start for g in sites})
        path = shrunk(paths, {g: site[g[0]] for g in paths})
        for k, r in enumerate(docs):
            q = min(1 - 1e-6, max(1e-6, path[r[2], r[3]]))
            out[k, head] = 1 / (1 + exp(-score[k] - log(q / (1 - q))))
    return out


def test_quality_equals_the_plain_version(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(900)]
    bad, rude = words[:25], words[25:40]
    docs, labels = [], {}
    for k in range(700):
        low, toxic = r.random() < (0.6 if k % 7 == 0 else 0.1), r.random() < 0.15
        said = [r.choice(bad if low and r.random() < 0.3 else rude if toxic and r.random() < 0.2 else words[40:]) for _ in range(r.randint(15, 60))]
        text = " ".join(said) + r.choice([".", " !!!", "\n" + " ".join(said[:5]) + "\n" + " ".join(said[:5])])
        docs.append((k, text, None if k % 50 == 3 else f"s{k % 7}", f"l{k % 3}"))
        if k % 5:
            labels[k] = (int(not low), int(toxic))
    docs += [(700 + k, docs[k][1], "s0", "l0") for k in range(20)] + [(800, None, "s1", "l1"), (801, "", "s9", None), (802, "Zz " * 30_000, "s1", "l1")]
    want = plain_quality(docs, labels)
    got = quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3), spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int")).collect()
    at = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    assert max(abs(at[d[0]][f"__{h}"] - want[k, i]) for k, d in enumerate(docs) for i, h in enumerate(quality.HEADS)) < 1e-9
    assert 30 < sum(not r["__keep"] for r in got) < 400


# --- fingerprints ---


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def tossed(row):
    """Each symbol's label: the lowest bit in which it differs from its left neighbour, and that bit."""
    out = []
    for k, x in enumerate(row):
        left = row[k - 1] if k else x ^ 1
        d = x ^ left or 1
        low = (d & -d).bit_length() - 1
        out.append(2 * low + (x >> low & 1))
    return out


def plain_level(row):
    runs = []
    for x in row:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    s = [x if n == 1 else mixed((x * 0xA24BAED4963EE407 + n) & M) for x, n in runs]
    label = s
    for _ in range(4):
        label = tossed(label)
    begin = [k for k in range(len(s)) if k == 0 or (1 < k < len(s) - 1 and label[k] > label[k - 1] and label[k] >= label[k + 1])]
    out = []
    for a, b in zip(begin, [*begin[1:], len(s)]):
        total = sum(mixed(x) * pow(scan.BASE, k, 1 << 64) for k, x in enumerate(s[a:b]))
        out.append(mixed((total + (b - a) * scan.BASE) & M))
    return out


def plain_sketch(text):
    row, out = list(text.encode()), []
    for _ in range(fingerprint.LEVELS):
        row = plain_level(row)
        bins = [min((x << 6 & M | 1 for x in row if x >> 58 == k), default=None) for k in range(fingerprint.BINS)]
        out.append([255 if x is None else mixed(x) % 255 for x in bins])
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    full = lambda x: sum(v != 255 for v in x)
    level = max((k for k in range(fingerprint.LEVELS) if min(full(a[k]), full(b[k])) >= fingerprint.ENOUGH), default=0)
    pairs = list(zip(a[level], b[level]))
    raw = sum(x == y != 255 for x, y in pairs) / max(1, sum(x != 255 or y != 255 for x, y in pairs))
    return min(1.0, max(0.0, (raw - 1 / 255) / (1 - 1 / 255)))


def test_fingerprints_equal_the_plain_version(spark):
    r = random.Random(2)
    say = lambda n: "".join(r.choice("ab cdé\n") for _ in range(n))
    base = say(900)
    texts = [base, base[:450] + say(20) + base[450:], "", "a", "aa" * 40, None, "é" * 3, say(3000), "ab", base, say(64), say(1)]
    docs = [(None, say(50))] + [(3 * k, t) for k, t in enumerate(texts)] + [(0, base), (0, base)]  # rows that repeat stand side by side
    got = fingerprint.compare_edited(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    order = sorted(docs, key=lambda x: -1 if x[0] is None else x[0])
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        code = lambda x: bytes(v for row in x for v in row).hex()
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), code(a), code(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    have = [(*tuple(x)[:5], round(x.near_edited, 9), round(x.near_next, 9)) for x in got]
    assert sorted(have, key=str) == sorted(want, key=str)


# --- leaks ---


def test_long_items_are_found(spark):
    """Verbatim items of 40 to 2,000 words, and the same with every seventh word replaced, at any place in a document."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([40, 64, 100, 200, 300, 400, 600, 800, 1000, 1500, 2000] * 3)]
    docs = []
    for k, text in items:
        docs.append((2 * k, say(r.randint(0, 200)) + " " + text + " " + say(r.randint(0, 200))))
        docs.append((2 * k + 1, say(r.randint(0, 100)) + " " + " ".join(x if i % 7 else r.choice(words) for i, x in enumerate(text.split())) + " " + say(50)))
    docs += [(1000 + k, say(1500)) for k in range(10)] + [(2000, None), (2001, " ".join(words[:2]) * 40_000)]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(d, d // 2) for d in range(2 * len(items))}


# --- the pipeline ---


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage on what the one before it kept, against the plain version of the same step."""
    from test_operators import brute_classes, brute_leaks, brute_spans, reference_ids

    import corpus_pipeline as P

    r = random.Random(21)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(700)]
    bad, good = words[:20], words[20:]
    say = lambda n: " ".join(r.choice(good) for _ in range(n))
    items = [(k, say(r.randint(20, 40))) for k in range(12)]
    shared = say(60)
    docs, labels = [], []
    for k in range(420):
        low = k % 6 == 0
        text = " ".join(r.choice(bad if low and r.random() < 0.35 else good) for _ in range(r.randint(40, 110)))
        if k % 17 == 5:
            text = docs[-1][1]
        elif k % 17 == 6:
            text = docs[-1][1] + " " + say(2)
        elif k % 19 == 3:
            text = say(10) + " " + shared + " " + say(10)
        elif k % 23 == 7:
            text = say(15) + " " + items[k % 12][1] + " " + say(12)
        docs.append((k, text, f"l{k % 2}", f"s{k % 3}", len(text)))
        if k % 4:
            labels.append((k, int(not low), 0 if k % 50 else 1))
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    steps, df = [spark.read.parquet(f"{d}/documents.parquet")], None
    for name, stage in P.STAGES:
        df = P.written(stage(spark, steps[-1], d), name)
        steps.append(df)
    texts = [{x.doc_id: x.text for x in s.collect()} for s in steps[:-1]]

    post = plain_quality([(k, t, s, g) for k, t, g, s, _ in docs], {k: (q, t) for k, q, t in labels})
    assert set(texts[1]) == {x[0] for k, x in enumerate(docs) if max(post[k, 0], post[k, 1]) < quality.REJECT} and len(texts[1]) < len(docs)
    assert set(texts[2]) == {k for k, (_, c) in brute_classes(sorted(texts[1].items())).items() if k == c} and len(texts[2]) < len(texts[1])
    want = brute_spans(sorted(texts[2].items()))
    assert {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts[3].items()} == {k: v[3] for k, v in want.items()} and texts[3] != texts[2]
    assert {x.doc_id: x.n_chars for x in steps[3].collect()} == {k: len(t) for k, t in texts[3].items()}
    leaked = {k for k, _ in brute_leaks(sorted(texts[3].items()), items)}
    assert set(texts[4]) == set(texts[3]) - leaked and leaked
    packed = steps[5].collect()
    assert {k: sum(x.length for x in packed if x.doc_id == k) for k in texts[4]} == {k: len(reference_ids(t)) for k, t in texts[4].items()}
    for s in {x.sequence_id for x in packed}:
        mine = sorted((x.offset, x.length) for x in packed if x.sequence_id == s)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0 and sum(mine[-1]) <= 4096
    assert len({x.sequence_id for x in packed}) == -(-sum(x.length for x in packed) // 4096)
