"""The shared scan, the sweeps and the keyword lookup against plain versions, and that their time grows with the text alone."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textveil.functions import scan
from textveil.operators import corpus as P
from textveil.operators import detectors as D
from textveil.operators import resolve as R

R_ = random.Random(31)


def test_found_and_cut(spark):
    texts = ["".join(R_.choice("ab1é😀 \n") for _ in range(n)) for n in [0, 1, 5, 63, 64, 65, 128, 129, 900, 3000] * 3] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = df.select("t", scan.found(F.col("t"), r"1+|b").alias("f"), scan.chunked(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.t is None or "".join(r.c) == r.t
        assert [tuple(x) for x in r.f] == ([] if r.t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"1+|b", r.t)])
    places = [(t, a, a + R_.randint(0, 200)) for t in texts if t is not None for a in [0, *(R_.randint(0, len(t)) for _ in range(8))]]
    cut = spark.createDataFrame(places, "t string, a int, z int").select("t", "a", "z", scan.cut(scan.chunked(F.col("t")), F.col("a"), F.col("z")).alias("got")).collect()
    assert all(r.got == r.t[r.a : r.z] for r in cut)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_one_edit_by_neighbourhoods(spark):
    keywords = ["инн", "снилс", "абв", "паспорт"]
    words = ["".join(R_.choice("абвинс") for _ in range(R_.randint(0, 5))) for _ in range(9_000)]
    for _ in range(1_000):  # near the long ones
        w = list(R_.choice(keywords))
        for _ in range(R_.randint(0, 2)):
            k = R_.randrange(len(w) + 1)
            w[k : k + R_.randint(0, 1)] = R_.choice(["", "а", "п"])
        words.append("".join(w))
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", scan.one_edit_away(F.array("w"), F.array(*map(F.lit, keywords)), F.lit(scan.neighbourhoods(keywords))).alias("near")).collect()
    assert all(r.near == (r.w != "" and any(edits(r.w, k) <= 1 for k in keywords)) for r in got) and 500 < sum(r.near for r in got) < 9_000


def plain_matches(rule, text):
    pattern = rule.pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?U:", "(?:")
    if rule.within != "run":
        return [(m.start(), m.end()) for m in re.finditer(pattern, text)]
    runs = [m for m in re.finditer(r"\b\d{3,15}\b", text) if rule.least <= len(m[0]) <= (rule.most)]
    return [(m.start(), m.end()) for m in runs if not pattern or re.search(pattern, m[0])]


def test_stretches_lose_no_match(spark):
    """Every pattern of every detector, without validators and contexts, against a search through whole texts."""
    bare = [D.Detector(f"{d.entity}{k}", (D.Rule(r.pattern, r.within, r.gate, r.least, r.most, **D.constant(0.5)),)) for d in D.ALL for k, r in enumerate(d.rules)]
    pieces = ["12", "3", "4567", "890123", "7", "8", "-", " ", " ", "(", ")", "+", "+1", "a", "Z", "_", ".", "@", "é", "/", ":", "=", "45 17 234567", "112-233-445 95", "1-02-77-0013866-3", "7701AB001", "7701-AB-001", "серия 4510 номер 123456", "a.b@c.de", "eyJa.eyJb.c", "sk-" + "a" * 20, "ghp_" + "B1" * 18, "AKIA" + "Q" * 16, "12345678:" + "x" * 35, "acme-" + "0a" * 8, "\n"]
    texts = ["".join(R_.choice(pieces) for _ in range(R_.randint(1, 40))) for _ in range(1500)]
    # each pattern by itself, and all of them at once
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    df = df.select("t", *[D.found_spans(F.col("t"), (b,)).alias(b.entity) for b in bare[:3]], D.found_spans(F.col("t"), bare).alias("all"))
    seen = 0
    for r in df.collect():
        assert [s.start for s in r.all if s.entity_type == bare[4].entity] == sorted(s.start for s in r.all if s.entity_type == bare[4].entity)
        for k, b in enumerate(bare):
            want = plain_matches(b.rules[0], r.t)
            assert [(s.start, s.end) for s in r.all if s.entity_type == b.entity] == want, (b, r.t)
            assert k > 2 or [(s.start, s.end) for s in r[b.entity]] == want
            seen += len(want)
    assert seen > 3_000


def plain_resolved(spans):
    best = {}
    for k, s in enumerate(spans):
        at = s[1:3]
        if at not in best or s[3] > best[at][1][3]:
            best[at] = (k, s)
    order = [s for _, s in sorted(best.values())]
    kept = []
    for s in sorted(order, key=lambda s: (s[1] - s[2], -s[3])):
        if not any(k[1] <= s[1] and k[2] >= s[2] and (k[0] == s[0] or k[3] >= s[3]) for k in kept):
            kept.append(s)
    free = []
    for s in sorted(order, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        if not any(k[1] < s[2] and s[1] < k[2] for k in free):
            free.append(s)
    long = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], s[1], s[0])):
        if not any(k[1] < s[2] and s[1] < k[2] for k in long):
            long.append((s[0], s[1], s[2]))
    return [(s[0], s[1], s[2]) for s in kept], sorted((s[1], s[2], s[0]) for s in free), sorted((a, b, t) for t, a, b in long)


def test_sweeps_equal_greedy_choices(spark):
    rows = []
    for k in range(300):
        size = R_.choice([10, 40, 400])
        rows.append((k, [(R_.choice("ABC"), a, a + R_.randint(1, R_.choice([3, 30])), R_.choice([0.5, 0.7, 0.9])) for a in (R_.randrange(size) for _ in range(R_.randint(0, 150)))]))
    df = spark.createDataFrame(rows, f"k long, s {D.SPANS}")
    ents = F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("label"))).cast(P.ENTS)
    once = R.best_of_equal(F.col("s"))
    for r in df.select("s", R.contained_out(once).alias("a"), R.best_disjoint(once).alias("b"), P.without_overlaps(ents).alias("c"), D.first_of_equal(F.col("s")).alias("d")).collect():
        kept, free, long = plain_resolved([tuple(s) for s in r.s])
        assert [tuple(s)[:3] for s in r.a] == kept
        assert sorted((s.start, s.end, s.entity_type) for s in r.b) == free
        assert [tuple(s) for s in r.c] == long
        first = {}
        for s in r.s:
            first.setdefault((s.start, s.end), tuple(s))
        assert [tuple(s) for s in r.d] == list(first.values())


@pytest.mark.parametrize("word", ["123 ", "mail.%d@example.com "])
def test_time_grows_with_the_text(spark, word):
    """A text of twice as many matches takes about twice the time, beyond what planning takes."""

    def took(n):
        text = "".join(word % k if "%" in word else word for k in range(n)) + "код cvv"
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        best = 1e9
        for _ in range(2):
            began = time.time()
            D.detect(df).selectExpr("size(spans) AS n").write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    took(1)
    floor, once, twice = took(1), took(8_000), took(16_000)
    assert twice - floor < 3 * max(once - floor, 0.5), (floor, once, twice)
