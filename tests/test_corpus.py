import random

import pytest
from pyspark.sql import functions as F

from textveil.operators import corpus as P
from textveil.operators import evaluate as E
from textveil.plans import planner as G
from textveil.sources import corpora as S


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def ents(spans, kind=P.ENTS):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in spans]).cast(kind)


def test_address_spans_merge(spark):
    text = "Москва, ул. Мира, д. 5; Тверь и Мира"
    spans = [(0, 6, "address_city"), (12, 16, "address_street"), (21, 22, "address_house"), (24, 29, "address_city"), (32, 36, "address_street")]
    got = one(spark, P.merge_address_spans(F.col("s"), F.col("t")), s=ents(spans), t=F.lit(text))
    assert [(e.start, e.end) for e in got] == [(0, 22), (24, 29), (32, 36)]  # nothing but a house follows a house; a word lies between


@pytest.mark.parametrize("a, b, want", [("HOUSE", "STREET", False), ("HOUSE", "HOUSE", True), ("ADDRESS", "ADDRESS", False), ("POSTAL", "CITY", True), ("CITY", "CITY", False), ("STREET", "CITY", True), ("COUNTRY", "HOUSE", False)])
def test_can_merge(spark, a, b, want):
    assert one(spark, P.can_merge(F.lit(a), F.lit(b))) is want


def test_biolu_orphans(spark):
    tokens = [("a", "I-CITY"), ("b", "B-STREET"), ("c", "I-STREET"), ("d", "O"), ("e", "U-HOUSE"), ("f", "L-HOUSE")]
    arr = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(g).alias("tag"), F.lit(2 * k).alias("start"), F.lit(2 * k + 1).alias("end")) for k, (t, g) in enumerate(tokens)])
    got = lambda how: [(p.start, p.end, p.type) for p in one(spark, P.biolu_parts(F.col("t"), how), t=arr)]
    assert got("single") == [(0, 1, "CITY"), (2, 5, "STREET"), (8, 9, "HOUSE"), (10, 11, "HOUSE")]
    assert got("drop") == [(2, 5, "STREET"), (8, 9, "HOUSE")]


def test_occurrences_and_snapping(spark):
    assert [tuple(s) for s in one(spark, P.occurrences(F.lit("a.b a.b axb"), F.lit("a.b")))] == [(0, 3), (4, 7)]
    assert one(spark, P.occurrences(F.lit("abc"), F.lit("zz"))) == [] and one(spark, P.occurrences(F.lit("abc"), F.lit(""))) == []
    assert [tuple(e) for e in one(spark, P.snapped(F.col("e"), F.lit("Ивану Петрову, да")), e=ents([(2, 8, "NAME"), (14, 15, "NAME")]))] == [(0, 13, "NAME")]
    assert [tuple(e) for e in one(spark, P.united_names(F.col("e"), F.lit("x" * 20)), e=ents([(5, 9, "name"), (0, 5, "first_name"), (12, 40, "name")]))] == [(0, 9, "NAME"), (12, 20, "NAME")]
    assert [tuple(e) for e in one(spark, P.without_overlaps(F.col("e")), e=ents([(0, 3, "A"), (2, 9, "B"), (9, 10, "C")]))] == [(2, 9, "B"), (9, 10, "C")]


def test_cyrillic(spark):
    for s, want in (("абвгдежab", True), ("абab", False), ("123", False), ("їabc", False), (None, False)):
        assert one(spark, P.is_russian(F.lit(s).cast("string"))) is want


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", "Иван тут", [("Иван", "NAME")])], "id string, text string, entities array<struct<text:string,type:string>>")
    S.append_records(df, path)
    S.append_records(df, path)
    with open(tmp_path / "r" / "part-x.json", "w") as f:
        f.write("\n  \n{bad\n")
    good, bad = S.read_records(spark, path)
    assert good.count() == 2 and [r.line for r in bad.collect()] == ["{bad"]
    annotated, rejects = P.annotate_substrings(good)
    assert [tuple(e) for e in annotated.first().ents] == [(0, 4, "NAME")] and rejects.count() == 0
    back = S.write_annotated(annotated.select("text", "ents", F.lit("train").alias("split")), str(tmp_path / "w"))
    assert back.count() == 2


def test_metrics_of_empty_and_macro(spark):
    counts = spark.createDataFrame([("s", "A", 1, 1, 0)], "subset string, label string, TP long, FP long, FN long")
    got = {(r.subset, r.label): (r.Precision, r.Recall, r.F1) for r in E.metrics(counts, ["A", "B"]).collect()}
    assert got[("s", "A")] == (0.5, 1.0, 0.667) and got[("s", "B")] == (0, 0, 0) and got[("COMBINED", "MACRO")] == (0.5, 1.0, 0.667)


def test_address_edges(spark):
    say = lambda form, edge: one(spark, G.compose_address(*map(F.lit, (form, edge, "Тверь", "ул.", "Мира", "5", "7", "2", "170100", "Область")), F.lit(0.0)))
    assert say("ADDR_CSH", "no_space_after_dot") == "Тверь, ул.Мира 5"
    assert say("ADDR_SHAP", "typo_in_addr") == "ул. Мира 5 кв. 7 подьезд 2"
    assert say("ADDR_SH", "complex_house_number") == "ул. Мира 5а"
    assert say("ADDR_FULL", "village_vs_house_d") == "г. д. Тверь, ул. Мира, д. 5, кв. 7"


def test_stream_restores_in_time(spark, tmp_path):
    from textveil.streaming.guard import restore_stream

    a, v = str(tmp_path / "a"), str(tmp_path / "v")
    spark.sql("SELECT 1 AS request_id, '<T_1>' AS text, timestamp'2024-01-01 00:00:30' AS ts UNION ALL SELECT 2, '<T_1>', timestamp'2024-01-01 00:05:00' UNION ALL SELECT 9, 'z', timestamp'2024-01-01 01:00:00'").write.parquet(a)
    spark.sql("SELECT r AS request_id, map('<T_1>', 'x') AS values, t AS ts FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:00'), (8, timestamp'2024-01-01 01:00:00') x(r, t)").write.parquet(v)
    stream = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    out = restore_stream(stream(a), stream(v))
    q = out.writeStream.format("memory").queryName("restored_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.request_id: r.restored for r in spark.table("restored_now").collect()}
    assert got[1] == "x" and got.get(2, "<T_1>") == "<T_1>"


def test_exact_split_refines_its_cut(spark, monkeypatch):
    import hashlib

    df = spark.range(3000).withColumnRenamed("id", "k")
    order = sorted(range(3000), key=lambda k: hashlib.md5(f"{k}/42".encode()).hexdigest())
    for most in (1, 100_000):
        monkeypatch.setattr(P, "RANKED_ROWS", most)
        for ratio in (0.0, 0.9, 1.0):
            got = {r.k for r in P.split(df, "k", ratio, exact=True).where("split = 'train'").collect()}
            assert got == set(order[: int(3000 * ratio)])


def test_plans_count_on_and_draw_by_weight(spark):
    rows = spark.createDataFrame([(k * k * 37 - 5,) for k in range(1, 2001)], "key long").repartition(5)
    got = [r.row for r in G.plans_for(rows, "key", existing=rows.limit(30)).collect()]
    assert sorted(got) == list(range(30, 2030))
    weights = {"a": 0.5, "b": 0.25, "c": 0.2, "d": 0.05, "e": 0.0}
    table = G.aliases(weights)
    share = {v: 0.0 for v in weights}
    for value, other, part in table:
        assert 0 <= part <= 1
        share[value] += part / len(table)
        share[other] += (1 - part) / len(table)
    assert all(abs(share[v] - w) < 1e-12 for v, w in weights.items())
    seen = spark.range(40_000).select(G.drawn(G.uniform(F.col("id"), "x", 3), weights).alias("v")).groupBy("v").count().collect()
    assert all(abs(r["count"] / 40_000 - weights[r.v]) < 0.01 for r in seen) and "e" not in {r.v for r in seen}
    assert G.aliases({"one": 3.0}) == [("one", "one", 1.0)]


def test_characters_are_swept(spark):
    r = random.Random(4)
    one = lambda: [("s", r.randrange(6), r.choice("AB"), a, a + r.randint(-1, 12), "") for a in (r.randrange(60) for _ in range(60))]
    gold, pred = one(), one() + [("s", 1, "C", 0, 5, ""), ("t", 1, "A", 0, 5, "")]
    schema = "subset string, doc_id long, label string, start int, end int, text string"
    got = {(x.subset, x.label): (x.TP, x.FP, x.FN) for x in E.char_match(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), ["A", "B"]).collect()}
    want = {}
    for key in {(x[0], x[2]) for x in gold + pred if x[2] != "C"}:
        chars = lambda side: {(x[1], k) for x in side if (x[0], x[2]) == key for k in range(x[3], x[4])}  # noqa: B023, E731
        g, p = chars(gold), chars(pred)
        want[key] = (len(g & p), len(p - g), len(g - p))
    assert got == want


def test_counts_are_taken_by_the_write(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, "train" if k % 3 else "dev") for k in range(100)] + [(100, None)], "k long, split string").repartition(3)
    assert S.write_annotated(df, f"{tmp_path}/a").count() == 101
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: read(self, path).where("k <> 7"))
    with pytest.raises(ValueError, match="differ"):
        S.write_annotated(df, f"{tmp_path}/c")


def test_small_tables_are_dealt_and_large_ones_left(spark, tmp_path):
    from textveil.sources.shared import dealt_if_small

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    dealt = dealt_if_small(table)
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(dealt.toPandas()["id"]) == list(range(1000))
    assert dealt_if_small(table, at_most=0) is table


def test_places_count_once_and_texts_as_often_as_they_stand(spark):
    from textveil.operators.evaluate import bag_match, exact_match

    schema = "subset string, doc_id long, label string, start int, end int, text string"
    gold = spark.createDataFrame([("a", 1, "NAME", 0, 3, "Аня"), ("a", 1, "NAME", 0, 3, "аня "), ("a", 1, "CVC", 5, 8, "123"), ("a", None, "CVC", 0, 3, None), ("a", 2, "OTHER", 0, 1, "x")], schema)
    pred = spark.createDataFrame([("a", 1, "NAME", 0, 3, "Аня"), ("a", 1, "CVC", 5, 9, "123"), ("a", None, "CVC", 0, 3, None)], schema)
    told = lambda d: {tuple(r) for r in d.collect()}
    assert told(bag_match(gold, pred, ["NAME", "CVC"])) == {("a", "NAME", 1, 0, 1), ("a", "CVC", 2, 0, 0)}
    assert told(exact_match(gold, pred, ["NAME", "CVC"])) == {("a", "NAME", 1, 0, 0), ("a", "CVC", 1, 1, 1)}
    assert told(exact_match(gold.limit(0), pred.limit(0), ["NAME"])) == set()


def test_substrings_are_searched_once(spark):
    """The tokens of a text and its entities stand once in the plan, whatever is asked of the result; many of both give the places of each."""
    text = "Иван-Пётр, ул. Мира 5; " * 3
    ents = [("Мира", "ADDRESS"), ("Иван", "NAME"), ("ул. Мира", "ADDRESS"), ("нет", "NAME"), (".", "X")]
    df = spark.createDataFrame([(1, text, ents), (2, text, []), (3, None, ents), (4, text, None)], "id long, text string, entities array<struct<text:string,type:string>>")
    good, bad = P.annotate_substrings(df)
    rows = good.select("id", F.explode("ents").alias("e")).select("id", "e.*")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\w+|[^\w\s]") == 1
    n = len(text) // 3
    want = {(1, k * n + a, k * n + b, t) for k in range(3) for a, b, t in ((0, 4, "NAME"), (11, 19, "ADDRESS"))}
    assert {tuple(r) for r in rows.collect()} == want and {r.id: len(r.ents) for r in good.collect()} == {1: 6, 2: 0} and {r.id for r in bad.collect()} == {3, 4}
