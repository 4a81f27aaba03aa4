import pytest
from pyspark.sql import functions as F

from textveil.functions import checks
from textveil.operators import detectors as D
from textveil.operators import mask as M
from textveil.operators import resolve as R

TEXTS = {
    1: "Иван Петров, ИНН 500100732259, тел. +7 916 123 45 67",
    2: "Email: test@example.com, СНИЛС 112-233-445 95",
    3: "Для подтверждения платежа введите данные карты: 5321 3012 4417 8904, срок 09/27, CVV 742.",
    4: "Прошу выставить счёт на ООО «ТехноСтрой». Реквизиты: ИНН 7707123458, ОГРН 1027700138663, КПП 770701001.",
    5: "Сотрудник Дмитрий Алексеевич Ковалёв, паспорт 45 17 234567, СНИЛС 987-654-321 00, принят на должность с 1 июня 2025 года.",
    6: "Уважаемые клиенты! В связи с техническими работами сервис будет недоступен 2 июня с 02:00 до 04:00 по московскому времени.",
    7: "😀 ИНН 7707123458",
    8: "ИНН и1234567890",
    9: None,
    10: "",
    11: "код 1234",
    12: "код 1234 карта",
    13: "Оплата инм 7707123458",
    14: "Номер 7707123458",
}
EXPECTED = {
    1: {("NAME", 0, 11, 0.85), ("INN", 17, 29, 0.9), ("PHONE_NUMBER", 36, 52, 0.95)},
    2: {("EMAIL", 7, 23, 0.9), ("SNILS", 31, 45, 0.9)},
    3: {("BANK_CARD_NUMBER", 48, 67, 1.0), ("CVC", 85, 88, 0.7)},
    4: {("INN", 57, 67, 0.9), ("OGRN", 74, 87, 1.0), ("KPP", 93, 102, 0.9)},
    5: {("PASSPORT_NUMBER", 46, 58, 1.0), ("SNILS", 66, 80, 0.9)},
    7: {("INN", 6, 16, 0.9)},
    11: {("TOKEN", 4, 8, 0.8)},
    13: {("INN", 11, 21, 0.9)},
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    names = spark.createDataFrame([(1, "NAME", 0, 11)], "doc_id long, entity_type string, start int, end int")
    return D.detect(docs, external=names).collect()


def test_golden(found):
    got = {r.doc_id: {(s.entity_type, s.start, s.end, round(s.score, 2)) for s in r.spans} for r in found}
    assert got == {k: EXPECTED.get(k, set()) for k in TEXTS}


def test_checks(spark):
    rows = [("inn", "500100732259", True), ("inn", "7707123458", True), ("inn", "7707123459", False), ("inn", "12345678901", False), ("inn", "", False), ("snils", "112-233-445 95", True), ("snils", "987-654-321 00", False), ("ogrn", "1027700138663", True), ("ogrn", "1027700138660", False), ("luhn", "5321 3012 4417 8904", True), ("luhn", "4276 5500 1122 3347", True), ("luhn", "", False), ("luhn", "4276 5500 1122 3348", False), ("luhn", None, False)]
    f = {"inn": checks.is_valid_inn, "snils": checks.is_valid_snils, "ogrn": checks.is_valid_ogrn, "luhn": checks.is_valid_luhn}
    df = spark.createDataFrame(rows, "kind string, s string, want boolean")
    for kind, check in f.items():
        assert df.where(F.col("kind") == kind).where(check(F.col("s")) != F.col("want")).count() == 0
    fixed = df.where("kind = 'luhn' AND s <> ''").select(checks.is_valid_luhn(checks.luhn_fixed(F.col("s"))).alias("ok"))
    assert all(r.ok for r in fixed.collect())


def test_greedy_is_no_anti_join(spark):
    """The middle span goes by score, so it doesn't drop the inner one, which has its type."""
    spans = [("A", 0, 20, 0.9), ("B", 2, 18, 0.5), ("B", 4, 8, 0.95), ("C", 15, 25, 0.3)]
    df = spark.createDataFrame([(spans,)], f"spans {D.SPANS}")
    got = {tuple(s)[:3] for s in df.select(R.contained_out(F.col("spans")).alias("x")).first().x}
    assert got == {("A", 0, 20), ("B", 4, 8), ("C", 15, 25)}
    best = [tuple(s)[:3] for s in df.select(R.best_disjoint(F.col("spans")).alias("x")).first().x]
    assert best == [("B", 4, 8), ("C", 15, 25)]


def test_mask_and_restore(spark):
    df = spark.createDataFrame([(1, "a x b x c y", [("T", 2, 3, 0.9), ("T", 6, 7, 0.9), ("T", 10, 11, 0.9)]), (2, "none", []), (3, None, None)], f"request_id long, text string, spans {D.SPANS}")
    assert {r.request_id: r.masked for r in M.mask(df).collect()}[1] == "a <T> b <T> c <T>"
    passed, rejected, vault = M.apply_policy(df, {"T": "MASK"})
    assert {r.request_id: r.masked for r in passed.where("request_id = 1").collect()} == {1: "a <T_1> b <T_1> c <T_2>"}
    assert rejected.count() == 0 and {(r.placeholder, r.value) for r in vault.collect()} == {("<T_1>", "x"), ("<T_2>", "y")}
    answers = spark.createDataFrame([(1, "<T_2> <T_1> <T_10>"), (5, "<T_1>")], "request_id long, text string")
    assert {r.request_id: r.restored for r in M.restore(answers, vault).collect()} == {1: "y x <T_10>", 5: "<T_1>"}
    assert M.apply_policy(df, {"T": "BLOCK"})[1].count() == 1


def test_tagger_hook(spark):
    from textveil.functions.tagger import tagged

    def load():
        return lambda texts: [[("NAME", 0, len(t), 0.85)] if t else [] for t in texts]

    docs = spark.createDataFrame([(1, "Иван"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in tagged(docs, load).collect()] == [(1, "NAME", 0, 4, 0.85)]


def test_phone_plans(spark):
    rows = [("+1 (743) 555-3824", True), ("+1 (017) 555-3824", False), ("+7 916 123-45-67", True), ("+7 216 123-45-67", False), ("89161234567", True), ("4951234567", True), ("5951234567", False), ("+380 44 123 45 67", True), ("+380 44 123 45", False), ("+44 20 7946 0958", True), ("+297 123 4567", True), (None, None)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert [tuple(r) for r in df.select("s", D.is_phone(F.col("s")).alias("got")).collect()] == rows
