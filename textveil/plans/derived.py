"""A Russian corpus derived from customer keys, in SQL that Spark and DuckDB both run: each text holds one known value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


def digit(s: str, k: int) -> str:
    return f"CAST(substr({s}, {k}, 1) AS INT)"


def weighted(s: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {digit(s, k + 1)}" for k, w in enumerate(weights)) + ")"


def text_of(number: str) -> str:
    return f"CAST({number} AS STRING)"


def padded(number: str, n: int) -> str:
    return f"lpad({text_of(number)}, {n}, '0')"


#: Numbers without their check digits, and what the check digits come from, as columns of nested selects.
_NUMBERS = {"inn9": "'7' || n8", "inn10": "'5001' || substr(n8, 3, 6)", "snils9": "'1' || n8", "ogrn12": "'1027' || n8", "ogrnip14": "'304770' || n8", "card15": "'4276' || n8 || substr(n8, 2, 3)"}
_LUHN = " + ".join((f"CASE WHEN {digit('card15', k)} > 4 THEN 2 * {digit('card15', k)} - 9 ELSE 2 * {digit('card15', k)} END" if k % 2 else digit("card15", k)) for k in range(1, 16))
_SUMS = {"c10": f"{weighted('inn9', [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10", "c11": f"{weighted('inn10', [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10", "csn": f"{weighted('snils9', list(range(9, 0, -1)))} % 101", "luhn": _LUHN}
_MORE = {"inn11": f"inn10 || {text_of('c11')}", "card16": f"card15 || {text_of('(10 - luhn % 10) % 10')}"}
_LAST = {"c12": f"{weighted('inn11', [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10"}

#: (text before, value, text after, entity type or None, score): the value of row k is case k % len(CASES).
CASES: list[tuple[str, str, str, str | None, float]] = [
    ("Реквизиты: ИНН ", f"inn9 || {text_of('c10')}", ", оплата по счёту.", "INN", 0.9),
    ("Реквизиты: ИНН ", f"inn9 || {text_of('(c10 + 1) % 10')}", ", оплата по счёту.", None, 0),
    ("ИНН этой организации указан в большом письме номер пять: ", f"inn9 || {text_of('c10')}", ".", "INN", 0.7),
    ("Клиент ИНН ", f"inn11 || {text_of('c12')}", ".", "INN", 0.9),
    ("СНИЛС ", "'1' || substr(n8, 1, 2) || '-' || substr(n8, 3, 3) || '-' || substr(n8, 6, 3) || ' ' || substr(n8, 2, 2)", " в базе.", "SNILS", 0.9),
    ("СНИЛС ", f"snils9 || {padded('(CASE WHEN csn >= 100 THEN 0 ELSE csn END)', 2)}", " в базе.", "SNILS", 1.0),
    ("ОГРН ", f"ogrn12 || {text_of('CAST(ogrn12 AS BIGINT) % 11 % 10')}", " от 2020 года.", "OGRN", 1.0),
    ("ОГРНИП ", f"ogrnip14 || {text_of('CAST(ogrnip14 AS BIGINT) % 13 % 10')}", ".", "OGRNIP", 1.0),
    ("КПП ", "'7' || n8", " в договоре.", "KPP", 0.9),
    ("КПП ", "'77' || substr(n8, 1, 2) || '-' || substr(n8, 3, 2) || '-' || substr(n8, 6, 3)", ".", "KPP", 1.0),
    ("Паспорт ", "'45 1' || substr(n8, 1, 1) || ' ' || substr(n8, 3, 6)", ", выдан.", "PASSPORT_NUMBER", 1.0),
    ("Пишите на ", "'user' || CAST(k AS STRING) || '@mail.example.com'", ", ждём.", "EMAIL", 0.9),
    ("Оплата картой ", "substr(card16, 1, 4) || ' ' || substr(card16, 5, 4) || ' ' || substr(card16, 9, 4) || ' ' || substr(card16, 13, 4)", ".", "BANK_CARD_NUMBER", 1.0),
    ("CVV ", "substr(n8, 3, 3)", " на обороте.", "CVC", 0.7),
    ("Код подтверждения ", text_of("(1000 + k % 9000)"), ".", "TOKEN", 0.8),
    ("token: ", "md5(CAST(k AS STRING)) || substr(md5(CAST(k + 1 AS STRING)), 1, 8)", ".", "TOKEN", 0.9),
    ("Звоните: тел. ", "'+7 916 ' || substr(n8, 1, 3) || ' ' || substr(n8, 4, 2) || ' ' || substr(n8, 6, 2)", ".", "PHONE_NUMBER", 0.95),
    ("Сумма заказа ", text_of("(10000 + k % 90000)"), " рублей, спасибо.", None, 0),
    # known formats of secrets, in their order; a random word without context, and one with a weak one
    ("Значение ", "'eyJ' || md5 || '.eyJ' || md5 || '.' || md5", " в журнале.", "TOKEN", 0.95),
    ("Authorization: Bearer ", "'eyJ' || md5 || '.eyJ' || md5 || '.' || md5", " ушёл.", "TOKEN", 0.97),
    ("Значение ", "'ghp_' || md5 || substr(md5, 1, 8)", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'github_pat_' || md5", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'glpat-' || md5", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'sk-' || md5", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'sk_live_' || md5", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'AKIA' || upper(substr(md5, 1, 16))", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'hf_' || md5", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "n8 || ':' || md5 || 'xyz'", " в журнале.", "TOKEN", 0.95),
    ("Значение ", "'acme-' || md5", " в журнале.", "TOKEN", 0.85),
    ("Строка ", "md5 || 'QwZxKjPvTy' || upper(md5)", " в журнале.", "TOKEN", 0.65),
    ("Ваш пароль такой: ", "md5 || 'QwZxKjPvTy'", ".", "TOKEN", 0.75),
    ("Ваш код ", text_of("(1000 + k % 9000)"), " карта.", None, 0),
    # keywords with one wrong letter and with two
    ("Клиент инм ", f"inn9 || {text_of('c10')}", ".", "INN", 0.9),
    ("Клиент имм ", f"inn9 || {text_of('c10')}", ".", None, 0),
    # dashed numbers, and other forms of passports and phones
    ("ОГРН ", f"'1-02-7' || substr(n8, 1, 1) || '-' || substr(n8, 2, 7) || '-' || {text_of('CAST(ogrn12 AS BIGINT) % 11 % 10')}", " от 2020 года.", "OGRN", 1.0),
    ("ОГРНИП ", f"'3-04-77-0' || n8 || '-' || {text_of('CAST(ogrnip14 AS BIGINT) % 13 % 10')}", ".", "OGRNIP", 1.0),
    ("Документ: ", "'серия 451' || substr(n8, 1, 1) || ' номер ' || substr(n8, 3, 6)", ", выдан.", "PASSPORT_NUMBER", 0.9),
    ("Паспорт ", "'451' || substr(n8, 1, 1) || ' ' || substr(n8, 3, 6)", ", выдан.", "PASSPORT_NUMBER", 0.95),
    ("Паспорт ", "'451' || substr(n8, 1, 1) || '-' || substr(n8, 3, 6)", ", выдан.", "PASSPORT_NUMBER", 0.95),
    ("Паспорт ", "'451' || substr(n8, 1, 1) || substr(n8, 3, 6)", ", выдан.", "PASSPORT_NUMBER", 0.7),
    ("Связь: ", "'8 (495) ' || substr(n8, 1, 3) || '-' || substr(n8, 4, 2) || '-' || substr(n8, 6, 2)", "!", "PHONE_NUMBER", 0.8),
    ("Связь: ", "'8916' || substr(n8, 1, 7)", "!", "PHONE_NUMBER", 0.65),
    ("Связь: ", "'+1 (017) 555-' || substr(n8, 1, 4)", "!", None, 0),
    ("Связь: ", "'+1 (917) 555-' || substr(n8, 1, 4)", "!", "PHONE_NUMBER", 0.8),
    ("Связь: ", "'+44 20 ' || substr(n8, 1, 4) || ' ' || substr(n8, 5, 4)", "!", "PHONE_NUMBER", 0.8),
]


def _case(values: list[str]) -> str:
    return "CASE c " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def corpus_sql(customer: str = "customer") -> str:
    """(doc_id, c, before, value, after, entity, score)"""
    s = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
    inner = f"SELECT c_custkey AS k, CAST(c_custkey % {len(CASES)} AS INT) AS c, {padded('(c_custkey * 7919 + 10000019) % 100000000', 8)} AS n8, md5(CAST(c_custkey AS STRING)) AS md5 FROM {customer}"
    for level, columns in enumerate((_NUMBERS, _SUMS, _MORE, _LAST)):
        inner = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({inner}) t{level}"
    return f"""
SELECT k AS doc_id, c, {_case([s(x[0]) for x in CASES])} AS before, {_case([x[1] for x in CASES])} AS value, {_case([s(x[2]) for x in CASES])} AS after,
  {_case([s(x[3]) for x in CASES])} AS entity, {_case([f"CAST({x[4]} AS DOUBLE)" for x in CASES])} AS score
FROM ({inner}) t
"""


_written: dict[tuple, str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its text, written once for each session and table; the known span goes from length(before) to length(before || value)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        made = spark.sql(corpus_sql("{customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet")).selectExpr("*", "before || value || after AS text")
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        made.write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


#: Gold and predicted spans (subset, doc_id, label, start, end, text) from the corpus: some predictions are missing, moved, renamed or twice.
GOLD_SQL = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'entity' ELSE 'domain' END AS subset, doc_id, entity AS label, length(before) AS s, length(before) + length(value) AS e, value AS text FROM {corpus} WHERE entity IS NOT NULL"
PRED_SQL = """
SELECT subset, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'TOKEN' ELSE label END AS label, s, CASE WHEN doc_id % 11 = 0 THEN e - 1 ELSE e END AS e,
  CASE WHEN doc_id % 11 = 0 THEN substr(text, 1, length(text) - 1) ELSE text END AS text
FROM ({gold}) g WHERE doc_id % 7 <> 0
UNION ALL SELECT subset, doc_id, label, s, e, text FROM ({gold}) g WHERE doc_id % 17 = 0
"""
