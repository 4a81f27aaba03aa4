"""The registered queries on the reference's operators, each over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.scan import chunked
from ..functions.tagger import tagged
from ..operators import corpus as P
from ..operators import detectors as D
from ..operators import evaluate as E
from ..operators import mask as M
from ..operators import resolve as R
from ..sources import corpora as S
from ..sources.shared import dealt_if_small, shared_folder
from . import planner as G
from . import quality as Q
from .derived import CASES, GOLD_SQL, PRED_SQL, corpus, corpus_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_CORPUS = f"({corpus_sql()})"
_GOLD = GOLD_SQL.replace("{corpus}", f"{_CORPUS} c0")
_PRED = PRED_SQL.replace("{gold}", _GOLD)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_if_small(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _spans(df: DataFrame, key: str = "doc_id") -> DataFrame:
    s = df.select(key, F.explode("spans").alias("s"))
    return s.select(key, "s.entity_type", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.round("s.score", 2).alias("score"))


_KNOWN = f"SELECT doc_id, entity AS entity_type, CAST(length(before) AS BIGINT) AS start_at, CAST(length(before) + length(value) AS BIGINT) AS end_at, score FROM {_CORPUS} c WHERE entity IS NOT NULL"

def _kept(df: DataFrame, name: str) -> DataFrame:
    """Rows that several results need: written once, so that detection doesn't run for each."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- detection ---------------------------------------------------------------


@query(_KNOWN)
def detect_all(spark, sf_dir):
    return _spans(D.detect(corpus(spark, sf_dir)))


def _detect_type(entity: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spans(D.detect(corpus(spark, sf_dir), entities=[entity]))

    QUERIES[name := f"detect_{entity.lower()}"] = run
    ORACLE_SQL[name] = f"SELECT * FROM ({_KNOWN}) k WHERE entity_type = '{entity}'"


for _entity in sorted({x[3] for x in CASES if x[3]}):
    _detect_type(_entity)


@query(f"SELECT * FROM ({_KNOWN}) k WHERE score >= 0.9")
def detect_min_score(spark, sf_dir):
    return _spans(D.detect(corpus(spark, sf_dir), min_score=0.9))


_MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_CARD = r"\b\d(?:[ \-]?\d){12,18}\b"
_LUHN = "list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 1 THEN CASE WHEN 2 * CAST({d}[i] AS INT) > 9 THEN 2 * CAST({d}[i] AS INT) - 9 ELSE 2 * CAST({d}[i] AS INT) END ELSE CAST({d}[i] AS INT) END)) % 10 = 0"


@query(f"""
SELECT 'EMAIL' AS entity_type, CAST(sum(len(regexp_extract_all(text, '{_MAIL}'))) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{_MAIL}') HAVING n > 0
UNION ALL SELECT 'BANK_CARD_NUMBER', count(*) FROM (SELECT regexp_replace(unnest(regexp_extract_all(text, '{_CARD}')), '[^0-9]', '', 'g') AS d FROM documents) t WHERE {_LUHN.format(d='d')} HAVING count(*) > 0
""")
def findings_by_type(spark, sf_dir):
    return R.findings_by_type(D.detect(_documents(spark, sf_dir), detectors=(D.CARD, D.EMAIL)))


@query(f"""
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_at, m[i] AS snippet
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_MAIL}') AS m, regexp_split_to_array(text, '{_MAIL}') AS g FROM documents) a) b
""")
def email_places(spark, sf_dir):
    found = R.findings(D.detect(_documents(spark, sf_dir), detectors=(D.EMAIL,)))
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "snippet")


def _places_sql(pattern: str, skip: int = 0, drop: int = 0) -> str:
    """Places of all matches of a pattern in documents, less ``skip`` characters at the start and ``drop`` at the end."""
    return f"""
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + {skip} AS BIGINT) AS start_at, substr(m[i], {skip + 1}, length(m[i]) - {skip + drop}) AS snippet
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents) a) b
"""


@query(_places_sql('(?:token|TOKEN|Token) = "[0-9a-fA-F]{40}"', 9, 1))
def token_places(spark, sf_dir):
    """Secrets beside a word for them, in all documents; random words without one score less."""
    found = R.findings(D.detect(_documents(spark, sf_dir), detectors=(D.TOKEN, D.EMAIL), entities=["TOKEN"], min_score=0.7))
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "snippet")


#: Area codes that end in 11 are services'.
_PHONE = r"[+]1 [(][2-9](?:[02-9][0-9]|1[02-9])[)] [2-9][0-9]{2}-[0-9]{4}|\b[78]?[3489][0-9]{9}\b"


@query(_places_sql(_PHONE))
def phone_places(spark, sf_dir):
    found = R.findings(D.detect(_documents(spark, sf_dir), detectors=(D.TOKEN, D.PHONE), entities=["PHONE_NUMBER"]))
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "snippet")


_PREFIXES = ["7916", "7495", "7800", "7216", "7701", "1917", "1212", "1911", "1017", "4420", "4460", "380", "297", "86", "998", "49", "7", "1"]
_NUMBERS_SQL = f"SELECT c_custkey, '+' || element_at(array({', '.join(f"'{p}'" for p in _PREFIXES)}), CAST(c_custkey % {len(_PREFIXES)} AS INT) + 1) || substr(CAST(c_custkey * 104729 + 10000000019 AS STRING), 2, CAST(6 + c_custkey % 5 AS INT)) AS number FROM {{customer}}"


@query(f"""
WITH n AS ({_NUMBERS_SQL.replace('element_at(array(', 'list_extract(list_value(').replace('{customer}', 'customer')}),
p(prefix, region, low, high, spot, digits) AS (VALUES {", ".join(f"('{p.prefix}', '{p.region}', {p.low}, {p.high}, {p.at}, '{p.digits}')" for p in D.PLANS)}),
m AS (SELECT n.*, p.*, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) AS best FROM n JOIN p ON starts_with(substr(number, 2), prefix))
SELECT c_custkey, number, prefix, region, high > 0 AND length(number) - 1 - length(prefix) BETWEEN low AND high AND contains(digits, substr(number, CAST(2 + length(prefix) + spot AS INT), 1)) AS valid FROM m WHERE best = 1
""")
def phone_plans(spark, sf_dir):
    """Numbers of many countries by the plan of their longest prefix: cities and networks, area codes, services, codes without numbers, wrong lengths."""
    n = spark.sql(_NUMBERS_SQL, customer=_table(spark, sf_dir, "customer"))
    plan = D.plan_of(F.substr("number", F.lit(2)))
    return n.select("c_custkey", "number", plan["prefix"].alias("prefix"), plan["region"].alias("region"), D.is_phone(F.col("number")).alias("valid"))


_SECRET = '(token|TOKEN|Token) = "[0-9a-fA-F]{40}"'


@query(f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_MAIL}', '<EMAIL>', 'g'), '{_SECRET}', '\\1 = "<TOKEN>"', 'g'), '{_PHONE}', '<PHONE_NUMBER>', 'g') AS r,
  {" + ".join(f"coalesce(len(regexp_extract_all(text, '{p}')), 0)" for p in (_MAIL, _SECRET, _PHONE))} AS n FROM documents),
c AS (SELECT doc_id, n, regexp_split_to_array(r, '{_CARD}') AS gap, list_transform(regexp_extract_all(r, '{_CARD}'), lambda x: CASE WHEN {_LUHN.format(d="regexp_replace(x, '[^0-9]', '', 'g')")} THEN '<BANK_CARD_NUMBER>' ELSE x END) AS card FROM t)
SELECT doc_id, CAST(n + coalesce(len(list_filter(card, lambda x: x = '<BANK_CARD_NUMBER>')), 0) AS INT) AS n,
  sha256(array_to_string(list_transform(range(1, len(gap) + 1), lambda i: gap[i] || coalesce(card[i], '')), '')) AS masked_sha256 FROM c
""")
def findings_all_types(spark, sf_dir):
    """All rules over all documents, masked: the whole of the first workload."""
    found = M.mask(D.detect(_documents(spark, sf_dir)))
    return found.select("doc_id", F.size("spans").alias("n"), F.sha2("masked", 256).alias("masked_sha256"))


@query(f"SELECT doc_id, 'NAME' AS entity_type, CAST(0 AS BIGINT) AS start_at, CAST(length(before) - 1 AS BIGINT) AS end_at, CAST(0.85 AS DOUBLE) AS score FROM {_CORPUS} c WHERE doc_id % 5 = 0 UNION ALL {_KNOWN}")
def detect_with_external(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    given = docs.where("doc_id % 5 = 0").selectExpr("doc_id", "'NAME' AS entity_type", "0 AS start", "length(before) - 1 AS end")
    return _spans(D.detect(docs, external=given))


_NUMBER = "regexp_replace(text, '[^0-9]', '', 'g')"


_D = "regexp_replace(value, '[^0-9]', '', 'g')"
_AT = lambda k: f"TRY_CAST(substr(d, {k}, 1) AS INT)"
_SUM = lambda weights: "(" + " + ".join(f"{w} * {_AT(k + 1)}" for k, w in enumerate(weights)) + ")"


@query(f"""
SELECT doc_id,
  CASE length(d) WHEN 10 THEN {_SUM(checks.INN_10)} % 11 % 10 = {_AT(10)} WHEN 12 THEN {_SUM(checks.INN_11)} % 11 % 10 = {_AT(11)} AND {_SUM(checks.INN_12)} % 11 % 10 = {_AT(12)} ELSE false END AS inn,
  CASE WHEN length(d) = 11 THEN CASE WHEN {_SUM(range(9, 0, -1))} % 101 >= 100 THEN 0 ELSE {_SUM(range(9, 0, -1))} % 101 END = TRY_CAST(substr(d, 10, 2) AS INT) ELSE false END AS snils,
  CASE WHEN length(d) = 13 THEN TRY_CAST(substr(d, 1, 12) AS BIGINT) % 11 % 10 = {_AT(13)} ELSE false END AS ogrn,
  CASE WHEN length(d) = 15 THEN TRY_CAST(substr(d, 1, 14) AS BIGINT) % 13 % 10 = {_AT(15)} ELSE false END AS ogrnip
FROM (SELECT doc_id, {_D} AS d FROM {_CORPUS} t) t
""")
def check_digits(spark, sf_dir):
    v = F.col("value")
    return corpus(spark, sf_dir).select("doc_id", checks.is_valid_inn(v).alias("inn"), checks.is_valid_snils(v).alias("snils"), checks.is_valid_ogrn(v).alias("ogrn"), checks.is_valid_ogrnip(v).alias("ogrnip"))


@query("SELECT c_custkey, round(-list_sum(list_transform(list_distinct(string_split(c_name, '')), lambda x: (length(c_name) - length(replace(c_name, x, ''))) / length(c_name) * log2((length(c_name) - length(replace(c_name, x, ''))) / length(c_name)))), 9) AS entropy FROM customer")
def name_entropy(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(checks.entropy(F.col("c_name")), 9).alias("entropy"))


@query("""
SELECT o_orderkey, CASE WHEN s % 10 = 0 THEN n ELSE substr(n, 1, 15) || CAST((10 - (s - CAST(substr(n, 16, 1) AS INT)) % 10) % 10 AS STRING) END AS fixed
FROM (SELECT o_orderkey, n, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(n[i] AS INT) > 9 THEN 2 * CAST(n[i] AS INT) - 9 ELSE 2 * CAST(n[i] AS INT) END ELSE CAST(n[i] AS INT) END)) AS s
  FROM (SELECT o_orderkey, '4276' || lpad(CAST((o_orderkey * 104729) % 1000000000000 AS STRING), 12, '0') AS n FROM orders) a) b
""")
def luhn_fixed(spark, sf_dir):
    n = F.concat(F.lit("4276"), F.lpad((F.col("o_orderkey") * 104729 % 1000000000000).cast("string"), 12, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", checks.luhn_fixed(n).alias("fixed"))


# --- resolution ----------------------------------------------------------------

_MANY = "SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ADDRESS' WHEN 2 THEN 'TOKEN' ELSE 'CVC' END AS entity_type, CAST(o_orderkey * 7 % 40 AS INT) AS s, CAST(o_orderkey * 7 % 40 + o_orderkey % 13 + 4 AS INT) AS e, CAST(o_orderkey * 31 % 100 AS DOUBLE) / 100 AS score FROM {orders}"


def _many_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("ord", F.struct("entity_type", F.col("s").alias("start"), F.col("e").alias("end"), "score").alias("x"))
    # few bytes, but much to do for each row: a number that is given isn't coalesced
    rows = spark.sql(_MANY, orders=_table(spark, sf_dir, "orders")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["x"]).cast(D.SPANS).alias("spans"))


_ONE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY score DESC, ord) AS rn FROM ({_MANY.replace('{orders}', 'orders')}) m) q WHERE rn = 1"
_FOLD = """
SELECT doc_id, x.t AS entity_type, CAST(x.s AS BIGINT) AS start_at, CAST(x.e AS BIGINT) AS end_at, round(x.p, 2) AS score
FROM (SELECT doc_id, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda k: {drops})) > 0 THEN a ELSE list_concat(a, b) END)) AS x
  FROM (SELECT doc_id, list([struct_pack(t := entity_type, s := s, e := e, p := score)] ORDER BY {order}) AS l FROM ({one}) o GROUP BY doc_id) g) r
"""


@query(f"SELECT doc_id, entity_type, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, round(score, 2) AS score FROM ({_ONE}) o")
def best_of_equal_spans(spark, sf_dir):
    return _spans(_many_spans(spark, sf_dir).withColumn("spans", R.best_of_equal(F.col("spans"))))


@query(_FOLD.format(drops="k.s <= b[1].s AND k.e >= b[1].e AND (k.t = b[1].t OR k.p >= b[1].p)", order="e - s DESC, score DESC, ord", one=_ONE))
def contained_spans_out(spark, sf_dir):
    return _spans(_many_spans(spark, sf_dir).withColumn("spans", R.contained_out(R.best_of_equal(F.col("spans")))))


@query(_FOLD.format(drops="k.s < b[1].e AND b[1].s < k.e", order="score DESC, e - s DESC, s, entity_type", one=_ONE))
def best_disjoint_spans(spark, sf_dir):
    return _spans(_many_spans(spark, sf_dir).withColumn("spans", R.best_disjoint(R.best_of_equal(F.col("spans")))))


_FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY ord) AS rn FROM ({_MANY.replace('{orders}', 'orders')}) m) q WHERE rn = 1"


@query(f"SELECT doc_id, entity_type, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, round(score, 2) AS score FROM ({_FIRST}) o")
def first_of_equal_spans(spark, sf_dir):
    return _spans(_many_spans(spark, sf_dir).withColumn("spans", D.first_of_equal(F.col("spans"))))


@query("SELECT doc_id, entity_type, start_at, end_at FROM (" + _FOLD.format(drops="k.s < b[1].e AND b[1].s < k.e", order="e - s DESC, s, entity_type", one=_MANY.replace("{orders}", "orders")) + ") f")
def overlaps_out(spark, sf_dir):
    ents = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("label"))).cast(P.ENTS)
    got = _many_spans(spark, sf_dir).select("doc_id", F.explode(P.without_overlaps(ents)).alias("e"))
    return got.select("doc_id", F.col("e.label").alias("entity_type"), F.col("e.start").cast("long").alias("start_at"), F.col("e.end").cast("long").alias("end_at"))


_LABELLED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Адрес доставки' WHEN 1 THEN 'ключ' WHEN 2 THEN 'г.' WHEN 3 THEN 'a@b.ru' ELSE 'Невский проспект' END AS word, CASE WHEN doc_id % 5 = 1 THEN 'TOKEN' WHEN doc_id % 5 = 3 THEN 'NAME' ELSE 'ADDRESS' END AS kind FROM {corpus}"


@query(f"SELECT doc_id, 'ADDRESS' AS entity_type, CAST(0 AS BIGINT) AS start_at, CAST(length(word) AS BIGINT) AS end_at, CAST(0.85 AS DOUBLE) AS score FROM ({_LABELLED.replace('{corpus}', _CORPUS + ' c')}) l WHERE doc_id % 5 = 4")
def labels_and_mail_out(spark, sf_dir):
    df = spark.sql(_LABELLED, corpus=corpus(spark, sf_dir))
    one = F.array(F.struct(F.col("kind").alias("entity_type"), F.lit(0).alias("start"), F.length("word").alias("end"), F.lit(0.85).alias("score"))).cast(D.SPANS)
    return _spans(df.withColumn("spans", R.resolved(one, chunked(F.col("word")))))


# --- masking -------------------------------------------------------------------


@query(f"SELECT doc_id, before || CASE WHEN entity IS NULL THEN value ELSE '<' || entity || '>' END || after AS masked FROM {_CORPUS} c")
def masked_texts(spark, sf_dir):
    return M.mask(D.detect(corpus(spark, sf_dir))).select("doc_id", "masked")


@query(f"SELECT doc_id, 'replace' AS operator, entity AS entity_type, CAST(length(before) AS BIGINT) AS start_at, CAST(length(before) + length(entity) + 2 AS BIGINT) AS end_at, '<' || entity || '>' AS placeholder FROM {_CORPUS} c WHERE entity IS NOT NULL")
def masked_places(spark, sf_dir):
    got = M.mask(D.detect(corpus(spark, sf_dir)), items=True).select("doc_id", F.explode("items").alias("i"))
    return got.select("doc_id", "i.operator", "i.entity_type", F.col("i.start").cast("long").alias("start_at"), F.col("i.end").cast("long").alias("end_at"), F.col("i.text").alias("placeholder"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<NAME>' || substr(before || value || after, 4) ELSE before || value || after END AS masked FROM {_CORPUS} c")
def masked_with_given(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    given = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "'NAME' AS entity_type", "0 AS start", "3 AS end", "CAST(1 AS DOUBLE) AS score")
    return M.mask_with(docs, given).select("doc_id", "masked")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<NAME>' || substr(before || value || after, 4) ELSE before || CASE WHEN entity IS NULL THEN value ELSE '<' || entity || '>' END || after END AS masked FROM {_CORPUS} c")
def masked_or_searched(spark, sf_dir):
    """Documents without given spans are searched."""
    docs = corpus(spark, sf_dir)
    given = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "'NAME' AS entity_type", "0 AS start", "3 AS end", "CAST(1 AS DOUBLE) AS score")
    return M.mask_with(docs, given, redetect_missing=True).select("doc_id", "masked")


_POLICY = {t: "BLOCK" if t in ("BANK_CARD_NUMBER", "CVC", "TOKEN") else "MASK" for t in D.TYPES}
_BLOCKED = "('BANK_CARD_NUMBER', 'CVC', 'TOKEN')"


def _policy(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumns({"request_id": F.col("doc_id"), "text": F.concat("text", F.lit(" И ещё раз "), "value")})
    return M.apply_policy(_kept(D.detect(docs), "policy"), _POLICY)


@query(f"SELECT doc_id AS request_id FROM {_CORPUS} c WHERE entity IN {_BLOCKED}")
def policy_rejected(spark, sf_dir):
    return _policy(spark, sf_dir)[1].select("request_id")


@query(f"SELECT doc_id AS request_id, '<' || entity || '_1>' AS placeholder, value FROM {_CORPUS} c WHERE entity IS NOT NULL AND entity NOT IN {_BLOCKED} UNION ALL SELECT doc_id, '<PHONE_NUMBER_1>', value FROM {_CORPUS} c WHERE regexp_matches(value, '^451[0-9][ -]?[0-9]{{6}}$')")
def policy_vault(spark, sf_dir):
    """A passport's ten digits, said again far from the word for it, are a phone number there."""
    return _policy(spark, sf_dir)[2]


@query(f"SELECT doc_id AS request_id, before || value || after || ' И ещё раз ' || value AS restored FROM {_CORPUS} c WHERE entity IS NULL OR entity NOT IN {_BLOCKED}")
def policy_restored(spark, sf_dir):
    passed, _, vault = _policy(spark, sf_dir)
    return M.restore(passed.select("request_id", F.col("masked").alias("text")), vault).select("request_id", "restored")


_SAID = "SELECT conv_id, turn, role, coalesce(text, '') || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Пишите на user' || CAST(conv_id AS STRING) || '@mail.example.com сегодня' WHEN 1 THEN ' Карта 5321 3012 4417 8904 годна' ELSE '' END AS text FROM {conversations}"


@query(f"SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN replace(text, 'user' || CAST(conv_id AS STRING) || '@mail.example.com', '<EMAIL_1>') ELSE text END AS masked FROM ({_SAID.replace('{conversations}', 'conversations')}) t WHERE NOT (coalesce(role, '') = 'user' AND (conv_id + turn) % 5 = 1)")
def policy_by_role(spark, sf_dir):
    """Users' turns with an address are masked and those with a card rejected; answers with either are never searched."""
    turns = spark.sql(_SAID, conversations=_table(spark, sf_dir, "conversations"))
    found = D.detect(turns, detectors=(D.EMAIL, D.CARD), key="conv_id")
    return M.apply_policy(found, {"EMAIL": "MASK", "BANK_CARD_NUMBER": "BLOCK"}, key="conv_id", role="role")[0].select("conv_id", "turn", "role", "masked")


# --- evaluation ----------------------------------------------------------------

_LABELS = sorted({x[3] for x in CASES if x[3]}) + ["NAME"]


def _sides(spark, sf_dir):
    c = corpus(spark, sf_dir)
    gold = spark.sql(GOLD_SQL, corpus=c)
    pred = spark.sql(PRED_SQL.replace("({gold}) g", "{gold}"), gold=gold)
    return tuple(d.withColumnsRenamed({"s": "start", "e": "end"}) for d in (gold, pred))


_GRID = "(VALUES " + ", ".join(f"('{x}')" for x in _LABELS) + ") l(label)"


def _metrics_sql(counts: str, digits: int) -> str:
    return f"""
WITH k AS ({counts}), every AS (SELECT * FROM k UNION ALL SELECT 'COMBINED', label, TP, FP, FN FROM k),
f AS (SELECT s.subset, l.label, CAST(coalesce(sum(TP), 0) AS BIGINT) AS TP, CAST(coalesce(sum(FP), 0) AS BIGINT) AS FP, CAST(coalesce(sum(FN), 0) AS BIGINT) AS FN
  FROM (SELECT DISTINCT subset FROM every) s CROSS JOIN {_GRID} LEFT JOIN every e ON e.subset = s.subset AND e.label = l.label GROUP BY ALL),
p AS (SELECT *, CASE WHEN TP + FP = 0 THEN 0 ELSE TP / (TP + FP) END AS p, CASE WHEN TP + FN = 0 THEN 0 ELSE TP / (TP + FN) END AS r FROM f),
m AS (SELECT subset, label, TP, FP, FN, round(p, {digits}) AS "Precision", round(r, {digits}) AS "Recall", round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, {digits}) AS "F1" FROM p)
SELECT * FROM m UNION ALL SELECT subset, 'MACRO', CAST(sum(TP) AS BIGINT), CAST(sum(FP) AS BIGINT), CAST(sum(FN) AS BIGINT),
  round(avg(round("Precision" * {10**digits})) FILTER (TP + FP + FN > 0)) / {10**digits}, round(avg(round("Recall" * {10**digits})) FILTER (TP + FP + FN > 0)) / {10**digits}, round(avg(round("F1" * {10**digits})) FILTER (TP + FP + FN > 0)) / {10**digits} FROM m GROUP BY subset
"""


def _match_sql(keys: str, distinct: bool) -> str:
    side = lambda q: f"SELECT {keys}, {'1' if distinct else 'count(*)'} AS n FROM (SELECT subset, doc_id, label, s, e, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM ({q}) q) w GROUP BY {keys}"
    return f"""SELECT subset, label, CAST(sum(least(g, p)) AS BIGINT) AS TP, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS FP, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS FN
FROM (SELECT {keys}, coalesce(a.n, 0) AS g, coalesce(b.n, 0) AS p FROM ({side(_GOLD)}) a FULL JOIN ({side(_PRED)}) b USING ({keys})) j GROUP BY subset, label"""


@query(_metrics_sql(_match_sql("subset, doc_id, label, text", False), 3))
def bag_scores(spark, sf_dir):
    return E.metrics(E.bag_match(*_sides(spark, sf_dir), _LABELS), _LABELS)


@query(_metrics_sql(_match_sql("subset, doc_id, label, s, e", True), 4))
def exact_scores(spark, sf_dir):
    return E.metrics(E.exact_match(*_sides(spark, sf_dir), _LABELS), _LABELS, 4)


_CHARS = f"""
SELECT subset, label, CAST(coalesce(sum(tp), 0) AS BIGINT) AS TP, CAST(coalesce(sum(p), 0) - coalesce(sum(tp), 0) AS BIGINT) AS FP, CAST(coalesce(sum(g), 0) - coalesce(sum(tp), 0) AS BIGINT) AS FN
FROM (SELECT subset, label, e - s AS g, 0 AS p, 0 AS tp FROM (SELECT subset, doc_id, label, min(s) AS s, max(e) AS e FROM ({_GOLD}) a GROUP BY ALL) x
  UNION ALL SELECT subset, label, 0, e - s, 0 FROM (SELECT subset, doc_id, label, min(s) AS s, max(e) AS e FROM ({_PRED}) a GROUP BY ALL) y
  UNION ALL SELECT subset, label, 0, 0, least(a.e, b.e) - greatest(a.s, b.s) FROM (SELECT subset, doc_id, label, min(s) AS s, max(e) AS e FROM ({_GOLD}) a GROUP BY ALL) a
    JOIN (SELECT subset, doc_id, label, min(s) AS s, max(e) AS e FROM ({_PRED}) a GROUP BY ALL) b USING (subset, doc_id, label)) u GROUP BY subset, label
"""


@query(_metrics_sql(_CHARS, 4))
def char_scores(spark, sf_dir):
    return E.metrics(E.char_match(*_sides(spark, sf_dir), _LABELS), _LABELS, 4)


@query(f"SELECT label, count(p.doc_id) AS found, count(*) AS total, round(count(p.doc_id) / count(*), 4) AS recall FROM ({_GOLD}) g LEFT JOIN (SELECT DISTINCT doc_id, s, e FROM ({_PRED}) q) p USING (doc_id, s, e) GROUP BY label")
def recall_of_any_type(spark, sf_dir):
    return E.recall_any_type(*_sides(spark, sf_dir))


@query(f"SELECT 'FP' AS kind, subset, doc_id, label, s, e, text FROM ({_PRED}) p WHERE NOT EXISTS (SELECT 1 FROM ({_GOLD}) g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.s = p.s AND g.e = p.e) UNION ALL SELECT 'FN', subset, doc_id, label, s, e, text FROM ({_GOLD}) g WHERE NOT EXISTS (SELECT 1 FROM ({_PRED}) p WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.s = p.s AND g.e = p.e)")
def error_list(spark, sf_dir):
    got = E.errors(*_sides(spark, sf_dir))
    return got.select("kind", "subset", "doc_id", "label", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "text")


@query(f"SELECT doc_id, CASE label WHEN 'EMAIL' THEN 'private_email' ELSE 'private_phone' END AS label FROM ({_GOLD}) g WHERE label IN ('EMAIL', 'PHONE_NUMBER')")
def mapped_labels(spark, sf_dir):
    mapping = spark.createDataFrame([("EMAIL", "private_email"), ("PHONE_NUMBER", "private_phone")], "label string, to string")
    return E.map_labels(_sides(spark, sf_dir)[0], mapping).select("doc_id", "label")


_F1 = f"SELECT label, \"F1\" FROM ({_metrics_sql('{counts}', 4)}) m WHERE subset = 'COMBINED' AND label <> 'MACRO'"


@query(f"WITH x AS ({_F1.replace('{counts}', _match_sql('subset, doc_id, label, s, e', True))}), y AS ({_F1.replace('{counts}', _CHARS)}), w AS (SELECT label, x.\"F1\" AS places, y.\"F1\" AS chars FROM x JOIN y USING (label)) SELECT * FROM w UNION ALL SELECT 'MACRO', round(avg(round(places * 10000))) / 10000, round(avg(round(chars * 10000))) / 10000 FROM w")
def compared_models(spark, sf_dir):
    gold, pred = _sides(spark, sf_dir)
    one = lambda counts, name: E.metrics(counts, _LABELS, 4, by_subset=False).where("label <> 'MACRO'").select("label", F.lit(name).alias("model"), "F1")
    return E.compare_models(one(E.exact_match(gold, pred, _LABELS), "places").union(one(E.char_match(gold, pred, _LABELS), "chars")), ["places", "chars"])


_INTERVALS = "SELECT o_custkey AS doc_id, CAST(o_orderkey * 13 % 300 AS BIGINT) AS start, CAST(o_orderkey * 13 % 300 + o_orderkey % 19 + 1 AS BIGINT) AS end FROM {orders}"


@query(f"""
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM ({_INTERVALS.replace('{orders}', 'orders').replace('AS end', 'AS "end"')}) i) n) s GROUP BY doc_id, island
""")
def united_intervals(spark, sf_dir):
    return E.union_intervals(spark.sql(_INTERVALS, orders=_table(spark, sf_dir, "orders")), ["doc_id"])


# --- corpus preparation --------------------------------------------------------

_MIXED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN before || value || after WHEN 1 THEN 'Їжак ' || before WHEN 2 THEN 'only latin here ' || before ELSE '12345' END AS text FROM {corpus}"


@query(f"SELECT doc_id FROM (SELECT doc_id, len(regexp_extract_all(text, '[а-яА-ЯёЁ]')) AS c, len(regexp_extract_all(text, '[a-zA-Zа-яА-ЯёЁ]')) AS n, regexp_matches(text, '[ЇїЄєІі]') AS u FROM ({_MIXED.replace('{corpus}', _CORPUS + ' c')}) m) t WHERE n > 0 AND c / n >= 0.7 AND NOT u")
def russian_texts(spark, sf_dir):
    return spark.sql(_MIXED, corpus=corpus(spark, sf_dir)).where(P.is_russian(F.col("text"))).select("doc_id")


_SOURCE_LABELS = "CASE o_orderkey % 6 WHEN 0 THEN 'First_Name' WHEN 1 THEN 'last_name' WHEN 2 THEN 'address_city' WHEN 3 THEN 'ADDRESS' WHEN 4 THEN 'email' ELSE 'date' END"


@query(f"SELECT CASE WHEN lower(l) IN ('first_name', 'last_name') THEN 'NAME' WHEN lower(l) IN ('address_city', 'address') THEN 'ADDRESS' ELSE l END AS label, count(*) AS n FROM (SELECT {_SOURCE_LABELS} AS l FROM orders) t GROUP BY 1")
def normalized_label_counts(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select(F.array(F.expr(_SOURCE_LABELS)).alias("labels"))
    return P.label_counts(df.withColumn("labels", P.normalize_labels(F.col("labels"))), "labels")


_PAIRS = {  # tokens and tags of a case; the entities they make
    0: ([("Иван", "B-FIRST_NAME"), ("Петров", "L-LAST_NAME"), ("тут", "O")], [("NAME", "Иван Петров")]),
    1: ([("Иван", "U-FIRST_NAME"), ("Петров", "U-LAST_NAME"), ("Олег", "U-FIRST_NAME")], [("NAME", "Иван Петров"), ("NAME", "Олег")]),
    2: ([("Москва", "U-CITY"), (",", "O"), ("ул", "O"), ("Мира", "U-STREET"), ("дом", "O"), ("5", "U-HOUSE")], [("ADDRESS", "Москва , ул Мира дом 5")]),
    3: ([("Мира", "I-STREET"), (" ", "O"), ("весна", "B-EMAIL"), ("пришла", "O")], [("ADDRESS", "Мира")]),
}
_PAIR_TEXT = {k: " ".join(t.strip() for t, _ in v[0] if t.strip()) for k, v in _PAIRS.items()}


@query("SELECT c_custkey AS doc_id, x.label AS label, x.value AS value FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 " + " ".join(f"WHEN {k} THEN [" + ", ".join(f"{{'label': '{a}', 'value': '{b}'}}" for a, b in v[1]) + "]" for k, v in _PAIRS.items()) + " END) AS x FROM customer) t")
def token_annotations(spark, sf_dir):
    """Tags of other kinds than names and addresses are normalised away first."""
    pairs = F.array(*[F.array(*[F.struct(F.lit(t).alias("token"), F.lit(g).alias("tag")) for t, g in v[0]]) for v in _PAIRS.values()])
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(pairs, (F.col("c_custkey") % 4 + 1).cast("int")).alias("pairs"))
    tags = P.normalize_tags(F.transform("pairs", lambda p: p["tag"]))
    df = df.withColumn("pairs", F.zip_with("pairs", tags, lambda p, t: F.struct(p["token"].alias("token"), t.alias("tag"))))
    got = P.annotate_tokens(df).select("doc_id", "text", F.explode("ents").alias("e"))
    return got.select("doc_id", F.col("e.label").alias("label"), F.substr("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value"))


_SPLIT_HASH = "CAST(('0x' || substr(md5(CAST({k} AS STRING) || '/42'), 1, 8)) AS BIGINT)"


@query(f"SELECT c_custkey, CASE WHEN {_SPLIT_HASH.format(k='c_custkey')} < {int(0.9 * 2**32)} THEN 'train' ELSE 'test' END AS split FROM customer")
def hash_split(spark, sf_dir):
    return P.split(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "split")


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(c_custkey AS STRING) || '/42'), c_custkey) <= floor(0.9 * (SELECT count(*) FROM customer)) THEN 'train' ELSE 'test' END AS split FROM customer")
def exact_split(spark, sf_dir):
    return P.split(_table(spark, sf_dir, "customer"), "c_custkey", exact=True).select("c_custkey", "split")


def _annotated(spark, sf_dir):
    c = corpus(spark, sf_dir)
    ents = F.when(F.col("entity").isNotNull(), F.array(F.struct(F.length("before").alias("start"), F.length(F.concat("before", "value")).alias("end"), F.col("entity").alias("label")))).otherwise(F.array()).cast(P.ENTS)
    return c.select("doc_id", "text", ents.alias("ents"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), F.when(F.col("doc_id") % 2 == 0, "base").otherwise("synth").alias("source"))


@query(f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS docs, count(entity) AS with_entities, round(100 * count(entity) / count(*), 1) AS percent, count(entity) AS entities, count(*) - count(entity) AS negatives FROM {_CORPUS} c GROUP BY 1")
def split_statistics(spark, sf_dir):
    return P.split_stats(_annotated(spark, sf_dir))


@query(f"SELECT entity AS label, CAST(min(length(value)) AS BIGINT) AS least, CAST(list_sort(list(length(value)))[len(list(length(value))) // 2 + 1] AS BIGINT) AS median, CAST(max(length(value)) AS BIGINT) AS most FROM {_CORPUS} c WHERE entity IS NOT NULL GROUP BY entity")
def length_statistics(spark, sf_dir):
    got = P.length_stats(_annotated(spark, sf_dir))
    return got.select("label", *[F.col(c).cast("long").alias(c) for c in ("least", "median", "most")])


@query(f"SELECT label, n, value, CAST(rank AS BIGINT) AS rank FROM (SELECT entity AS label, CAST(length(value) AS BIGINT) AS n, value, row_number() OVER (PARTITION BY entity ORDER BY length(value) DESC, encode(value)) AS rank FROM {_CORPUS} c WHERE entity IS NOT NULL) t WHERE rank <= 5")
def longest_entities(spark, sf_dir):
    return P.longest(_annotated(spark, sf_dir)).select("label", F.col("n").cast("long").alias("n"), "value", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS STRING) || '/42'), c_custkey LIMIT 20")
def sampled_docs(spark, sf_dir):
    return P.sample_docs(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 20)


@query(f"SELECT doc_id, substr(before || CASE WHEN entity IS NULL THEN value ELSE '>>' || entity || ':' || value || '<<' END || after, 1, 300) AS shown FROM {_CORPUS} c")
def highlighted(spark, sf_dir):
    return _annotated(spark, sf_dir).select("doc_id", M.highlight(F.col("text"), F.col("ents")).alias("shown"))


_RECORDS = "SELECT doc_id, before || value || after || ' ' || value AS text, CASE doc_id % 4 WHEN 0 THEN CAST(NULL AS STRING) ELSE value END AS word FROM {corpus}"


@query(f"SELECT doc_id, CAST(length(before) AS BIGINT) AS s, CAST(length(before) + length(value) AS BIGINT) AS e FROM {_CORPUS} c WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, length(before || value || after) + 1, length(before || value || after || value) + 1 FROM {_CORPUS} c WHERE doc_id % 4 <> 0")
def substring_annotations(spark, sf_dir):
    recs = spark.sql(_RECORDS, corpus=corpus(spark, sf_dir))
    good, _ = P.annotate_substrings(recs.withColumn("entities", F.array(F.struct(F.col("word").alias("text"), F.lit("NAME").alias("type")))))
    return good.select("doc_id", F.explode("ents").alias("x")).select("doc_id", F.col("x.start").cast("long").alias("s"), F.col("x.end").cast("long").alias("e"))


@query(f"SELECT doc_id FROM {_CORPUS} c WHERE doc_id % 4 = 0")
def rejected_records(spark, sf_dir):
    recs = spark.sql(_RECORDS, corpus=corpus(spark, sf_dir))
    return P.annotate_substrings(recs.withColumn("entities", F.array(F.struct(F.col("word").alias("text"), F.lit("NAME").alias("type")))))[1].select("doc_id")


@query(f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'synth' END AS source, count(*) AS n FROM {_CORPUS} c GROUP BY 1, 2")
def pooled_sources(spark, sf_dir):
    a = _annotated(spark, sf_dir)
    return S.source_counts(S.pool(a.where("source = 'base'"), a.where("source = 'synth'")))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS turn, role, text AS content FROM conversations")
def chat_round_trip(spark, sf_dir):
    got = S.chat_turns(S.chat_texts(_table(spark, sf_dir, "conversations")), "conv_id")
    return got.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "content")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_LINES = "SELECT doc_id, before || value || after AS text, value AS word, coalesce(entity, 'NAME') AS kind, doc_id % 7 = 0 AS broken FROM {corpus}"


def _records(spark, sf_dir):
    """The corpus as JSON lines in two appends; every seventh line is cut off in the middle, and blank lines lie between."""
    path, rows = _new_folder(spark, "records"), spark.sql(_LINES, corpus=corpus(spark, sf_dir))
    good = rows.where("NOT broken").select(F.col("doc_id").cast("string").alias("id"), "text", F.array(F.struct(F.col("word").alias("text"), F.col("kind").alias("type"))).alias("entities"))
    S.append_records(good.where("CAST(id AS BIGINT) % 2 = 0"), path)
    S.append_records(good.where("CAST(id AS BIGINT) % 2 = 1"), path)
    broken = rows.where("broken").select(F.concat(F.lit('{"id": "'), F.col("doc_id").cast("string"), F.lit('", "text')).alias("value"))
    broken.union(rows.where("broken").select(F.lit("  "))).write.mode("append").text(path)
    return S.read_records(spark, path)


@query(f"SELECT CAST(doc_id AS STRING) AS id, text, word, kind FROM ({_LINES.replace('{corpus}', _CORPUS + ' c')}) t WHERE NOT broken")
def json_records(spark, sf_dir):
    one = F.element_at("entities", 1)
    return _records(spark, sf_dir)[0].select("id", "text", one["text"].alias("word"), one["type"].alias("kind"))


@query(f"""SELECT '{{"id": "' || CAST(doc_id AS STRING) || '", "text' AS line FROM {_CORPUS} c WHERE doc_id % 7 = 0""")
def json_rejects(spark, sf_dir):
    return _records(spark, sf_dir)[1]


@query(f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, doc_id, before || value || after AS text, CASE WHEN entity IS NULL THEN 0 ELSE 1 END AS n FROM {_CORPUS} c")
def annotated_files(spark, sf_dir):
    """Written by split and read back, with the counts compared."""
    back = S.write_annotated(_annotated(spark, sf_dir), _new_folder(spark, "annotated"))
    return back.select("split", "doc_id", "text", F.size("ents").alias("n"))


_OFFSETS = {  # texts with labelled places of several sources, and the entities that they make
    0: ("Иван Петров живёт тут", [(0, 4, "first_name"), (0, 11, "name"), (12, 17, "date")], [("NAME", "Иван Петров")]),
    1: ("Ивану Петрову, да", [(2, 8, "name")], [("NAME", "Ивану Петрову")]),
    2: ("Москва, ул. Мира, д. 5; Тверь и Мира", [(0, 6, "address_city"), (12, 16, "address_street"), (21, 22, "address_house"), (24, 29, "address_city"), (32, 36, "address_street")], [("ADDRESS", "Москва, ул. Мира, д. 5"), ("ADDRESS", "Тверь"), ("ADDRESS", "Мира")]),
    3: ("John пришёл с Олегом", [(0, 4, "name"), (14, 20, "first_name")], [("NAME", "Олегом")]),
    4: ("улица Ивана Петрова 5", [(6, 19, "name"), (0, 19, "address_street"), (20, 21, "address_house")], [("ADDRESS", "улица Ивана Петрова 5")]),
}


def _values_sql(table: dict) -> str:
    return "SELECT c_custkey AS doc_id, x.label AS label, x.value AS value FROM (SELECT c_custkey, unnest(CASE c_custkey % " + str(len(table)) + " " + " ".join(f"WHEN {k} THEN [" + ", ".join(f"{{'label': '{a}', 'value': '{b}'}}" for a, b in v[-1]) + "]" for k, v in table.items()) + " END) AS x FROM customer) t"


def _chosen(table: dict, value) -> Column:
    return F.element_at(F.array(*[value(v) for v in table.values()]), (F.col("c_custkey") % len(table) + 1).cast("int"))


@query(_values_sql(_OFFSETS))
def offset_annotations(spark, sf_dir):
    """Files with parallel arrays of labels, starts and ends, one for each split, to entities on token borders."""
    told = {c: _chosen(_OFFSETS, lambda v, k=k: F.array(*[F.lit(x[k]) for x in v[1]])) for c, k in (("entity_starts", 0), ("entity_ends", 1), ("entity_labels", 2))}
    df = _table(spark, sf_dir, "customer").select("c_custkey", _chosen(_OFFSETS, lambda v: F.lit(v[0])).alias("text"), *[v.alias(k) for k, v in told.items()])
    paths = {}
    for part in ("train", "test"):
        paths[part] = _new_folder(spark, part)
        # the text carries the key, behind a mark that belongs to no token
        df.where(F.col("c_custkey") % 2 == int(part == "test")).withColumn("text", F.concat("text", F.lit("\n"), F.col("c_custkey").cast("string"))).drop("c_custkey").write.parquet(paths[part])
    got = P.annotate_offsets(S.read_offsets(spark, paths)).select(F.substring_index("text", "\n", -1).cast("long").alias("doc_id"), "text", F.explode("ents").alias("e"))
    return got.select("doc_id", F.col("e.label").alias("label"), F.substr("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value"))


_TAGS = {  # tokens and tags with parts that nothing opens or closes; strictly read, only opened parts count
    0: ([("а", "I-CITY"), ("б", "B-STREET"), ("в", "I-STREET"), ("г", "O"), ("д", "U-HOUSE"), ("е", "L-HOUSE")], [("STREET", "б в"), ("HOUSE", "д")]),
    1: ([("Иван", "B-FIRST_NAME"), ("Ильич", "L-FIRST_NAME"), ("Мира", "L-STREET")], [("NAME", "Иван Ильич")]),
    2: ([("а", "B-CITY"), ("б", "B-CITY"), ("в", "L-CITY")], [("CITY", "а"), ("CITY", "б в")]),
}


@query(_values_sql(_TAGS))
def strict_tag_parts(spark, sf_dir):
    """Token files; parts without a beginning are dropped."""
    path = _new_folder(spark, "tokens")
    columns = [_chosen(_TAGS, lambda v, k=k: F.array(*[F.lit(x[k]) for x in v[0]], *([F.lit("")] * 1))).alias(c) for k, c in ((0, "tokens"), (1, "ner_tags"))]
    df = _table(spark, sf_dir, "customer").select("c_custkey", *columns)
    # the key goes along as a last token without a tag
    own = {"tokens": F.concat(F.slice("tokens", 1, F.size("tokens") - 1), F.array(F.col("c_custkey").cast("string"))), "ner_tags": F.concat(F.slice("ner_tags", 1, F.size("ner_tags") - 1), F.array(F.lit("O")))}
    df.withColumns(own).select("tokens", "ner_tags").write.parquet(path)
    text, tokens = P.tokens_text(F.col("pairs"))
    told = S.read_tokens(spark, path).select(text.alias("text"), tokens.alias("t")).select("text", F.explode(P.biolu_parts(F.col("t"), "drop")).alias("p"))
    return told.select(F.substring_index("text", " ", -1).cast("long").alias("doc_id"), F.col("p.label").alias("label"), F.substr("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("value"))


def _inn_tagger():
    """A stand-in for a user's model: it finds one word."""
    return lambda texts: [[("NAME", t.index("ИНН"), t.index("ИНН") + 3, 0.85)] if "ИНН" in t else [] for t in texts]


@query(f"SELECT doc_id, 'NAME' AS entity_type, CAST(strpos(before || value || after, 'ИНН') - 1 AS BIGINT) AS start_at, CAST(strpos(before || value || after, 'ИНН') + 2 AS BIGINT) AS end_at FROM {_CORPUS} c WHERE contains(before || value || after, 'ИНН')")
def tagged_spans(spark, sf_dir):
    got = tagged(corpus(spark, sf_dir), _inn_tagger)
    return got.select("doc_id", "entity_type", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


# --- plans and their checks ----------------------------------------------------


def _drawn_sql(dimension: str, weights: dict[str, float], key: str) -> str:
    """The alias table's cells as three lists."""
    table = G.aliases(weights)
    values, others, shares = (", ".join(f"'{v}'" for v in x) if k < 2 else ", ".join(f"{v!r}::DOUBLE" for v in x) for k, x in enumerate(zip(*table, strict=True)))
    at, cell = f"u_{dimension} * {len(table)}", f"CAST(floor(u_{dimension} * {len(table)}) AS INT) + 1"
    return f"CASE WHEN {at} - floor({at}) < [{shares}][{cell}] THEN [{values}][{cell}] ELSE [{others}][{cell}] END"


def _uniform_sql(dimension: str, key: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS STRING) || '/{dimension}/42'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296"


_PLAN_PARTS = {  # some values of each part, to draw from
    "surname_M": ["Петров", "Сидоров", "Орлов"], "surname_F": ["Петрова", "Ковалёва", "Седых"], "first_M": ["Иван", "Олег"], "first_F": ["Анна", "Ольга", "Вера"],
    "patronymic_M": ["Ильич", "Петрович"], "patronymic_F": ["Ильинична", "Петровна"], "city": ["Тверь", "Омск", "Великие Луки"], "region": ["Тверская область", "Омская область"],
    "street_type": ["ул.", "пер.", "проспект", "переулок"], "street": ["Мира", "Садовая", "Ленина"],
}
_WHOLE = sum(G.WEIGHTS["domain"].values())
_PLAN_DIMENSIONS = [*G.WEIGHTS, "edge", "edge_case", "typo", "multi", "second"] + [f"{d}{k}" for k in ("", "_2") for d in ("gender", "surname", "surname_other", "first", "patronymic", "city", "street_type", "street", "region", "house", "apartment", "entrance", "postal_code", "suffix", "village", "village_house")]
_EDGES = {"named AND placed": G.NAME_EDGES + G.ADDRESS_EDGES, "named": G.NAME_EDGES, "placed": G.ADDRESS_EDGES}


def _one_sql(values: list[str], u: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(floor({u} * {len(values)}) AS INT) + 1]"


def _number_sql(low: int, high: int, u: str) -> str:
    return f"CAST(CAST(floor({u} * {high - low + 1}) AS INT) + {low} AS STRING)"


def _name_sql(k: str) -> str:
    of = lambda part, d: f"CASE WHEN u_gender{k} < 0.5 THEN {_one_sql(_PLAN_PARTS[part + '_M'], f'u_{d}{k}')} ELSE {_one_sql(_PLAN_PARTS[part + '_F'], f'u_{d}{k}')} END"
    edge = "coalesce(edge_case, '') = 'hyphenated_surname'" if not k else "false"
    return f"CASE WHEN u_gender{k} < 0.5 THEN 'M' ELSE 'F' END AS gender{k}, {of('surname', 'surname')} || CASE WHEN {edge} THEN '-' || {of('surname', 'surname_other')} ELSE '' END AS surname{k}, {of('first', 'first')} AS first{k}, {of('patronymic', 'patronymic')} AS patronymic{k}"


def _address_sql(k: str) -> str:
    edge = "coalesce(edge_case, '')" if not k else "''"
    city, kind, street, region = (_one_sql(_PLAN_PARTS[p], f"u_{p}{k}") for p in ("city", "street_type", "street", "region"))
    house = _number_sql(1, 200, f"u_house{k}")
    return f"""lower(left({city}, 3)) AS abbr{k}, {region} AS region{k},
      CASE {edge} WHEN 'lowercase_city' THEN lower({city}) WHEN 'village_vs_house_d' THEN 'д. ' || {_one_sql(_PLAN_PARTS['city'], f'u_village{k}')} ELSE {city} END AS city{k},
      CASE {edge} WHEN 'abbr_no_dot' THEN rtrim({kind}, '.') WHEN 'lowercase_city' THEN lower({kind}) ELSE {kind} END AS kind{k}, CASE {edge} WHEN 'lowercase_city' THEN lower({street}) ELSE {street} END AS street{k},
      CASE {edge} WHEN 'complex_house_number' THEN {house} || {_one_sql(G.HOUSE_SUFFIXES, f'u_suffix{k}')} WHEN 'village_vs_house_d' THEN {_number_sql(1, 50, f'u_village_house{k}')} ELSE {house} END AS house{k},
      {_number_sql(1, 400, f'u_apartment{k}')} AS flat{k}, {_number_sql(1, 8, f'u_entrance{k}')} AS door{k}, {_number_sql(100_000, 999_999, f'u_postal_code{k}')} AS code{k}"""


def _address_text_sql(k: str) -> str:
    edge = "coalesce(edge_case, '')" if not k else "''"
    head = f"CASE WHEN {edge} = 'no_space_after_dot' THEN replace(kind{k} || ' ', '. ', '.') ELSE kind{k} || ' ' END"
    line = f"({head} || street{k} || ' ' || house{k})"
    text = f"""CASE addr_form WHEN 'ADDR_FULL' THEN 'г. ' || city{k} || ', ' || {head} || street{k} || ', д. ' || house{k} || ', кв. ' || flat{k} WHEN 'ADDR_CSH' THEN city{k} || ', ' || {line}
      WHEN 'ADDR_SHA' THEN {line} || ' кв. ' || flat{k} WHEN 'ADDR_SH' THEN {line} WHEN 'ADDR_SHAP' THEN {line} || ' кв. ' || flat{k} || ' подъезд ' || door{k}
      WHEN 'ADDR_ABBR' THEN abbr{k} || ', ' || street{k} || ' ' || house{k} || ' кв ' || flat{k} WHEN 'ADDR_WORDS' THEN 'улица ' || street{k} || ' дом ' || house{k} || ' квартира ' || flat{k}
      WHEN 'ADDR_REGION' THEN region{k} || ', ' || city{k} || ', ' || {line} WHEN 'ADDR_LOW' THEN lower(kind{k} || ' ' || street{k} || ' ' || house{k} || ' кв. ' || flat{k})
      WHEN 'ADDR_INDEX' THEN code{k} || ', г. ' || city{k} || ', ' || {head} || street{k} || ', д. ' || house{k} END"""
    typo = " ".join(f"WHEN contains({text}, '{right}') THEN regexp_replace({text}, '{right}', '{wrong}')" for right, wrong in G.TYPOS.items())
    return f"CASE WHEN {edge} <> 'typo_in_addr' THEN {text} {typo} ELSE {text} END"


_NAME_TEXT_SQL = """CASE regexp_replace(name_form, '_(GEN|DAT)$', '') WHEN 'NAME_FI' THEN surname || ' ' || first WHEN 'NAME_IF' THEN first || ' ' || surname WHEN 'NAME_FIO' THEN surname || ' ' || first || ' ' || patronymic
  WHEN 'NAME_IFO' THEN first || ' ' || patronymic || ' ' || surname WHEN 'NAME_IO' THEN first || ' ' || patronymic WHEN 'NAME_I' THEN first
  WHEN 'NAME_INITF' THEN left(first, 1) || '.' || gap || left(patronymic, 1) || '. ' || surname WHEN 'NAME_FINIT' THEN surname || ' ' || left(first, 1) || '.' || gap || left(patronymic, 1) || '.' END"""
_NAMED = "entity_type IN ('NAME_ONLY', 'BOTH', 'NAME_CONTEXT')"
_PLACED = "entity_type IN ('ADDRESS_ONLY', 'BOTH')"
_PLAN_SQL = f"""
WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 + (SELECT count(*) FROM nation) AS row FROM customer),
u AS (SELECT row, {", ".join(f"{_uniform_sql(d, 'row')} AS u_{d}" for d in _PLAN_DIMENSIONS)} FROM r),
k AS (SELECT *, {_drawn_sql('entity_type', G.WEIGHTS['entity_type'], 'row')} AS entity_type FROM u),
d AS (SELECT *, {_NAMED} AS named, {_PLACED} AS placed,
  CASE entity_type WHEN 'NAME_ONLY' THEN {_drawn_sql('domain', {x: w / _WHOLE for x, w in G.WEIGHTS['domain'].items()} | {'NAME': G.EXTRA_DOMAIN}, 'row')}
    WHEN 'ADDRESS_ONLY' THEN {_drawn_sql('domain', {x: w / _WHOLE for x, w in G.WEIGHTS['domain'].items()} | {'ADDRESS': G.EXTRA_DOMAIN}, 'row')} ELSE {_drawn_sql('domain', G.WEIGHTS['domain'], 'row')} END AS domain,
  CASE WHEN {_NAMED} THEN {_drawn_sql('name_form', G.WEIGHTS['name_form'], 'row')} END AS name_form, CASE WHEN {_PLACED} THEN {_drawn_sql('addr_form', G.WEIGHTS['addr_form'], 'row')} END AS addr_form,
  {", ".join(f"{_drawn_sql(x, G.WEIGHTS[x], 'row')} AS {x}" for x in ('style', 'length', 'expression'))},
  CASE WHEN entity_type = 'NEGATIVE' THEN {_drawn_sql('neg_category', G.WEIGHTS['neg_category'], 'row')} END AS neg_category,
  entity_type <> 'NEGATIVE' AND u_typo < {G.TYPO_SHARE} AS has_typo, entity_type IN ('NAME_ONLY', 'ADDRESS_ONLY', 'BOTH') AND u_multi < {G.MULTI_SHARE} AS multi_entity FROM k),
e AS (SELECT *, CASE WHEN entity_type <> 'NEGATIVE' AND u_edge < {G.EDGE_SHARE} THEN CASE {" ".join(f"WHEN {when} THEN {_one_sql(values, 'u_edge_case')}" for when, values in _EDGES.items())} END END AS edge_case,
  CASE WHEN entity_type = 'NEGATIVE' THEN NULL WHEN multi_entity THEN {_drawn_sql('position', G.WEIGHTS['position_multi'], 'row')} ELSE {_drawn_sql('position', G.WEIGHTS['position'], 'row')} END AS position,
  CASE WHEN entity_type = 'NEGATIVE' THEN 'neg_synth' ELSE CASE domain {" ".join(f"WHEN '{x}' THEN '{y}'" for x, y in G.PREFIXES.items())} END END AS id_prefix FROM d),
f AS (SELECT *, CASE WHEN coalesce(edge_case, '') = 'initials_no_space' THEN '' ELSE ' ' END AS gap, multi_entity AND named AND (NOT placed OR u_second < 0.5) AS again, {_name_sql('')}, {_name_sql('_2')}, {_address_sql('')}, {_address_sql('_2')} FROM e)
SELECT row, entity_type, domain, name_form, addr_form, style, length, expression, neg_category, edge_case, has_typo, multi_entity, position, id_prefix, id_prefix || '_' || lpad(CAST(row + 1 AS STRING), CAST(greatest(4, length(CAST(row + 1 AS STRING))) AS INT), '0') AS id,
  CASE WHEN named THEN gender END AS gender, CASE WHEN named THEN surname || ' ' || first || ' ' || patronymic END AS full_fio, CASE WHEN named THEN {_NAME_TEXT_SQL} END AS name_text,
  CASE WHEN placed THEN city || '|' || abbr || '|' || region || '|' || kind || '|' || street || '|' || house || '|' || flat || '|' || door || '|' || code END AS address, CASE WHEN placed THEN {_address_text_sql('')} END AS address_text,
  CASE WHEN again THEN surname_2 || ' ' || first_2 || ' ' || patronymic_2 END AS full_fio_2, CASE WHEN multi_entity AND placed AND NOT again THEN {_address_text_sql('_2')} END AS address_text_2 FROM f
"""


def _plans(spark, sf_dir):
    """Keys with gaps, and ids that continue after as many rows as nation has."""
    return G.plans_for(_table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7919 + 11).alias("key")), "key", existing=_table(spark, sf_dir, "nation"))


@query(_PLAN_SQL)
def plan_rows(spark, sf_dir):
    got = G.with_data(_plans(spark, sf_dir), _PLAN_PARTS)
    address = F.concat_ws("|", *[F.col(f"addr_data.{c}") for c in ("city", "city_abbr", "region", "street_type", "street_name", "house", "apartment", "entrance", "postal_code")])
    plain = [c for c in got.columns if c not in ("name_data", "name_text", "addr_data", "name_data_2", "addr_data_2")]
    return got.select(*plain, F.col("name_data.gender").alias("gender"), F.col("name_data.full_fio").alias("full_fio"), "name_text", F.when(F.col("addr_data").isNotNull(), address).alias("address"), F.col("addr_data.address_string").alias("address_text"), F.col("name_data_2.full_fio").alias("full_fio_2"), F.col("addr_data_2.address_string").alias("address_text_2"))


_MIXED_DIMENSIONS = ["entity_type", "name_form", "addr_form", "style", "length", "expression", "neg_category"]


@query(f"WITH p AS ({_PLAN_SQL}), s AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM p WHERE {d} IS NOT NULL GROUP BY 2" for d in _MIXED_DIMENSIONS) + """),
a AS (SELECT dimension, value, n / sum(n) OVER (PARTITION BY dimension) AS share, n FROM s),
w AS (SELECT dimension, value, w / sum(w) OVER (PARTITION BY dimension) AS w FROM (VALUES """ + ", ".join(f"('{d}', '{k}', {v}::DOUBLE)" for d in _MIXED_DIMENSIONS for k, v in G.WEIGHTS[d].items()) + """) t(dimension, value, w))
SELECT w.dimension, w.value, coalesce(n, 0) AS n, round(coalesce(share, 0), 6) AS share, round(w, 6) AS target, round(coalesce(share, 0) - w, 6) AS difference FROM w LEFT JOIN a USING (dimension, value)""")
def plan_mix(spark, sf_dir):
    """All dimensions that each plan draws once, against their weights."""
    return G.mix_audit(_plans(spark, sf_dir), G.weight_table(spark), _MIXED_DIMENSIONS)


_FORMS = list(G.WEIGHTS["addr_form"])
_ADDRESS = {"ADDR_FULL": "'г. Тверь, ул. Мира, д. ' || h || ', кв. ' || a", "ADDR_CSH": "'Тверь, ул. Мира ' || h", "ADDR_SHA": "'ул. Мира ' || h || ' кв. ' || a", "ADDR_SH": "'ул. Мира ' || h", "ADDR_SHAP": "'ул. Мира ' || h || ' кв. ' || a || ' подъезд 2'", "ADDR_ABBR": "'тве, Мира ' || h || ' кв ' || a", "ADDR_WORDS": "'улица Мира дом ' || h || ' квартира ' || a", "ADDR_REGION": "'Тверская область, Тверь, ул. Мира ' || h", "ADDR_LOW": "'ул. мира ' || h || ' кв. ' || a", "ADDR_INDEX": "'170100, г. Тверь, ул. Мира, д. ' || h"}


@query(f"SELECT k, CASE k % 10 {' '.join(f'WHEN {i} THEN {_ADDRESS[f]}' for i, f in enumerate(_FORMS))} END AS address FROM (SELECT c_custkey AS k, CAST(c_custkey % 200 + 1 AS STRING) AS h, CAST(c_custkey % 400 + 1 AS STRING) AS a FROM customer) t")
def composed_addresses(spark, sf_dir):
    k = F.col("c_custkey")
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (k % 10 + 1).cast("int"))
    text = G.compose_address(form, F.lit(None).cast("string"), F.lit("Тверь"), F.lit("ул."), F.lit("Мира"), (k % 200 + 1).cast("string"), (k % 400 + 1).cast("string"), F.lit("2"), F.lit("170100"), F.lit("Тверская область"), F.lit(0.0))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), text.alias("address"))


@query("SELECT k, CASE k % 8 WHEN 0 THEN 'Петров Иван' WHEN 1 THEN 'Иван Петров' WHEN 2 THEN 'Петров Иван Ильич' WHEN 3 THEN 'Иван Ильич Петров' WHEN 4 THEN 'Иван Ильич' WHEN 5 THEN 'Иван' WHEN 6 THEN 'И. И. Петров' ELSE 'Петров И. И.' END AS name FROM (SELECT c_custkey AS k FROM customer) t")
def composed_names(spark, sf_dir):
    k = F.col("c_custkey")
    forms = ["NAME_FI", "NAME_IF", "NAME_FIO", "NAME_IFO", "NAME_IO", "NAME_I", "NAME_INITF", "NAME_FINIT"]
    name = G.compose_name(F.element_at(F.array(*map(F.lit, forms)), (k % 8 + 1).cast("int")), F.lit(None).cast("string"), F.lit("Петров"), F.lit("Иван"), F.lit("Ильич"), F.lit("Сидоров"))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("name"))


@query("SELECT c_custkey AS id, rule FROM customer, (VALUES (1, 'entity_in_text'), (2, 'types_agree'), (3, 'multi_has_two'), (4, 'position'), (5, 'length')) r(c, rule) WHERE c_custkey % 6 = c")
def record_checks(spark, sf_dir):
    c = F.col("c_custkey") % 6
    ent = F.struct(F.when(c == 1, "Олег").otherwise("Иван").alias("text"), F.when(c == 2, "ADDRESS").otherwise("NAME").alias("type"))
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("Иван пришёл сегодня рано утром.").alias("text"), F.array(ent).alias("entities"), F.lit("NAME_ONLY").alias("entity_type"), (c == 3).alias("multi_entity"), F.when(c == 4, "end").when(c == 1, "mixed").otherwise("beginning").alias("position"), F.when(c == 5, "long").otherwise("short").alias("length"))
    return Q.check_records(df)


@query("SELECT c_custkey AS id, 'address_verbatim' AS rule FROM customer WHERE c_custkey % 3 = 1")
def address_checks(spark, sf_dir):
    k = F.col("c_custkey")
    where = F.concat(F.lit("ул. Мира "), (k % 200).cast("string"))
    text = F.concat(F.lit("Он живёт: "), F.when(k % 3 == 1, F.upper(where)).otherwise(where), F.lit("."))
    ent = F.array(F.struct(F.regexp_extract(text, "(?i)ул. мира [0-9]+", 0).alias("text"), F.lit("ADDRESS").alias("type")))
    df = _table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text"), ent.alias("entities"), F.lit("ADDRESS_ONLY").alias("entity_type"), F.lit(False).alias("multi_entity"), F.lit("mixed").alias("position"), F.lit(None).cast("string").alias("length"), where.alias("address"))
    return Q.check_records(df, address="address")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS expression, count(*) FILTER (c_custkey % 5 = 0) AS position FROM customer")
def missing_fields(spark, sf_dir):
    k = F.col("c_custkey")
    return Q.missing_fields(_table(spark, sf_dir, "customer").select(F.when(k % 3 != 0, "joy").alias("expression"), F.when(k % 5 != 0, "end").alias("position")), ["expression", "position"])


# --- streams -------------------------------------------------------------------


@query(f"SELECT doc_id, before || CASE WHEN entity IS NULL THEN value ELSE '<' || entity || '_1>' END || after AS masked FROM {_CORPUS} c WHERE entity IS NULL OR entity NOT IN {_BLOCKED}")
def guarded_stream(spark, sf_dir):
    """The corpus as files of messages, through the guard until all are done, and read back."""
    from ..streaming.guard import guard

    base = f"{shared_folder(spark)}/guard-{uuid.uuid4().hex}"
    corpus(spark, sf_dir).select("doc_id", "text").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 64).parquet(f"{base}/in")
    guard(stream, _POLICY, f"{base}/out", f"{base}/state", key="doc_id", role=None).awaitTermination()
    return spark.read.parquet(f"{base}/out/passed").select("doc_id", "masked")


@query(f"SELECT doc_id AS request_id, value || ' и ' || value || ' <TOKEN_9>' AS restored FROM {_CORPUS} c WHERE doc_id % 3 <> 0")
def restored_stream(spark, sf_dir):
    """Answers in a stream meet the vault's maps in a stream; those of every third request come after its time and stay masked, so they are not here."""
    from ..streaming.guard import restore_stream

    base, docs = _new_folder(spark, "restored"), corpus(spark, sf_dir)
    asked = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 60)
    late = F.when(F.col("doc_id") % 3 == 0, 600).otherwise(30)
    docs.select(F.col("doc_id").alias("request_id"), F.create_map(F.lit("<T_1>"), F.col("value")).alias("values"), asked.alias("ts")).write.parquet(f"{base}/vault")
    docs.select(F.col("doc_id").alias("request_id"), F.lit("<T_1> и <T_1> <TOKEN_9>").alias("text"), F.timestamp_seconds(F.unix_timestamp(asked) + late).alias("ts")).write.parquet(f"{base}/answers")
    stream = lambda x: spark.readStream.schema(spark.read.parquet(f"{base}/{x}").schema).parquet(f"{base}/{x}")
    out = restore_stream(stream("answers"), stream("vault"))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").where("restored <> text").select("request_id", "restored")


_IN_TIME = "(doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 4 = 0))"


@query(f"SELECT doc_id AS request_id, 'Ответ: ' || before || CASE WHEN entity IS NULL OR {_IN_TIME} THEN value ELSE '<' || entity || '_1>' END || after AS restored, {_IN_TIME} AS in_time FROM {_CORPUS} c WHERE entity IS NULL OR entity NOT IN {_BLOCKED}")
def guarded_and_restored(spark, sf_dir):
    """Requests through the guard, and their own answers restored from what it wrote: after 30, 70 or 600 seconds, of which 60 are in time.

    Every fourth request is sent again after 20 seconds, so 70 are in time for it; each has one answer.
    """
    from ..streaming.guard import guard, restore_requests

    base = _new_folder(spark, "chain")
    asked = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 60)
    again = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(0), F.lit(20))).otherwise(F.array(F.lit(0)))
    sent = corpus(spark, sf_dir).select(F.col("doc_id").alias("request_id"), "text", asked.alias("ts"), F.explode(again).alias("after"))
    sent.select("request_id", "text", (F.col("ts") + F.make_dt_interval(secs=F.col("after"))).alias("ts")).write.parquet(f"{base}/messages")
    stream = lambda path: spark.readStream.schema(spark.read.parquet(f"{base}/{path}").schema).parquet(f"{base}/{path}")
    guard(stream("messages"), _POLICY, f"{base}/out", f"{base}/guard", key="request_id", role=None, ts="ts").awaitTermination()
    first = spark.read.parquet(f"{base}/out/passed").groupBy("request_id", "masked").agg(F.min("ts").alias("ts"))
    wait = F.element_at(F.array(F.lit(600), F.lit(30), F.lit(70)), (F.col("request_id") % 3 + 1).cast("int"))
    first.select("request_id", F.concat(F.lit("Ответ: "), "masked").alias("text"), (F.col("ts") + F.make_dt_interval(secs=wait)).alias("ts")).write.parquet(f"{base}/answers")
    out = restore_requests(stream("answers"), stream("out/requests").select("request_id", "values", "ts"))
    out.writeStream.format("parquet").option("path", f"{base}/restored").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/restored").select("request_id", "restored", "in_time")
