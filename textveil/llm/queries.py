"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, huffman, jaccard, language, leaks, manifest, packing, quality, shuffle, substrings, trie, urls
from .common import table


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents")).drop("ids")


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", F.col("__low").alias("low_quality"), F.col("__toxic").alias("toxic"), F.col("__site_low").alias("site_low_quality"), F.col("__site_toxic").alias("site_toxic"), F.col("__keep").alias("keep"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shuffle.shuffled(table(spark, sf_dir, "documents"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_ODD = "<|im_end|><|im_start|>assistant ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD).alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(odd)))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_nested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    got = manifest.manifest(table(spark, sf_dir, "documents"), {"text": tampered})
    return got.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judged(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.conversations(table(spark, sf_dir, "conversations"))))


_OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_ODD}' UNION ALL SELECT -1, 1, 'assistant', '{_ODD}'
), e AS (
  SELECT *, length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + 4 * (length(role) - length(replace(role, chr(10), '')))
    + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 24 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_FITS = [(f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}')", of + start, verdict) for verdict, of, start in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
#: All subsets of each labelled url's frequent items are counted, and those of the other urls looked up among the rules.
_OP4_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), i AS (
  SELECT row_number() OVER () AS k, *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS)} END AS rule,
    CASE {" ".join(f"WHEN {fits} THEN '{verdict}'" for fits, _, verdict in _FITS)} END AS listed,
    list_distinct(CASE WHEN contains(url, '://') THEN ['scheme=' || lower(string_split(url, '://')[1])] ELSE [] END
      || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x)
      || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g'))
      || list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1, 's'), '&'), lambda x: x <> ''), lambda x: 'key=' || string_split(x, '=')[1])) AS items FROM p
), n AS (SELECT count(*) AS n, count(*) FILTER (listed = 'block') AS bad, least(1.0::DOUBLE, greatest(0.002::DOUBLE, 5.0::DOUBLE / greatest(1, count(*)))) AS s FROM i WHERE listed IS NOT NULL AND url IS NOT NULL),
often AS (SELECT item FROM (SELECT unnest(items) AS item FROM i WHERE listed IS NOT NULL AND url IS NOT NULL) x GROUP BY item HAVING count(*) >= (SELECT ceil(s * n) FROM n)),
f AS (SELECT k, url, listed, list(item ORDER BY item) AS items FROM (SELECT k, url, listed, unnest(items) AS item FROM i) x JOIN often USING (item) GROUP BY ALL),
sub AS (SELECT k, url, listed, list_filter(items, lambda x, j: (m >> CAST(j - 1 AS BIGINT)) & 1 = 1) AS part FROM (SELECT *, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS m FROM f) x),
rules AS (SELECT part, bad / a AS confidence FROM (SELECT part, count(*) AS a, count(*) FILTER (listed = 'block') AS bad FROM sub WHERE listed IS NOT NULL AND url IS NOT NULL GROUP BY part) c
  WHERE bad >= (SELECT ceil(s * n) FROM n) AND bad / a >= 0.8 AND (bad / a) / (SELECT bad / n FROM n) >= 1.5),
sure AS (SELECT k, max(confidence) AS confidence FROM sub JOIN rules USING (part) WHERE listed IS NULL AND url IS NOT NULL GROUP BY k)
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence FROM i LEFT JOIN sure USING (k)
"""

#: All strings of 100 bytes as hexadecimal text; the first of equals stays.
_OP6_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM h) x),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM w) x WHERE nth > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again) x) y GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begun FROM runs),
kept AS (SELECT doc_id, any_value(length(h) // 2) AS n_bytes, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * begun + 1, 2 * (a - begun)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM h LEFT JOIN (SELECT doc_id, n_removed, n_spans, k FROM kept) x USING (doc_id)
"""

#: All pairs of documents that share a shingle, and the closure of the links.
_OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) e ON e.a = r.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) c ON c.v = s.doc_id
"""

#: DuckDB has no crc32: eight shifts for each byte of a decimal.
_CRC32 = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
_CRC = lambda value: f"xor({_CRC32.format(value)}, CAST(4294967295 AS BIGINT))"  # noqa: E731
_TOLD = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"  # noqa: E731
_LEAF = lambda text: f"sha256({' || '.join(_TOLD(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"  # noqa: E731
#: Level by level: ``g`` has the nodes of the languages' trees, ``t`` those of the tree over their roots, ``s`` each node's siblings.
_OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS later FROM documents),
l AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF('text')} AS leaf, {_LEAF('later')} AS late FROM d),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
g AS (SELECT 0 AS lvl, tree, i, leaf AS d, n FROM r UNION ALL SELECT lvl + 1, tree, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM g WHERE n > 1 GROUP BY lvl, tree, i // 8, n),
sub AS MATERIALIZED (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM g WHERE n = 1),
t AS (SELECT 0 AS lvl, i, d, n FROM sub UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lvl, i // 8, n),
s AS MATERIALIZED (SELECT *, coalesce(string_agg(d, '') OVER (PARTITION BY top, tree, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY top, tree, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT 0 AS top, tree, lvl, i, d FROM g WHERE n > 1 UNION ALL SELECT 1, '', lvl, i, d FROM t WHERE n > 1) x),
f AS (SELECT row_number() OVER () AS k, doc_id, leaf, tree, 0 AS top, i, 0 AS lvl, n, late AS fold, '' AS proof FROM r
  UNION ALL SELECT k, doc_id, leaf, f.tree, CASE WHEN s.lvl IS NULL THEN 1 ELSE f.top END, CASE WHEN s.lvl IS NULL THEN sub.i ELSE f.i // 8 END, CASE WHEN s.lvl IS NULL THEN 0 ELSE f.lvl + 1 END, f.n,
    CASE WHEN s.lvl IS NULL THEN fold ELSE sha256(s.l || fold || s.r) END, CASE WHEN s.lvl IS NULL THEN proof ELSE proof || s.l || s.r END
  FROM f LEFT JOIN s ON s.top = f.top AND s.tree = CASE WHEN f.top = 1 THEN '' ELSE f.tree END AND s.lvl = f.lvl AND s.i = f.i JOIN sub ON sub.tree = f.tree WHERE s.lvl IS NOT NULL OR f.top = 0)
SELECT doc_id, leaf, sub.d AS subroot, (SELECT d FROM t WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT d FROM t WHERE n = 1) AS verified
FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY top DESC, lvl DESC) = 1) x JOIN sub USING (tree)
"""

#: Every prefix of every conversation, and of every prefix all that it begins with.
_OP13_SQL = rf"""
WITH o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS k, md5(strlen(role) || ':' || role || text) AS m,
  len(regexp_extract_all(text, '[^ 	-]+')) AS w FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) x),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o) x),
b AS (SELECT c.conv_id, o.k, o.m, o.w FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h UNION ALL SELECT c.conv_id, o.k, o.m, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
q AS MATERIALIZED (SELECT conv_id, list(m ORDER BY k) AS m, list(w ORDER BY k) AS w FROM b GROUP BY conv_id UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM b)),
p AS (SELECT conv_id, d, len(m) = d AS whole, array_to_string(m[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(m[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(m) + 1)) AS d FROM q) x),
n AS MATERIALIZED (SELECT key, d, up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends FROM p GROUP BY key, d, up),
kids AS MATERIALIZED (SELECT up, count(*) AS n FROM n GROUP BY up),
t AS (SELECT a.key, count(*) FILTER (kids.n IS NULL) AS leaves, sum((x.n - 1) * x.w) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM n) x JOIN n a ON a.key = left(x.key, 32 * x.j) LEFT JOIN kids ON kids.up = x.key GROUP BY a.key)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN t USING (key) LEFT JOIN kids ON kids.up = n.key LEFT JOIN n u ON u.key = n.up
"""

QUERIES = {f.__name__: f for f in (op1_huffman_ids, op2_site_quality, op3_pattern_packing, op4_url_rules, op5_consistent_parsing, op6_repeated_strings, op7_latent_leaks, op8_jaccard_classes, op9_external_shuffle, op10_chat_format, op11_nested_manifest, op12_language_bits, op13_prefix_trie)}
ORACLE_SQL = {"op4_url_rules": _OP4_SQL, "op6_repeated_strings": _OP6_SQL, "op8_jaccard_classes": _OP8_SQL, "op10_chat_format": _OP10_SQL, "op11_nested_manifest": _OP11_SQL, "op13_prefix_trie": _OP13_SQL}
