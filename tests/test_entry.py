import math

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SOME = ["findings_by_type", "email_places", "contained_spans_out", "best_disjoint_spans", "exact_scores", "char_scores", "united_intervals", "exact_split", "length_statistics", "longest_entities", "token_annotations", "plan_rows", "record_checks", "chat_round_trip", "detect_all", "check_digits", "first_of_equal_spans", "overlaps_out", "masked_or_searched", "policy_by_role", "json_records", "json_rejects", "annotated_files", "offset_annotations", "strict_tag_parts", "tagged_spans", "address_checks", "restored_stream", "findings_all_types", "phone_plans", "plan_mix", "guarded_and_restored"]


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def told(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("customer", "orders", "documents", "conversations", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = entry.queries()[name](spark, DIR).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted((tuple(told(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)
