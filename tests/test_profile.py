from datetime import datetime
from decimal import Decimal

import pytest

from gneiss import api
from gneiss.operators.profile import profile_table
from gneiss.options import ProfileOptions

from . import fixtures as fx

RICH = ProfileOptions(pattern_profile_enabled=True, case_variant_tracking_enabled=True, relationship_fingerprint_enabled=True)


@pytest.fixture(scope="module")
def customer(spark):
    return profile_table(spark.createDataFrame(list(fx.customers()), fx.CUSTOMER), RICH, primary_keys=("CUSTOMER_ID",), lobs=fx.LOBS).cache()


@pytest.fixture(scope="module")
def cols(customer):
    return {r["name"]: r for r in customer.collect()}


def test_keys_and_ranges(cols):
    c = cols["customer_id"]
    assert (c["row_count"], c["distinct_count"], c["uniqueness"], c["min_value"], c["max_value"]) == (200, 200, 1.0, "1", "200")
    assert c["candidate_primary_key"] and c["declared_primary_key"] and not c["low_cardinality"] and c["values"] == []
    assert (cols["age"]["min_value"], cols["age"]["max_value"], cols["age"]["distinct_count"], len(cols["age"]["values"])) == ("-1", "150", 62, 20)
    d = cols["create_date"]
    assert (d["min_value"], d["max_value"], d["distinct_count"], d["quasi_constant"], d["constant"]) == ("2026-09-15", "2099-12-31", 2, True, False)


def test_values_and_spellings(cols):
    s = cols["status"]
    assert [(v["value"], v["count"]) for v in s["values"]] == [("ACTIVE", 119), ("INACTIVE", 59), ("PENDING", 20), ("Active", 1), ("active", 1)]
    assert (s["distinct_count"], s["uniqueness"], s["trim_changed_count"], s["case_variant_group_count"]) == (5, 0.025, 1, 1)
    assert (s["min_length"], s["max_length"], s["avg_length"], s["min_value"]) == (6, 8, 6.7, None)
    assert s["potential_enum"] and s["low_cardinality"]
    assert [(v["value"], v["count"]) for v in cols["gender"]["values"]] == [("F", 67), ("M", 67), ("U", 66)]
    assert [(p["pattern"], p["count"]) for p in cols["phone"]["patterns"]] == [("D11", 199), ("D3-D4-D4", 1)]
    assert [(p["pattern"], p["count"]) for p in s["patterns"]] == [("L6", 121), ("L8", 59), ("L7", 20)]
    assert (cols["phone"]["min_length"], cols["phone"]["max_length"], cols["phone"]["avg_length"]) == (11, 13, 11.01)


def test_missing_values(cols):
    c = cols["optional_code"]
    assert (c["null_count"], c["blank_count"], c["semantic_null_count"], c["distinct_count"], c["uniqueness"]) == (1, 1, 1, 4, 4 / 197)
    assert c["null_rate"] == 1 / 200 and [(v["value"], v["count"]) for v in c["values"]] == [("C0", 50), ("C1", 49), ("C2", 49), ("C3", 49)]


def test_constant(cols):
    c = cols["source_system"]
    assert c["constant"] and c["quasi_constant"] and c["potential_enum"] and (c["distinct_count"], c["uniqueness"]) == (1, 0.005)


def test_large_objects(cols):
    n, p = cols["note"], cols["payload"]
    assert (n["min_length"], n["max_length"], n["avg_length"], n["distinct_count"]) == (101, 300, 200.5, 0)
    assert (p["min_length"], p["max_length"], p["avg_length"]) == (2049, 2248, 2148.5)
    assert n["lob_content_skipped"] and n["low_cardinality"] and not n["potential_enum"] and n["family"] == "LOB" and n["min_value"] is None


def test_clob_preview_patterns(spark):
    o = ProfileOptions(pattern_profile_enabled=True, clob_preview_chars=3)
    r = profile_table(spark.createDataFrame([("ab12",), (" x",), ("",), (None,)], "t string"), o, lobs={"t": "CLOB"}).first()
    assert sorted((p["pattern"], p["count"]) for p in r["patterns"]) == [("L2D1", 1), ("W1L1", 1)]
    assert (r["min_length"], r["max_length"], r["null_count"]) == (0, 4, 1)


def test_defaults_leave_optional_parts_empty(spark):
    r = profile_table(spark.createDataFrame([("A",), ("B",), ("A",)], "status string")).first()
    assert (r["distinct_count"], len(r["values"]), r["patterns"], r["case_variant_group_count"], r["fingerprint"]["min_hash_bins"]) == (2, 2, [], 0, [])


def test_empty_table(spark):
    r = profile_table(spark.createDataFrame([], "a string, b int"), RICH).collect()
    assert [x["row_count"] for x in r] == [0, 0] and r[0]["null_rate"] == 0.0 and r[0]["low_cardinality"] and not r[0]["candidate_primary_key"]


def test_types(spark):
    rows = [(0.1, float("nan"), Decimal("1.50"), datetime(2020, 1, 1), True, b"ab", [1]), (1e25, float("inf"), Decimal("-2.00"), datetime(2020, 1, 1, 0, 0, 0, 500000), False, b"cd", [2]), (-0.0, 3.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "f float, d double, n decimal(10,2), t timestamp_ntz, b boolean, x binary, a array<int>")
    r = {x["name"]: x for x in profile_table(df).collect()}
    assert {v["value"] for v in r["f"]["values"]} == {"0.1", "1.0E25", "0"} and r["f"]["min_value"] == "0"
    assert {v["value"] for v in r["d"]["values"]} == {"NaN", "Infinity", "3"} and (r["d"]["min_value"], r["d"]["max_value"]) == ("3", "3")
    assert ({v["value"] for v in r["n"]["values"]}, r["n"]["min_value"], r["n"]["max_value"]) == ({"1.5", "-2"}, "-2", "1.5")
    assert (r["t"]["min_value"], r["t"]["max_value"]) == ("2020-01-01 00:00:00.0", "2020-01-01 00:00:00.5")
    assert {v["value"] for v in r["b"]["values"]} == {"true", "false"} and r["b"]["min_value"] is None
    assert (r["x"]["distinct_count"], r["x"]["values"][0]["value"], r["x"]["min_length"]) == (1, "<binary:2>", 2)
    assert {v["value"] for v in r["a"]["values"]} == {"[1]", "[2]"} and r["a"]["family"] == "OTHER"


def test_trim_off(spark):
    df = spark.createDataFrame([(" a",), ("a",), ("",), (" ",), (" null ",)], "v string")
    on, off = profile_table(df).first(), profile_table(df, ProfileOptions(trim_strings=False)).first()
    assert (on["distinct_count"], on["blank_count"], on["semantic_null_count"], on["trim_changed_count"]) == (1, 2, 1, 3)
    assert (off["distinct_count"], off["blank_count"], off["semantic_null_count"], off["trim_changed_count"]) == (3, 1, 1, 0)


def test_limits(spark):
    df = spark.createDataFrame([(f"{'x' * (i % 7 + 1)}{i}", i) for i in range(150)], "v string, n int")
    r = profile_table(df, ProfileOptions(pattern_profile_enabled=True, pattern_limit=3, top_value_limit=5, case_variant_tracking_enabled=True)).first()
    assert not r["low_cardinality"] and r["values"] == [] and r["patterns"][0]["pattern"] == "OTHER" and sum(p["count"] for p in r["patterns"]) == 150 and r["case_variant_group_count"] == 0


def test_metrics_can_be_off(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "v string, n int")
    o = ProfileOptions(distinct_enabled=False, value_frequency_enabled=False, range_enabled=False, length_enabled=False)
    r = profile_table(df, o).collect()
    assert [(x["distinct_count"], x["uniqueness"], x["min_value"], x["min_length"], x["low_cardinality"]) for x in r] == [(0, 0.0, None, None, False)] * 2


@pytest.mark.parametrize("bad", [{"fetch_size": 0}, {"query_timeout_seconds": -1}, {"enum_print_threshold": 200}, {"distinct_enabled": False}, {"pattern_limit": 0}, {"relationship_fingerprint_enabled": True, "distinct_enabled": False, "value_frequency_enabled": False}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        ProfileOptions(**bad)


def test_relationships(spark, customer):
    orders = profile_table(spark.createDataFrame(list(fx.orders()), fx.ORDERS), RICH)
    found = {(r["left_ref"], r["right_ref"]): r for r in api.relationships(api.named(customer, "CUSTOMER", "TEST"), api.named(orders, "ORDERS", "TEST")).collect()}
    g = found["TEST.CUSTOMER.gender", "TEST.ORDERS.gender"]
    assert (g["kind"], g["similarity"], g["name_similarity"]) == ("SHARED_DICTIONARY", 1.0, 1.0)
    c = found["TEST.CUSTOMER.customer_id", "TEST.ORDERS.customer_id"]
    assert c["kind"] == "POTENTIAL_RELATION" and 0.45 <= c["similarity"] < 0.8
    assert ("TEST.CUSTOMER.age", "TEST.ORDERS.customer_id") not in found
    assert [r["kind"] for r in found.values()] == sorted((r["kind"] for r in found.values()), reverse=True)


def test_row_feed(spark):
    feed = api.RowFeed(spark, "a string, b int")
    feed.accept_row("x", 1)
    with pytest.raises(RuntimeError):
        feed.accept_cell("y")
    feed.begin_row()
    for wrong in (feed.begin_row, feed.end_row, feed.finish):
        with pytest.raises(RuntimeError):
            wrong()
    feed.accept_cell("y")
    feed.accept_cell(2)
    feed.end_row()
    assert feed.finish().filter("name = 'b'").first()["max_value"] == "2"
    with pytest.raises(RuntimeError):
        feed.accept_row("z", 3)


def test_find_column(customer):
    assert api.find_column(customer, "STATUS").first()["ordinal"] == 2 and api.find_column(customer, "nope").count() == 0


def test_decimals_of_any_width(spark):
    big = 123456789012345678901234567890
    df = spark.createDataFrame([(Decimal(5), Decimal("0.000000000000000001"), Decimal("1.50")), (Decimal(big), Decimal("-12345678901234567890.5"), Decimal("-2")), (Decimal(-big), None, None)], "a decimal(38,0), b decimal(38,18), c decimal(10,2)")
    r = {x["name"]: (x["min_value"], x["max_value"]) for x in profile_table(df).collect()}
    assert r == {"a": (str(-big), str(big)), "b": ("-12345678901234567890.5", "0.000000000000000001"), "c": ("-2", "1.5")}


def test_times_of_day(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.sql("SELECT CAST(v AS TIME(6)) AS t FROM VALUES ('12:00:00.5'), ('09:30:00'), ('12:00:00'), (NULL) AS x(v)")
    r = profile_table(df).first()
    assert (r["family"], r["database_type_name"], r["min_value"], r["max_value"], r["distinct_count"]) == ("DATE_TIME", "TIME", "09:30:00", "12:00:00.5", 3)
