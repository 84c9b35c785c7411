import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import canonical as cn
from gneiss.functions import names, texts
from gneiss.functions.types import family_of, type_text

HAN = re.compile("[㐀-䶿一-鿿豈-﫿々]")


def kind(ch):
    if unicodedata.category(ch) == "Nd":
        return "D"
    if HAN.match(ch):
        return "C"
    if unicodedata.category(ch).startswith("L"):
        return "L"
    return "W" if ch in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" else ch if ch in "-_/.:@#" else "S"


def expected(text):
    if not text:
        return "EMPTY"
    runs = re.findall(r"([DCLWS])(\1*)|([-_/.:@#])", "".join(map(kind, text)))
    return "".join(f"{a}{len(b) + 1}" if a else c for a, b, c in runs)


LETTERS = st.text(st.sampled_from("abZé中文09٣ \t\n-_/.:@#!?$😀,"), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LETTERS, min_size=30, max_size=60))
def test_pattern_shape_length_trim(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    shapes = cn.shapes(F.col("v"))
    got = df.select("v", cn.pattern(F.col("v")).alias("p"), cn.utf16_length(F.col("v")).alias("n"), cn.trim(F.col("v")).alias("t"), *[c.alias(k) for k, c in shapes.items()]).collect()
    for r in got:
        v = r["v"]
        assert r["p"] == expected(v)
        assert r["n"] == len(v.encode("utf-16-le")) // 2
        assert r["t"] == v.strip("".join(map(chr, range(33))))
        k = {"S" if x in "-_/.:@#" else x for x in map(kind, v)}
        assert (r["numeric_only"], r["alphabetic_only"], r["alphanumeric_only"], r["chinese_only"]) == (k == {"D"}, k == {"L"}, k == {"D", "L"}, k == {"C"})
        assert (r["contains_whitespace"], r["contains_special"], r["mixed"]) == ("W" in k, "S" in k, len(k) > 1)


@pytest.mark.parametrize(("x", "text"), [(12.0, "12"), (0.1, "0.1"), (-0.0, "0"), (1e10, "10000000000"), (1e25, "1.0E25"), (float("nan"), "NaN"), (1e-20, "1.0E-20"), (123.456, "123.456"), (100.0, "100")])
def test_double_text(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(cn.double_text(F.col("x"))).first()[0] == text


@pytest.mark.parametrize(("a", "b", "s"), [("customerId", "CUSTOMER_ID", 1.0), ("order", "sales_order", 0.6), ("order_no", "sales_order", 0.5), ("a_b", "b_c", 1 / 3), ("x", "y", 0.0), ("__", "abc", 0.6), ("id", "key", 0.0)])
def test_name_similarity(spark, a, b, s):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(names.name_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(s)


def test_types():
    assert [type_text(*x) for x in (("VARCHAR", 12, 100, 0), ("DECIMAL", 3, 18, 2), ("NUMBER", 2, 20, 0), ("INTEGER", 4, 10, 0), ("VARCHAR", 12, 0, 0), (None, 12, 5, 0))] == ["VARCHAR(100)", "DECIMAL(18,2)", "NUMBER(20,0)", "INTEGER", "VARCHAR", ""]
    assert [family_of(k) for k in (12, -5, 93, 16, -3, 2005, 2003)] == ["STRING", "NUMBER", "DATE_TIME", "BOOLEAN", "BINARY", "LOB", "OTHER"]


def test_report_texts(spark):
    df = spark.sql("SELECT array(named_struct('value', 'a', 'count', 3L, 'ratio', 0.75D), named_struct('value', 'b', 'count', 1L, 'ratio', 0.25D)) AS v, array(named_struct('value', repeat('x', 30001), 'count', 1L, 'ratio', 1D), named_struct('value', 'y', 'count', 1L, 'ratio', 1D)) AS w, 0L AS t")
    r = df.select(texts.value_summary(F.col("v")), texts.value_summary(F.col("w")), texts.time_text(F.col("t"))).first()
    assert r[0] == "a(3, 75.00%); b(1, 25.00%)" and r[1].endswith(" ...") and "y(" not in r[1] and r[2] == ""
