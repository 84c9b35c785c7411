"""Texts of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest list of values in a cell; what follows becomes " ...".
MOST_CHARS = 30_000
# Names of observations in reports.
ENUM, KEY, CONSTANT, QUASI, LOB_ONLY = "潜在枚举", "候选唯一键", "常量字段", "准常量", "LOB仅统计长度"


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def length_summary(least: Column, most: Column, mean: Column) -> Column:
    return F.when(least.isNull(), "").otherwise(F.format_string("%d / %d / %.2f", least, most, mean))


def value_summary(values: Column) -> Column:
    """``v(count, pct); ...``; stops once it is longer than MOST_CHARS."""
    one = lambda v: F.concat(v["value"], F.lit("("), v["count"].cast("string"), F.lit(", "), percent(v["ratio"]), F.lit(")"))

    def add(acc: Column, v: Column) -> Column:
        more = F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("; "), one(v))
        return F.when(acc["full"], acc).when(F.length(acc["text"]) > MOST_CHARS, F.struct(F.concat(acc["text"], F.lit(" ...")).alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(more.alias("text"), acc["full"].alias("full")))

    return F.aggregate(values, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add, lambda acc: acc["text"])


def insight_summary(potential_enum: Column, candidate_key: Column, constant: Column, quasi: Column, lob: Column) -> Column:
    return F.concat_ws("；", F.when(potential_enum, ENUM), F.when(candidate_key, KEY), F.when(constant, CONSTANT), F.when(quasi & ~constant, QUASI), F.when(lob, LOB_ONLY))


def time_text(millis: Column) -> Column:
    return F.when(millis <= 0, "").otherwise(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss"))
