from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gneiss.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def test_query_is_sorted_by_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["doc_id"]: r["passes"][0]["position"] if r["passes"] else 9.0 for r in mixing.mix_sources(docs).collect()}
    got = queries.op10_mixing(spark, SF).collect()
    at = [first[r["doc_id"]] for r in got]
    assert at == sorted(at) and len(set(at)) > 50 and len(at) == docs.count()


def test_turns_hold_every_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op10_turns"](spark, SF).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    words, turns = defaultdict(int), defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["words"]
        turns[r["doc_id"]].append((r["turn"], r["position"]))
    mixed = mixing.mix_sources(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in mixed if r["taken"]} == words
    assert {r["doc_id"]: [(k + 1, pytest.approx(p["position"])) for k, p in enumerate(r["passes"])] for r in mixed if r["taken"]} == turns


def test_schedules_change_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") < 100)
    order = [[r["doc_id"] for r in mixing.by_first_turn(mixing.mix_sources(docs, schedules=s)).collect()] for s in (mixing.SCHEDULES, mixing.SCHEDULES[::-1])]
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1])
