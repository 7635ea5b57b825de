"""The queries of this package: against SQL where there is any, and properties of the others."""

import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import queries, registry
from tests.sqlcheck import check, connect


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, data, name):
    check(registry.QUERIES[name](spark, data), connect(data), registry.SQL[name])


@pytest.mark.parametrize("name, columns", [("p1_found", ["conv_id", "turn", "defect"]), ("p4_found", ["entry_id_a", "entry_id_b"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id"])])
def test_columns_and_keys(spark, data, name, columns):
    found = registry.QUERIES[name](spark, data)
    assert found.columns == columns
    rows = [tuple(map(str, r)) for r in found.collect()]
    assert rows and len(rows) == len(set(rows))


def test_every_document_comes_back_from_its_ids(spark, data):
    found = registry.QUERIES["p6_round_trip"](spark, data)
    assert found.filter("not same_text").count() == 0
    assert found.count() == spark.read.parquet(f"{data}/documents.parquet").select("doc_id").distinct().count()


def test_mixes_keep_their_caps(spark, data):
    targets = spark.read.parquet(f"{data}/mix_targets.parquet").select("mix_name", "source", "max_repeats").distinct()
    mix = registry.QUERIES["p7_mix"](spark, data)
    assert mix.join(targets, ["mix_name", "source"]).filter("repeats > max_repeats or repeats < 1").count() == 0
    assert mix.join(targets, ["mix_name", "source"], "left_anti").count() == 0


def test_mixes_reach_what_is_allotted_to_within_one_document(spark, data):
    chosen, plan = queries._mix(spark, data)
    chosen = chosen.persist()
    longest = chosen.agg({"n_tokens": "max"}).first()[0]
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got"))
    rows = plan.join(got, ["mix_name", "source"], "left").select("allotted", F.coalesce("got", F.lit(0)).alias("got")).collect()
    assert rows and all(abs(r.allotted - r.got) <= longest for r in rows)
