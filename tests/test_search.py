import pytest
from pyspark.sql import functions as F

from corvane.operators import latest, search

FACTS = "namespace_id string, kind string, id string, label string, value string"


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    names = ["Alpha Beta", "ALPHABET", "béta", "al", "", "a_b%c", "alp hab", "zzz", "phabet alp", None, "ÀLPHA", "x\\y"]
    facts = spark.createDataFrame([(f"ns-{i % 2}", ["buyer", "service", "settlement"][i % 3], f"id-{i}-{n or 'none'}", n, "v") for i, n in enumerate(names * 3)], FACTS)
    path = str(tmp_path / "index")
    search.build(facts, path, 16)
    for needle in ("alpha", "ALP%BET", "a", "al_ha", "%", "béta", "bet", "id-1", "phabet", "àlp", "none", "\\\\y", "qqq", "hab%alp"):
        want = sorted(map(str, latest.search(facts, needle).collect()))
        assert sorted(map(str, search.find(spark, path, needle, buckets=16).collect())) == want, needle
    assert search.find(spark, path, "alpha", "ns-1", 16).where("namespace_id <> 'ns-1'").count() == 0
    with pytest.raises(ValueError):
        search.find(spark, path, "")


def test_fewer_files_are_read_for_a_needle(spark, tmp_path):
    facts = spark.range(400).select(F.lit("ns").alias("namespace_id"), F.lit("buyer").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(None).cast("string").alias("label"), F.lit("v").alias("value"))
    path = str(tmp_path / "index")
    search.build(facts, path, 64)
    one = facts.first().id
    files = lambda grams: {r.f for r in search.lists(spark, path, grams, 64).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    every = {r.f for r in spark.read.parquet(f"{path}/grams").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert len(files(search.needed(one[:5]))) * 5 < len(every)
    assert [r.id for r in search.find(spark, path, one, buckets=64).collect()] == [one]
    plan = search.lists(spark, path, ["abc"], 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert search.needed("a%b_cd") == [] and search.needed("abcd") == ["abc", "bcd"]
