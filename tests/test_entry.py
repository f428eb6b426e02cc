import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.session import checkpointed, input_bytes, parts_for, spread, table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@needs_data
def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "score"}


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


@needs_data
def test_every_document_has_one_place_in_the_line_table(spark):
    offsets = entry.queries()["line_byte_offsets"](spark, DATA)
    ends = offsets.groupBy("id").agg(F.max("byte_end").alias("end"))
    sizes = table(spark, DATA, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size")).distinct()
    assert ends.join(sizes, "id").where("end <> size").count() == 0


def test_spread_and_checkpoint(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(small).count() == 10
    spark.range(10).repartition(64).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert spread(wide) is wide and input_bytes(small) > 0 and parts_for(small) == 4
    made = spark.range(3)
    assert spread(made) is made
    assert checkpointed(small).count() == 10
